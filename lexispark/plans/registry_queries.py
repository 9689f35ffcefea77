"""Queries of scans, sinks, ingest and the catalogue's routes, over registry files made from the driver's tables.

Whole tables are written as registry files once per session and folder (with padded, short, surplus and blank lines) and
read back through the scans; each query's SQL reads the tables themselves.
"""

from __future__ import annotations

import re
import tempfile
import threading
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import search as S
from ..sources import ingest, tsv
from ..sources.registry import DATASETS
from ..sources.shared import load_snapshot, save_snapshot, shared_dir
from ..sources.tsv import table
from .catalog_queries import search_sql
from .engine import CHILDREN, GLOBAL, Engine, compact, rank_order

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, tuple[Query, str]] = {}
_folders: dict[tuple[str, str], tuple[str, set[str]]] = {}

#: Table, its key, and its fields as SQL that both engines read. ``mitm`` has no file.
FIELDS = {
    "specialites": ("customer", "c_custkey", ["c_custkey", "c_name", "c_mktsegment", "''", "concat('\"', cast(c_nationkey as varchar(9)))"]),
    "presentations": ("orders", "o_orderkey", ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"]),
    "compositions": ("events", "event_id", ["user_id", "event_type", "case when event_id % 11 = 0 then '' else event_type end", "case when event_id % 13 = 0 then '' else concat(event_type, ' ', cast(event_id % 3 as varchar(9))) end", "''"]),
    "avis_smr": ("supplier", "s_suppkey", ["s_suppkey", "concat('H', cast(s_suppkey as varchar(9)))", "'motif'", "'2020'", "s_nationkey", "s_name"]),
    "avis_asmr": ("nation", "n_nationkey", ["n_nationkey", "'H'", "'motif'", "'2021'", "n_regionkey", "n_name"]),
    "generiques": ("customer", "c_custkey", ["c_nationkey", "concat('GROUP ', cast(c_nationkey as varchar(9)))", "c_custkey", "'0'", "c_custkey"]),
    "conditions": ("customer", "c_custkey", ["c_custkey", "concat('liste ', c_mktsegment)"]),
    "ruptures": ("part", "p_partkey", ["p_partkey", "''", "p_brand", "p_type"]),
}
#: Every third line of the first file stops after three fields; every fifth of the others has all its columns and one more.
SHORT = "c_custkey % 3 = 0"


def view(name: str) -> str:
    """A dataset as SQL over the tables: ``pos`` and its columns, absent ones NULL."""
    if name == "substances":
        return f"""(SELECT min(pos) AS pos, code_substance AS code, arg_min(denomination_substance, pos) AS denomination, count(*)::BIGINT AS medicaments_count
          FROM {view('compositions')} WHERE code_substance <> '' AND denomination_substance <> '' GROUP BY code_substance)"""
    columns = DATASETS[name].columns
    if name == "mitm":
        return f"(SELECT 0::BIGINT AS pos, {', '.join(f'NULL::VARCHAR AS {c}' for c in columns)} WHERE false)"
    source, key, fields = FIELDS[name]
    found = []
    for k, c in enumerate(columns):
        value = f"({fields[k]})::VARCHAR" if k < len(fields) else f"CASE WHEN {key} % 5 = 0 THEN 'x' END"
        found.append(f"CASE WHEN {SHORT} THEN NULL ELSE {value} END AS {c}" if name == "specialites" and k > 2 else f"{value} AS {c}")
    return f"(SELECT row_number() OVER (ORDER BY {key}) AS pos, {', '.join(found)} FROM {source})"


def registry(spark: SparkSession, d: str, *names: str) -> str:
    """A folder of registry files made from the tables of ``d``, with the files of some datasets at least."""
    at = (spark.sparkContext.applicationId, d)
    folder, made = _folders.setdefault(at, (f"{shared_dir(spark)}/registry-{spark.sparkContext.applicationId}-{len(_folders)}", set()))
    for name in names:
        if name in made or name not in FIELDS:
            continue
        source, key, fields = FIELDS[name]
        width = len(DATASETS[name].columns)
        values = [F.expr(f"cast({x} as string)") for x in fields]
        values[1] = F.concat(F.lit("  "), values[1], F.lit(" "))  # padded
        whole = F.concat_ws("\t", *values)
        line = F.when(F.col(key) % 5 == 0, F.concat(whole, F.lit("\tx" * (width - len(fields)) + "\tsurplus"))).otherwise(whole)
        if name == "specialites":
            line = F.when(F.expr(SHORT), F.concat_ws("\t", *values[:3])).otherwise(line)
        line = F.concat(line, F.when(F.col(key) % 2 == 0, "\r").otherwise(""), F.when(F.col(key) % 7 == 0, "\n").otherwise(""))
        table(spark, d, source).orderBy(key).select(line).write.mode("overwrite").text(f"{folder}/{DATASETS[name].file}")
        made.add(name)
    return folder


_engines: dict[tuple[str, str], Engine] = {}


#: Enabled datasets, and those that details are made of.
EVERY = tuple(name for name, x in DATASETS.items() if x.enabled)
DETAILS = ("specialites", *CHILDREN, "generiques")


def engine(spark: SparkSession, d: str, *names: str) -> Engine:
    """One engine for all queries, which loads the datasets that a query names when the first query does."""
    at = (spark.sparkContext.applicationId, d)
    folder = registry(spark, d, *("compositions" if name == "substances" else name for name in names))
    if at not in _engines:
        _engines[at] = Engine(spark, folder, names=())
    return _engines[at].load(*names)


def query(sql: str, name: str | None = None):
    def add(f: Query) -> Query:
        _queries[name or f.__name__] = (f, sql)
        return f

    return add


def one(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Scans


def _scan(name: str, large: bool) -> Query:
    def run(spark, d):
        read = tsv.scan_large if large else tsv.scan
        rows = read(spark, f"{registry(spark, d, name)}/{DATASETS[name].file}", DATASETS[name])
        return rows.drop("_pos")

    return run


for _name in ("specialites", "presentations", "compositions", "conditions"):
    _sql = f"SELECT * EXCLUDE (pos) FROM {view(_name)}"
    query(_sql, f"scan_{_name}")(_scan(_name, False))
    query(_sql, f"scan_large_{_name}")(_scan(_name, True))


@query(f"SELECT pos, cis FROM {view('specialites')}")
def scan_positions(spark, d):
    """Lines count in file order over all files and splits, blank ones aside."""
    rows = tsv.scan(spark, f"{registry(spark, d, 'specialites')}/{DATASETS['specialites'].file}", DATASETS["specialites"])
    return rows.select((F.col("_pos") + 1).alias("pos"), "cis")


@query(f"SELECT * EXCLUDE (pos) FROM {view('mitm')}")
def scan_missing_file(spark, d):
    return engine(spark, d, "mitm").table("mitm").drop("_pos")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*)::BIGINT AS n FROM {view(n)}" for n in (*FIELDS, "mitm", "substances")))
def load_all(spark, d):
    e = engine(spark, d, *EVERY)
    out = None
    for name in EVERY:
        rows = e.table(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT 'no dataset infos' AS message")
def table_unknown(spark, d):
    try:
        return engine(spark, d).table("infos")
    except KeyError as e:
        return one(spark, message=e.args[0])


_EIGHT_BIT = "regexp_replace(coalesce(text, ''), '[^\\x{00}-\\x{7F}\\x{A0}-\\x{FF}]', '?', 'g')"


@query(f"SELECT doc_id, {_EIGHT_BIT} AS text, CASE WHEN regexp_matches({_EIGHT_BIT}, '[^\\x{{00}}-\\x{{7F}}]') THEN 'iso-8859-1' ELSE 'utf-8' END AS charset FROM documents")
def charset_latin(spark, d):
    raw = F.encode(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\u0000-\\u007F\\u00A0-\\u00FF]", "?"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", tsv.decode(raw).alias("text"), tsv.encoding_name(raw).alias("charset"))


@query("SELECT doc_id, coalesce(text, '') AS text, 'utf-16' AS charset FROM documents")
def charset_utf16(spark, d):
    raw = F.concat(F.unhex(F.lit("FEFF")), F.encode(F.coalesce("text", F.lit("")), "UTF-16BE"))  # with its byte-order mark
    return table(spark, d, "documents").select("doc_id", tsv.decode(raw).alias("text"), tsv.encoding_name(raw).alias("charset"))


@query("SELECT doc_id, text FROM documents")
def charset_utf8(spark, d):
    return table(spark, d, "documents").select("doc_id", tsv.decode(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).alias("text"))


@query(f"SELECT true AS known, {lit(DATASETS['specialites'].file)} AS source")
def metadata(spark, d):
    found = engine(spark, d, "specialites").metadata()
    return one(spark, known=bool(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z", found["last_updated"])), source=found["source"])


@query(" UNION ALL ".join(f"SELECT {lit(x.name)} AS name, {lit(x.file) if x.file else 'NULL'} AS file, {len(x.columns)}::BIGINT AS n_columns, {len(x.indexed)}::BIGINT AS n_indexed, {lit(x.primary)} AS ranked, {str(x.enabled).lower()} AS enabled" for x in DATASETS.values()))
def source_catalogue(spark, d):
    rows = [(x.name, x.file, len(x.columns), len(x.indexed), x.primary, x.enabled) for x in DATASETS.values()]
    return spark.createDataFrame(rows, "name string, file string, n_columns long, n_indexed long, ranked string, enabled boolean")


# Ingest over HTTP, manifest and snapshots

_SERVED = {x.file: f"{x.name}\tété".encode("utf-8" if k % 2 else "iso-8859-1") for k, x in enumerate(DATASETS.values()) if x.file and x.enabled and x.name != "mitm"}
_WANTED = [x.file for x in DATASETS.values() if x.file and x.enabled]


def _ingested() -> list[tuple]:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            raw = _SERVED.get(self.path.strip("/"))
            self.send_response(404 if raw is None else 200)
            self.end_headers()
            self.wfile.write(raw or b"")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with tempfile.TemporaryDirectory() as folder:
            ingest.log.disabled, now, out = True, datetime(2024, 1, 1, tzinfo=UTC), []
            for run, at in enumerate((now, now + timedelta(hours=1), now + timedelta(hours=25))):
                status = ingest.refresh(f"http://127.0.0.1:{server.server_port}", folder, at)
                known = ingest.load_manifest(Path(folder))
                out += [(run, name, x, known.get(name, {}).get("encoding"), (Path(folder) / name).read_text(encoding="utf-8") if name in known else None) for name, x in status.items()]
            return out
    finally:
        ingest.log.disabled = False
        server.shutdown()


@query(" UNION ALL ".join(f"SELECT {run}::BIGINT AS run, {lit(f)} AS file, " + (f"{lit(('written', 'fresh', 'same')[run])} AS status, {lit('utf-8' if b'\xc3' in _SERVED[f] else 'iso-8859-1')} AS charset, {lit(next(x.name for x in DATASETS.values() if x.file == f) + chr(9) + 'été')} AS text" if f in _SERVED else "'failed' AS status, NULL AS charset, NULL AS text") for run in range(3) for f in _WANTED))
def ingest_http(spark, d):
    """Three runs against a server that lacks one file: written, fresh an hour later, checked and same a day later."""
    return spark.createDataFrame(_ingested(), "run long, file string, status string, charset string, text string")


@query("SELECT c_custkey, c_name FROM customer")
def snapshot_swap(spark, d):
    folder = f"{shared_dir(spark)}/snapshot-{spark.sparkContext.applicationId}"
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    save_snapshot(rows.where("c_custkey < 10"), folder)
    save_snapshot(rows, folder)
    return load_snapshot(spark, folder)


# Routes


def _listed(name: str, page: int, limit: int) -> Query:
    return lambda spark, d: engine(spark, d, name).rows(name, "", page, limit)


for _name in (*FIELDS, "mitm", "substances"):
    _limit = 2 if _name == "substances" else 20
    query(f"SELECT * EXCLUDE (pos) FROM {view(_name)} ORDER BY pos LIMIT {_limit} OFFSET {_limit}", f"api_list_{_name}")(_listed(_name, 2, _limit))

_ASKED = {"specialites": "building", "presentations": "5-low", "compositions": "click", "avis_smr": "supplier", "avis_asmr": "nation_1", "generiques": "group 1", "conditions": "liste machinery", "ruptures": "economi", "substances": "view"}


def _found(name: str, q: str) -> Query:
    def run(spark, d):
        rows = engine(spark, d, name).search(name, q)
        return rows.select(DATASETS[name].columns[0], F.col("_priority").alias("priority"), F.round("_score", 6).alias("score"))

    return run


for _name, _q in _ASKED.items():
    _x = DATASETS[_name]
    query(f"SELECT v.{_x.columns[0]}, s.priority, s.score FROM ({search_sql(view(_name), 'pos', list(_x.indexed), _x.primary, _q)}) s JOIN {view(_name)} v ON v.pos = s.id", f"api_search_{_name}")(_found(_name, _q))

_GLOBAL = (("specialite", "specialites"), ("presentation", "presentations"), ("composition", "compositions"))


@query("SELECT type, cis, priority, score FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS type, {k} AS src, v.pos, v.cis, s.priority, s.score FROM ({search_sql(view(n), 'pos', list(DATASETS[n].indexed), DATASETS[n].primary, 'click 0012')}) s JOIN {view(n)} v ON v.pos = s.id" for k, (t, n) in enumerate(_GLOBAL)) + ") ORDER BY src, priority DESC, score DESC, pos LIMIT 50")
def api_search(spark, d):
    rows = R.page(engine(spark, d, *(name for _, name in GLOBAL)).found("click 0012"), ["_src", *rank_order()], 1, 50)
    return rows.select("type", "cis", F.col("_priority").alias("priority"), F.round("_score", 6).alias("score"))


@query("SELECT 'a query is needed' AS message")
def api_search_without_query(spark, d):
    try:
        engine(spark, d).search_all("")
    except ValueError as e:
        return one(spark, message=str(e))


@query("""SELECT '{"data":[' || string_agg(j, ',' ORDER BY p_partkey) || '],"pagination":{"total":' || any_value(n) || ',"page":2,"limit":3,"pages":' || any_value(ceil(n / 3)::BIGINT) || '}}' AS json
FROM (SELECT p_partkey, (SELECT count(*) FROM part) AS n, '{"cis":"' || p_partkey || '","cip13":"","code_statut":"' || p_brand || '","libelle_statut":"' || p_type || '"' || CASE WHEN p_partkey % 5 = 0 THEN ',"date_debut":"x","date_mise_a_jour":"x","date_remise_dispo":"x","lien_ansm":"x"' ELSE '' END || '}' AS j FROM part ORDER BY p_partkey LIMIT 3 OFFSET 3)""")
def api_list_json(spark, d):
    page = engine(spark, d, "ruptures").list("ruptures", "", 2, 3)
    return one(spark, json=re.sub(r',"metadata":\{[^}]*\}\}$', "}", page.json()))


_CHILD = {
    "presentations": ("orders", "o_orderkey", "o_custkey"),
    "compositions": ("events", "event_id", "user_id"),
    "avis_smr": ("supplier", "s_suppkey", "s_suppkey"),
    "avis_asmr": ("nation", "n_nationkey", "n_nationkey"),
    "conditions": ("customer", "c_custkey", "c_custkey"),
}


def _json_rows(name: str, where: str) -> str:
    pairs = ", ".join(f"'{c}': {c}" for c in DATASETS[name].columns)
    # absent columns go: no text of the tables holds such a pair
    return f"""coalesce((SELECT '[' || string_agg(regexp_replace(to_json({{{pairs}}})::VARCHAR, ',"[a-z_0-9]+":null', '', 'g'), ',' ORDER BY pos) || ']' FROM {view(name)} WHERE {where}), '[]')"""


def _detail_sql(cis: int) -> str:
    own = f"(SELECT regexp_replace(to_json({{{', '.join(f'{chr(39)}{c}{chr(39)}: {c}' for c in DATASETS['specialites'].columns)}}})::VARCHAR, ',\"[a-z_0-9]+\":null', '', 'g') FROM {view('specialites')} WHERE cis = '{cis}')"
    children = " || ".join(f"',\"{n}\":' || {_json_rows(n, f'cis = {chr(39)}{cis}{chr(39)}')}" for n in _CHILD)
    group = f"(SELECT id_groupe FROM {view('generiques')} WHERE cis = '{cis}')"
    label = f"(SELECT libelle_groupe FROM {view('generiques')} WHERE cis = '{cis}')"
    items = _json_rows("generiques", f"id_groupe = {group}")
    return f"SELECT rtrim({own}, '}}') || {children} || ',\"generiques\":{{\"id_groupe\":\"' || {group} || '\",\"libelle_groupe\":\"' || {label} || '\",\"items\":' || {items} || '}}}}' AS json"


@query(_detail_sql(11))
def api_detail_json(spark, d):
    found = engine(spark, d, *DETAILS).detail("11")
    found.pop("metadata")
    return one(spark, json=compact(found))


def _object(name: str, alias: str) -> str:
    """A row as JSON text without its absent columns."""
    fields = ", ".join(f"CASE WHEN {alias}.{c} IS NOT NULL THEN '\"{c}\":' || to_json({alias}.{c})::VARCHAR END" for c in DATASETS[name].columns)
    return f"concat_ws(',', {fields})"


_JSON_CHILDREN = ("presentations", "compositions", "avis_smr", "avis_asmr", "conditions")
_DETAILS_JSON = (
    "WITH "
    + ", ".join(f"{n} AS (SELECT x.cis, string_agg('{{' || {_object(n, 'x')} || '}}', ',' ORDER BY x.pos) AS j FROM {view(n)} x GROUP BY 1)" for n in _JSON_CHILDREN)
    + f""", gi AS (SELECT id_groupe, string_agg('{{' || {_object('generiques', 'x')} || '}}', ',' ORDER BY x.pos) AS items FROM {view('generiques')} x GROUP BY 1),
gf AS (SELECT cis, arg_min(id_groupe, pos) AS id_groupe, arg_min(libelle_groupe, pos) AS libelle_groupe FROM {view('generiques')} GROUP BY 1),
g AS (SELECT cis, '{{"id_groupe":' || to_json(id_groupe)::VARCHAR || ',"libelle_groupe":' || to_json(libelle_groupe)::VARCHAR || ',"items":[' || items || ']}}' AS j FROM gf JOIN gi USING (id_groupe))
SELECT s.cis, '{{' || concat_ws(',', {_object('specialites', 's')}"""
    + "".join(f", '\"{n}\":[' || coalesce({n}.j, '') || ']'" for n in _JSON_CHILDREN)
    + f", '\"generiques\":' || coalesce(g.j, 'null')) || '}}' AS json FROM {view('specialites')} s"
    + "".join(f" LEFT JOIN {n} ON {n}.cis = s.cis" for n in (*_JSON_CHILDREN, "g"))
)


@query(_DETAILS_JSON)
def details_json(spark, d):
    """JSON of every drug with all its children and its group."""
    return engine(spark, d, *DETAILS).details_json(metadata=False).select("cis", "json")


@query("SELECT c.c_custkey FROM customer c WHERE (SELECT count(DISTINCT event_type) FROM events) = (SELECT count(DISTINCT event_type) FROM events e WHERE e.user_id = c.c_custkey)")
def division_all_types(spark, d):
    """Customers with events of every type."""
    rows = R.divide(table(spark, d, "events"), "user_id", "event_type", table(spark, d, "events").select("event_type"))
    return table(spark, d, "customer").select("c_custkey").join(rows, F.col("c_custkey") == F.col("user_id"), "left_semi")


@query(f"""WITH found AS (SELECT DISTINCT v.id_groupe FROM ({search_sql(view('generiques'), 'pos', list(DATASETS['generiques'].indexed), DATASETS['generiques'].primary, 'group 12')}) s JOIN {view('generiques')} v ON v.pos = s.id)
SELECT s.cis, s.denomination, (SELECT count(*) FROM {view('presentations')} p WHERE p.cis = s.cis)::BIGINT AS n_presentations FROM {view('specialites')} s
WHERE s.cis IN (SELECT cis FROM {view('generiques')} WHERE id_groupe IN (SELECT id_groupe FROM found))""")
def api_group_details(spark, d):
    """A search of groups, then the details of each member."""
    return engine(spark, d, *DETAILS).group_details("group 12").select("cis", "denomination", F.size("presentations").cast("long").alias("n_presentations"))


@query("SELECT true AS missing")
def api_detail_unknown(spark, d):
    return one(spark, missing=engine(spark, d, *DETAILS).detail("00000000") is None)


@query(f"""SELECT '{{' || chr(10) || '  "status": "ok",' || chr(10) || '  "last_updated": "T",' || chr(10) || '  "source": "{DATASETS['specialites'].file}"' || chr(10) || '}}' AS json""")
def api_health(spark, d):
    return one(spark, json=re.sub(r'("last_updated": )"[^"]*"', r'\1"T"', engine(spark, d, "specialites").health(pretty=True)))


@query(f"SELECT g.libelle_groupe, s.cis, s.denomination FROM {view('generiques')} g JOIN {view('specialites')} s USING (cis) WHERE g.id_groupe = '7'")
def group_to_drugs(spark, d):
    e = engine(spark, d, "generiques", "specialites")
    members = e.table("generiques").where("id_groupe = '7'").select("libelle_groupe", "cis")
    return members.join(e.table("specialites").select("cis", "denomination"), "cis").select("libelle_groupe", "cis", "denomination")


@query(f"SELECT bool_or(condition = 'liste BUILDING') AS found, bool_or(condition = 'liste I') AS other FROM {view('conditions')}")
def exists_any(spark, d):
    rows = engine(spark, d, "conditions").table("conditions")
    return R.exists_any(rows, F.col("condition") == "liste BUILDING").join(F.broadcast(R.exists_any(rows, F.col("condition") == "liste I", "other")))


@query(f"SELECT DISTINCT condition FROM {view('conditions')}")
def distinct_conditions(spark, d):
    return engine(spark, d, "conditions").table("conditions").select("condition").distinct()


# Search: absent fields, boosts

_PARTIAL = "(SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS p_type FROM part)"


@query(search_sql(_PARTIAL, "p_partkey", ["p_name", "p_type"], "p_name", "economy"))
def search_absent_field(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("p_type"))
    found = S.ranked(rows, "p_partkey", ["p_name", "p_type"], "p_name", "economy")
    return found.select(F.col("p_partkey").alias("id"), F.col("_priority").alias("priority"), F.round("_score", 6).alias("score"))


@query(search_sql("part", "p_partkey", ["p_name", "p_type"], "p_name", "small ring").replace("SELECT po.id, qi, w *", "SELECT po.id, qi, (CASE field WHEN 'p_name' THEN 2.5::DOUBLE ELSE 1 END) * w *"))
def search_boosted(spark, d):
    found = S.ranked(table(spark, d, "part"), "p_partkey", ["p_name", "p_type"], "p_name", "small ring", S.Scoring(boosts=(("p_name", 2.5),)))
    return found.select(F.col("p_partkey").alias("id"), F.col("_priority").alias("priority"), F.round("_score", 6).alias("score"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _queries.items()}
