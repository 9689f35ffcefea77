"""Queries of the catalogue and search operators over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, fold_py
from ..operators import relational as R
from ..operators import search as S
from ..sources import ingest
from ..sources.tsv import table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, tuple[Query, str]] = {}

#: All columns of a line: (l_orderkey, l_linenumber) repeats, so "first" needs them all.
LINE_ORDER = ["l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice"]
SEPARATORS = r"[\n\r\p{Z}\p{P}]+"
NOW = "2024-01-01 00:00:00"


def query(sql: str, name: str | None = None):
    def add(f: Query) -> Query:
        _queries[name or f.__name__] = (f, sql)
        return f

    return add


# Pages, look-ups and filters


@query("SELECT * FROM part ORDER BY p_partkey LIMIT 100")
def list_page_1(spark, d):
    return R.page(table(spark, d, "part"), ["p_partkey"])


@query("SELECT * FROM part ORDER BY p_partkey LIMIT 25 OFFSET 50")
def list_page_n(spark, d):
    return R.page(table(spark, d, "part"), ["p_partkey"], 3, 25)


@query("SELECT * FROM part ORDER BY p_partkey LIMIT 25 OFFSET 1000000000")
def list_page_past_end(spark, d):
    return R.page(table(spark, d, "part"), ["p_partkey"], 40_000_001, 25)


@query("SELECT count(*) AS total, 2::BIGINT AS page, 100::BIGINT AS \"limit\", ceil(count(*) / 100)::BIGINT AS pages FROM part")
def page_metadata(spark, d):
    return R.page_info(table(spark, d, "part"), 2, 100)


@query("SELECT * FROM orders WHERE o_custkey = 40 ORDER BY o_orderkey LIMIT 1")
def lookup_first(spark, d):
    return R.first_match(table(spark, d, "orders"), F.col("o_custkey") == 40, ["o_orderkey"])


@query("SELECT * FROM lineitem WHERE l_orderkey = 56")
def filter_eq(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_orderkey") == 56)


@query("SELECT doc_id, lang FROM documents WHERE length(text) > 0 AND length(lang) > 0")
def truthy_filter(spark, d):
    return table(spark, d, "documents").where(R.present("text", "lang")).select("doc_id", "lang")


# Nested children, groups and roll-ups


@query("SELECT o_orderkey, l_partkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def detail_flat(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def _keys(column: str, field: str):
    return F.array_join(F.array_sort(F.transform(column, lambda x: F.lpad(x[field].cast("string"), 10, "0"))), ",")


@query("""SELECT o_orderkey, count(l_orderkey)::BIGINT AS n_lines, coalesce(string_agg(lpad(l_partkey::VARCHAR, 10, '0'), ',' ORDER BY l_partkey), '') AS parts
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def detail_nested(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("_pos"), "l_partkey")
    rows = R.nest(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "lines")
    return rows.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), _keys("lines", "l_partkey").alias("parts"))


@query("""SELECT o_orderkey, count(l_orderkey)::BIGINT AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey = 56 GROUP BY o_orderkey""")
def detail_one(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("_pos"), "l_partkey")
    rows = R.nest(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "lines").where("o_orderkey = 56")
    return rows.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, string_agg(lpad(o_orderkey::VARCHAR, 10, '0'), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1),
e AS (SELECT user_id, count(*) AS n, string_agg(lpad(event_id::VARCHAR, 10, '0'), ',' ORDER BY event_id) AS keys FROM events GROUP BY 1)
SELECT c_custkey, coalesce(o.n, 0)::BIGINT AS n_orders, coalesce(o.keys, '') AS orders, coalesce(e.n, 0)::BIGINT AS n_events, coalesce(e.keys, '') AS events
FROM customer LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN e ON c_custkey = user_id""")
def detail_multi_child(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("_pos"), F.col("o_orderkey").alias("k"))
    events = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("_pos"), F.col("event_id").alias("k"))
    rows = R.nest(R.nest(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "orders"), events, "c_custkey", "events")
    return rows.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), _keys("orders", "k").alias("orders"), F.size("events").cast("long").alias("n_events"), _keys("events", "k").alias("events"))


@query("""WITH f AS (SELECT l_orderkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_shipdate, l_quantity, l_extendedprice) = 1),
g AS (SELECT l_suppkey, count(*) AS n, sum(l_partkey)::BIGINT AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey, f.l_suppkey, g.n::BIGINT AS n_members, g.s AS part_sum FROM orders LEFT JOIN f ON o_orderkey = f.l_orderkey LEFT JOIN g ON f.l_suppkey = g.l_suppkey""")
def group_two_hop(spark, d):
    lines = table(spark, d, "lineitem")
    first = R.first_group(lines, "l_orderkey", "l_suppkey", LINE_ORDER)
    members = lines.groupBy("l_suppkey").agg(F.count("*").alias("n_members"), F.sum("l_partkey").alias("part_sum"))
    found = first.join(members, "l_suppkey")
    return table(spark, d, "orders").select("o_orderkey").join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_suppkey", "n_members", "part_sum")


@query("""SELECT s_suppkey, s_name AS label, count(l_suppkey)::BIGINT AS n_items, coalesce(min(l_orderkey), -1)::BIGINT AS low FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) ON s_suppkey = l_suppkey GROUP BY ALL""")
def group_nested(spark, d):
    members = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    own = members.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_suppkey").alias("grp"), F.lit("").alias("label"), F.col("l_orderkey").alias("_pos"), "l_orderkey")
    rows = R.with_group(table(spark, d, "supplier").select("s_suppkey", "s_name"), own, "s_suppkey", "grp", "label", "g")
    return rows.select("s_suppkey", F.col("s_name").alias("label"), F.coalesce(F.size("g.items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.get("g.items", F.lit(0))["l_orderkey"], F.lit(-1)).cast("long").alias("low"))


@query("""SELECT l_partkey AS code, arg_min(p_name, (l_orderkey, l_linenumber)) AS denomination, count(*)::BIGINT AS medicaments_count
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE length(p_name) > 0 GROUP BY l_partkey""")
def substances_rollup(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).where(R.present("p_name"))
    return R.first_and_count(rows, "l_partkey", "p_name", ["l_orderkey", "l_linenumber"], "medicaments_count").select(F.col("l_partkey").alias("code"), F.col("p_name").alias("denomination"), "medicaments_count")


@query("""SELECT type, k, name FROM (SELECT 'part' AS type, 0 AS s, p_partkey AS k, p_name AS name FROM part UNION ALL SELECT 'customer', 1, c_custkey, c_name FROM customer UNION ALL SELECT 'supplier', 2, s_suppkey, s_name FROM supplier) ORDER BY s, k LIMIT 150 OFFSET 1950""")
def tagged_union_page(spark, d):
    parts = [(t, table(spark, d, t).select(F.col(f"{p}key").alias("k"), F.col(f"{t[0]}_name").alias("name"))) for t, p in (("part", "p_part"), ("customer", "c_cust"), ("supplier", "s_supp"))]
    return R.page(R.tagged_union(parts), ["_src", "k"], 14, 150).select("type", "k", "name")


# Text and indexes

_PO = """WITH l AS ({base}), tk AS (SELECT id, field, regexp_split_to_array(v, '[\\n\\r\\p{{Z}}\\p{{P}}]+') AS raw FROM l WHERE v IS NOT NULL),
fl AS (SELECT id, field, len(list_distinct(raw))::BIGINT AS flen FROM tk),
po AS (SELECT id, field, term, count(*)::BIGINT AS tf FROM (SELECT id, field, lower(strip_accents(unnest(raw))) AS term FROM tk) WHERE term <> '' GROUP BY 1, 2, 3)"""


def _base(table_name: str, key: str, fields: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {key} AS id, '{f}' AS field, {f}::VARCHAR AS v FROM {table_name}" for f in fields)


@query("SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def fold_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", fold(F.col("text")).alias("folded"))


@query(_PO.format(base=_base("documents", "doc_id", ["text"])) + " SELECT id, len(raw)::BIGINT AS n_raw, flen FROM tk JOIN fl USING (id, field)")
def tokenize_terms(spark, d):
    return S.field_tokens(table(spark, d, "documents"), "doc_id", ["text"]).select("id", F.size("raw").cast("long").alias("n_raw"), F.col("len").alias("flen"))


@query(_PO.format(base=_base("part", "p_partkey", ["p_name", "p_type"])) + " SELECT po.*, flen FROM po JOIN fl USING (id, field)")
def index_postings(spark, d):
    return S.build_index(table(spark, d, "part"), "p_partkey", ["p_name", "p_type"]).postings.withColumnRenamed("len", "flen").select("id", "field", "term", "tf", "flen")


@query(_PO.format(base=_base("documents", "doc_id", ["text"])) + " SELECT field, term, count(*)::BIGINT AS df FROM po GROUP BY 1, 2")
def index_vocab_df(spark, d):
    return S.build_index(table(spark, d, "documents"), "doc_id", ["text"]).vocabulary


@query(_PO.format(base=_base("part", "p_partkey", ["p_name", "p_type"])) + " SELECT field, round(avg(flen), 9) AS avg_len FROM fl GROUP BY 1")
def index_field_len(spark, d):
    return S.build_index(table(spark, d, "part"), "p_partkey", ["p_name", "p_type"]).stats.select("field", F.round("avg_len", 9).alias("avg_len"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def sha256_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))


# Search


#: DuckDB counts edits of bytes: the only letter of two bytes that folding leaves in the given texts counts as one.
_LEV = "levenshtein(translate(term, 'ß', chr(1)), translate(q, 'ß', chr(1)))"


def search_sql(table_name: str, key: str, fields: list[str], primary: str, asked: str, tag: str = "", order: str = "") -> str:
    """The specification of ranked search in SQL: ids, priorities and scores to 6 decimals."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    terms = ", ".join(f"({i}, {quoted(q)}, {m})" for i, (q, m) in enumerate(S.query_terms(asked)))
    folded = quoted(fold_py(asked))
    return (
        _PO.format(base=_base(table_name, key, fields))
        + f""",
qt(qi, q, md) AS (VALUES {terms}), st AS (SELECT field, avg(flen) AS avgl FROM fl GROUP BY 1), sz AS (SELECT count(*)::DOUBLE AS n FROM {table_name}),
df AS (SELECT field, term, count(*)::DOUBLE AS df FROM po GROUP BY 1, 2),
vo AS (SELECT field, term, df, qi, CASE WHEN term = q THEN 1.0::DOUBLE
  WHEN starts_with(term, q) THEN 0.375::DOUBLE * length(term) / (length(term) + 0.3::DOUBLE * (length(term) - length(q)))
  ELSE 0.45::DOUBLE * length(term) / (length(term) + {_LEV}) END AS w
  FROM df, qt WHERE starts_with(term, q) OR (md > 0 AND {_LEV} <= md)),
sc AS (SELECT po.id, qi, w * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (0.5::DOUBLE + tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * flen / avgl))) AS s
  FROM po JOIN vo USING (field, term) JOIN fl USING (id, field) JOIN st USING (field), sz)
SELECT {tag}id, CASE WHEN pf = {folded} THEN 2 WHEN starts_with(pf, {folded}) THEN 1 ELSE 0 END AS priority, round(score, 6) AS score
FROM (SELECT id, sum(s) * count(DISTINCT qi) AS score FROM sc GROUP BY 1) JOIN (SELECT {key} AS id, lower(strip_accents(coalesce({primary}, ''))) AS pf FROM {table_name}) USING (id){order}"""
    )


def _search(name: str, key: str, fields: list[str], primary: str, asked: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = S.ranked(table(spark, d, name), key, fields, primary, asked)
        return rows.select(F.col(key).alias("id"), F.col("_priority").alias("priority"), F.round("_score", 6).alias("score"))

    return run


for _name, _args in {
    "search_exact": ("part", "p_partkey", ["p_name", "p_type"], "p_name", "small"),
    "search_prefix": ("part", "p_partkey", ["p_name", "p_type"], "p_name", "wid"),
    "search_fuzzy": ("part", "p_partkey", ["p_name"], "p_name", "widgit"),
    "search_numeric": ("customer", "c_custkey", ["c_name", "c_mktsegment"], "c_name", "00000012"),
    "search_multi_term": ("documents", "doc_id", ["text"], "text", "mentenre thion"),
    "search_multi_field": ("customer", "c_custkey", ["c_custkey", "c_name", "c_mktsegment"], "c_name", "building 1"),
    "search_priority": ("part", "p_partkey", ["p_name", "p_type"], "p_name", "small ring"),
    "search_punctuation_only": ("part", "p_partkey", ["p_name"], "p_name", "small, ring!"),
}.items():
    query(search_sql(*_args), _name)(_search(*_args))


@query(search_sql("part", "p_partkey", ["p_name", "p_type"], "p_name", "small ring", "", " ORDER BY priority DESC, score DESC, id LIMIT 20 OFFSET 20"))
def search_page(spark, d):
    rows = _search("part", "p_partkey", ["p_name", "p_type"], "p_name", "small ring")(spark, d)
    return R.page(rows, [F.desc("priority"), F.desc("score"), "id"], 2, 20)


@query("SELECT p_partkey AS id FROM part WHERE false")
def search_no_terms(spark, d):
    return S.ranked(table(spark, d, "part"), "p_partkey", ["p_name"], "p_name", " .. ").select(F.col("p_partkey").alias("id"))


@query("SELECT p_partkey AS id FROM part")
def search_empty(spark, d):
    return S.ranked(table(spark, d, "part"), "p_partkey", ["p_name"], "p_name", "").select(F.col("p_partkey").alias("id"))


_GLOBAL = (("part", "p_partkey", ["p_name", "p_type"], "p_name"), ("customer", "c_custkey", ["c_name", "c_mktsegment"], "c_name"), ("supplier", "s_suppkey", ["s_name"], "s_name"))


@query("SELECT type, id, priority, score FROM (" + " UNION ALL ".join(f"(SELECT * FROM ({search_sql(*a, 'small 000000001', chr(39) + a[0] + chr(39) + f' AS type, {k} AS src, ')}))" for k, a in enumerate(_GLOBAL)) + ") ORDER BY src, priority DESC, score DESC, id LIMIT 50")
def search_global(spark, d):
    rows = R.tagged_union([(a[0], _search(*a, "small 000000001")(spark, d)) for a in _GLOBAL])
    return R.page(rows, ["_src", F.desc("priority"), F.desc("score"), "id"], 1, 50).select("type", "id", "priority", "score")


# Ingest


@query("""WITH o AS (SELECT doc_id::VARCHAR AS filename, sha256(CASE WHEN quality = 1 THEN text ELSE '' END) AS hash FROM documents JOIN labels USING (doc_id)),
n AS (SELECT doc_id::VARCHAR AS filename, sha256(text) AS hash FROM documents)
SELECT filename, n.hash, o.hash AS old_hash, CASE WHEN o.filename IS NULL THEN 'new' WHEN n.hash IS NOT DISTINCT FROM o.hash THEN 'same' ELSE 'changed' END AS status FROM n LEFT JOIN o USING (filename)""")
def change_detection(spark, d):
    docs = table(spark, d, "documents")
    digest = lambda c: F.sha2(c.cast("binary"), 256).alias("hash")
    # the manifest knows the labelled documents, those of low quality by the digest of an empty file
    seen = docs.join(table(spark, d, "labels"), "doc_id")
    old = seen.select(F.col("doc_id").cast("string").alias("filename"), digest(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.lit(""))))
    new = docs.select(F.col("doc_id").cast("string").alias("filename"), digest(F.col("text")))
    return ingest.changed(new, old)


@query(f"SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END <= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS, true) AS due FROM events")
def freshness_24h(spark, d):
    seen = F.when(F.col("event_id") % 7 == 0, F.lit("no date")).otherwise(F.col("ts").cast("string"))
    return table(spark, d, "events").select("event_id", ingest.is_due(seen, F.lit(None).cast("string"), F.to_timestamp(F.lit(NOW))).alias("due"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _queries.items()}
