"""A text index kept on disk in segments, changed by adding to it and read in part.

A segment is written once: ``postings (bucket, term, field, id, tf, len)`` and ``keys (bucket, key, term)`` in a folder
per bucket of their term or key, sorted within, so that a search with literal terms opens a few folders and skips row
groups; ``terms (field, term, df, tf_max, len_min)``, changes of document frequencies, and limits for upper bounds; ``forward (bucket, id, field, len, terms)``, what a
row had, by id. A change writes one more segment with nothing but the new and changed rows and a list of ids whose older
postings are dead; frequencies and lengths are sums, so those of dead rows are taken off. When a tier holds
``MERGE_AT`` segments of like size, they are merged without reading any text. Versions are committed by number
(``sources.commits``): readers keep theirs, two writers lose nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, max_distance, tokens
from ..sources import commits
from . import matching
from .search import Scoring, query_terms

#: Folders of a segment's tables.
BUCKETS = 16

#: Matched terms that become literals of a scan's filter; more are joined.
LITERALS = 2_000

#: Segments of one tier, each of which holds up to TIER times the rows of the one below.
MERGE_AT, TIER = 4, 8


#: Rows and queries of a block of ``score_many``, and rows that are multiplied at once.
ROW_BLOCK, QUERY_BLOCK, PRODUCT_ROWS = 2048, 256, 64

#: Columns of a segment's tables; ``id`` has the type of the rows' ids.
SCHEMAS = {
    "postings": "id {id}, field string, len long, term string, tf long, bucket int",
    "forward": "id {id}, field string, len long, terms array<string>, bucket int",
    "keys": "key string, term string, bucket int",
    "terms": "field string, term string, df long, tf_max long, len_min long",
    "dead": "id {id}",
}


def bucket(value: str | F.Column):
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _summed(terms: DataFrame) -> DataFrame:
    """One row per field and term; limits of rows that are gone stay limits. A term may change its limits alone."""
    return terms.groupBy("field", "term").agg(F.sum("df").alias("df"), F.max("tf_max").alias("tf_max"), F.min("len_min").alias("len_min")).where("df <> 0 or tf_max is not null")


@dataclass(frozen=True)
class TextStore:
    """One version of a store. ``update`` returns the next one."""

    spark: SparkSession
    path: str
    version: int
    content: dict
    scoring: Scoring = Scoring()

    @staticmethod
    def open(spark: SparkSession, path: str, version: int | None = None, scoring: Scoring = Scoring()) -> "TextStore":
        return TextStore(spark, path, *commits.load(spark, f"{path}/versions", version), scoring)

    @staticmethod
    def create(rows: DataFrame, id_col: str, fields: list[str], path: str, scoring: Scoring = Scoring()) -> "TextStore":
        """A new store of all ``rows``, whose ids must differ."""
        kind = rows.schema[id_col].dataType.simpleString()
        empty = {"id": id_col, "kind": kind, "fields": fields, "segments": [], "n": 0, "sums": {f: [0, 0] for f in fields}, "share": scoring.fuzzy_share, "most": scoring.fuzzy_most}

        def fresh(before: dict | None) -> dict:
            if before is not None:
                raise FileExistsError(path)
            return empty

        number, content = commits.commit(rows.sparkSession, f"{path}/versions", fresh)
        return TextStore(rows.sparkSession, path, number, content, scoring).update(rows)

    # Tables

    def _read(self, segment: str, table: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table].format(id=self.content["kind"])).parquet(f"{self.path}/segments/{segment}/{table}")

    def _part(self, name: str, segment: dict) -> DataFrame:
        return self._read(segment["name"], name).withColumn("seq", F.lit(segment["seq"]))

    def _parts(self, name: str) -> DataFrame | None:
        found = [self._part(name, s) for s in self.content["segments"] if name in s["has"]]
        return _union(found) if found else None

    def _live(self, rows: DataFrame | None) -> DataFrame | None:
        """Without what a later segment has replaced or taken away."""
        dead = self._parts("dead")
        if rows is None or dead is None:
            return rows
        dead = dead.groupBy(F.col("id").alias("gone")).agg(F.max("seq").alias("until"))
        return rows.join(dead, (F.col("id") == F.col("gone")) & (F.col("seq") < F.col("until")), "left_anti")

    def postings(self) -> DataFrame:
        return self._live(self._parts("postings"))

    def forward(self) -> DataFrame | None:
        return self._live(self._parts("forward"))

    def vocabulary(self) -> DataFrame:
        """``field, term, df`` of live rows."""
        parts = self._parts("terms")
        return parts.groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")

    # Changes

    def _write(self, rows: DataFrame, name: str, table: str, order: str | None) -> None:
        if order:
            # a task per part of a bucket, without a sample of rows that cost their tokens a second time
            parts = BUCKETS * -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
            place = F.pmod(F.xxhash64(order), F.lit(parts)).cast("int")
            rows = rows.withColumn("bucket", bucket(order)).repartitionById(parts, place).sortWithinPartitions("bucket", order)
        writer = rows.write.partitionBy("bucket") if order else rows.write
        writer.parquet(f"{self.path}/segments/{name}/{table}")

    def update(self, changed: DataFrame | None = None, removed: DataFrame | None = None) -> "TextStore":
        """The store after rows of ``changed`` (new or changed, different ids) are added or replaced and the ids of
        ``removed`` are gone. Only ``changed`` is tokenised. Unknown ids of ``removed`` and null ids are left aside."""
        key, fields, name = self.content["id"], self.content["fields"], uuid.uuid4().hex
        has, n, sums = [], 0, {f: [0, 0] for f in fields}
        ids = [df.select(F.col(f"`{key}`").alias("id")) for df in (changed, removed) if df is not None]
        old, dead = self.forward(), None
        if old is not None and ids:
            # rows that are there and go; by id, so that the join reads what it needs
            _union(ids).where("id is not null").distinct().join(old.select("id").distinct(), "id", "left_semi").write.parquet(f"{self.path}/segments/{name}/dead")
            dead = self._read(name, "dead")
            has.append("dead")
        deltas = []
        if changed is not None:
            base = changed.where(F.col(f"`{key}`").isNotNull())
            pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("v")) for f in fields))
            # a row without any field keeps a line of its own, so that it counts and can go
            own = base.select(F.col(f"`{key}`").alias("id"), F.explode_outer(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("p"))
            own = own.select("id", "p.field", F.size(F.array_distinct(tokens(F.col("p.v")))).cast("long").alias("len"), F.filter(tokens(fold(F.col("p.v"))), lambda t: t != "").alias("terms"))
            self._write(own, name, "forward", "id")
            has.append("forward")
            own = self._read(name, "forward")
            # rows of an id meet before their terms part, so that terms are counted where they are
            places = own.select("id", "field", "len", "terms").repartition("id").select("id", "field", "len", F.explode("terms").alias("term"))
            self._write(places.groupBy("id", "field", "len", "term").agg(F.count("*").alias("tf")), name, "postings", "term")
            has.append("postings")
            deltas.append(self._read(name, "postings").groupBy("field", "term").agg(F.count("*").alias("df"), F.max("tf").alias("tf_max"), F.min("len").alias("len_min")))
            n += base.count()
            for r in own.where("field is not null").groupBy("field").agg(F.count("*").alias("c"), F.sum("len").alias("s")).collect():
                sums[r.field] = [sums[r.field][0] + r.c, sums[r.field][1] + r.s]
        if dead is not None:
            gone = old.join(dead, "id", "left_semi")
            deltas.append(gone.select("field", F.explode(F.array_distinct("terms")).alias("term")).groupBy("field", "term").agg((-F.count("*")).alias("df"), F.lit(None).cast("long").alias("tf_max"), F.lit(None).cast("long").alias("len_min")))
            for r in gone.where("field is not null").groupBy("field").agg(F.count("*").alias("c"), F.sum("len").alias("s")).collect():
                sums[r.field] = [sums[r.field][0] - r.c, sums[r.field][1] - r.s]
            n -= dead.count()
        if deltas:
            self._write(_summed(_union(deltas)), name, "terms", None)
            has.append("terms")
        if changed is not None:
            terms = self._read(name, "terms").where("tf_max is not null").select("term").distinct()
            known = self._parts("keys")
            if known is not None:  # keys of a term are the same in every segment: once is enough
                terms = terms.join(known.where(F.col("key").startswith("p:")).select("term").distinct(), "term", "left_anti")
            self._write(matching.keyed_terms(terms, self._matching()), name, "keys", "key")
            has.append("keys")
        start = self.version

        def add(before: dict) -> dict:
            if before is None or commits.versions(self.spark, f"{self.path}/versions")[-1] != start:
                raise RuntimeError(f"{self.path} was changed by another writer; open it anew and repeat the update")
            seq = 1 + max((s["seq"] for s in before["segments"]), default=0)
            total = {f: [before["sums"][f][0] + sums[f][0], before["sums"][f][1] + sums[f][1]] for f in fields}
            segment = {"name": name, "seq": seq, "has": has, "rows": max(0, n)}
            return before | {"segments": [*before["segments"], segment], "n": before["n"] + n, "sums": total}

        after = TextStore(self.spark, self.path, *commits.commit(self.spark, f"{self.path}/versions", add), self.scoring)
        return after.compact()

    def _matching(self) -> Scoring:
        return Scoring(fuzzy_share=self.content["share"], fuzzy_most=self.content["most"])

    def compact(self, at: int = MERGE_AT) -> "TextStore":
        """Merge segments while a tier holds ``at`` of them or more; live rows are copied, no text is read again."""
        tiers: dict[int, list[dict]] = {}
        for s in self.content["segments"]:
            tier, size = 0, TIER
            while s["rows"] >= size:
                tier, size = tier + 1, size * TIER
            tiers.setdefault(tier, []).append(s)
        full = next((t for _, t in sorted(tiers.items()) if len(t) >= at), None)
        if full is None:
            return self
        # a run of neighbours, so that what is dead by a later segment stays so
        first, last = min(s["seq"] for s in full), max(s["seq"] for s in full)
        run = [s for s in self.content["segments"] if first <= s["seq"] <= last]
        rest = [s for s in self.content["segments"] if s not in run]
        own, name = TextStore(self.spark, self.path, self.version, self.content | {"segments": run}, self.scoring), uuid.uuid4().hex
        has = []
        for table, order in (("postings", "term"), ("forward", "id"), ("keys", "key")):
            rows = own._parts(table)
            if rows is not None:
                live = rows if table == "keys" else own._live(rows)
                self._write(live.drop("seq", "bucket"), name, table, order)
                has.append(table)
        if (terms := own._parts("terms")) is not None:
            self._write(_summed(terms), name, "terms", None)
            has.append("terms")
        if rest and (dead := own._parts("dead")) is not None:  # of rows in segments before the run
            dead.select("id").distinct().write.parquet(f"{self.path}/segments/{name}/dead")
            has.append("dead")
        merged = {"name": name, "seq": last, "has": has, "rows": sum(s["rows"] for s in run)}
        start = self.version

        def swap(before: dict) -> dict:
            if commits.versions(self.spark, f"{self.path}/versions")[-1] != start:
                raise RuntimeError(f"{self.path} was changed by another writer; open it anew and compact it")
            return before | {"segments": sorted([*rest, merged], key=lambda s: s["seq"])}

        return TextStore(self.spark, self.path, *commits.commit(self.spark, f"{self.path}/versions", swap), self.scoring).compact(at)

    # Look-ups

    def _of(self, rows: DataFrame | None, column: str, values: list[str]) -> DataFrame | None:
        """Rows with one of the literal values: only the folders of their buckets are opened, and row groups skipped."""
        if rows is None:
            return None
        hashed = self.spark.createDataFrame([(v,) for v in values], "v string").select(bucket("v").alias("b")).distinct()
        wanted = [r.b for r in hashed.collect()]
        return rows.where(F.col("bucket").isin(wanted) & F.col(column).isin(values))

    def expanded(self, query: str) -> DataFrame:
        """``field, term, df, qi, w``: what the terms of one query match, read from the buckets of their keys alone."""
        asked = query_terms(query, self.scoring)
        rows = self.spark.createDataFrame([(i, q, m) for i, (q, m) in enumerate(asked)], "qi int, q string, most int")
        keys = [r.key for r in rows.select("q", "most").distinct().select(F.explode(matching.query_keys(F.col("q"), F.col("most"))).alias("key")).distinct().collect()]
        near = self._of(self._parts("keys"), "key", keys).select("term").distinct()
        found = near.crossJoin(F.broadcast(rows)).withColumn("w", matching.weight(self.scoring)).where("w is not null").select("qi", "term", "w")  # rows: the terms of one query
        return found.join(self.vocabulary(), "term").select("field", "term", "df", "qi", "w")

    def hits(self, query: str) -> DataFrame:
        """Postings of what a query matches, with ``df, qi, w``. Up to ``LITERALS`` terms are looked up as literals."""
        asked = self.expanded(query)
        some = asked.limit(LITERALS + 1).collect()
        if len(some) > LITERALS:
            return self.postings().drop("bucket", "seq").join(asked, ["field", "term"])
        if not some:
            return self.postings().drop("bucket", "seq").where(F.lit(False)).crossJoin(asked.select("df", "qi", "w").limit(0))
        known = self.spark.createDataFrame(some, "field string, term string, df long, qi int, w double")
        rows = self._live(self._of(self._parts("postings"), "term", sorted({r.term for r in some})))
        return rows.drop("bucket", "seq").join(F.broadcast(known), ["field", "term"])  # at most LITERALS rows

    def _scored(self, hits: DataFrame) -> DataFrame:
        """``part`` of a hit in the score."""
        s, n = self.scoring, float(self.content["n"])
        mean = F.lit(0.0)
        for f, (rows, total) in self.content["sums"].items():
            mean = F.when(F.col("field") == f, F.lit(total / rows if rows else 0.0)).otherwise(mean)
        idf = F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = F.lit(s.d) + F.col("tf") * (s.k + 1) / (F.col("tf") + s.k * (1 - s.b + s.b * F.col("len") / mean))
        boost = F.lit(1.0)
        for name, factor in s.boosts:
            boost = F.when(F.col("field") == name, F.lit(factor)).otherwise(boost)
        return hits.withColumn("part", F.col("w") * idf * part * boost)

    def score(self, query: str) -> DataFrame:
        """``id, score`` of one query."""
        return self._scored(self.hits(query)).groupBy("id").agg((F.sum("part") * F.countDistinct("qi")).alias("score"))

    def score_many(self, queries: DataFrame, text: str = "text") -> DataFrame:
        """``qid, id, score`` of a table of queries ``qid, text``: each as ``score`` gives it. Queries that are null or
        have no terms match nothing; a term that a query repeats counts as often; equal queries are answered each.

        Different terms are matched once for all queries, by joins on equal keys. Scores are then a product of three sparse
        matrices, rows by terms, terms by query terms, and these by queries, block by block: a task holds one block of rows
        and one of queries, with what of the three lies between. A term's postings in a block of rows, and its matches in a
        block of queries, travel as one row."""
        words = queries.select("qid", F.explode(tokens(fold(F.col(f"`{text}`").cast("string")))).alias("q")).where("q <> ''")
        row_blocks, query_blocks = (max(1, -(-n // size)) for n, size in ((self.content["n"], ROW_BLOCK), (queries.count(), QUERY_BLOCK)))
        asked = words.groupBy("qid", "q").agg(F.count("*").cast("double").alias("m")).withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).cast("int"))
        found = matching.matches(asked.select("q").distinct(), self._parts("keys").select("key", "term").distinct(), self.scoring)
        found = found.join(asked.select("q", F.col("qb").alias("own")).distinct(), "q").groupBy("term", "own").agg(F.collect_list(F.struct(F.xxhash64("q").alias("t"), "w")).alias("matched"))
        postings = self.postings().drop("bucket", "seq").join(self.vocabulary().select("field", "term", "df"), ["field", "term"])
        parts = self._scored(postings.withColumn("w", F.lit(1.0))).withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int"))
        left = parts.groupBy("term", "rb").agg(F.collect_list(F.struct("id", "part")).alias("posted")).join(found, "term")
        left = left.select("rb", "own", F.col("posted.id").alias("ids"), F.col("posted.part").alias("parts"), F.col("matched.t").alias("terms"), F.col("matched.w").alias("weights"))
        right = asked.select("qid", F.xxhash64("q").alias("t"), "m", "qb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("block"))
        kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {self.content['kind']}, score double"
        return left.groupBy("rb", "own").cogroup(right.groupBy("block", "qb")).applyInArrow(_product, kinds)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths and values of lists."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.diff(lists.offsets.to_numpy()), lists.flatten()


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(), coded.dictionary


def _product(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """``qid, id, score`` of a block of rows and one of queries: of each term, its postings (``ids, parts``) and matched
    query terms (``terms, weights``), and of each query (``qid``) its terms (``t``) and how often it has each (``m``)."""
    qid = asked.column("qid").combine_chunks()
    column, qids = _coded(qid.combine_chunks() if isinstance(qid, pa.ChunkedArray) else qid)
    terms, at = np.unique(asked.column("t").to_numpy(), return_inverse=True)
    times = np.zeros((len(terms), len(qids)))
    np.add.at(times, (at, column), asked.column("m").to_numpy())
    (n, ids), (_, parts), (matched, hashes), (_, weights) = (_lists(rows.column(c)) for c in ("ids", "parts", "terms", "weights"))
    line, ids = _coded(ids)
    order = np.argsort(line, kind="stable")
    own, parts, line = np.repeat(np.arange(len(n)), n)[order], parts.to_numpy()[order], line[order]
    place, weights, first = np.searchsorted(terms, hashes.to_numpy()), weights.to_numpy(), np.cumsum(matched) - matched
    ends, found = np.searchsorted(line, np.arange(0, len(ids) + PRODUCT_ROWS, PRODUCT_ROWS)), []
    for k in range(len(ends) - 1):
        run = slice(ends[k], ends[k + 1])
        each = matched[own[run]]
        pick = np.repeat(first[own[run]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        asks = np.zeros(len(terms), bool)
        asks[place[pick]] = True
        used = np.flatnonzero(asks)
        cell = np.repeat(line[run] - k * PRODUCT_ROWS, each) * len(used) + (np.cumsum(asks) - 1)[place[pick]]
        sums = np.bincount(cell, np.repeat(parts[run], each) * weights[pick], PRODUCT_ROWS * len(used)).reshape(PRODUCT_ROWS, -1)
        held = np.zeros(PRODUCT_ROWS * len(used))
        held[cell] = 1
        own_times = times[used]
        many = held.reshape(PRODUCT_ROWS, -1) @ own_times
        row, query = np.nonzero(many)
        score = (sums @ own_times)[row, query] * many[row, query]
        found.append(pa.Table.from_arrays([qids.take(pa.array(query)), ids.take(pa.array(row + k * PRODUCT_ROWS)), pa.array(score)], ["qid", "id", "score"]))
    empty = pa.Table.from_arrays([qids.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], ["qid", "id", "score"])
    return pa.concat_tables([empty, *found])
