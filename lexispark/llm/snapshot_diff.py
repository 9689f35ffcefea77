"""Differences of two snapshots whose rows may have got new keys.

Keys go into compressed sets, one container for each value of their high bits (after Chambi, Lemire, Kaser and Godin,
2016): a list of the low 16 bits, a bitmap or runs, whatever is shortest. Intersection and differences of containers give
the keys that both snapshots have, or only one of them; rows are fetched by these keys. Rows left over pair by content,
by their rank in the order of keys.

Only digests of rows travel. A key that a snapshot has in several rows identifies none of them: such rows, and rows
without a key, pair by content alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType

from .common import ranges, small_batches, with_range, written

#: Bits of a key within its container.
LOW_BITS = 16

#: Keys that a task sorts at once before it makes containers of them.
CHUNK_KEYS = 1 << 20

#: Kinds of sets: keys of both snapshots, of the earlier and the later one alone, and repeated ones of either.
PAIRED, EARLIER, LATER, REPEATED = "paired", "earlier", "later", "repeated"


def packed(lows: np.ndarray) -> bytes:
    """A container of rising different low bits, as the shortest of list (A), bitmap (B) and runs (R)."""
    if not len(lows):
        return b""
    breaks = np.flatnonzero(np.diff(lows) != 1)
    starts, ends = lows[np.concatenate([[0], breaks + 1])], lows[np.concatenate([breaks, [len(lows) - 1]])]
    sizes = {b"A": 2 * len(lows), b"B": 1 << LOW_BITS - 3, b"R": 4 * len(starts)}
    kind = min(sizes, key=sizes.get)
    if kind == b"A":
        return kind + lows.astype("<u2").tobytes()
    if kind == b"R":
        return kind + np.stack([starts, ends], axis=1).astype("<u2").tobytes()
    bits = np.zeros(1 << LOW_BITS, dtype=np.uint8)
    bits[lows] = 1
    return kind + np.packbits(bits, bitorder="little").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    """The rising low bits of a container."""
    if not blob:
        return np.zeros(0, dtype=np.int64)
    kind, body = blob[:1], blob[1:]
    if kind == b"A":
        return np.frombuffer(body, "<u2").astype(np.int64)
    if kind == b"B":
        return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little"))
    runs = np.frombuffer(body, "<u2").astype(np.int64).reshape(-1, 2)
    sizes = runs[:, 1] - runs[:, 0] + 1
    return np.repeat(runs[:, 0] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of the keys of one task: ``high, side, own, again``; ``again`` are those seen more than once."""

    def made(side: int, held: list[np.ndarray]) -> Iterator[tuple]:
        keys, times = np.unique(np.concatenate(held), return_counts=True)
        high = keys >> LOW_BITS
        for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(high)) + 1):
            low = keys[part] - (high[part] << LOW_BITS)
            yield int(high[part[0]]), side, packed(low), packed(low[times[part] > 1])

    def sent(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        rows = [r for side in (0, 1) if held[side] for r in made(side, held[side])]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["high", "side", "own", "again"])

    held, n = [[], []], 0
    for batch in batches:
        keys, side = (np.asarray(batch.column(i)) for i in (0, 1))
        for s in (0, 1):
            if (side == s).any():
                held[s].append(keys[side == s])
        n += len(keys)
        if n >= CHUNK_KEYS:
            yield sent(held)
            held, n = [[], []], 0
    if n:
        yield sent(held)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From partial containers, sorted by high bits, to sets: ``high, kind, keys``. One container is held at a time."""
    high, seen = None, None

    def ended() -> pa.RecordBatch:
        (a, a_again), (b, b_again) = seen
        again = a_again | b_again
        kinds = {PAIRED: a & b & ~again, EARLIER: a & ~b & ~again, LATER: b & ~a & ~again, REPEATED: again}
        found = [(high, k, packed(np.flatnonzero(v))) for k, v in kinds.items() if v.any()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], ["high", "kind", "keys"])

    for batch in batches:
        for h, side, own, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if h != high:
                if seen is not None:
                    yield ended()
                high, seen = h, [[np.zeros(1 << LOW_BITS, dtype=bool) for _ in range(2)] for _ in range(2)]
            present, repeated = seen[side]
            low = unpacked(own)
            repeated[low[present[low]]] = True
            present[low] = True
            repeated[unpacked(again)] = True
    if seen is not None:
        yield ended()


def key_sets(earlier: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """``high long, kind string, keys binary``: containers of keys of both snapshots, of one alone, and repeated within
    one. Nothing but the key columns is read; null keys are in no set."""
    for df in (earlier, later):
        if not isinstance(df.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType)):
            raise TypeError(f"keys are whole numbers, {key} is {df.schema[key].dataType.simpleString()}")
    both = None
    for side, df in enumerate((earlier, later)):
        own = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.lit(side).alias("side")).where("k is not null")
        both = own if both is None else both.union(own)
    partial = both.mapInArrow(_partial, "high long, side int, own binary, again binary")
    return partial.repartition("high").sortWithinPartitions("high").mapInArrow(_merged, "high long, kind string, keys binary")


def keys_of(sets: DataFrame) -> DataFrame:
    """``k long, kind string``: a row for each key of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for high, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = (high << LOW_BITS) + unpacked(blob)
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([kind]).take(pa.array(np.zeros(len(keys), np.int64)))], ["k", "kind"])

    return sets.select("high", "kind", "keys").mapInArrow(run, "k long, kind string")


def _digest(df: DataFrame, name: str) -> Column:
    value = F.col(f"`{name}`")
    text = value if isinstance(df.schema[name].dataType, StringType) else F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.unhex(F.sha2(text.cast("binary"), 256)))


def _rows(df: DataFrame, key: str, columns: list[str], side: str, carry: dict[str, Column]) -> DataFrame:
    """``k, side``, a digest per column ``d<i>`` (null for null), ``content``, and what is carried."""
    own = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.lit(side).alias("side"), *(_digest(df, c).alias(f"d{i}") for i, c in enumerate(columns)), *(v.alias(f"y{i}") for i, v in enumerate(carry.values())))
    marks = [F.coalesce(F.hex(f"d{i}"), F.lit("~")) for i in range(len(columns))]
    return own.withColumn("content", F.unhex(F.sha2(F.concat_ws(",", F.lit(""), *marks), 256)))


def ranked(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with ``rank``, from 1 in rising order of ``k`` (nulls first) within ``group``. A group is cut by ranges of
    the keys, ranked in each and shifted by the numbers of its rows in the ranges before, so no task takes a whole one."""
    apart = with_range(rows, ranges(rows, ["k"]), ["k"])
    within = Window.partitionBy(*group, "range").orderBy(F.asc_nulls_first("k"), "salt")
    placed = apart.withColumn("place", F.row_number().over(within))
    sizes = apart.groupBy(*group, "range").agg(F.count("*").alias("n"))
    # the last range of most groups is their only one: a shift is needed where there are several
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("shift", F.sum("n").over(before)).where("shift > 0").drop("n")
    found = placed.join(shifts, [*group, "range"], "left")
    return found.withColumn("rank", F.col("place") + F.coalesce("shift", F.lit(0))).drop("place", "shift", "range", "salt")


def diff(earlier: DataFrame, later: DataFrame, key: str, columns: list[str], carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each pair and each unpaired row: ``key`` (the later row's, else the earlier one's), ``old_key`` (the earlier
    row's), ``op`` (same, update, rekey, insert, delete), ``changed array<string>`` (columns of a pair that differ; null
    equals null alone) and what is computed of the later row by ``carry``.

    Columns of other names are not read and may differ; a column that both have is compared by its SHA-256. Empty
    snapshots give inserts or deletes only. Rows with a repeated or null key pair with equal rows alone, as ``same``
    where keys are equal too, and are inserted and deleted where their content changes.
    """
    spark, carry = earlier.sparkSession, carry or {}
    small_batches(spark)
    keys = keys_of(key_sets(earlier, later, key).where(F.col("kind") != REPEATED))
    rows = _rows(earlier, key, columns, EARLIER, {n: F.lit(None) for n in carry}).unionByName(_rows(later, key, columns, LATER, carry))
    named = rows.where("k is not null").join(keys, "k", "left")
    rows = written(named.unionByName(rows.where("k is null").withColumn("kind", F.lit(None).cast("string"))), "snapshots")
    carried = [f"y{i}" for i in range(len(carry))]

    paired = rows.where(F.col("kind") == PAIRED)
    old = paired.where(F.col("side") == EARLIER).select("k", *(F.col(f"d{i}").alias(f"o{i}") for i in range(len(columns))))
    new = paired.where(F.col("side") == LATER).select("k", *(f"d{i}" for i in range(len(columns))), *carried)
    marks = F.array_compact(F.array(*(F.when(~F.col(f"d{i}").eqNullSafe(F.col(f"o{i}")), F.lit(c)) for i, c in enumerate(columns))))
    kept = old.join(new, "k").select("k", F.col("k").alias("old_key"), marks.alias("changed"), *carried)
    kept = kept.select("k", "old_key", F.when(F.size("changed") > 0, "update").otherwise("same").alias("op"), "changed", *carried)

    loose = ranked(rows.where(~F.col("kind").eqNullSafe(PAIRED)).select("k", "side", "content", *carried), ["content", "side"])
    gone = loose.where(F.col("side") == EARLIER).select("content", "rank", F.col("k").alias("old_key"), F.lit(True).alias("was"))
    come = loose.where(F.col("side") == LATER).select("content", "rank", "k", F.lit(True).alias("is"), *carried)
    met = gone.join(come, ["content", "rank"], "full")
    op = F.when(F.col("is").isNull(), "delete").when(F.col("was").isNull(), "insert").when(F.col("k").eqNullSafe(F.col("old_key")), "same").otherwise("rekey")
    moved = met.select(F.when(F.col("is"), F.col("k")).otherwise(F.col("old_key")).alias("k"), "old_key", op.alias("op"), F.array().cast("array<string>").alias("changed"), *carried)
    return kept.union(moved).toDF("key", "old_key", "op", "changed", *carry)


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The later snapshot of op13: what becomes of a row depends on the CRC-32 of its key."""
    turn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(-1))
    rows = docs.select("doc_id", "text", "lang", "source", turn.alias("turn")).where("turn <> 0")
    swap, other = F.col("turn") == 2, -1 - F.col("doc_id")
    keys = F.when(F.col("turn") == 5, F.array("doc_id", other)).when(F.col("turn").isin(3, 4), F.array(other)).otherwise(F.array("doc_id"))
    return rows.select(
        F.explode(keys).alias("doc_id"), F.when(F.col("turn") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(swap, F.col("source")).otherwise(F.col("lang")).alias("lang"), F.when(swap, F.col("lang")).when(F.col("turn") != 4, F.col("source")).alias("source"),
    )


def snapshot_diff(docs: DataFrame) -> DataFrame:
    """The digest of op13: ``docs`` against ``later_snapshot`` of it."""
    columns = ["text", "lang", "source"]
    whole = F.sha2(F.concat_ws("\n", *(F.coalesce(c, F.lit("~")) for c in columns)), 256)
    found = diff(docs.select("doc_id", *columns), later_snapshot(docs), "doc_id", columns, {"row_sha256": whole})
    return found.select("key", "old_key", "op", F.array_join("changed", ",").alias("changed"), "row_sha256")


#: DuckDB SQL of the digest; CRC-32 is computed bit by bit from its polynomial.
ORACLE = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, text, lang, source, coalesce(xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10, -1) AS turn FROM documents, tab),
n AS (SELECT unnest(CASE WHEN turn = 5 THEN [doc_id, -1 - doc_id] WHEN turn IN (3, 4) THEN [-1 - doc_id] ELSE [doc_id] END) AS k, CASE WHEN turn = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
  CASE WHEN turn = 2 THEN source ELSE lang END AS lang, CASE WHEN turn = 2 THEN lang WHEN turn <> 4 THEN source END AS source FROM d WHERE turn <> 0),
o AS (SELECT doc_id AS k, text, lang, source FROM documents),
kept AS (SELECT k AS key, k AS old_key, concat_ws(',', CASE WHEN n.text IS DISTINCT FROM o.text THEN 'text' END, CASE WHEN n.lang IS DISTINCT FROM o.lang THEN 'lang' END, CASE WHEN n.source IS DISTINCT FROM o.source THEN 'source' END) AS changed, n.text, n.lang, n.source FROM o JOIN n USING (k)),
lo AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY k) AS i FROM o WHERE k NOT IN (SELECT k FROM n)),
ln AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY k) AS i FROM n WHERE k NOT IN (SELECT k FROM o)),
moved AS (SELECT coalesce(ln.k, lo.k) AS key, lo.k AS old_key, CASE WHEN ln.k IS NULL THEN 'delete' WHEN lo.k IS NULL THEN 'insert' ELSE 'rekey' END AS op, ln.text, ln.lang, ln.source
  FROM lo FULL JOIN ln ON lo.i = ln.i AND lo.text IS NOT DISTINCT FROM ln.text AND lo.lang IS NOT DISTINCT FROM ln.lang AND lo.source IS NOT DISTINCT FROM ln.source)
SELECT key, old_key, op, changed, CASE WHEN op <> 'delete' THEN sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) END AS row_sha256
FROM (SELECT key, old_key, CASE WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, text, lang, source FROM kept UNION ALL SELECT key, old_key, op, '', text, lang, source FROM moved)"""
