"""Document fingerprints: bottom-k sketches of shingle hashes, by DataFrame functions alone.

A sketch is the ``k`` smallest different 64-bit hashes of a text's shingles of ``WORDS`` words, in rising order. Fewer than
``k`` values are the whole set. Sketches of parts merge into the sketch of their union (Broder, 1997; Cohen and Kaplan,
2007) and estimate resemblance, containment and the number of different shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranges, with_range

#: Hashes kept: the standard error of a resemblance is at most 0.5 / sqrt(K).
K = 128

#: Words of a shingle; a text of fewer words is one shingle.
WORDS = 5

#: Whitespace that ends a word.
GAP = "[\\x09-\\x0D\\x20]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lowest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """``array<long>`` of a text; null and empty texts, and texts of whitespace alone, have no shingles and an empty
    sketch. Letters count without case."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP, -1), "")

    def hashes(w: Column) -> Column:
        several = F.transform(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: F.xxhash64(F.slice(w, i, words)))
        return F.when(F.size(w) >= words, several).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return lowest(once(parts, hashes), k)


def merged(*sketches: Column, k: int = K) -> Column:
    """The sketch of the union of what the sketches stand for. Null ones count as empty."""
    return lowest(F.concat(*(F.coalesce(s, F.array().cast("array<bigint>")) for s in sketches)), k)


def merge_by(rows: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group: tasks keep the ``k`` smallest hashes of a group before anything is shuffled, so a group
    that holds most rows costs no more than ``k`` values from each task. Null keys are a group; groups without any hash
    have an empty sketch; an empty table gives no rows."""
    names = [f"g{i}" for i in range(len(by))]
    flat = rows.select(*(F.col(f"`{c}`").alias(a) for c, a in zip(by, names, strict=True)), F.explode_outer(F.col(f"`{sketch}`")).alias("h"))
    apart = flat.groupBy(*names, "h").agg(F.lit(1).alias("one"))
    place = F.row_number().over(Window.partitionBy(*names).orderBy(F.asc_nulls_last("h")))
    return apart.withColumn("place", place).where(F.col("place") <= k).groupBy(*names).agg(F.sort_array(F.collect_list("h")).alias("s")).toDF(*by, sketch)


def encoded(sketch: Column) -> Column:
    """A sketch as text: base64 of its values, eight bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def decoded(value: Column) -> Column:
    """The sketch of ``encoded``; null for null."""

    def values(digits: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), (F.length(digits) / 16).cast("int") - 1), lambda i: F.conv(F.substring(digits, i * 16 + 1, F.lit(16)), 16, -10).cast("long"))
        return F.when(F.length(digits) > 0, each).otherwise(F.array().cast("array<bigint>"))

    return F.when(value.isNotNull(), once(F.hex(F.unbase64(value)), values))


def count(sketch: Column, k: int = K) -> Column:
    """Different shingles: exact below ``k``, else estimated from how low the k-th hash of 2**64 lies."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(float(k - 1)) / F.greatest(share, F.lit(2.0**-64)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Shingles in both by shingles in either, estimated on the ``k`` lowest of either. Two empty sketches are alike."""
    both = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))).cast("double") / F.size(u)
    return once(merged(a, b, k=k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both(u)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of the shingles of ``a`` that ``b`` has too; 1 where ``a`` has none."""
    shared = resemblance(a, b, k) * count(merged(a, b, k=k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / count(a, k)))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", k: int = K) -> DataFrame:
    """``keep`` plus ``sketch array<long>`` and ``n_shingles double`` of each row; rows map one to one, columns of other
    names are not read, an empty table gives no rows."""
    rows = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), sketch(F.col(f"`{text}`").cast("string"), k).alias("s"))
    return rows.select("*", count(F.col("s"), k).alias("c")).toDF(*keep, "sketch", "n_shingles")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """``key, text, sketch, next_text, next_sketch``: each row beside the next one in falling order of ``key``, the first
    after the last. Null keys come last; rows that share a key follow each other by a hash of their texts.

    Rows are dealt once, by ranges of the key that end at rows of a bounded sample, so that no task takes them all. The
    row a range ends at is the next one of the first row of the range above it: it is fetched once more for that range.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cuts = ranges(rows, ["key", "h"])
    # ends of ranges, by the range that they are next in; the last row of all is next to the first one
    last = rows.agg(F.max(F.struct("key", "h")).alias("c"))
    ends = cuts.select(F.posexplode("cuts")).select((F.col("pos") + 1).alias("range"), F.col("col.key").alias("key"), F.col("col.h").alias("h")).union(last.where("c is not null").select(F.lit(0), "c.key", "c.h"))
    ends = F.broadcast(ends)  # as many rows as there are ranges
    found = rows.join(ends.withColumnsRenamed({"key": "k", "h": "g"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("g"))).groupBy("range").agg(F.first("key").alias("key"), F.first("text").alias("text"), F.first("h").alias("h"))
    own = with_range(rows, cuts, ["key", "h"]).withColumn("own", F.lit(True))
    guests = found.select("key", "text", "h", F.lit(-1.0).alias("salt"), "range", F.lit(False).alias("own"))
    dealt = own.select("key", "text", "h", "salt", "range", "own").unionByName(guests).repartition("range").withColumn("sketch", sketch(F.col("text"), k))
    before = Window.partitionBy("range").orderBy("own", F.asc_nulls_first("key"), "h", "salt")
    both = dealt.withColumns({"next_text": F.lag("text").over(before), "next_sketch": F.lag("sketch").over(before)})
    return both.where("own").select("key", "text", "sketch", "next_text", "next_sketch")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """The digest of op12. ``near_*`` are resemblances, ``contained_*`` shares of the document's own shingles; null texts
    count as empty, repeated rows each keep theirs, a single row is its own next one, an empty table gives no rows."""
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select(F.col("key").alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", encoded(own).alias("fingerprint"), encoded(edited).alias("edited_fingerprint"),
        resemblance(own, edited).alias("near_edited"), resemblance(own, following).alias("near_next"),
        count(own).alias("n_shingles"), containment(own, edited).alias("contained_edited"), containment(own, following).alias("contained_next"),
    )
