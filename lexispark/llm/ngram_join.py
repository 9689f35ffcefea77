"""N-gram Jaccard self-join with signature trees.

A document is its set of distinct word shingles (64-bit hashes). Sets of size a and b with Jaccard t or more differ in
at most (a+b)(1-t)/(1+t) shingles, so if shingles are dealt into one part more than that by hash, some part is equal
in both: size classes and hashes of parts are exact candidate keys. Histograms of shingle hashes bound the overlap of
two sets that share a key, before they form a candidate group. Within a block of candidates, a tree over the sets holds OR-combined token bitmaps and size ranges; a dual
traversal prunes node pairs whose largest possible overlap is too small, or that are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, drop_rows, map_arrow, written
from .linkage import Union, candidate_groups, join_checked, verified_groups

FANOUT = 8
FAMILIES = pa.list_(pa.struct([("kind", pa.int32()), ("keys", pa.list_(pa.int64())), ("data", pa.binary())]))
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _C[3]
        h = (h ^ (h >> np.uint64(29))) * _C[0]
        return h ^ (h >> np.uint64(32))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; the whole sequence where there are fewer words. A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(n, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            total = _mix(total * _C[1] + h[k : len(words) - size + 1 + k])
    return np.unique(total)


class Keys:
    """Candidate keys of sets for Jaccard ``num / den`` or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, np.array([1])
        self._reach(1 << 16)

    def _reach(self, size: int) -> None:
        """Size classes up to one beyond a set's: a linked pair lies in one class or two neighbours."""
        low = self.low.tolist()
        while len(low) < 4 or low[-3] <= size:
            at = low[-1]
            low.append(max(at + 1, (at - 1) * self.den // self.num + 1))
        self.low = np.array(low)
        self.apart = [2 * (x - 1) * (self.den - self.num) // (self.den + self.num) for x in low[2:]]
        # somewhat more parts than differences, so that parts of several shingles must be equal, not just empty ones
        self.parts = [int(np.ceil((d + 1) * (1.1 if x > 6 * (d + 1) else 1.3))) for d, x in zip(self.apart, low, strict=False)]
        # cells of a family's histograms: about eight shingles to a cell
        self.cells = [1 << max(3, (x // 8).bit_length()) for x in low]

    def of(self, s: np.ndarray) -> list[tuple[int, np.ndarray, bytes]]:
        """For each family of a set's size: its number, keys, and signature (size, and shingles in each cell)."""
        if len(s) >= self.low[-3]:
            self._reach(len(s))
        own = int(np.searchsorted(self.low, len(s), side="right")) - 1
        out = []
        for family in (own - 1, own):
            if family < 0 or (apart := self.apart[family]) == 0:
                continue  # only equal sets would link
            parts = self.parts[family]
            spread = _mix(s ^ _C[2])
            part = (spread % np.uint64(parts)).astype(np.int64)
            again = _mix(spread)
            low = np.bincount(part, (again & np.uint64(0xFFFFFFFF)).astype(float), minlength=parts).astype(np.uint64)
            high = np.bincount(part, (again >> np.uint64(32)).astype(float), minlength=parts).astype(np.uint64)
            count = np.bincount(part, minlength=parts)
            # differences touch `apart` parts at most: if more parts than that have k shingles, one of these is equal
            least = next((k for k in (3, 2, 1) if (count >= k).sum() > apart), 0)
            with np.errstate(over="ignore"):
                base = np.arange(parts, dtype=np.uint64) * _C[1] + np.uint64(family + 1) * _C[2]
                keys = _mix(_mix(base ^ _mix(low)) + high)[count >= least]
            cells = np.bincount((again >> np.uint64(40)).astype(np.int64) & (self.cells[family] - 1), minlength=self.cells[family])
            out.append((family, keys.view(np.int64), np.concatenate([[len(s)], cells]).astype("<u4").tobytes()))
        return out


def may_overlap(num: int, den: int):
    """Signatures of one family: the overlap of two sets is at most the sum of their cells' smaller counts."""

    def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.ascontiguousarray(x).view("<u4") for x in (a, b))
        most = np.minimum(a[:, None, 1:], b[None, :, 1:]).sum(axis=2, dtype=np.int64)
        return np.nonzero((num + den) * most >= num * (a[:, :1].astype(np.int64) + b[:, 0].astype(np.int64)))

    return near


class SignatureTree:
    """Levels of nodes over sets in order of size: level 0 has the sets, each higher node covers FANOUT below it."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.order = num, den, sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.sets = [sets[i] for i in self.order]
        size = np.array([len(s) for s in self.sets])
        bits = max(256, 1 << int(4 * size.max() - 1).bit_length())
        maps = np.empty((len(sets), bits // 64), np.uint64)
        for k, s in enumerate(self.sets):
            row = np.zeros(bits, bool)
            row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
            maps[k] = np.packbits(row).view(np.uint64)
        extra = size - np.bitwise_count(maps).sum(axis=1)
        self.levels = [(maps, size, size, extra)]  # bitmap, smallest, largest, most tokens beyond the bits
        while len(self.levels[-1][0]) > 1:
            maps, least, most, extra = self.levels[-1]
            cuts = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts), np.maximum.reduceat(extra, cuts)))
        self.union = Union(len(sets))
        self.whole = [np.full(len(x[0]), k == 0) for k, x in enumerate(self.levels)]

    def possible(self, level: int, a: slice, b: slice) -> np.ndarray:
        """Which pairs of nodes of two runs can hold a link."""
        maps, least, most, extra = self.levels[level]
        shared = np.bitwise_count(maps[a, None] & maps[None, b]).sum(axis=2, dtype=np.int64)
        overlap = np.minimum(shared + np.minimum(extra[a, None], extra[None, b]), np.minimum(most[a, None], most[None, b]))
        enough = (self.num + self.den) * overlap >= self.num * (least[a, None] + least[None, b])
        return enough & (self.den * most[a, None] >= self.num * least[None, b]) & (self.den * most[None, b] >= self.num * least[a, None])

    def root(self, level: int, k: int) -> int:
        """The common root of all sets below a node, -1 if they differ."""
        first = self.union.find(k * FANOUT**level)
        if not self.whole[level][k]:
            last = min((k + 1) * FANOUT, len(self.levels[level - 1][0]))
            if any(self.root(level - 1, j) != first for j in range(k * FANOUT, last)):
                return -1
            self.whole[level][k] = True
        return first

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        both = int(np.count_nonzero(a.take(a.searchsorted(b), mode="clip") == b))
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def links(self) -> Iterator[tuple[int, int]]:
        """Linked pairs that connect all that is connected."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                if a != b and self.union.find(a) != self.union.find(b) and self.linked(a, b):
                    self.union.join(a, b)
                    yield self.order[a], self.order[b]
                continue
            if (r := self.root(level, a)) >= 0 and r == self.root(level, b):
                continue
            below = len(self.levels[level - 1][0])
            ra, rb = slice(a * FANOUT, min((a + 1) * FANOUT, below)), slice(b * FANOUT, min((b + 1) * FANOUT, below))
            may = self.possible(level - 1, ra, rb)
            pairs = [(ra.start + int(i), rb.start + int(j)) for i, j in zip(*np.nonzero(may), strict=True) if ra.start + i <= rb.start + j]
            # nodes with themselves come first: what is connected within needs no comparison across
            stack += [(level - 1, i, j) for i, j in sorted(pairs, key=lambda p: (p[0] == p[1], -p[0], -p[1])) if level > 1 or i != j]


def tree_links(num: int, den: int):
    def link(items: list[bytes]) -> Iterator[tuple[int, int]]:
        yield from SignatureTree([np.frombuffer(x, np.uint64) for x in items], num, den).links()

    return link


def _groups(df: DataFrame, n: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """``id, h`` (hash of the text), ``n`` (shingles), ``class, component_id, grp``, which names the component."""
    kind = dict(df.dtypes)[key]
    source = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).withColumn("h", F.xxhash64("t"))

    def make():
        keys = Keys(num, den)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingles(t, n) for t in batch.column(1).to_pylist()]
            own = [keys.of(s) if len(s) else [] for s in found]
            families = pa.array([[{"kind": f, "keys": k.tolist(), "data": d} for f, k, d in x] for x in own], FAMILIES)
            digest = pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in found], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in found], pa.int64()), digest, families], ["id", "h", "n", "class", "families"])

        return apply

    sets = written(map_arrow(source, make, f"id {kind}, h long, n long, class long, families array<struct<kind:int,keys:array<long>,data:binary>>"), "sets")
    rows = sets.where("n > 0").groupBy("class", "id").agg(F.count("*").alias("rows"))
    classes = written(rows.groupBy("class").agg(F.min("id").alias("low"), F.sum("rows").alias("members")), "classes")
    # one row stands for each class; only rows that repeat even the key have to be told apart
    heads = rows.join(classes, "class").where(F.col("id").eqNullSafe(F.col("low"))).select(F.col("class").alias("node"), "low", "rows")
    own = join_checked(sets.withColumn("node", F.col("class")), heads, ["node"]).where(F.col("id").eqNullSafe(F.col("low")))
    own = own.select("node", "rows", F.explode("families").alias("f")).select("node", "rows", "f.*")
    own = own.where("rows = 1").drop("rows").union(own.where("rows > 1").drop("rows").dropDuplicates(["node", "kind"]))
    candidates = candidate_groups(own.select("node", "kind", "keys"), own.select("node", "kind", "data"), may_overlap(num, den), num / den)

    # one text of each candidate class, fetched by its smallest key and checked by its digest
    ids = classes.join(candidates, F.col("class") == F.col("node")).select("low", "class", "component")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = source.join(ids, F.col("id").eqNullSafe(F.col("low")))

    def digest():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            node, group, t = (batch.column(k).to_pylist() for k in range(3))
            found = [shingles(x, n) for x in t]
            keep = [k for k, s in enumerate(found) if len(s) and xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) == node[k]]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for k in keep], y) for x, y in ((node, pa.int64()), (group, pa.int64()))] + [pa.array([found[k].tobytes() for k in keep], pa.binary())], ["node", "component", "data"])

        return apply

    data = map_arrow(texts.select("class", "component", "t"), digest, "node long, component long, data binary")
    groups = verified_groups(data, tree_links(num, den)).withColumnRenamed("component", "grp")
    lows = classes.join(groups, F.col("class") == F.col("node")).groupBy("grp").agg(F.min("low").alias("glow"))
    linked = groups.join(lows, "grp").select(F.col("node").alias("class"), "glow", "grp")
    # only classes of several rows or links need a look-up: all others are their own component
    several = classes.join(linked, "class", "left").where("members > 1 or glow is not null").select("class", F.coalesce("glow", "low").alias("component_id"), "grp")
    named = join_checked(sets.select("id", "h", "n", "class"), several, ["class"], "left")
    named = written(named.select("id", "h", "n", "class", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("grp", "class").alias("grp")), "groups")
    discard(sets, classes)
    return named


def similarity_groups(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``key, n_shingles long, class long, component_id``: one per input row.

    Two rows link if their shingle sets have Jaccard ``num / den`` or more; ``component_id`` is the smallest key
    reachable by links. Null, empty and word-less texts have no shingles, link with nothing (not even each other) and
    are their own component. Rows that repeat a key are rows of their own; a null key is skipped as a component's
    smallest unless it is the only one. Equal sets form one class by their hash (``class``) before any comparison, so
    copies are never paired. Columns of other names are not read; an empty table gives no rows.
    """
    found = _groups(df, n, num, den, key, text)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "class", "component_id")


def ngram_join(docs: DataFrame) -> DataFrame:
    """The digest of op4: 3-word shingles, Jaccard 0.9."""
    return similarity_groups(docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, all columns: that of the smallest key (null last), then text hash. Documents without
    words stay. Rows that repeat both key and text are one document and stay or go together; rows that share only the
    key are judged by their own texts. An empty table gives no rows."""
    rows = _groups(docs, n, num, den, key, text).where("n > 0").select("grp", F.struct(F.col("id").isNull().alias("none"), "id", "h").alias("own"))
    first = rows.groupBy("grp").agg(F.min("own").alias("first"), F.max("own").alias("last")).where("first <> last").select("grp", "first")
    gone = join_checked(rows, first, ["grp"]).where("own <> first").select(F.col("own.id").alias("k"), F.col("own.h").alias("h")).distinct()
    return drop_rows(docs, written(gone, "copies"), key, text)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, n, hash(g) AS g FROM (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""
