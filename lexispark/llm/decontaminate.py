"""Benchmark decontamination by greedy string tiling.

Test items are indexed by the hashes of their word windows of the least tile length. Documents are joined with the items
whose windows they share: by a look-up in each task where the items are few, by a shuffle of the shared windows where
they are not. For each such pair, running Karp-Rabin greedy string tiling marks, from the longest match down, all matches
of unmarked words in both, and the share of the item's words under tiles is compared with a threshold. Tiles may come in
any order, so reordered passages count.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, drop_rows, map_arrow, written

#: Words of the least tile, and least share of an item's words under tiles, in per cent.
TILE, COVERAGE = 5, 80
#: Bytes of item text that every task may hold; with more items, shared windows are joined by a shuffle.
HELD_BYTES = 16 << 20
SIGNS = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
TILES = pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))
FOUND = "n_words long, covered long, coverage double, tiles array<struct<doc_start:long,item_start:long,length:long>>"


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode().translate(SIGNS).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * BASE + h[k : len(h) - n + 1 + k]
    return total


class Running:
    """Karp-Rabin hashes of the windows of any length, from running hashes of all prefixes."""

    def __init__(self, h: np.ndarray):
        self.h, self.free = h, np.ones(len(h), bool)
        self.prefix = np.zeros(len(h) + 1, np.uint64)
        with np.errstate(over="ignore"):
            total = np.uint64(0)
            for k, x in enumerate(h):
                total = total * BASE + x
                self.prefix[k + 1] = total

    def unmarked(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of n words without a marked one."""
        marks = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marks[n:] == marks[: len(marks) - n])
        with np.errstate(over="ignore"):
            return at, self.prefix[at + n] - self.prefix[at] * np.power(BASE, np.uint64(n), dtype=np.uint64)


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(start in doc, start in item, length)``, longest first, ties by item then document.

    The length of the longest match of unmarked words is found by bisection, as every match holds shorter ones; all
    matches of that length are marked that do not overlap, and the next length is smaller."""
    near = np.flatnonzero(np.isin(windows(doc, least), windows(item, least)))
    if not len(near):
        return []
    # only stretches of the document that windows of the item cover can hold tiles
    covered = np.zeros(len(doc) + 1, np.int64)
    np.add.at(covered, near, 1)
    np.add.at(covered, near + least, -1)
    place = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
    breaks = np.flatnonzero(np.diff(place) > 1) + 1
    place = np.insert(place, breaks, -1)  # a marked word stands between stretches
    a, b = Running(item), Running(np.where(place >= 0, doc[place], np.uint64(0)))
    b.free[place < 0] = False
    out, longest = [], min(len(item), len(place))
    while longest >= least:
        low, high = least - 1, longest
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if np.isin(a.unmarked(n)[1], b.unmarked(n)[1]).any() else (low, n - 1)
        if low < least:
            break
        n, waiting = low, defaultdict(list)
        (ai, ah), (bj, bh) = a.unmarked(n), b.unmarked(n)
        for j, w in zip(bj[::-1].tolist(), bh[::-1].tolist(), strict=True):
            waiting[w].append(j)
        for i, w in zip(ai.tolist(), ah.tolist(), strict=True):
            if not a.free[i : i + n].all():
                continue
            held = waiting.get(w, [])
            while held:  # a place once covered stays so
                j = held.pop()
                if b.free[j : j + n].all() and np.array_equal(a.h[i : i + n], b.h[j : j + n]):
                    a.free[i : i + n] = b.free[j : j + n] = False
                    out.append((int(place[j]), i, n))
                    break
        longest = n - 1
    return out


def covering(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]] | None:
    """Tiles of an item in a document in order of the document, None where they cover too little of it."""
    n = min(TILE, len(item))
    under = np.zeros(len(item), bool)
    for at in np.flatnonzero(np.isin(windows(item, n), windows(doc, n))).tolist():
        under[at : at + n] = True
    if 100 * under.sum() < COVERAGE * len(item):
        return None  # tiles lie within shared windows
    found = sorted(tiles(item, doc, n))
    return found if 100 * sum(t[2] for t in found) >= COVERAGE * len(item) else None


def _columns(sizes: list[int], found: list[list[tuple[int, int, int]]]) -> list[pa.Array]:
    covered = [sum(t[2] for t in x) for x in found]
    named = [[dict(zip(("doc_start", "item_start", "length"), t, strict=True)) for t in x] for x in found]
    return [pa.array(sizes, pa.int64()), pa.array(covered, pa.int64()), pa.array([c / n for c, n in zip(covered, sizes, strict=True)], pa.float64()), pa.array(named, TILES)]


class ItemIndex:
    def __init__(self, texts: list[str]):
        self.items = [word_hashes(t) for t in texts]
        seeds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for k, h in enumerate(self.items):
            for w in windows(h, n := min(TILE, len(h))).tolist() if len(h) else ():
                seeds[n][w].add(k)
        self.seeds = {n: dict(x) for n, x in seeds.items()}
        self.known = {n: np.array(sorted(x), np.uint64) for n, x in self.seeds.items()}
        self.low = {}
        for n, known in self.known.items():  # most windows of a document end at this table
            self.low[n] = np.zeros(1 << 18, bool)
            self.low[n][(known >> np.uint64(46)).astype(np.int64)] = True

    def shared(self, h: np.ndarray) -> list[int]:
        """Items that share a window with a document."""
        out = set()
        for n, known in self.known.items():
            w = windows(h, n)
            w = w[self.low[n][(w >> np.uint64(46)).astype(np.int64)]]
            if len(w):
                at = known.take(known.searchsorted(w), mode="clip")
                for x in np.unique(w[at == w]).tolist():
                    out |= self.seeds[n][x]
        return sorted(out)


def _looked_up(source: DataFrame, items: DataFrame, schema: str) -> DataFrame:
    """Few items: every task holds them all."""
    held = items.toArrow()
    names, texts = held.column("i").combine_chunks(), held.column("u").to_pylist()

    def make():
        index = ItemIndex(texts)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, which, found = [], [], []
            for r, t in enumerate(batch.column(2).to_pylist()):
                h = word_hashes(t)
                for k in index.shared(h):
                    if (own := covering(index.items[k], h)) is not None:
                        rows.append(r)
                        which.append(k)
                        found.append(own)
            at = pa.array(rows, pa.int64())
            own = _columns([len(index.items[k]) for k in which], found)
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), names.take(pa.array(which, pa.int64())), *own], ["k", "h", "i", "n_words", "covered", "coverage", "tiles"])

        return apply

    return map_arrow(source, make, schema)


def _joined(source: DataFrame, items: DataFrame, schema: str) -> DataFrame:
    """Many items: windows are rows, and what documents and items share meets by a join; documents and items that share
    enough are then fetched. A window of n < TILE words is told apart by its length."""
    sizes = sorted(r[0] for r in map_arrow(items.select("u"), lambda: lambda batch: pa.RecordBatch.from_arrays([pa.array([min(TILE, len(word_hashes(t))) for t in batch.column(0).to_pylist()], pa.int64())], ["n"]), "n long").distinct().collect())
    kept = "n long, row long, w long"

    def seeds(lengths):
        def make():
            def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
                out = [], [], []
                for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    h = word_hashes(t)
                    for n in lengths(len(h)):
                        own = np.unique(windows(h, n)).view(np.int64).tolist()
                        for x, y in zip(out, ([n] * len(own), [row] * len(own), own), strict=True):
                            x += y
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["n", "row", "w"])

            return apply

        return make

    docs = written(source.withColumn("row", F.monotonically_increasing_id()), "documents")
    own = map_arrow(items.select("n", "u"), seeds(lambda n: [min(TILE, n)] if n else []), kept).withColumnRenamed("row", "item")
    found = map_arrow(docs.select("row", "t"), seeds(lambda n: [x for x in sizes if 0 < x <= n]), kept).join(own, ["n", "w"])
    pairs = found.select("row", "item").distinct()
    texts = docs.join(pairs, "row").join(items.select(F.col("n").alias("item"), "i", "u"), "item").select("k", "h", "i", "t", "u")

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, sizes, tiled = [], [], []
            for r, (t, u) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                item = word_hashes(u)
                if (own := covering(item, word_hashes(t))) is not None:
                    rows.append(r)
                    sizes.append(len(item))
                    tiled.append(own)
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), *_columns(sizes, tiled)], ["k", "h", "i", "n_words", "covered", "coverage", "tiles"])

        return apply

    return map_arrow(texts, make, schema)


def _leaks(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """Columns ``k`` (key), ``h`` (hash of the text), ``i`` (item) and those of ``FOUND``."""
    whole = F.col(f"`{text}`").cast("string")
    source = docs.select(F.col(f"`{key}`").alias("k"), F.xxhash64(whole).alias("h"), whole.alias("t")).where("t is not null")
    items = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{item_text}`").cast("string").alias("u")).where("u is not null")
    items = written(items.withColumn("n", F.monotonically_increasing_id()), "items")
    schema = f"k {source.schema['k'].dataType.simpleString()}, h long, i {items.schema['i'].dataType.simpleString()}, {FOUND}"
    few = items.agg(F.coalesce(F.sum(F.length("u") + 100), F.lit(0))).first()[0] <= HELD_BYTES
    if not few:
        return _joined(source, items, schema)
    found = _looked_up(source, items, schema)
    discard(items)
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item covered enough: ``key, item_id, n_words long`` (of the item), ``covered
    long, coverage double, tiles array<struct<doc_start long, item_start long, length long>>``.

    Keys and item ids are of any type. Null, empty and word-less texts, of documents or items, match nothing. Items of
    fewer words than a tile must stand as a whole. Repeated rows of either table give repeated rows; equal matches go to
    the first place in the item, then in the document. Columns of other names are not read; empty tables give no rows.
    """
    return _leaks(docs, benchmark, key, text, item, item_text).drop("h").withColumnsRenamed({"k": key, "i": "item_id"})


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The result of op2."""
    return find_leaks(docs, benchmark).withColumn("n_tiles", F.size("tiles").cast("long")).drop("tiles")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold no benchmark item, all columns. A row goes by its own key (null or not) and text: another row
    with the same key stays if its text holds none. Null and empty texts stay, repeated rows go or stay together; an
    empty benchmark drops nothing."""
    found = written(_leaks(docs, benchmark, key, text, "item_id", "text").select("k", "h").distinct(), "leaks")
    return drop_rows(docs, found, key, text)
