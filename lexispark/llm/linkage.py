"""Exact linkage of similar items: pigeonhole keys -> candidate groups -> bounded blocks -> verified links -> groups.

Items that link share a key. Within a key, pairs whose signatures rule a link out are dropped, and only as many pairs
are kept as connect the rest; connected components of these are the candidate groups. An item's data is shuffled once,
to its group. A group of more than ``BLOCK_BYTES`` is cut into blocks, and every pair of blocks is
compared in a task of its own, so no task holds an unbounded group and no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, cut, discard, written

#: A block's data; an item counts for ITEM_BYTES at least, so that a block has 4096 items at most.
BLOCK_BYTES, ITEM_BYTES, BLOCK_ITEMS = 32 << 20, 8 << 10, 4096
#: Bytes of a side with data that may be broadcast; beyond them, joins shuffle.
BROADCAST_BYTES = 64 << 20


#: All pairs of a run of so many rows.
SHORT_PAIRS = [np.triu_indices(n, 1) for n in range(33)]
#: Rows whose runs are compared together, and pairs of them at once.
RUN_ROWS, PAIRS = 1 << 15, 1 << 16
#: Items of small groups that are verified together.
TOGETHER = 2048
#: Hot keys that are literals of a filter; more are joined.
HOT_LITERALS = 1000
#: Items, one of so many at most, from whose keys the hot ones are found.
SAMPLED = 64


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", data: str | None = None) -> DataFrame:
    """Broadcast ``small`` if counting its rows, and the bytes of its column ``data``, shows that it fits, else shuffle
    both sides (AQE splits skewed keys)."""
    rows, size = small.agg(F.count("*"), F.coalesce(F.sum(F.length(data)), F.lit(0)) if data else F.lit(0)).first()
    return big.join(F.broadcast(small) if rows <= (BROADCAST_ROWS // 10 if data else BROADCAST_ROWS) and size <= BROADCAST_BYTES else small, on, how)


class Union:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


class Labels:
    """Connected components of 0..n-1 under pairs that come in arrays: each item's label is the least of its component."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.of[i], self.of[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            up = np.arange(len(self.of))
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while (up[up] != up).any():
                up = up[up]
            self.of = up[self.of]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Nodes and data of each run of equal leading columns."""
    at, nodes, data = None, [], []
    for batch in batches:
        own = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys + 1)])
        starts = np.flatnonzero(np.concatenate([[True], (own[1:, :keys] != own[:-1, :keys]).any(axis=1)])) if len(own) else []
        values = batch.column(keys + 1).to_pylist()
        for first, end in zip(starts, [*starts[1:], len(own)], strict=True):
            if at is not None and (own[first, :keys] != at).any():
                yield np.concatenate(nodes), data
                nodes, data = [], []
            at = own[first, :keys]
            nodes.append(own[first:end, keys])
            data += values[first:end]
    if at is not None:
        yield np.concatenate(nodes), data


def _sizes(own: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(own[:, :4]).view("<u4")[:, 0].astype(np.int64)


def _close(keys: int, near: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], ratio: float):
    """Pairs of a run that connect all that may link: (a member, the first of those that it is connected with). A run is
    compared in order of size, each block only with sizes up to the ``ratio``-th part more."""

    def run(batches):
        a, b = [], []
        for nodes, data in _runs(batches, keys):
            own = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
            size, labels = _sizes(own), Labels(len(own))
            order = np.argsort(size, kind="stable")
            own, size, nodes = own[order], size[order], nodes[order]
            rows = max(1, min(256, (1 << 24) // max(own.size, 1)))
            for first in range(0, len(own), rows):
                end = int(np.searchsorted(size, size[min(first + rows, len(own)) - 1] / ratio + 1, side="right"))
                i, j = near(own[first : first + rows], own[first:end])
                labels.join(i + first, j + first)
            tied = np.flatnonzero(labels.of != np.arange(len(nodes)))
            a.extend(nodes[labels.of[tied]].tolist())
            b.extend(nodes[tied].tolist())
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a.clear()
                b.clear()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _stack(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows."""
    _, ends, values = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(values, np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leading columns with nodes, and signatures of one length, of ``RUN_ROWS`` rows or so: runs of equal leading columns
    stay whole."""
    held, rows, most = [], 0, RUN_ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((np.column_stack([batch.column(k).to_numpy() for k in range(keys + 1)]).astype(np.int64), _stack(batch.column(keys + 1))))
        rows += batch.num_rows
        if rows < most:
            continue
        own, data = (np.concatenate(x) for x in zip(*held, strict=True))
        other = np.flatnonzero((own[:, :keys] != own[-1, :keys]).any(axis=1))
        start = int(other[-1]) + 1 if len(other) else 0
        if start:
            yield own[:start], data[:start]
        held, rows = [(own[start:].copy(), data[start:].copy())], rows - start
        most = max(RUN_ROWS, 2 * rows)
    if rows:
        own, data = (np.concatenate(x) for x in zip(*held, strict=True))
        yield own, data


def _near_in_size(run: np.ndarray, size: np.ndarray, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows, in order of run and size, of one run and with sizes of a quotient of ``ratio`` or more, some at a time."""
    place = (run << np.int64(40)) + size
    end = np.searchsorted(place, (run << np.int64(40)) + (size / ratio + 1e-6).astype(np.int64), side="right")
    n = end - np.arange(1, len(end) + 1)
    total = np.concatenate([[0], np.cumsum(n)])
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(total, total[first] + PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(first, last), n[first:last])
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - (total[i] - total[first])
        first = last


def _close_stacked(keys: int, pairs: Callable[[np.ndarray, np.ndarray], np.ndarray], ratio: float):
    """As ``_close``, of signatures of one length: ``pairs`` tells row by row which pairs may link, so that many runs are
    compared at once. Pairs that are connected already are left out."""

    def run(batches):
        for own, data in _whole_runs(batches, keys):
            runs = np.cumsum(np.concatenate([[False], (own[1:, :keys] != own[:-1, :keys]).any(axis=1)]))
            order = np.lexsort((size := _sizes(data), runs))
            data, nodes, labels = data[order], own[order, keys], Labels(len(own))
            for i, j in _near_in_size(runs[order], size[order], ratio):
                apart = labels.of[i] != labels.of[j]
                i, j = i[apart], j[apart]
                may = pairs(data[i], data[j])
                labels.join(i[may], j[may])
            tied = np.flatnonzero(labels.of != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[labels.of[tied]]), pa.array(nodes[tied])], ["a", "b"])

    return run


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part in order of its first column: rows of values that several rows hold, with their number, and all rows of
    the part's first and last value (``edge``), which other parts may hold too."""
    part, held, began = TaskContext.get().partitionId(), [], False

    def counted(rows: pa.Table, last: bool) -> list[pa.RecordBatch]:
        nonlocal began
        key = rows.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n, edge = np.diff(np.append(starts, len(key))), np.zeros(len(starts), bool)
        edge[0] |= not began
        edge[-1] |= last
        began, n, edge = True, np.repeat(n, n), np.repeat(edge, n)
        for name, values in (("n", n), ("part", np.full(len(key), part, np.int32)), ("edge", edge)):
            rows = rows.append_column(name, pa.array(values))
        return rows.filter(pa.array(edge | (n > 1))).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and at == key[0] == key[-1]:
            held.append(batch)
            continue
        rows, at = pa.Table.from_batches([*held, batch]), key[-1]
        start = rows.num_rows - batch.num_rows + int(np.searchsorted(key, at))  # the last value's run stays open
        if start:
            yield from counted(rows.slice(0, start), False)
        held = rows.slice(start).to_batches()
    if held:
        yield from counted(pa.Table.from_batches(held), True)


def shared_keys(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``pairs`` (``key long, node long, kind int``, no nulls) whose key has several rows, with their number
    ``n``; and the table of ``written`` behind them.

    Rows are dealt once, by ranges of key and node, so that a key of any share of the rows spreads over many tasks.
    Only a part's first and last key can go on in another part: these, two a part at most, are summed and broadcast."""
    dealt = pairs.select("key", "node", "kind").repartitionByRange("key", "node").sortWithinPartitions("key")
    counted = written(dealt.mapInArrow(_count_runs, "key long, node long, kind int, n long, part int, edge boolean"), "keys")
    edges = counted.where("edge").groupBy("key", "part").agg(F.max("n").alias("n")).groupBy("key").agg(F.sum("n").alias("total"))
    found = counted.join(F.broadcast(edges), "key", "left").withColumn("n", F.coalesce("total", "n"))
    return found.where("n > 1").select("key", "node", "kind", "n"), counted


def _by_key(rows: DataFrame, large: DataFrame | None, own: Callable, pair: Callable) -> DataFrame:
    """Edges of ``rows`` (``key, node, data``), key by key, and of ``large`` (with ``blocks``), block pair by block pair."""
    edges = rows.select("key", "node", "data").repartition("key").sortWithinPartitions("key").mapInArrow(own, "a long, b long")
    if large is None:
        return edges
    large = large.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "data").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return edges.union(large.mapInArrow(pair, "a long, b long"))


def candidate_groups(keyed: DataFrame, signatures: DataFrame, near: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], ratio: float) -> DataFrame:
    """``keyed``: rows ``node long, kind int, keys array<long>``; ``signatures``: ``node, kind, data binary``, of equal
    length for equal kinds (one row each). Rows ``node, component`` of the items connected by pairs that share a key
    and may link by ``near``, which gives the indices of the pairs of two stacks of signatures that are not ruled out.
    A signature begins with the item's size in four bytes, and linked items' sizes have a quotient of ``ratio`` or more.

    Keys of one item end at a count; only the others meet their signatures. Keys of more than ``BLOCK_ITEMS`` items are
    compared block pair by block pair."""
    shared, keys = shared_keys(keyed.select(F.explode("keys").alias("key"), "node", "kind"))
    shared = shared.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ITEMS).cast("int")).drop("n")
    nodes = shared.select("node", "kind").distinct()
    signed = written(join_checked(signatures, nodes, ["node", "kind"]), "signatures")
    shared = join_checked(shared, signed, ["node", "kind"], data="data")
    groups = components(_by_key(shared.where("blocks = 1"), shared.where("blocks > 1"), _close(1, near, ratio), _close(3, near, ratio)))
    discard(keys, signed)
    return groups


def _marks(hot: DataFrame) -> Callable[[DataFrame], DataFrame] | None:
    """What adds ``blocks`` of the hot keys (``key, blocks``) to rows, null for other keys; None without hot keys. A few keys
    are literals: rows of other keys, which are most, go through no join."""
    n = hot.count()
    if n > HOT_LITERALS:
        sent = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
        return lambda rows: rows.join(sent, "key", "left")
    known: dict[int, list[int]] = {}
    for r in hot.collect():
        known.setdefault(r.blocks, []).append(r.key)
    if not known:
        return None
    found = F.coalesce(*(F.when(F.col("key").isin(keys), F.lit(b)) for b, keys in sorted(known.items())))
    return lambda rows: rows.withColumn("blocks", found)


def candidates_by_rounds(keyed: DataFrame, pairs: Callable[[np.ndarray, np.ndarray], np.ndarray], ratio: float, times: int, rounds: int) -> DataFrame:
    """As ``candidate_groups``, for rows ``node long, size int, keys array<long>, data binary`` that mostly share their
    keys, with signatures of one length, of which ``pairs`` tells row by row whether they may link. In each of ``rounds`` a
    part of the keys goes, with its signatures, through a shuffle that is deleted before the next: only that part is on
    disk at once. Every key goes through one round.

    Keys of more than ``BLOCK_ITEMS`` items, by those of a part of the items, are cut by size into classes of a ``ratio``
    each, as items of a link lie in one class or two neighbours; each item goes to its own class and the next. Of more than
    ``times`` as many, classes are compared block pair by block pair. A key that is taken for smaller or larger than it is
    takes more or fewer rows together and loses none."""
    share = max(1, min(SAMPLED, BLOCK_ITEMS // SAMPLED))
    counted = keyed.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).select(F.explode("keys").alias("key")).groupBy("key").agg((F.count("*") * share).alias("n"))
    hot = written(counted.where(F.col("n") > BLOCK_ITEMS).select("key", F.ceil(F.col("n") / (times * BLOCK_ITEMS)).cast("int").alias("blocks")), "hot")
    blocks, edges = _marks(hot), []
    step = F.floor(F.log("size") / (-math.log(ratio) * 1.001)).cast("int")
    for k in range(rounds):
        rows = keyed.select(F.explode("keys").alias("key"), "size", "node", "data").where(F.pmod("key", F.lit(rounds)) == k)
        small, large = rows, None
        if blocks is not None:
            marked = blocks(rows)
            small, large = marked.where("blocks is null"), marked.where("blocks is not null").withColumn("step", F.explode(F.array(step, step + 1)))
            large = large.withColumn("key", F.xxhash64("key", "step"))
        edges.append(written(_by_key(small, large, _close_stacked(1, pairs, ratio), _close_stacked(3, pairs, ratio)), "edges"))
    groups = components(reduce(DataFrame.union, edges))
    discard(hot, *edges)
    return groups


def verified_groups(data: DataFrame, link: Callable[..., Iterator[tuple[int, int]]], few: int = 0) -> DataFrame:
    """``data``: rows ``node long, component long, data binary``, one per item. ``link`` yields index pairs that are
    linked and suffice to connect what is connected. Groups of up to ``few`` items come to it several at a time, one after
    another, with their numbers of items. Returns ``node, component`` of all linked items."""
    data = written(data, "blocks")
    weight = F.greatest(F.length("data"), F.lit(ITEM_BYTES)).cast("long")
    sizes = data.groupBy("component").agg(F.ceil(F.sum(weight) / BLOCK_BYTES).cast("int").alias("blocks"))
    large = written(sizes.where("blocks > 1"), "large")
    placed = join_checked(data, large, ["component"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "data")

    def run(batches):
        at, nodes, items = None, [], []
        waiting, held, sizes, weight = [], [], [], 0

        def edges(nodes, found):
            a, b = pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        def ended():
            nonlocal weight
            if 1 < len(items) <= few:
                waiting.extend(nodes)
                held.extend(items)
                sizes.append(len(items))
                weight += sum(map(len, items))
            elif len(items) > 1:
                yield edges(nodes, list(link(items)))
            if len(held) > TOGETHER or weight > BLOCK_BYTES // 8:
                yield from together()

        def together():
            nonlocal weight
            if held:
                yield edges(waiting, list(link(held, sizes)))
            waiting.clear()
            held.clear()
            sizes.clear()
            weight = 0

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for k, (*key, node) in enumerate(keys):
                if key != at:
                    yield from ended()
                    at, nodes, items = key, [], []
                if not nodes or nodes[-1] != node:  # repeated rows of an item count once
                    nodes.append(node)
                    items.append(batch.column(4)[k].as_py())
        yield from ended()
        yield from together()

    place = ["component", "low", "high"]
    links = placed.repartition(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place).sortWithinPartitions(*place, "node").mapInArrow(run, "a long, b long")
    groups = components(cut(links))
    discard(data, large)
    return groups
