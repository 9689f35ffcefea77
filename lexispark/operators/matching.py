"""Matches of a table of query terms in a vocabulary, by joins on equal keys.

A vocabulary term is found by its prefixes of a few lengths, and, for fuzzy matches, by its segments: a term within ``d``
edits of a query term, cut into d + 1 segments, has one of them unchanged in the query term, at most ``d`` places off
(Li, Deng, Wang and Feng, PVLDB 2011). Candidates are verified, so matches are those of comparing every pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of prefixes that are keys: a query term of any length is looked up by the longest one it has.
PREFIXES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)


def most_edits(term: Column, share: float = 0.2, most: int = 6) -> Column:
    """``functions.text.max_distance`` of a column."""
    return F.when(term.rlike("^[0-9]+$"), F.lit(0)).otherwise(_most(F.length(term), share, most))


def _most(size: Column, share: float, most: int) -> Column:
    return F.least(F.lit(most), F.floor(F.lit(share) * size + 0.5)).cast("int")


def _segment(size: Column, d: Column, i: Column) -> tuple[Column, Column]:
    """Where segment ``i`` of d + 1 starts (from 0) in a term of that size, and its length: the last ones are longer."""
    base, longer = F.floor(size / (d + 1)).cast("int"), (size % (d + 1)).cast("int")
    return base * i + F.greatest(F.lit(0), longer - (d + 1 - i)), base + (i >= d + 1 - longer).cast("int")


def _key(*parts: Column) -> Column:
    return F.concat_ws(":", *(p.cast("string") for p in parts))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def term_keys(term: Column, share: float = 0.2, most: int = 6) -> Column:
    """All keys under which a vocabulary term is found."""
    size = F.length(term)
    prefixes = F.transform(F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n <= size), lambda n: _key(F.lit("p"), F.substring(term, F.lit(1), n)))
    if not most:
        return prefixes

    def cut(d: Column) -> Column:
        def key(i: Column) -> Column:
            start, length = _segment(size, d, i)
            return _key(d, size, i, F.substring(term, start + 1, length))

        # query terms that allow d edits and are at most d longer or shorter
        asked = (_most(F.greatest(size - d, F.lit(0)), share, most) <= d) & (_most(size + d, share, most) >= d)
        return F.when(asked, F.transform(F.sequence(F.lit(0), d), key)).otherwise(_none("string"))

    return F.concat(prefixes, F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), cut)))


def query_keys(term: Column, edits: Column) -> Column:
    """All keys under which to look for matches of a query term that allows so many edits."""
    size = F.length(term)
    longest = F.array_max(F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n <= F.greatest(size, F.lit(1))))
    prefix = F.array(_key(F.lit("p"), F.substring(term, F.lit(1), longest)))

    def of_size(other: Column) -> Column:
        def of_segment(i: Column) -> Column:
            start, length = _segment(other, edits, i)
            first, last = F.greatest(F.lit(0), start - edits), F.least(start + edits, size - length)
            places = F.when(first <= last, F.sequence(first, last)).otherwise(_none("int"))
            return F.transform(places, lambda p: _key(edits, other, i, F.substring(term, p + 1, length)))

        return F.flatten(F.transform(F.sequence(F.lit(0), edits), of_segment))

    fuzzy = F.flatten(F.transform(F.sequence(F.greatest(F.lit(1), size - edits), size + edits), of_size))
    return F.array_distinct(F.concat(prefix, F.when(edits > 0, fuzzy).otherwise(_none("string"))))


def weight(scoring, term: str = "term", asked: str = "q", edits: str = "most") -> Column:
    """Of a match: exact before prefix before fuzzy; null for none."""
    size, asked_size = F.length(term).cast("double"), F.length(asked).cast("double")
    near = (F.col(edits) > 0) & (F.abs(F.length(term) - F.length(asked)) <= F.col(edits)) & (F.levenshtein(term, asked) <= F.col(edits))
    return (
        F.when(F.col(term) == F.col(asked), F.lit(1.0))
        .when(F.startswith(term, asked), F.lit(scoring.prefix_weight) * size / (size + F.lit(scoring.prefix_slope) * (size - asked_size)))
        .when(near, F.lit(scoring.fuzzy_weight) * size / (size + F.levenshtein(term, asked)))
    )


def keyed_terms(terms: DataFrame, scoring) -> DataFrame:
    """``key, term`` of a table of different terms."""
    return terms.select(F.explode(term_keys(F.col("term"), scoring.fuzzy_share, scoring.fuzzy_most)).alias("key"), "term")


def keyed_queries(asked: DataFrame, scoring) -> DataFrame:
    """``key, q, most`` of a table of different query terms ``q``."""
    own = asked.select("q", most_edits(F.col("q"), scoring.fuzzy_share, scoring.fuzzy_most).alias("most"))
    return own.select(F.explode(query_keys(F.col("q"), F.col("most"))).alias("key"), "q", "most")


#: Kinds of characters in a word's signature, and pairs of words that are compared at once.
KINDS, PAIRS = 32, 1 << 18
#: Pairs whose distances run together.
TOGETHER = 1 << 14
ONE = np.uint64(1)


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, twice 64 bits: whether it has a kind of character once, and twice, of which an edit changes two at
    most; and which kinds of pairs of neighbours it has, of which an edit changes four at most."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.repeat(np.arange(len(words)) * KINDS, [len(x) for x in words]) + (points & np.uint32(KINDS - 1))
    n = np.bincount(at, minlength=KINDS * len(words)).reshape(-1, KINDS)
    own = at // KINDS
    inside = own[1:] == own[:-1]
    cell = ((points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(26))[inside]
    pairs = np.zeros((len(words), 64), bool)
    pairs[own[1:][inside], cell] = True
    letters = np.packbits(np.concatenate([n > 0, n > 1], axis=1), axis=1).view(np.uint64)[:, 0]
    return letters, np.packbits(pairs, axis=1).view(np.uint64)[:, 0]


class Words:
    """Words whose edit distances are bounded many at once, bit-parallel (Myers, 1999; Hyyrö, 2003)."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        self.size = np.array([len(x) for x in words])
        self.code, self.start = (points & np.uint32(KINDS - 1)).astype(np.int64), np.cumsum(self.size) - self.size
        own = np.repeat(np.arange(len(words)), self.size)
        place = np.arange(len(points)) - self.start[own]
        fits = place < 64
        self.places = np.zeros(len(words) * KINDS, np.uint64)
        np.bitwise_or.at(self.places, (own * KINDS + self.code)[fits], ONE << place[fits].astype(np.uint64))

    def near(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which pairs may be within ``most`` edits: characters of one kind are taken for equal, and words of more than 64
        may always be."""
        out = self.size[j] > 64
        short = np.flatnonzero(~out)
        short = short[np.argsort(-self.size[i[short]], kind="stable")]
        for first in range(0, len(short), TOGETHER):
            k = short[first : first + TOGETHER]
            a, base, n, m = self.start[i[k]], j[k] * KINDS, self.size[i[k]], self.size[j[k]]
            rises, falls, score, top = np.full(len(k), ~np.uint64(0)), np.zeros(len(k), np.uint64), m.copy(), (m - 1).astype(np.uint64)
            for column in range(int(n[0])):
                live = int(np.searchsorted(-n, -column, side="left"))
                up, down = rises[:live], falls[:live]
                same = self.places[base[:live] + self.code[a[:live] + column]]
                level = (((same & up) + up) ^ up) | same
                more, less = down | ~(level | up), up & level
                score[:live] += (more >> top[:live] & ONE).astype(np.int64) - (less >> top[:live] & ONE).astype(np.int64)
                more, less, old = more << ONE | ONE, less << ONE, same | down
                rises[:live], falls[:live] = less | ~(old | more), more & old
            out[k] = score <= most[k]
        return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, edits, word``, in order of key and ``edits``, which are -1 for vocabulary terms: pairs of a term and a query
    term of one key whose signatures allow so many edits."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, edits = rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(np.int64)
        words = rows.column(2).combine_chunks()
        texts = words.to_pylist()
        letters, neighbours = signatures(texts)
        distances = Words(texts)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        terms = np.add.reduceat(edits < 0, starts)
        ends = np.append(starts[1:], len(key))
        found, n = [], 0
        for start, middle, end in zip(starts.tolist(), (starts + terms).tolist(), ends.tolist(), strict=True):
            if start == middle or middle == end:
                continue
            step = max(1, PAIRS // (middle - start))
            for first in range(middle, end, step):
                last = min(end, first + step)
                i, j = np.nonzero(np.bitwise_count(letters[first:last, None] ^ letters[None, start:middle]) <= (2 * edits[first:last]).astype(np.uint8)[:, None])
                i, j = i + first, j + start
                near = np.bitwise_count(neighbours[i] ^ neighbours[j]) <= 4 * edits[i]
                i, j = i[near], j[near]
                if len(i) > TOGETHER:
                    near = distances.near(i, j, edits[i])
                    i, j = i[near], j[near]
                found.append((i, j))
                n += len(i)
                if n > 50_000:
                    yield batch(words, distances, edits, found)
                    found, n = [], 0
        if found:
            yield batch(words, distances, edits, found)

    def batch(words: pa.Array, distances: Words, edits: np.ndarray, found: list) -> pa.RecordBatch:
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        near = distances.near(i, j, edits[i])
        i, j = i[near], j[near]
        return pa.RecordBatch.from_arrays([words.take(pa.array(i)), pa.array(edits[i], pa.int32()), words.take(pa.array(j))], ["q", "most", "term"])

    held: list[pa.RecordBatch] = []
    for new in batches:
        if not new.num_rows:
            continue
        key = new.column(0).to_numpy()
        held.append(new)
        if key[0] == key[-1] and held[0].column(0)[0].as_py() == key[-1]:
            continue  # one key so far, which may go on
        rows = pa.Table.from_batches(held)
        start = int(np.argmax(rows.column(0).to_numpy() == key[-1]))  # the last key's rows stay
        if start:
            yield from pairs(rows.slice(0, start))
        held = rows.slice(start).to_batches()
    if held:
        yield from pairs(pa.Table.from_batches(held))


def matches(asked: DataFrame, keyed: DataFrame, scoring) -> DataFrame:
    """``q, term, w``: every vocabulary term that matches a query term exactly, by prefix or within its edits, once.
    ``asked`` has different query terms ``q``, ``keyed`` is what ``keyed_terms`` makes of different terms.

    Of candidates with a common segment, only those become rows that are within their edits by kinds of characters."""
    queries, prefix = keyed_queries(asked, scoring), F.col("key").startswith("p:")
    begun = queries.where(prefix).join(keyed.where(prefix), "key").select("q", "most", "term").where(F.startswith("term", "q"))
    own = queries.where(~prefix).select(F.xxhash64("key").alias("key"), F.col("most").alias("edits"), F.col("q").alias("word"))
    terms = keyed.where(~prefix).select(F.xxhash64("key").alias("key"), F.lit(-1).alias("edits"), F.col("term").alias("word"))
    rows = terms.join(own.select("key").distinct(), "key", "left_semi").unionByName(own)
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = rows.repartition(parts, "key").sortWithinPartitions("key", "edits").mapInArrow(_near, "q string, most int, term string")
    # a distance beyond a literal bound ends early
    edits = F.coalesce(*(F.when(F.col("most") == d, F.levenshtein("term", "q", d)) for d in range(1, scoring.fuzzy_most + 1)), F.lit(-1))
    valued = begun.union(near.where(edits >= 0)).distinct().withColumn("w", weight(scoring)).where("w is not null")
    return valued.select("q", "term", "w")
