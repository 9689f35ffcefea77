"""Ranked full-text search over relational inverted indexes.

Exact, prefix and fuzzy matches of every query term are weighed, scored by BM25+ (Lv & Zhai, CIKM 2011) per field, and
summed; rows whose primary field equals the query, or starts with it, come first.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, fold_py, max_distance, tokens, tokens_py
from ..sources.shared import shared_dir

if TYPE_CHECKING:
    from .store import TextStore


@dataclass(frozen=True)
class Scoring:
    """Constants of matching and ranking."""

    k: float = 1.2
    b: float = 0.7
    d: float = 0.5
    prefix_weight: float = 0.375
    prefix_slope: float = 0.3
    fuzzy_weight: float = 0.45
    fuzzy_share: float = 0.2
    fuzzy_most: int = 6
    boosts: tuple[tuple[str, float], ...] = ()


@dataclass(frozen=True)
class Index:
    """``postings (id, field, term, tf, len)``, ``vocabulary (field, term, df)``, ``stats (field, avg_len)``, ``size (n)``,
    and the ``places`` of terms, a row each, so that a search counts only its own terms. Nothing is kept: ``store`` is the
    index to build once."""

    postings: DataFrame
    vocabulary: DataFrame
    stats: DataFrame
    size: DataFrame
    places: DataFrame


def field_tokens(base: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``id, field, raw array, len``: absent fields give no row; ``len`` counts distinct raw tokens."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))
    rows = base.select(F.col(id_col).alias("id"), F.explode(pairs).alias("p")).select("id", "p.field", tokens(F.col("p.v")).alias("raw")).where("raw is not null")
    return rows.withColumn("len", F.size(F.array_distinct("raw")).cast("long"))


def build_index(base: DataFrame, id_col: str, fields: list[str]) -> Index:
    rows = field_tokens(base, id_col, fields)
    # folding neither makes nor takes separators, so whole texts are folded and then cut
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))
    own = base.select(F.col(id_col).alias("id"), F.explode(pairs).alias("p")).select("id", "p.field", tokens(fold(F.col("p.v"))).alias("terms"), F.size(F.array_distinct(tokens(F.col("p.v")))).cast("long").alias("len"))
    places = own.select("id", "field", "len", F.explode("terms").alias("term")).where("term <> ''")
    postings = places.groupBy("id", "field", "term", "len").agg(F.count("*").alias("tf"))
    vocabulary = own.select("field", F.explode(F.array_distinct("terms")).alias("term")).where("term <> ''").groupBy("field", "term").agg(F.count("*").alias("df"))
    return Index(postings, vocabulary, rows.groupBy("field").agg(F.avg("len").alias("avg_len")), base.agg(F.count("*").alias("n")), places)


def query_terms(query: str, scoring: Scoring = Scoring()) -> list[tuple[str, int]]:
    terms = [t for t in map(fold_py, tokens_py(query)) if t]
    return [(t, max_distance(t, scoring.fuzzy_share, scoring.fuzzy_most)) for t in terms]


def expand(vocabulary: DataFrame, terms: list[tuple[str, int]], scoring: Scoring = Scoring()) -> DataFrame:
    """Vocabulary terms that match a query term, with the weight of the match: exact before prefix before fuzzy."""
    asked = F.array(*(F.struct(F.lit(i).alias("qi"), F.lit(t).alias("q"), F.lit(m).alias("most")) for i, (t, m) in enumerate(terms)))
    found = vocabulary.withColumn("a", F.explode(asked)).select("*", "a.*").drop("a")
    size, asked_size = F.length("term").cast("double"), F.length("q").cast("double")
    # a length test spares most of the edit distances
    near = (F.col("most") > 0) & (F.abs(F.length("term") - F.length("q")) <= F.col("most")) & (F.levenshtein("term", "q") <= F.col("most"))
    weight = (
        F.when(F.col("term") == F.col("q"), F.lit(1.0))
        .when(F.startswith("term", "q"), F.lit(scoring.prefix_weight) * size / (size + F.lit(scoring.prefix_slope) * (size - asked_size)))
        .when(near, F.lit(scoring.fuzzy_weight) * size / (size + F.levenshtein("term", "q")))
    )
    return found.withColumn("w", weight).where("w is not null").select("field", "term", "df", "qi", "w")


def _matching(terms: list[tuple[str, int]]) -> Column:
    """Whether the column ``term`` matches any query term."""
    out = F.lit(False)
    for q, most in terms:
        out = out | F.startswith("term", F.lit(q))
        if most:
            out = out | ((F.abs(F.length("term") - len(q)) <= most) & (F.levenshtein("term", F.lit(q)) <= most))
    return out


def scanned(base: DataFrame, id_col: str, fields: list[str], terms: list[tuple[str, int]], scoring: Scoring = Scoring()) -> DataFrame:
    """``id, score`` without an index: one pass over the texts keeps the hits and a row per field for the lengths, which
    are written; frequencies, mean lengths and scores are made of those."""
    spark = base.sparkSession
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))
    own = base.select(F.col(id_col).alias("id"), F.explode(pairs).alias("p")).where("p.v is not null")
    # the empty term, which no token counts as, stands for the field itself
    own = own.select("id", "p.field", F.size(F.array_distinct(tokens(F.col("p.v")))).cast("long").alias("len"), F.concat(F.array(F.lit("")), F.filter(tokens(fold(F.col("p.v"))), lambda t: t != "")).alias("terms"))
    kept = own.select("id", "field", "len", F.explode("terms").alias("term")).where((F.col("term") == "") | _matching(terms))
    path = f"{shared_dir(spark)}/hits-{uuid.uuid4().hex}"
    kept.groupBy("id", "field", "len", "term").agg(F.count("*").alias("tf")).write.parquet(path)
    rows = spark.read.parquet(path)
    hits, sizes = rows.where("term <> ''"), rows.where("term = ''")
    stats = sizes.groupBy("field").agg(F.avg("len").alias("avg_len"))
    asked = expand(hits.groupBy("field", "term").agg(F.count("*").alias("df")), terms, scoring)
    return _summed(hits.join(asked, ["field", "term"]), stats, base.agg(F.count("*").alias("n")), scoring)


def score(index: Index, terms: list[tuple[str, int]], scoring: Scoring = Scoring()) -> DataFrame:
    """``id, score``. Only matched vocabulary (small) is broadcast, by Spark's own size test."""
    asked = expand(index.vocabulary, terms, scoring)
    # what the query does not ask for ends before the shuffle
    hits = index.places.join(asked, ["field", "term"]).groupBy("id", "field", "term", "len", "df", "qi", "w").agg(F.count("*").alias("tf"))
    return _summed(hits, index.stats, index.size, scoring)


def _summed(hits: DataFrame, stats: DataFrame, size: DataFrame, scoring: Scoring) -> DataFrame:
    hits = hits.join(F.broadcast(stats), "field").crossJoin(F.broadcast(size))  # a row per field, and one row
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.lit(scoring.d) + F.col("tf") * (scoring.k + 1) / (F.col("tf") + scoring.k * (1 - scoring.b + scoring.b * F.col("len") / F.col("avg_len")))
    boost = F.lit(1.0)
    for name, factor in scoring.boosts:
        boost = F.when(F.col("field") == name, F.lit(factor)).otherwise(boost)
    return hits.groupBy("id").agg((F.sum(F.col("w") * idf * part * boost) * F.countDistinct("qi")).alias("score"))


def priority(primary: Column, query: str) -> Column:
    """2 if the folded field equals the folded query, 1 if it starts with it, else 0."""
    text, asked = F.coalesce(primary.cast("string"), F.lit("")), fold_py(query)
    # folding goes character by character: of a long text its head decides, unless that is all marks or ends in a sigma
    size = 4 * len(asked) + 64
    head = fold(F.substring(text, 1, size))
    folded = fold(text) if set("σς") & set(asked) else F.when((F.length(text) > size) & (F.length(head) > len(asked) + 1), head).otherwise(fold(text))
    return F.when(folded == asked, 2).when(F.startswith(folded, F.lit(asked)), 1).otherwise(0)


def ranked(base: DataFrame, id_col: str, fields: list[str], primary: str, query: str, scoring: Scoring = Scoring(), index: Index | "TextStore" | None = None) -> DataFrame:
    """Matching rows of ``base`` with ``_priority`` and ``_score``. A query without terms matches nothing; an empty
    query, the whole table. Order with ``in_rank``. ``index`` may be a ``TextStore`` of the rows, which is read in part."""
    if not isinstance(query, str):
        raise TypeError("a query is a string")
    if not query:
        return base.withColumns({"_priority": F.lit(0), "_score": F.lit(0.0)})
    terms = query_terms(query, scoring)
    if not terms:
        return base.where(F.lit(False)).withColumns({"_priority": F.lit(0), "_score": F.lit(0.0)})
    if index is None:
        found = scanned(base, id_col, fields, terms, scoring)
    else:
        found = score(index, terms, scoring) if isinstance(index, Index) else index.score(query)
    # priorities come before the join, so that texts nobody asks for are not shuffled
    first = base.withColumn("_priority", priority(F.col(primary), query))
    return first.join(found.withColumnsRenamed({"id": id_col, "score": "_score"}), id_col)


def in_rank(rows: DataFrame, id_col: str) -> DataFrame:
    """Priority, then score (to 6 decimals, so that sums in any order rank alike), then row order."""
    return rows.orderBy(F.desc("_priority"), F.desc(F.round("_score", 6)), id_col)
