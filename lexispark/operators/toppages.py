"""The first rows of a search without scoring every hit: MaxScore (Turtle and Flood, 1995) over a text store.

Each matched term has an upper bound of what it adds to any row, from the largest term frequency and the shortest field
it occurs with. A row that is matched by the query terms of a set G alone scores at most (sum of their bounds) x |G|, as
the sum is multiplied by the number of matched query terms. Postings are read of the query terms with the largest bounds
until what the others could reach together stays below the k-th best score so far; postings of the others are not read:
the rows that can still get into the first k are fetched by id, and scored in full from what they hold.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_py
from .search import in_rank, priority, query_terms
from .store import LITERALS, TextStore, bucket

#: Ranks compare scores to so many decimals; what is closer counts as equal.
SLACK = 1e-6


@dataclass(frozen=True)
class Top:
    """The first rows, in rank order, and how many postings were read of those that match."""

    rows: DataFrame
    read: int
    matched: int


def _bounds(store: TextStore, found: list) -> dict[int, float]:
    """Most that a row can get from each query term."""
    s, n, total = store.scoring, store.content["n"], {}
    boosts = dict(s.boosts)
    for r in found:
        rows, length = store.content["sums"][r.field]
        norm = s.k * (1 - s.b + s.b * r.len_min / (length / rows))
        part = s.d + r.tf_max * (s.k + 1) / (r.tf_max + norm)
        total[r.qi] = total.get(r.qi, 0.0) + r.w * log(1 + (n - r.df + 0.5) / (r.df + 0.5)) * part * boosts.get(r.field, 1.0)
    return total


def _known(store: TextStore, found: list) -> DataFrame:
    rows = [(r.field, r.term, r.df, r.qi, r.w) for r in found]
    return F.broadcast(store.spark.createDataFrame(rows, "field string, term string, df long, qi int, w double"))  # LITERALS rows at most


def _partial(store: TextStore, found: list) -> DataFrame:
    """``id, sum, m`` from the postings of some matched terms."""
    rows = store._live(store._of(store._parts("postings"), "term", sorted({r.term for r in found}))).drop("bucket", "seq")
    hits = store._scored(rows.join(_known(store, found), ["field", "term"]))
    return hits.groupBy("id").agg(F.sum("part").alias("sum"), F.countDistinct("qi").alias("m"))


def _in_full(store: TextStore, ids: DataFrame, found: list) -> tuple[DataFrame, bool]:
    """``id, score`` of rows from their own terms, looked up by id as literals in the folders that hold them; for many ids,
    of all rows from the postings. And whether it is the latter."""
    some = [r.id for r in ids.limit(LITERALS + 1).collect()]
    if len(some) > LITERALS:  # what all of them hold would be read: the postings of the matched terms are less
        hits = store._live(store._of(store._parts("postings"), "term", sorted({r.term for r in found}))).drop("bucket", "seq")
        return store._scored(hits.join(_known(store, found), ["field", "term"])).groupBy("id").agg((F.sum("part") * F.countDistinct("qi")).alias("score")), True
    own = store.spark.createDataFrame([(i,) for i in some], f"id {store.content['kind']}")
    wanted = [r.b for r in own.select(bucket("id").alias("b")).distinct().collect()]
    rows = store._parts("forward").where(F.col("bucket").isin(wanted) & F.col("id").isin(some))
    words = store._live(rows).select("id", "field", "len", F.explode("terms").alias("term")).join(_known(store, found).drop("df", "qi", "w").distinct(), ["field", "term"], "left_semi")
    counted = words.groupBy("id", "field", "term", "len").agg(F.count("*").alias("tf"))
    return store._scored(counted.join(_known(store, found), ["field", "term"])).groupBy("id").agg((F.sum("part") * F.countDistinct("qi")).alias("score")), False


def top(store: TextStore, base: DataFrame, primary: str, query: str, k: int = 20) -> Top:
    """The first ``k`` rows of ``search.ranked`` over ``base``, with ``_priority`` and ``_score``, in ``in_rank`` order."""
    key = store.content["id"]
    terms = query_terms(query, store.scoring)
    nothing = base.where(F.lit(False)).withColumns({"_priority": F.lit(0), "_score": F.lit(0.0)})
    if not terms or k < 1:
        return Top(nothing, 0, 0)
    limits = store._parts("terms").groupBy("field", "term").agg(F.max("tf_max").alias("tf_max"), F.min("len_min").alias("len_min"))
    found = store.expanded(query).join(limits, ["field", "term"]).limit(LITERALS + 1).collect()
    if not found:
        return Top(nothing, 0, 0)
    matched = sum({(r.field, r.term): r.df for r in found}.values())
    whole = lambda ids: base.withColumn("_priority", priority(F.col(primary), query)).join(ids.withColumnsRenamed({"id": key, "score": "_score"}), key)
    if len(found) > LITERALS:  # a query that matches much of the vocabulary
        return Top(in_rank(whole(store.score(query)), key).limit(k), matched, matched)

    bounds = _bounds(store, found)
    order, taken, least = sorted(bounds, key=lambda q: (-bounds[q], q)), 1, float("-inf")
    while True:
        mine = [r for r in found if r.qi in order[:taken]]
        partial, rest = _partial(store, mine), order[taken:]
        more, many = sum(bounds[q] for q in rest), len(rest)
        best = partial.select((F.col("sum") * F.col("m")).alias("s")).orderBy(F.desc("s")).limit(k).collect()
        least = best[-1].s if len(best) == k else float("-inf")
        if not rest or more * many < least - SLACK:
            break
        taken = min(len(order), 2 * taken)
    ids = partial.where((F.col("sum") + more) * (F.col("m") + many) >= least - SLACK).select("id") if least > float("-inf") else partial.select("id")

    # rows whose primary field begins with the query hold each of its terms there, the last one maybe as a prefix
    leading = {}
    for r in found:
        if r.field == primary and r.term.startswith(terms[r.qi][0]) and (r.qi == len(terms) - 1 or r.term == terms[r.qi][0]):
            leading.setdefault(r.qi, []).append(r)
    read = {(r.field, r.term): r.df for r in mine}
    if len(leading) == len(terms) and fold_py(query):
        rarest = min(leading.values(), key=lambda own: sum(r.df for r in own))
        read |= {(r.field, r.term): r.df for r in rarest}
        first = _partial(store, rarest).select("id")
        first = base.select(F.col(key).alias("id"), F.col(primary).alias("p")).join(first, "id", "left_semi").where(priority(F.col("p"), query) > 0).select("id")
        ids = ids.union(first).distinct()
    scores, every = _in_full(store, ids, found)
    return Top(in_rank(whole(scores), key).limit(k), matched if every else sum(read.values()), matched)
