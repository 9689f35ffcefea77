"""Bottom-k sketches against sets of shingles, and the digest against a brute-force version."""

import base64
import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from lexispark.llm import common
from lexispark.llm import fingerprints as P
from lexispark.llm.queries import queries

DATA = "/root/testdata/sf0.001"


def chained(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def shingles(text):
    words = [w for w in re.split("[\x09-\x0d\x20]+", (text or "").lower()) if w]
    return {chained(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def lowest(values):
    return sorted(values)[: P.K]


def alike(a, b):
    u = lowest(set(lowest(a)) | set(lowest(b)))
    return sum(x in set(lowest(a)) and x in set(lowest(b)) for x in u) / len(u) if u else 1.0


def as_text(a):
    return base64.b64encode(b"".join(struct.pack(">q", x) for x in lowest(a))).decode()


def expected(rows):
    """Digest of rows (id, text), by id and text."""
    order = sorted(((k, common_hash(t or ""), t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -r[1]))
    out = []
    for i, (k, _, t) in enumerate(order):
        following = order[(i + 1) % len(order)][2]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(shingles(t)), as_text(shingles(edited)), round(alike(shingles(t), shingles(edited)), 9), round(alike(shingles(t), shingles(following)), 9)))
    return sorted(out, key=str)


def common_hash(text):
    return chained([text])


def digest(frame):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint.replace("\r\n", ""), r.edited_fingerprint.replace("\r\n", ""), round(r.near_edited, 9), round(r.near_next, 9)) for r in frame.collect()), key=str)


def test_query_equals_brute_force_over_the_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    assert digest(queries()["op12_fingerprints"](spark, DATA)) == expected([(r.doc_id, r.text) for r in table.collect()])


@pytest.mark.parametrize("per_range", [1, 3, 16])
def test_edges_are_dealt_right(spark, per_range, monkeypatch):
    monkeypatch.setattr(common, "SAMPLED_PER_RANGE", per_range)
    rng = random.Random(per_range)
    word = lambda: "".join(rng.choice("abcdé✓𝄞 \n") for _ in range(rng.randint(1, 9)))
    rows = [(k, " ".join(word() for _ in range(rng.randint(0, 40)))) for k in range(-20, 60)]
    rows += [(None, "null key"), (None, None), (7, None), (7, ""), (8, "   "), (9, "x"), (10, "Ab cD"), (11, "ab cd"), (-100, "w " * 30_000)]
    rows += [(30, "same row again and again now")] * 60 + [(31, f"text {k} of one key that many share") for k in range(60)]  # a hot row, a hot key
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"key": F.lit(1), "h": F.lit("h"), "range": F.lit(0), "sketch": F.lit("s"), "cuts": F.lit(0)})
    assert digest(P.fingerprint_digest(frame)) == expected(rows)


def test_one_row_and_no_rows(spark):
    schema = "doc_id long, text string"
    assert P.fingerprint_digest(spark.createDataFrame([], schema)).collect() == []
    assert digest(P.fingerprint_digest(spark.createDataFrame([(3, "a b c d e f")], schema))) == expected([(3, "a b c d e f")])


def test_sketches_merge_and_travel_as_text(spark):
    rng = random.Random(1)
    texts = [" ".join(str(rng.randint(0, 400)) for _ in range(n)) for n in (0, 3, 90, 700, 4000)]
    rows = [(f"g{k % 2}" if k % 5 else None, t) for k in range(40) for t in [texts[k % 5]]]
    frame = spark.createDataFrame(rows, "g string, text string").withColumn("part", F.expr("1"))
    parts = P.fingerprints(frame, ("g",))
    got = {r.g: r.sketch for r in P.merge_by(parts, ["g"]).collect()}
    assert got == {g: lowest(set().union(*(shingles(t) for h, t in rows if h == g))) for g in (None, "g0", "g1")}
    two = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"))
    for r in two.select("a", "b", P.merged(F.col("a"), F.col("b")).alias("m"), P.decoded(P.encoded(F.col("a"))).alias("back")).collect():
        assert r.back == r.a and r.m == lowest(set(r.a) | set(r.b))


def test_estimates_come_near_the_sets(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(60):
        words = [str(rng.randint(0, 10**6)) for _ in range(3000)]
        cut, more = rng.randint(0, 3000), rng.randint(0, 2000)
        pairs.append((" ".join(words), " ".join(words[:cut] + [str(rng.randint(0, 10**6)) for _ in range(more)])))
    frame = spark.createDataFrame(pairs, "a string, b string").select("*", P.sketch(F.col("a")).alias("s"), P.sketch(F.col("b")).alias("t"))
    got = frame.select("a", "b", P.resemblance(F.col("s"), F.col("t")).alias("r"), P.containment(F.col("s"), F.col("t")).alias("c"), P.count(F.col("s")).alias("n")).collect()
    errors = []
    for r in got:
        a, b = shingles(r.a), shingles(r.b)
        errors.append((abs(r.r - len(a & b) / len(a | b)), abs(r.c - len(a & b) / len(a)), abs(r.n / len(a) - 1)))
    mean = [sum(e[i] for e in errors) / len(errors) for i in range(3)]
    assert mean[0] < 0.04 and mean[1] < 0.07 and mean[2] < 0.1 and max(e[0] for e in errors) < 0.15


def test_no_python_in_the_plan(spark):
    plan = queries()["op12_fingerprints"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "SinglePartition" not in plan.split("BroadcastExchange")[0]
