"""Key containers, and differences of snapshots against a brute-force version."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.llm import common
from lexispark.llm import snapshot_diff as S
from lexispark.llm.queries import queries

SCHEMA = "doc_id long, text string, lang string, source string"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 65535), max_size=300), st.integers(0, 65535), st.integers(0, 9000))
def test_containers_round_trip(some, start, length):
    for lows in (some, set(range(start, min(65536, start + length))), some | set(range(start, min(65536, start + length), 2))):
        array = np.array(sorted(lows), dtype=np.int64)
        blob = S.packed(array)
        assert S.unpacked(blob).tolist() == array.tolist()
        assert len(blob) <= 1 + min(2 * len(array), 8192)


def test_containers_take_the_shortest_form():
    assert [S.packed(np.array(x))[:1] for x in ([5, 9], range(3, 60000), range(0, 65536, 2))] == [b"A", b"R", b"B"]


def brute(earlier, later):
    """Rows (key, old_key, op, changed) of snapshots given as lists of (key, text, lang, source)."""
    out = []
    many = {k for side in (earlier, later) for k, n in Counter(r[0] for r in side).items() if n > 1} | {None}
    old, new = ({r[0]: r for r in side if r[0] not in many} for side in (earlier, later))
    for k in old.keys() & new.keys():
        changed = ",".join(n for n, a, b in zip(("text", "lang", "source"), old[k][1:], new[k][1:], strict=True) if a != b)
        out.append((k, k, "update" if changed else "same", changed))
    left, right = defaultdict(list), defaultdict(list)
    for side, other, into in ((earlier, new, left), (later, old, right)):
        for r in side:
            if r[0] in many or r[0] not in other:
                into[r[1:]].append(r[0])
    order = lambda k: (k is not None, k or 0)
    for content in left.keys() | right.keys():
        a, b = sorted(left[content], key=order), sorted(right[content], key=order)
        out += [(y, x, "same" if x == y else "rekey", "") for x, y in zip(a, b, strict=False)]
        out += [(x, x, "delete", "") for x in a[len(b) :]] + [(y, None, "insert", "") for y in b[len(a) :]]
    return sorted(out, key=str)


def found(spark, earlier, later, **more):
    a, b = (spark.createDataFrame(x, SCHEMA).repartition(3).withColumns({"k": F.lit("k"), "side": F.lit(1), "rank": F.lit(2), "content": F.lit(None), "range": F.lit(3)}) for x in (earlier, later))
    rows = S.diff(a, b, "doc_id", ["text", "lang", "source"], **more).collect()
    return sorted(((r.key, r.old_key, r.op, ",".join(r.changed)) for r in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_two_snapshots(spark, seed, monkeypatch):
    monkeypatch.setattr(common, "SAMPLED_PER_RANGE", 2)
    monkeypatch.setattr(S, "CHUNK_KEYS", 50)
    rng = random.Random(seed)
    keys = [*range(-40, 60), *range(65530, 65545), -(1 << 63), (1 << 63) - 1, 1 << 40, None]
    value = lambda some: rng.choice([*some, None, ""])
    draw = lambda n: [(rng.choice(keys), rng.choice(["hot", "hot", value("abc"), "~"]), value(["en", "de"]), value("s")) for _ in range(n)]
    earlier = draw(150)
    later = [r if rng.random() < 0.5 else (rng.choice(keys), *r[1:]) for r in earlier if rng.random() < 0.9] + draw(40)
    assert found(spark, earlier, later) == brute(earlier, later)


def test_hot_contents_pair_in_the_order_of_keys(spark):
    earlier = [(k, "same", "en", "a") for k in range(300)] + [(k, f"text {k}", "en", "a") for k in range(300, 400)]
    later = [(-1 - 3 * k, "same", "en", "a") for k in range(280)] + [(k, f"text {k}", None, "a") for k in range(300, 390)]
    assert found(spark, earlier, later) == brute(earlier, later)


def test_empty_snapshots(spark):
    one = [(1, "x", None, None), (None, "y", "en", "")]
    assert found(spark, [], []) == []
    assert found(spark, one, []) == brute(one, []) and found(spark, [], one) == brute([], one)
    with pytest.raises(TypeError, match="whole numbers"):
        S.key_sets(spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("a",)], "k string"), "k")


def test_sets_hold_all_keys_once(spark):
    a, b = spark.range(0, 150_000).withColumnRenamed("id", "k"), spark.range(100_000, 200_000).withColumnRenamed("id", "k")
    sets = S.key_sets(a.union(a.where("k < 10")), b, "k")
    got = {r.kind: (r.n, r.s) for r in S.keys_of(sets).groupBy("kind").agg(F.count("*").alias("n"), F.sum("k").alias("s")).collect()}
    assert got == {"paired": (50_000, sum(range(100_000, 150_000))), "earlier": (99_990, sum(range(10, 100_000))), "later": (50_000, sum(range(150_000, 200_000))), "repeated": (10, 45)}
    assert sets.agg(F.sum(F.length("keys"))).first()[0] < 200  # runs


def test_query_equals_brute_force_over_the_whole_table(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    later = []
    for k, text, lang, source in rows:
        turn = zlib.crc32(str(k).encode()) % 10
        later += {0: [], 1: [(k, (text or "") + "+", lang, source)], 2: [(k, text, source, lang)], 3: [(-1 - k, text, lang, source)], 4: [(-1 - k, text, lang, None)], 5: [(k, text, lang, source), (-1 - k, text, lang, source)]}.get(turn, [(k, text, lang, source)])
    by_key = {r[0]: hashlib.sha256("\n".join("~" if v is None else v for v in r[1:]).encode()).hexdigest() for r in later}
    got = sorted(((r.key, r.old_key, r.op, r.changed, r.row_sha256) for r in queries()["op13_snapshot_diff"](spark, data).collect()), key=str)
    assert got == sorted(((*r, None if r[2] == "delete" else by_key[r[0]]) for r in brute(rows, later)), key=str)
