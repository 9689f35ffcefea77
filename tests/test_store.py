"""The kept index: matches against every pair, scores against the search that reads all rows, files read."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.functions.text import fold_py, max_distance
from lexispark.operators import matching as M
from lexispark.operators import search as S
from lexispark.operators import toppages as T
from lexispark.operators.store import TextStore

FIELDS = ["name", "note"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def noisy(rng, word):
    word = list(word)
    for _ in range(rng.randint(0, 4)):
        k = rng.randint(0, len(word))
        word[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "é", "q"])
    return "".join(word)


@pytest.mark.parametrize("scoring", [S.Scoring(), S.Scoring(fuzzy_share=0.4, fuzzy_most=3), S.Scoring(fuzzy_share=0.0)])
def test_matches_are_those_of_all_pairs(spark, scoring):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcde") for _ in range(n)) for n in (1, 2, 3, 4, 5, 7, 8, 9, 12, 13, 17, 18, 23, 27, 28, 40, 300) for _ in range(4)]
    terms = sorted({w for x in words for w in (x, noisy(rng, x), noisy(rng, x)) if w} | {"123", "1234", "12345678", "12345679"})
    asked = sorted({w for x in words for w in (x, noisy(rng, x), x[: len(x) // 2]) if w} | {"123", "12345678", "zzz"})
    keyed = M.keyed_terms(spark.createDataFrame([(t,) for t in terms], "term string"), scoring)
    got = {(r.q, r.term): r.w for r in M.matches(spark.createDataFrame([(q,) for q in asked], "q string"), keyed, scoring).collect()}
    expected = {}
    for q in asked:
        most = max_distance(q, scoring.fuzzy_share, scoring.fuzzy_most)
        for t in terms:
            d = edits(q, t) if most and abs(len(q) - len(t)) <= most else 99
            if t == q:
                expected[q, t] = 1.0
            elif t.startswith(q):
                expected[q, t] = scoring.prefix_weight * len(t) / (len(t) + scoring.prefix_slope * (len(t) - len(q)))
            elif d <= most:
                expected[q, t] = scoring.fuzzy_weight * len(t) / (len(t) + d)
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-12 for k, v in expected.items())


def test_no_theta_join(spark):
    frame = spark.createDataFrame([("ab",)], "term string")
    plan = M.matches(frame.withColumnRenamed("term", "q"), M.keyed_terms(frame, S.Scoring()), S.Scoring())._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def texts(rng, n, start=0):
    words = ["alpha", "alphabet", "alpine", "Béta", "beta", "gamma", "gammas", "delta9", "12345", "omega"]
    some = lambda: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))])
    return [(start + k, some(), some()) for k in range(n)]


SCHEMA = "k long, name string, note string"


def expected(spark, rows, query):
    if not rows:
        return {}
    index = S.build_index(spark.createDataFrame(rows, SCHEMA), "k", FIELDS)
    return {r.id: round(r.score, 9) for r in S.score(index, S.query_terms(query)).collect()}


def test_scores_after_changes_equal_a_full_rebuild(spark, tmp_path):
    rng = random.Random(4)
    rows = {r[0]: r for r in texts(rng, 60)}
    store = TextStore.create(spark.createDataFrame(list(rows.values()), SCHEMA), "k", FIELDS, str(tmp_path / "store"))
    first = store
    for step in range(4):
        changed = [(k, *texts(rng, 1)[0][1:]) for k in rng.sample(sorted(rows), 7)] + texts(rng, 4, 100 * (step + 1))
        gone = rng.sample(sorted(rows), 5)
        gone = [k for k in gone if k not in {c[0] for c in changed}]
        rows |= {c[0]: c for c in changed}
        for k in gone:
            del rows[k]
        store = store.update(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([(k,) for k in [*gone, 10**9, None]], "k long"))
        assert store.content["n"] == len(rows)
        if step in (0, 3):
            for query in ("alpha bet", "gamm 12345 alpha alpha"):
                assert {r.id: round(r.score, 9) for r in store.score(query).collect()} == pytest.approx(expected(spark, list(rows.values()), query))
    assert len(store.content["segments"]) < 5  # merged
    index = S.build_index(spark.createDataFrame(list(rows.values()), SCHEMA), "k", FIELDS)
    assert sorted(map(tuple, store.vocabulary().select("field", "term", "df").collect())) == sorted(map(tuple, index.vocabulary.select("field", "term", "df").collect()))
    # a reader's version is what it was
    assert first.content["n"] == 60 and first.vocabulary().count() > 0 and TextStore.open(spark, store.path, first.version).content == first.content
    with pytest.raises(RuntimeError, match="another writer"):
        first.update(removed=spark.createDataFrame([(1,)], "k long"))


def test_only_changed_rows_are_read_and_tokenised(spark, tmp_path):
    rows = texts(random.Random(2), 200)
    store = TextStore.create(spark.createDataFrame(rows, SCHEMA), "k", FIELDS, str(tmp_path / "store")).update(spark.createDataFrame([(5, "new words", None)], SCHEMA))
    last = store.content["segments"][-1]
    assert last["rows"] <= 1 and store._part("forward", last).count() == 1 and {r.term for r in store._part("postings", last).collect()} == {"new", "words"}
    assert {r.id for r in store.score("words").collect()} == {5}


def test_a_search_opens_the_folders_of_its_terms(spark, tmp_path):
    rows = [(k, f"word{k} common", None) for k in range(3000)]
    store = TextStore.create(spark.createDataFrame(rows, SCHEMA), "k", FIELDS, str(tmp_path / "store"))
    hits = store.hits("word1234")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and ("In(term" in plan or "EqualTo(term" in plan)
    scan = store._of(store._parts("postings"), "term", ["word1234", "word123"])
    read = scan.select(F.input_file_name()).distinct().count()
    every = store.postings().select(F.input_file_name()).distinct().count()
    assert read <= 2 < every
    assert {r.id for r in hits.where("w = 1").collect()} == {1234}


def test_many_queries_equal_one_at_a_time(spark, tmp_path):
    rng = random.Random(9)
    rows = texts(rng, 80)
    store = TextStore.create(spark.createDataFrame(rows, SCHEMA), "k", FIELDS, str(tmp_path / "store"), S.Scoring(boosts=(("name", 2.0),)))
    asked = [(1, "alpha bet"), (2, "alpha bet"), (3, "ALPHA, alpha; gam"), (4, None), (5, " .. "), (6, "zzzzz"), (None, "beta"), (8, "gamma " * 50 + "12345")]
    got = {}
    for r in store.score_many(spark.createDataFrame(asked, "qid long, text string")).collect():
        got.setdefault(r.qid, {})[r.id] = r.score
    for q, text in asked:
        own = {r.id: r.score for r in store.score(text).collect()} if text and S.query_terms(text) else {}
        assert got.get(q, {}) == pytest.approx(own)


@pytest.mark.parametrize("k", [1, 40])
def test_first_rows_by_upper_bounds(spark, tmp_path, k):
    rng = random.Random(k)
    words = ["common"] * 30 + ["usual"] * 10 + ["rare", "rarer", "raree", "seldom", "odd"]
    rows = [(n, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))), rng.choice([None, "common odd", "usual"])) for n in range(300)]
    rows += [(1000 + n, "common rare words first", None) for n in range(3)] + [(2000, "common rare", "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    store = TextStore.create(frame, "k", FIELDS, str(tmp_path / "store"), S.Scoring(boosts=(("note", 1.5),)))
    for query in ("common rare", "Seldom common usual odd", "comm", ""):
        found = T.top(store, frame, "name", query, k)
        own = S.in_rank(S.ranked(frame, "k", FIELDS, "name", query, store.scoring), "k").limit(k).collect() if query else []
        assert [(r.k, r["_priority"], round(r["_score"], 6)) for r in found.rows.collect()] == [(r.k, r["_priority"], round(r["_score"], 6)) for r in own]
        assert found.read <= found.matched
    assert k > 5 or T.top(store, frame, "name", "seldom common", k).read < 0.5 * T.top(store, frame, "name", "seldom common", k).matched


def test_store_of_no_rows(spark, tmp_path):
    store = TextStore.create(spark.createDataFrame([], SCHEMA), "k", FIELDS, str(tmp_path / "store"))
    assert store.score("alpha").count() == 0 and store.content["n"] == 0
    store = store.update(spark.createDataFrame([(1, "alpha", None)], SCHEMA))
    assert {r.id for r in store.score("alpha").collect()} == {1}
    assert store.update(removed=spark.createDataFrame([(1,)], "k long")).score("alpha").count() == 0
    with pytest.raises(FileExistsError):
        TextStore.create(spark.createDataFrame([], SCHEMA), "k", FIELDS, str(tmp_path / "store"))


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=12))
def test_edit_bound_is_that_of_single_queries(value):
    assert max_distance(fold_py(value)) == (0 if fold_py(value).isascii() and fold_py(value).isdigit() else min(6, int(0.2 * len(fold_py(value)) + 0.5)))
