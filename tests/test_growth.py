"""Work that was done twice, or for what a query does not ask for."""

import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexispark.operators import matching as M
from lexispark.operators import search as S
from lexispark.operators import store as ST
from lexispark.operators import toppages
from lexispark.operators.store import TextStore
from lexispark.plans.engine import Engine
from lexispark.sources.registry import DATASETS


def test_only_named_datasets_are_loaded(spark, tmp_path):
    (tmp_path / DATASETS["conditions"].file).write_text("1\tliste I\n")
    (tmp_path / DATASETS["compositions"].file).write_text("1\te\ts1\tname\n")
    engine = Engine(spark, str(tmp_path), names=["conditions"])
    assert list(engine.tables) == ["conditions"] and engine.search("conditions", "liste").count() == 1
    assert sorted(os.listdir(f"{engine.home}/tables")) == ["conditions"]
    assert set(engine.load("substances").tables) == {"conditions", "compositions", "substances"} and engine.table("substances").count() == 1
    assert set(engine.reload().tables) == {"conditions", "compositions", "substances"}
    engine.drop()


def test_texts_are_read_once_for_an_index(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def text(k):
        seen.add(1)
        return f"word{k} common"

    rows = spark.range(40).select("id", F.udf(text)("id").alias("v")).where(F.col("v") != "")
    store = TextStore.create(rows, "id", ["v"], str(tmp_path / "s"))
    # twice in one pass for the terms, as filter and value, and once for the number of rows
    assert seen.value <= 120 and store.score("common").count() == 40


def test_a_search_without_an_index_is_that_with_one(spark):
    rows = [(1, "rings and ring", "a ring"), (2, "Ring", None), (3, "rang", "ringlet, ring"), (4, None, None), (5, "", "other"), (6, "other words", "none")]
    base = spark.createDataFrame(rows, "id long, a string, b string")
    shown = lambda found: {(r.id, r._priority, round(r._score, 9)) for r in found.collect()}
    for q in ("ring", "ring other", "rin", "absent"):
        found = S.ranked(base, "id", ["a", "b"], "a", q)
        assert shown(found) == shown(S.ranked(base, "id", ["a", "b"], "a", q, index=S.build_index(base, "id", ["a", "b"])))


def test_priority_of_long_texts(spark):
    texts = ["small ring", "small ring" + " x" * 500, "́" * 300 + "small ring", "s" * 400, "Small Ringe", "", None]
    got = [r.p for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", S.priority(F.col("t"), "small ring").alias("p")).orderBy("k").collect()]
    assert got == [2, 1, 2, 0, 1, 0, 0]


def test_first_page_of_many_candidates(spark, tmp_path, monkeypatch):
    rows = spark.range(60).select("id", F.concat(F.lit("thing "), F.when(F.col("id") % 3 == 0, "rare ").otherwise(""), F.col("id") % 7).alias("v"))
    store = TextStore.create(rows, "id", ["v"], str(tmp_path / "s"))
    monkeypatch.setattr(toppages, "LITERALS", 5)
    monkeypatch.setattr(TextStore, "forward", None)
    got = toppages.top(store, rows, "v", "thing rare", 9)
    want = S.in_rank(S.ranked(rows, "id", ["v"], "v", "thing rare", index=store), "id").limit(9)
    assert [(r.id, round(r._score, 9)) for r in got.rows.collect()] == [(r.id, round(r._score, 9)) for r in want.collect()]
    assert got.read == got.matched
    assert "forward" not in " ".join(got.rows.inputFiles())


def test_text_of_a_group_is_not_shuffled_for_each_member(spark, tmp_path):
    (tmp_path / DATASETS["specialites"].file).write_text("".join(f"{k}\tname {k}\n" for k in range(300)))
    (tmp_path / DATASETS["generiques"].file).write_text("".join(f"g{k % 2}\tgroup\t{k}\n" for k in range(299)))
    found = Engine(spark, str(tmp_path)).details_json(metadata=False)
    rows = {r.cis: r.json for r in found.collect()}
    assert rows["299"].endswith('"generiques":null}') and rows["4"].count('"id_groupe":"g0"') == 151 and '"libelle_groupe":"group","items":[{' in rows["4"]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in plan if "Join" in line]
    assert "_group" in joins[0]  # the last one


def test_many_queries_in_blocks(spark, tmp_path, monkeypatch):
    for name, size in (("ROW_BLOCK", 7), ("QUERY_BLOCK", 2), ("PRODUCT_ROWS", 3)):
        monkeypatch.setattr(ST, name, size)
    rows = spark.range(40).select("id", F.concat(F.lit("thing "), F.when(F.col("id") % 3 == 0, "rare ").otherwise(""), F.col("id") % 7).alias("v"))
    store = TextStore.create(rows, "id", ["v"], str(tmp_path / "s"))
    asked = {1: "thing rare", 2: "rare rare 3", 3: "", 4: "5", 5: "none such", 6: "thing"}
    found = store.score_many(spark.createDataFrame(list(asked.items()), "qid long, text string"))
    # each pair once, from blocks: nothing is grouped by query and row
    assert "FlatMapCoGroups" in found._jdf.queryExecution().optimizedPlan().toString()
    want = {(k, r.id, round(r.score, 6)) for k, q in asked.items() if q for r in store.score(q).collect()}
    got = [(r.qid, r.id, round(r.score, 6)) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def _edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(before[j] + (x != y), before[j + 1] + 1, now[j] + 1))
        before = now
    return before[-1]


def test_candidates_end_before_they_are_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "PAIRS", 50)
    draw = random.Random(3)
    words = sorted({"".join(draw.choices("abcé", k=draw.randint(1, 12))) for _ in range(300)} | {"x" * 70, "x" * 69 + "y"})
    i, j = (np.array([draw.randrange(len(words)) for _ in range(4000)]) for _ in range(2))
    most = np.array([draw.randint(1, 4) for _ in range(4000)])
    want = np.array([_edits(words[a], words[b]) <= m for a, b, m in zip(i, j, most, strict=True)])
    letters, pairs = M.signatures(words)
    assert not (want & ((np.bitwise_count(letters[i] ^ letters[j]) > 2 * most) | (np.bitwise_count(pairs[i] ^ pairs[j]) > 4 * most))).any()
    short = np.array([len(words[b]) <= 64 for b in j])
    assert (M.Words(words).near(i, j, most) == want)[short].all()
    # rows of one key that hold a common segment, most of them far apart
    rows = pa.table({"key": [7] * 8, "edits": pa.array([-1, -1, -1, -1, -1, -1, 1, 1], pa.int32()), "word": ["abcxyz", "abcuvw", "abcabc", "abcabd", "zzzabc", "abc", "abcabc", "abqabc"]})
    got = {(q, t) for x in M._near(iter(rows.to_batches(max_chunksize=3))) for q, t in zip(x.column(0).to_pylist(), x.column(2).to_pylist(), strict=True)}
    assert got == {("abcabc", "abcabc"), ("abcabc", "abcabd"), ("abqabc", "abcabc")}
    scoring = S.Scoring()
    asked, terms = spark.createDataFrame([(w,) for w in words[::5]], "q string"), spark.createDataFrame([(w,) for w in words], "term string")
    found = {(r.q, r.term) for r in M.matches(asked, M.keyed_terms(terms, scoring), scoring).collect()}
    bound = lambda q: min(6, int(0.2 * len(q) + 0.5))
    assert found == {(q, t) for q in words[::5] for t in words if t.startswith(q) or _edits(t, q) <= bound(q)}
