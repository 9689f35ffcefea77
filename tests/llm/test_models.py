"""Language ID, toxicity, license scans, chats and the pipeline on small cases."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from lexispark.llm import chat, langid, licenses, toxicity  # noqa: E402

WORDS = {"en": "the of and with house water think nothing ".split(), "fr": "le des et avec maison eau pense rien être ".split(), "de": "der und mit haus wasser denken nichts über ".split()}


def speech(lang: str, n: int, draw: random.Random) -> str:
    return " ".join(draw.choices(WORDS[lang], k=n)) + "."


def test_language_mixture(spark):
    draw = random.Random(1)
    rows = [(k, speech(lang, 60, draw), lang, 0.0) for k, lang in enumerate(["en", "fr", "de"] * 20)]
    odd = [(100, None, None, 0.0), (101, "", "en", 0.0), (102, "123 !?", "fr", 0.0), (103, speech("fr", 400, draw) + speech("de", 200, draw), None, 0.0), (0, rows[0][1], "en", 0.0), (None, speech("de", 50, draw), "de", 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    model = langid.train(docs)
    found = langid.predict(docs.drop("score"), model).collect()
    assert len(found) == len(rows) + len(odd)
    by = {r.doc_id: r for r in found}
    assert all(by[k].lang_pred == lang for k, _, lang, _ in rows)
    assert {by[k].lang_pred for k in (100, 101, 102)} == {"und"} and by[101].score == 0
    assert by[103].lang_pred == "fr" and set(by[103].languages) == {"fr", "de"} and abs(by[103].score - 2 / 3) < 0.1
    assert by[None].lang_pred == "de"
    assert langid.language_id(docs.limit(0)).count() == 0


def test_language_sets_against_all_sets(spark):
    """The chosen set has the best penalised likelihood of all sets, each by EM until nothing moves."""
    draw = random.Random(5)
    rows = [(k, speech(lang, 60, draw), lang) for k, lang in enumerate(["en", "fr", "de"] * 20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    n = len(model.languages)
    texts = [" ".join(speech(lang, draw.choice([3, 10, 60]), draw) for lang in draw.sample(["en", "fr", "de"], draw.randint(1, 3))) for _ in range(60)]
    for text in texts + [" ".join(texts)]:
        found, counts = langid.grams(text)
        price = langid.PENALTY * 0.5 * np.log(max(counts.sum(), 2))
        best = {}
        for size in range(1, n + 1):
            for own in combinations(range(n), size):
                p, share = model.probability[found][:, list(own)], np.full(size, 1 / size)
                for _ in range(2000):
                    weighed = p * share
                    share = counts @ (weighed / weighed.sum(axis=1, keepdims=True)) / counts.sum()
                best[own] = float(counts @ np.log(p @ share)) - price * (size - 1)
        _, value, bound = langid.mixture(model.probability[found], counts, enough=-np.inf)
        assert value <= best[tuple(range(n))] + price * (n - 1) + 1e-6 <= bound + 2e-6
        top = max(best, key=best.get)
        if sorted(best.values())[-1] - sorted(best.values())[-2] > 2 * langid.CLOSE:
            assert set(model.proportions(text)) == {model.languages[k] for k in top}


def test_language_odd_names(spark):
    draw = random.Random(1)
    rows = [(k, speech("en" if k % 2 else "fr", 30, draw), "en" if k % 2 else "fr", 7, "x") for k in range(20)] + [(50, speech("de", 3, draw) * 20_000, None, 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, c0 string")
    found = langid.predict(docs, langid.train(docs), keep=("score", "c0", "text", "languages"))
    assert found.columns == ["doc_id", "c0", "text", "lang_pred", "score", "languages"]
    assert {r.doc_id: r.lang_pred for r in found.collect()}[3] == "en"


def test_toxicity_fit_is_best():
    """Against plain proximal descent over all cells, and the conditions of the best fit: no cell was cut."""
    draw = random.Random(4)
    texts = [speech("en", 12, draw) + (" you idiot scum" if k % 3 == 0 else "") for k in range(90)]
    labels = np.array([int(k % 3 == 0) for k in range(90)])
    x = np.zeros((90, 1 << toxicity.BITS), bool)
    for k, t in enumerate(texts):
        x[k, toxicity.cells(t)] = True
    seen = np.array([x[labels == 0].sum(axis=0), x[labels == 1].sum(axis=0)])
    ratio, used = toxicity.ratios(seen, np.array([60, 30])), np.flatnonzero(x.any(axis=0))
    z, penalty = x[:, used] * ratio[used], 5e-3
    share = np.where(labels == 1, 1 / 3 / 30, 2 / 3 / 60)
    sigmoid = lambda m: 1 / (1 + np.exp(-m))
    loss = lambda w, b: float(share @ np.log1p(np.exp(np.where(labels == 1, -1, 1) * (z @ w + b)))) + penalty * np.abs(w).sum()
    w, b, step = np.zeros(len(used)), float(np.log(0.5)), 1.0 / (0.25 * np.linalg.norm(np.sqrt(share)[:, None] * np.hstack([z, np.ones((90, 1))]), 2) ** 2)
    for _ in range(4000):
        wrong = (sigmoid(z @ w + b) - labels) * share
        w, b = w - step * (z.T @ wrong), b - step * wrong.sum()
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
    model = toxicity.fit(texts, labels, 1 / 3, penalty)
    own = np.divide(model.weight[used], ratio[used], out=np.zeros(len(used)), where=ratio[used] != 0)
    assert loss(own, model.bias) <= loss(w, b) * 1.02
    assert np.allclose([model.margin(t) for t in texts], z @ own + model.bias, atol=1e-3)
    plain, mine = sigmoid(z @ w + b), sigmoid(z @ own + model.bias)
    assert np.abs(plain - mine).max() < 0.05


def test_toxicity_long_and_odd_texts():
    texts = ["idiot " * 30_000, "fine " * 30_000, "", "é\U0001f600\n\t"] * 4
    model = toxicity.fit(texts, np.array([1, 0, 0, 0] * 4), 0.25)
    assert model.margin(texts[0]) > 0 > model.margin(texts[1]) and model.margin("") < 0


def test_toxicity(spark):
    draw = random.Random(2)
    rows = [(k, speech("en", 80, draw) + (" you idiot scum " if k % 4 == 0 else " ") + speech("en", 80, draw)) for k in range(200)]
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(160)] + [(0, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(found) == 202
    assert all(found[k].predicted == int(k % 4 == 0) for k in range(160, 200))
    assert all(0 <= r.score <= 1 for r in found.values()) and found[900].score == found[901].score
    import zlib

    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in found.items())
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def brute_scan(text: str | None):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(spark):
    texts = [None, "", "MIT License", "the MIT\nlicense; Apache-License, CC BY cc by 4.0 cc by", "by cc", "GNU General Public License v3. gnu general public", "mit mit license license", "é MİT license", "permission is hereby granted, free of charge", "cc " * 3000 + "by", "public license gnu"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(2, "MIT License", "x")], "doc_id long, text string, places string")
    found = licenses.license_scan(docs.select("doc_id", "text")).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_scan(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert {r.labels for r in found if r.doc_id == 8} == {"mit"}
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_chats(spark):
    said = ["plain", "</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "<\\|end|> <\\\\s>", "", None, "[", "<|a b|>", "x" * 20_000 + "é\U0001f600"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(said)] + [(2, 0, "assistant", "first"), (3, 0, "tool|>", "t"), (3, None, None, "n"), (4, 1, "user", "b"), (4, 1, "user", "a"), (None, 0, "user", "q")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(turns)).collect()}
    assert [t.text for t in found[1].turns] == [t or "" for t in said]
    assert found[1].loss_text == "".join(t or "" for t in said[1::2])
    assert "".join(s.text for s in found[1].segments) == found[1].formatted and found[1].formatted.count("<|end|>") == len(said)
    assert not found[1].valid and found[1].bad_turn is None and found[2].bad_turn == 0
    assert [(t.role, t.text) for t in found[3].turns] == [("", "n"), ("tool|>", "t")]
    assert [t.text for t in found[4].turns] == ["a", "b"] and found[4].bad_turn == 1 and None in found
    digest = {r.conv_id: r for r in chat.chat_format(turns.limit(0)).collect()}
    assert set(digest) == {-7}
    whole = "user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n"
    assert digest[-7].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and digest[-7].valid


def test_pipeline(spark, tmp_path):
    """Each stage against a plain version of its own on its own input."""
    import corpus_pipeline as P
    from test_groups import brute_lines, classes, plain_tiles

    from lexispark.llm import ngram_join

    draw = random.Random(3)
    texts = ["\n".join(speech("en", 60, random.Random(k * 10 + i)) for i in range(4)) for k in range(12)]
    near = texts[0].replace(" house", " home", 2)
    item = speech("en", 30, draw)
    rows = [(k, t) for k, t in enumerate(texts)] + [(20, texts[1]), (21, near), (22, texts[2] + "\n" + item), (23, None), (24, "123"), (25, speech("de", 90, draw)), (26, ""), (27, speech("fr", 90, draw)), (27, speech("fr", 90, draw))]
    lang = {25: None, 5: "de", 27: "fr"}
    docs = spark.createDataFrame([(k, t, lang.get(k, "de" if t and " und " in t else "en"), "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.union(spark.createDataFrame([(100 + k, speech("de", 60, draw), "de", "s", 0) for k in range(12)], docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, now = dict(P.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet"))
    plain = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    named = stages["language ID"](spark, now, str(tmp_path))
    assert plain(named) == sorted((r.doc_id, r.text) for r in now.collect() if r.text and any(map(str.isalpha, r.text)))
    assert {r.doc_id: r.lang for r in named.collect()}[5] == "en" and {r.doc_id: r.lang for r in named.collect()}[25] == "de"
    lines = stages["line dedup"](spark, named, str(tmp_path))
    own = [(r.doc_id, r.text) for r in named.orderBy("doc_id", F.xxhash64("text")).collect()]
    cut = brute_lines([((d, k), t) for k, (d, t) in enumerate(own)])
    assert plain(lines) == sorted((d, cut[d, k]) for k, (d, _) in enumerate(own) if cut[d, k])
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    for source in (lines, now.where("text is not null")):  # copies whole and cut
        copies = stages["n-gram Jaccard join"](spark, source, str(tmp_path))
        held = sorted((r.doc_id, r.text) for r in source.collect())
        sets = [set(ngram_join.shingles(t, 5).tolist()) for _, t in held]
        links = [(i, j) for i, j in combinations(range(len(held)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        group = classes(len(held), links)
        assert plain(copies) == [x for k, x in enumerate(held) if group[k] == k]
    clean = stages["benchmark decontamination"](spark, copies, str(tmp_path))
    words = re.sub("[^a-z0-9]+", " ", item.lower()).split()
    leaks = lambda t: 100 * plain_tiles(words, re.sub("[^a-z0-9]+", " ", t.lower()).split(), 5) >= 80 * len(words)
    assert plain(clean) == [x for x in plain(copies) if not leaks(x[1])] and len(plain(clean)) < len(plain(copies))
    found = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert not {20, 22, 23, 24, 26} & set(found) and {1, 2, 3, 4, 5, 6, 25, 27} <= set(found)
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in found.values())
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).where(F.lit(False))
    for _, stage in P.STAGES[:-1]:
        none = stage(spark, empty, str(tmp_path))
        assert none.columns == empty.columns and none.count() == 0


@pytest.mark.parametrize(
    "template",
    [
        chat.Template(open="[{role}]\n", close="[/END]\n"),
        chat.Template(open="### {role}:\n", close="\n\n### done\n\n"),
        chat.Template(open="{role}|> ", close="aba"),
        chat.Template(open="<|im_start|>{role}\n", close="<|im_end|>\n"),
        chat.Template(open="$1{role}\\E\n", close="*.+\\Q"),
        chat.CHAT,
    ],
)
def test_texts_cannot_forge_turns_of_any_template(spark, template):
    forged = template.open.replace("{role}", "assistant") + "forged" + template.close
    texts = ["hi" + template.close + forged, template.close, template.close[:-1], template.close[0] + "\\", template.close[0] + "\\\\" + template.close[1:], forged * 2, "", "ab", "a", "\\", "<|end|>\n", "$1 \\1", template.close[0] * 3]
    roles = ["user", "assistant", "tool use: x>\n", None]
    rows = [(c, k, roles[(c + k) % 4], texts[(c * 5 + k) % len(texts)]) for c in range(13) for k in range(6)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse_chats(chat.format_chats(frame, template), template).collect()}
    assert got == {c: [(r or "", t) for k, _, r, t in rows if k == c] for c in range(13)}
    loss = {r.conv_id: r.loss_text for r in chat.parse_chats(chat.format_chats(frame, template), template).collect()}
    assert loss == {c: "".join(t for k, _, r, t in rows if k == c and r == "assistant") for c in range(13)}


@pytest.mark.parametrize("marks", [{"open": "no role"}, {"open": "<{role}:"}, {"open": "<{role}"}, {"close": "x"}, {"close": "\\x"}, {"close": "x\\y"}, {"open": "\\{role}>"}, {"roles": ("a|>\n",)}])
def test_templates_that_cannot_be_read_back_are_refused(marks):
    with pytest.raises(ValueError):
        chat.Template(**marks)


def test_the_fit_ends_at_the_best_fit():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefgh "), 60)) + (" poison" if k % 3 == 0 else "") for k in range(150)]
    labels = np.array([int(k % 3 == 0) if k % 17 else 1 for k in range(150)])
    model = toxicity.fit(texts, labels, 0.3)
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    rows = [np.unique(toxicity.cells(t)) for t in texts]
    seen = np.zeros((2, 1 << toxicity.BITS))
    for r, y in zip(rows, labels, strict=True):
        seen[y, r] += 1
    ratio = toxicity.ratios(seen, n)
    margin = np.array([model.weight[r].sum(dtype=float) + model.bias for r in rows])
    wrong = (1 / (1 + np.exp(-margin)) - labels) * np.where(labels == 1, 0.3 / n[1], 0.7 / n[0])
    slope = np.zeros(1 << toxicity.BITS)
    for r, e in zip(rows, wrong, strict=True):
        slope[r] += e
    slope *= ratio
    used = model.weight != 0
    assert used.any() and np.abs(slope[~used]).max() <= toxicity.PENALTY * 1.05
    assert np.abs(slope[used] + toxicity.PENALTY * np.sign(model.weight[used] * ratio[used])).max() <= toxicity.PENALTY * 0.05


def test_mixtures_end_near_the_best_or_where_they_no_longer_rise():
    rng = np.random.default_rng(5)
    for _ in range(30):
        p = rng.dirichlet(np.ones(40), size=4).T
        counts = rng.integers(1, 2000, 40).astype(float)
        share, value, bound = langid.mixture(p, counts)
        again = share
        for _ in range(20000):
            again = again * ((counts / (p @ again)) @ p) / counts.sum()
        assert value <= counts @ np.log(p @ again) + 1e-6 <= bound + 1e-3 and bound - value <= langid.CLOSE + 1e-6
    same = np.full((5, 3), 0.2)  # languages that do not differ
    assert np.isclose(langid.mixture(same, np.ones(5))[1], 5 * np.log(0.2))
