"""Similarity groups, line dedup, decontamination and search against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lexispark.llm import decontaminate as D
from lexispark.llm import line_dedup as L
from lexispark.llm import linkage
from lexispark.llm import ngram_join as N
from lexispark.llm import topk_search as K
from lexispark.llm.edits import within


def near_texts(seed: int, groups: int = 12) -> list[str]:
    """Random texts with copies at all distances, shared passages, and very short ones."""
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(draw.choices(words, k=40))
    out = ["", "   ", "a", "A", "a b", "a b c", "A b\tc", "...", "é É"]
    for _ in range(groups):
        base = draw.choices(words, k=draw.choice([6, 12, 30, 120, 400]))
        for _ in range(draw.randint(1, 9)):
            own = list(base)
            for _ in range(draw.randint(0, max(1, len(own) // 12))):
                own[draw.randrange(len(own))] = draw.choice(words)
            out.append(" ".join(own) + (" " + passage if draw.random() < 0.3 else ""))
    return out


def classes(n: int, links) -> list[int]:
    union = linkage.Union(n)
    for i, j in links:
        union.join(i, j)
    return [union.find(i) for i in range(n)]


@pytest.mark.parametrize(("n", "num", "block"), [(3, 90, None), (5, 80, None), (5, 80, 1)])
def test_similarity_groups(spark, monkeypatch, n, num, block):
    if block:  # force large groups and keys into block pairs
        monkeypatch.setattr(linkage, "BLOCK_BYTES", 3 * linkage.ITEM_BYTES)
        monkeypatch.setattr(linkage, "BLOCK_ITEMS", 2)
    texts = near_texts(n + num)
    sets = [set(N.shingles(t, n).tolist()) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    assert len(links) > 10
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, n int")
    found = {r.doc_id: r for r in N.similarity_groups(docs, n, num).collect()}
    assert [found[k].component_id for k in range(len(texts))] == classes(len(texts), links)
    assert [found[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    kept = {r.doc_id for r in N.keep_one(docs, n, num).collect()}
    assert kept == set(classes(len(texts), links))


def test_shared_keys(spark):
    draw = random.Random(2)
    keys = [7] * 900 + [-(1 << 63), (1 << 63) - 1] + [draw.randrange(-500, 500) for _ in range(1100)]
    pairs = list(enumerate(draw.sample(keys, len(keys))))
    # small batches, and parts that stay apart
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": "40", "spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        frame = spark.createDataFrame(pairs, "node long, key long").selectExpr("key", "node", "0 as kind")
        found, counted = linkage.shared_keys(frame)
        rows = sorted((r.key, r.node, r.n) for r in found.collect())
        several = Counter(k for _, k in pairs)
        assert rows == sorted((k, node, several[k]) for node, k in pairs if several[k] > 1)
        # the hot key is dealt over many parts, none of which holds much more than its share
        sizes = [r.n for r in counted.where("key = 7").groupBy("part").agg({"n": "max"}).toDF("part", "n").collect()]
        assert len(sizes) > 2 and max(sizes) < 600
        assert linkage.shared_keys(frame.where("false"))[0].count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_tree_prunes_nothing_linked():
    sets = [N.shingles(t, 3) for t in near_texts(5, 40)]
    sets = [s for s in sets if len(s)]
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert classes(len(sets), N.SignatureTree(sets, 80, 100).links()) == classes(len(sets), links)


def test_groups_odd_rows(spark):
    rows = [(1, None), (2, ""), (7, "a b c d"), (7, "a b c d"), (7, "x y z q"), (None, "x y z q"), (5, "x y z q"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in N.similarity_groups(docs, 3, 90).collect())
    assert found == sorted([("1", 0, 1), ("2", 0, 2), ("7", 2, 7), ("7", 2, 7), ("7", 2, 5), ("None", 2, 5), ("5", 2, 5), ("None", 0, None)])
    assert N.similarity_groups(docs.limit(0)).count() == 0


def brute_lines(docs: list[tuple[int, str]]) -> dict[int, str]:
    """By the plain edit distance of all pairs of lines."""
    where = [(d, k, x) for d, t in docs for k, x in enumerate(L.normalised(t)) if x]
    distinct = sorted({x for *_, x in where})
    text = [x.decode() for x in distinct]
    near = [(i, j) for i, j in combinations(range(len(distinct)), 2) if plain_similar(text[i], text[j])]
    group = dict(zip(distinct, classes(len(distinct), near), strict=True))
    seen, gone = set(), set()
    for d, k, x in sorted(where):
        (gone.add((d, k)) if group[x] in seen else seen.add(group[x]))
    assert near
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in docs}


def plain_edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def plain_similar(a: str, b: str) -> bool:
    most = max(len(a), len(b)) * 10 // 100
    lost = sum((Counter(a) - Counter(b)).values()), sum((Counter(b) - Counter(a)).values())
    return max(lost) <= most and plain_edits(a, b) <= most


def test_line_dedup(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK_ITEMS", 3)
    draw = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    base = [draw.choices(words, k=draw.choice([1, 2, 8, 60, 90])) for _ in range(25)]
    lines = []
    for _ in range(200):
        own = list(draw.choice(base))
        if len(own) >= 60:
            for _ in range(draw.randint(0, 2)):
                own[draw.randrange(len(own))] = draw.choice(words)
        lines.append(draw.choice(["{}", "{}.", " {} ", "{}!"]).format(" ".join(own).title() if draw.random() < 0.2 else " ".join(own)))
    docs = [(d, "\n".join(draw.choices(lines + ["", "--"], k=draw.randint(1, 9)))) for d in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in L.dedup_lines(frame).collect()}
    expected = brute_lines(docs)
    for d, text in docs:
        assert found[d].text == expected[d] or (found[d].n_kept == 0 and expected[d] == ""), d
        assert found[d].n_lines == len(text.split("\n"))


def test_line_dedup_recall(spark):
    """Lines with changed words or characters against all pairs of enough edit similarity."""
    draw = random.Random(6)
    words = ["".join(draw.choices("aeioubdfgklmnprst", k=draw.randint(2, 9))) for _ in range(3000)]
    lines = []
    for n in (3, 5, 8, 10, 20, 30, 60) * 8:
        line = " ".join(draw.choices(words, k=n))
        lines.append(line)
        for kind in ("word", "characters"):
            own = line
            for _ in range(draw.randint(1, 1 + n // 4)):
                if kind == "word":
                    changed = own.split()
                    changed[draw.randrange(n)] = draw.choice(words)
                    changed = " ".join(changed)
                else:
                    at = draw.randrange(len(own) - 1)
                    changed = own[:at] + draw.choice(["", "xy", "z"]) + own[at + 1 :]
                own = changed if L.similar(line, changed) else own
            lines.append(own)
    lines = [x.decode() for x in sorted({L.normalised(x)[0] for x in lines})]
    near = [(i, j) for i, j in combinations(range(len(lines)), 2) if plain_similar(lines[i], lines[j])]
    assert len(near) > 60
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = {r.doc_id for r in L.dedup_lines(docs).where("n_kept > 0").collect()}
    whole = classes(len(lines), near)
    assert kept >= set(whole)  # no line goes without a link
    assert len(lines) - len(kept) >= 0.9 * (len(lines) - len(set(whole)))


def test_line_candidates_at_the_edge():
    """Lines with 9 to 10 % of their characters changed share a key and pass their signatures, in each class of length."""
    draw = random.Random(12)
    words = ["".join(draw.choices("aeioubdfgklmnprst", k=draw.randint(2, 9))) for _ in range(3000)]
    for n in (15, 22, 30, 50, 64, 80, 120, 220, 400, 1200):
        found = total = 0
        while total < 400:
            line = " ".join(draw.choices(words, k=n // 4))[:n].strip()
            own = list(line)
            for at in draw.sample(range(len(own)), int(len(own) * draw.uniform(9, 10) / 100)):
                own[at] = draw.choice(["", "z" + own[at], "q"])
            own = "".join(own)
            if not L.similar(line, own):
                continue
            keys, signed = L.sketches([line.encode(), own.encode()])
            signed = np.frombuffer(b"".join(signed), np.uint8).reshape(2, -1)
            may = L.pairs_may_link(signed[:1], signed[1:])[0]
            assert may == (len(L.may_link(signed[:1], signed[1:])[0]) > 0)
            found, total = found + bool(may and set(keys[0]) & set(keys[1])), total + 1
        assert found >= 0.9 * total, (n, found)


def test_sketches_know_their_own_line():
    """Equal lines have equal sketches, whatever lines are sketched with them."""
    draw = random.Random(15)
    lines = ["".join(draw.choices("abcdefgh ij", k=n)).encode() for n in (10, 12, 21, 22, 40, 64, 66, 70, 200, 900) * 4]
    together = L.sketches(lines)
    for k, line in enumerate(lines):
        assert ([together[0][k]], [together[1][k]]) == L.sketches([line]), k


@pytest.mark.parametrize("most", [4, 4096])
def test_line_candidates_by_rounds(spark, monkeypatch, most):
    """No round moves much more than its part of the keys; together they find what all pairs of equal keys give, with hot
    keys cut by size and without."""
    draw = random.Random(16)
    words = ["".join(draw.choices("aeioubdfgklmnprst", k=draw.randint(2, 5))) for _ in range(60)]
    lines = {" ".join(draw.choices(words, k=draw.choice([3, 12, 13, 14, 30]))) for _ in range(300)}
    lines = sorted(lines | {x[:-2] + draw.choice(["q", "zz", ""]) for x in lines for _ in range(2)})
    keys, signed = L.sketches([x.encode() for x in lines])
    rows = [(k, len(lines[k]), keys[k], bytearray(signed[k])) for k in range(len(lines))]
    keyed = spark.createDataFrame(rows, "node long, size int, keys array<long>, data binary")
    moved, by_key = [], linkage._by_key

    def counted(rows, large, *rest):
        moved.append((rows.count(), large.select("node", "step").count() // 2 if large is not None else 0))
        return by_key(rows, large, *rest)

    monkeypatch.setattr(linkage, "_by_key", counted)
    monkeypatch.setattr(linkage, "BLOCK_ITEMS", most)
    found = {r.node: r.component for r in linkage.candidates_by_rounds(keyed, L.pairs_may_link, 0.9, 2, 4).collect()}
    holders = {}
    for k, own in enumerate(keys):
        for key in own:
            holders.setdefault(key, []).append(k)
    own = np.frombuffer(b"".join(signed), np.uint8).reshape(len(lines), -1)
    i, j = np.array(sorted({pair for x in holders.values() for pair in combinations(sorted(set(x)), 2)})).T
    may = L.pairs_may_link(own[i], own[j])
    whole = classes(len(lines), list(zip(i[may].tolist(), j[may].tolist(), strict=True)))
    several = Counter(whole)
    assert found == {k: c for k, c in enumerate(whole) if several[c] > 1}
    assert len(moved) == 4 and any(x[1] for x in moved) == (most == 4)
    assert sum(map(sum, moved)) == sum(map(len, keys)) and max(map(sum, moved)) < 0.4 * sum(map(len, keys))


def test_edits_of_many_pairs():
    """The band of diagonals against the distance of each pair, with alphabets below and beyond its cells."""
    draw = random.Random(5)
    for alphabet in ("ab", "abcdefgh é", "".join(map(chr, range(0x4E00, 0x4E00 + 400)))):
        lines = []
        for n in (1, 3, 20, 64, 65, 130, 300, 600):
            line = "".join(draw.choices(alphabet, k=n))
            lines.append(line)
            for _ in range(4):
                own = list(line)
                for _ in range(draw.randint(0, 1 + n // 8)):
                    at = draw.randrange(len(own))
                    own[at : at + 1] = draw.choice([[], [own[at], draw.choice(alphabet)], [draw.choice(alphabet)]]) or ([] if len(own) > 1 else own[:1])
                lines.append("".join(own))
        i, j = np.triu_indices(len(lines), 1)
        size = np.array([len(x) for x in lines])
        for part in (5, 10, 40):
            most = np.minimum(np.maximum(size[i], size[j]) * part // 100, 63)
            near, exact = within(lines, i, j, most)
            plain = np.array([L.edits(lines[a], lines[b], int(m)) <= m for a, b, m in zip(i, j, most, strict=True)])
            assert exact == (len(alphabet) <= 128)
            assert (near == plain).all() if exact else (near | ~plain).all()


def test_line_links_of_large_groups(monkeypatch):
    """Groups of more lines than go without signatures, by bands and one by one, against all pairs."""
    draw = random.Random(7)
    words = [f"w{k}x" for k in range(400)]
    base = [draw.choices(words, k=draw.choice([20, 40])) for _ in range(6)]
    lines = set()
    while len(lines) < 150:
        own = list(draw.choice(base))
        for _ in range(draw.randint(0, 6)):
            own[draw.randrange(len(own))] = draw.choice(words)
        lines.add(" ".join(own))
    lines = sorted(lines)
    near = [(i, j) for i, j in combinations(range(len(lines)), 2) if L.edits(lines[i], lines[j], most := max(len(lines[i]), len(lines[j])) // 10) <= most]
    for many in (1, 1 << 30):
        monkeypatch.setattr(L, "MANY", many)
        found = list(L.line_links([x.encode() for x in lines]))
        assert set(found) | {(j, i) for i, j in found} <= {*near, *((j, i) for i, j in near)}
        assert classes(len(lines), found) == classes(len(lines), near)


def test_line_dedup_odd_rows(spark):
    rows = [(2, "same line\nown"), (1, "Same line!"), (3, None), (4, ""), (5, "\n\n"), (2, "same line\nown"), (None, "own"), (6, "x" * 50_000 + "\nsame line")]
    docs = spark.createDataFrame([(a, b, "e", 1) for a, b in rows], "doc_id long, text string, __gone string, n_lines int")
    found = sorted((str(r.doc_id), r.text, r.n_lines, r.n_kept) for r in L.dedup_lines(docs).collect() if r.text is not None)
    assert found == sorted([("2", "", 2, 0), ("2", "", 2, 0), ("1", "Same line!", 1, 1), ("4", "", 1, 1), ("5", "\n\n", 3, 3), ("None", "own", 1, 1), ("6", "x" * 50_000, 2, 1)])
    assert L.dedup_lines(docs).columns == ["doc_id", "text", "__gone", "n_lines", "n_kept"]
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_edits():
    draw = random.Random(1)
    for _ in range(500):
        a, b = ("".join(draw.choices("abc", k=draw.randint(0, 12))) for _ in range(2))
        for most in (0, 3, 20):
            assert min(L.edits(a, b, most), most + 1) == min(plain_edits(a, b), most + 1)
    for _ in range(500):
        a, b = (" ".join(draw.choices(("ab", "c", "de"), k=draw.randint(1, 9))) for _ in range(2))
        assert L.word_edits(a, b, 99, 3) >= plain_edits(a, b)


def plain_tiles(item: list, doc: list, least: int) -> int:
    """Words covered by greedy string tiling, by comparing everything."""
    free_a, free_b, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n >= least:
                    best.append((n, i, j))
        if not best:
            return total
        top = max(best)[0]
        for n, i, j in best:
            if n == top and all(free_a[i : i + n]) and all(free_b[j : j + n]):
                free_a[i : i + n] = free_b[j : j + n] = [False] * n
                total += n


def test_tiling():
    draw = random.Random(9)
    for _ in range(60):
        item = draw.choices(range(12), k=draw.randint(5, 30))
        doc = draw.choices(range(12), k=10) + item[15:] + draw.choices(range(12), k=3) + item[:15]
        arrays = [np.array(x, dtype=np.uint64) * np.uint64(7919) for x in (item, doc)]
        found = D.tiles(*arrays, 4)
        assert sum(t[2] for t in found) == plain_tiles(item, doc, 4)
        assert all(item[i : i + n] == doc[j : j + n] for j, i, n in found)


def test_tiling_of_repeats():
    """Long repetitive texts take one pass per tile length."""
    import time

    word = np.full(500, 7, np.uint64)
    start = time.time()
    assert D.tiles(word, np.full(20_000, 7, np.uint64), 5) == [(0, 0, 500)]
    two = np.array([7, 9] * 250 + [1], np.uint64)
    assert sum(t[2] for t in D.tiles(two, np.tile(two[:31], 600), 5)) > 400
    assert time.time() - start < 5


@pytest.mark.parametrize("held", [None, 0])
def test_leaks(spark, monkeypatch, held):
    if held is not None:  # items meet documents by a shuffle
        monkeypatch.setattr(D, "HELD_BYTES", held)
    item = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew some fine purple tea"
    words = item.split()
    docs = [(1, f"before {item.upper()}! after"), (2, " ".join(words[9:] + ["and"] + words[:9])), (3, " ".join(words[:9])), (4, None), (5, ""), (6, "two words"), (7, " ".join(words[::-1])), (None, f"x {item}"), (None, "clean"), (1, "clean"), (2, " ".join(words[9:] + ["and"] + words[:9]))]
    frame = spark.createDataFrame([(a, b, 9, 1) for a, b in docs], "doc_id int, text string, item_id int, h int")
    bench = spark.createDataFrame([(0, item), (1, "two words"), (2, None), (3, "..."), (4, "other text entirely of eight words or so")], "item_id int, text string")
    rows = D.find_leaks(frame.select("doc_id", "text"), bench).collect()
    found = {(r.doc_id, r.item_id): r for r in rows}
    assert sorted(map(str, found)) == sorted(map(str, {(1, 0), (2, 0), (6, 1), (None, 0)})) and len(rows) == 5
    assert found[2, 0].coverage == 1.0 and len(found[2, 0].tiles) == 2
    kept = D.drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("3", docs[2][1]), ("4", ""), ("5", ""), ("7", docs[6][1]), ("None", "clean"), ("1", "clean")])
    assert D.find_leaks(frame, bench.limit(0)).count() == 0 and D.find_leaks(frame.limit(0), bench).count() == 0
    assert D.drop_leaks(frame, bench.limit(0)).count() == len(docs)


def test_leaks_of_whole_tables(spark):
    """The query's rows against plain tiling of every document with every item."""
    draw = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    items = [" ".join(draw.choices(words, k=draw.choice([2, 4, 8, 30, 60]))) for _ in range(12)]
    docs = []
    for k in range(40):
        own = draw.choices(words, k=draw.choice([0, 3, 40, 150]))
        if k % 2:
            part = items[k % len(items)].split()
            cut = draw.randrange(len(part))
            part = part[cut:] + ["between"] + part[:cut] if draw.random() < 0.5 else part[: max(1, len(part) * draw.choice([6, 8, 9, 10]) // 10)]
            own[len(own) // 2 : len(own) // 2] = part
        docs.append((k, " ".join(own)))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = {}
    for k, t in docs:
        for i, u in enumerate(items):
            item = u.split()
            covered = plain_tiles(item, t.split(), min(5, len(item)))
            if 100 * covered >= 80 * len(item):
                expected[k, i] = covered
    found = {(r.doc_id, r.item_id): r.covered for r in D.decontamination(frame, bench).collect()}
    assert found == expected and len(expected) > 10


def test_keep_one_odd_rows(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, near), (3, near), (3, "another text of some seven or more words"), (2, near + " again"), (None, "another text of some seven or more words"), (9, None), (9, ""), (2, near + " again")]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, h int, k int")
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("2", rows[3][1]), ("2", rows[3][1]), ("3", rows[2][1]), ("9", ""), ("9", "")])
    assert N.keep_one(docs.limit(0)).count() == 0


def test_search(spark, monkeypatch):
    for name, value in (("SHARD_DOCS", 20), ("BLOCK_DOCS", 4), ("BLOCK_QUERIES", 3), ("JOB_QUERIES", 4), ("SEEDS", 1), ("WAVE", 2)):
        monkeypatch.setattr(K, name, value)
    draw = random.Random(2)
    texts = [" ".join(draw.choices([f"w{int(k**2)}" for k in range(30)], weights=range(30, 0, -1), k=draw.randint(0, 40))) for _ in range(90)] + [None, "", "W0 w0"]
    docs = list(enumerate(texts)) + [(3, "w0 twice")]
    bags = [K.words(t) for _, t in docs]
    n, mean = len(docs), sum(map(len, bags)) / len(docs)
    df = {w: sum(w in b for b in map(set, bags)) for w in {w for b in bags for w in b}}

    def best(query, k):
        out = []
        for (i, _), b in zip(docs, bags, strict=True):
            s = sum(query.count(w) * np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w in set(query) if w in b)
            if s > 0:
                out.append((-round(s, 6), i))
        return [(i, -s) for s, i in sorted(out)[:k]]

    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = [(k, texts[k]) for k in (0, 10, 20, 30, 91)] + [(99, "nothing here")]
    found = K.search(frame, spark.createDataFrame(asked, "id long, text string"), 5).collect()
    for q, t in asked:
        mine = [(r.doc_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
        assert [m[0] for m in mine] == [b[0] for b in best(K.words(t), 5)]
        assert [m[1] for m in mine] == pytest.approx([b[1] for b in best(K.words(t), 5)], abs=2e-6)
    assert K.search(frame.limit(0), frame.selectExpr("doc_id as id", "text")).count() == 0


def test_size_classes_have_no_end():
    keys = N.Keys(90, 100)
    of = lambda k, n: [(f, x.tolist(), b) for f, x, b in k.of(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
    at = [of(keys, n) for n in (5, 1 << 10)]
    keys._reach(1 << 33)  # beyond any array: the table follows the sets
    assert keys.low[-2] > 1 << 33 and len(keys.parts) >= len(keys.apart)
    assert [of(keys, n) for n in (5, 1 << 10)] == at
    small = N.Keys(90, 100)
    small.low, small.apart, small.parts, small.cells = small.low[:6], small.apart[:4], small.parts[:4], small.cells[:6]
    assert of(small, 100_000) == of(keys, 100_000)


def test_rows_of_keys_that_are_not_hot_meet_no_join(spark, monkeypatch):
    keyed = spark.createDataFrame([(k, 20 + k % 3, [1, 2 + k % 5], bytearray([20 + k % 3, 0, 0, 0] + [1] * 8)) for k in range(40)], "node long, size int, keys array<long>, data binary")
    near = lambda a, b: np.ones(len(a), bool)
    plans, by_key = [], linkage._by_key

    def seen(rows, large, *rest):
        plans.append((rows._jdf.queryExecution().optimizedPlan().toString(), large))
        return by_key(rows, large, *rest)

    monkeypatch.setattr(linkage, "_by_key", seen)
    monkeypatch.setattr(linkage, "BLOCK_ITEMS", 4)
    found = [{r.node: r.component for r in linkage.candidates_by_rounds(keyed, near, 0.9, 2, 3).collect()}]
    assert len(plans) == 3 and all("Join" not in plan and large is not None for plan, large in plans)
    monkeypatch.setattr(linkage, "HOT_LITERALS", 0)
    found.append({r.node: r.component for r in linkage.candidates_by_rounds(keyed, near, 0.9, 2, 3).collect()})
    assert found[0] == found[1] == dict.fromkeys(range(40), 0)
