"""BPE against the tokenizers library, texts of all kinds."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from lexispark.llm import bpe, token_store  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SPEC = open(PATH, encoding="utf-8").read()
ODD = ["", " ", "\n", "a  b", " a", "a ", "x\n\ny z", "it's we'll 'S", "naïve Ünï 東京 \U0001f600", "<|endoftext|>", "a<|endoftext|> b", "\x1ca\x1db\x85c\xa0d  e", "a b   c", "12 345.67%", "q" * 3000, "the, end.\nNext!\r\nLast\t.", "\x00\x7f�", "é a.\n b"]


def ids(x: bytes) -> list[int]:
    return np.frombuffer(x, "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    model = bpe.coder(SPEC)
    assert ids(model.text_ids(text)) == expected == ids(token_store.encoder(SPEC)(text))
    assert model.decode(np.array(expected, dtype=int)).tobytes().decode() == LIBRARY.decode(expected, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'sthe1é\xa0 "), st.characters(codec="utf-8")), max_size=40))
def test_any_text(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(bpe.coder(SPEC).text_ids(text)) == expected == ids(token_store.encoder(SPEC)(text))


def test_other_tokenizers_are_refused():
    import json

    for path, value in ((("pre_tokenizer", "add_prefix_space"), True), (("model", "ignore_merges"), True), (("normalizer",), {"type": "NFC"}), (("added_tokens", 0, "lstrip"), True)):
        spec = json.loads(SPEC)
        at = spec
        for x in path[:-1]:
            at = at[x]
        at[path[-1]] = value
        with pytest.raises(ValueError, match="not a plain"):
            bpe.checked(json.dumps(spec))


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 5)], "doc_id long, text string, token_ids string, c0 int")
    found = bpe.bpe_round_trip(docs, PATH, keep=("doc_id", "token_ids", "c0", "text"))
    assert found.columns == ["doc_id", "c0", "text", "token_ids", "decoded"] and found.first().decoded == "a b"


def test_compatible_pairs_only():
    model = bpe.PrefixCoder(SPEC)
    for word in ("Ġunbelievable", "internationalisation", "aaaaaaaaab"):
        assert ids(model.encode_piece(word)) == model.merged([model.single[c] for c in word])


def test_frames(spark):
    rows = [(1, "a b", "en", 5), (1, "a b", "en", 5), (2, None, None, None), (None, "x", "fr", 1), (3, "é" * 5000, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, __text int")
    found = bpe.bpe_round_trip(docs.select("doc_id", "text"), PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in found) == sorted((a or 0, b or "") for a, b, *_ in rows)
    digest = bpe.bpe_digest(docs, PATH).collect()
    assert {r.ids_sha256 for r in digest if r.n_tokens == 0} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.bpe_digest(docs.limit(0), PATH).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(docs.select("doc_id", "text"), PATH), PATH).collect()
    assert sorted(r.decoded for r in back) == sorted(b or "" for _, b, *_ in rows)


def test_store(spark, tmp_path):
    rows = [(k * 7 % 101 - 20, f"text {k} " * (k % 5)) for k in range(101)] + [(3, "twice"), (None, "nobody"), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    store = token_store.build_store(docs, PATH, str(tmp_path / "store"))
    found = store.read(spark).collect()
    assert len(found) == len(rows)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    one = {r.doc_id: r for r in found}
    for key, text in rows:
        if key is None or key == 3:
            continue
        expected = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
        assert store.get(key).tolist() == expected
        assert one[key].ids_crc32 == zlib.crc32(np.array(expected, "<u4").tobytes()) and one[key].n_tokens == len(expected)
    assert store.get(3) is not None
    assert all(store.get(k) is None for k in (-1000, 101, 499, 10**12))
    assert token_store.build_store(docs.limit(0), PATH, str(tmp_path / "none")).read(spark).count() == 0


def test_store_rows_of_one_key(spark, tmp_path, monkeypatch):
    """A key, and no key, with most of the rows: spread over shards, each row read back through the hash."""
    monkeypatch.setattr(token_store, "shard_count", lambda df: 6)
    rows = [(7, f"text {k % 90}") for k in range(300)] + [(None, "none")] * 40 + [(k, "x " * 2000) for k in range(20)]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, k string, start int").repartition(5)
    store = token_store.build_store(docs, PATH, str(tmp_path / "store"))
    assert len(store.manifest) >= 5 and max(r["docs"] for r in store.manifest) < 150
    found = sorted(store.read(spark).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] * 40 + sorted(k for k, _ in rows if k is not None)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    expected = sorted((k or -1, zlib.crc32(np.array(LIBRARY.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())) for k, t in rows)
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in found) == expected
    first = token_store.Shard(store.folder, store.manifest[0]["shard"])
    assert first.get(None).tolist() == LIBRARY.encode("none", add_special_tokens=False).ids + [2] and first.get(None, 40) is None
    # a wrong index is noticed
    path = f"{tmp_path}/store/shard-{store.manifest[-1]['shard']:06d}.idx"
    raw = bytearray(open(path, "rb").read())
    raw[-8:-4] = bytes(4)
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="lacks a key"):
        store.read(spark).collect()


def test_store_reads_little(spark, tmp_path, monkeypatch):
    """A look-up reads as much of a large index as of a small one."""
    read = []
    monkeypatch.setattr(token_store.Shard, "_at", lambda self, start, size: read.append(size) or self.index.read_at(size, start))
    most = []
    for n in (50, 5000):
        store = token_store.build_store(spark.range(n).selectExpr("id as doc_id", "'t' as text"), PATH, str(tmp_path / str(n)))
        read.clear()
        assert all(store.get(k) is not None for k in range(0, n, n // 50))
        most.append(sum(read) - token_store.HEADER * len(store.open))
    assert most[1] < 2 * most[0] + 1000


def test_folder_without_scheme(spark):
    from lexispark.llm.common import qualified

    assert qualified(spark, "/tmp/x") == "file:///tmp/x" and qualified(spark, "file:///a") == "file:///a"


def test_perfect_hash():
    keys = np.random.default_rng(1).choice(1 << 40, 5000, replace=False).astype(np.uint64)
    turn = np.zeros(len(keys), np.uint64)
    slots = token_store.PerfectHash.build(keys, turn).slots(keys, turn)
    assert sorted(slots) == list(range(len(keys)))
    assert token_store.turns(np.array([0, 0, 0, 4, 4, 5]), 2).tolist() == [1 << 62, (1 << 62) + 1, 0, 0, 1, 0]
