"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a pre-token has exactly one *last token* in its BPE encoding. A multi-pattern suffix automaton over
the vocabulary lists, for each position, the tokens that are suffixes of the prefix; such a token is the last one iff
the pair of it and the last token of the prefix before it is *compatible*, that is, BPE would not merge across their
border. Following the back-pointers from the full prefix gives the exact ids. Vocabularies are read, never trained.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# The byte-level pre-tokenizer's split pattern, with white space as Unicode's White_Space property.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}

#: Entries of a generation of each worker's caches, of which there are two; results do not depend on it.
CACHE = 250_000
#: Remembered tests of pairs at most; one costs more than a whole word.
PAIRS = 600_000
#: A pair of ids is remembered as one number.
ID_BITS = 20
_coders: dict[int, "PrefixCoder"] = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def checked(spec: str) -> dict:
    """A ``tokenizer.json`` of the kind that this module encodes; ValueError for any other."""
    found = json.loads(spec)
    model, cut = found["model"], found.get("pre_tokenizer") or {}
    odd = {
        "model": model.get("type", "BPE") != "BPE",
        "normalizer": found.get("normalizer") is not None,
        "pre-tokenizer": cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") is not False or cut.get("use_regex", True) is not True,
        "decoder": (found.get("decoder") or {}).get("type") != "ByteLevel",
        "model options": any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added tokens": any(t.get(x) for t in found.get("added_tokens", []) for x in ("single_word", "lstrip", "rstrip")),
        "number of ids": max([*model["vocab"].values(), *(t["id"] for t in found.get("added_tokens", []))], default=0) >= 1 << ID_BITS,
    }
    if any(odd.values()):
        raise ValueError(f"not a plain byte-level BPE: {', '.join(k for k, v in odd.items() if v)}")
    return found


def letters_only(text: str) -> bool:
    """Whether a text is Latin letters throughout, on which all versions of Unicode agree."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0250")


class PieceCache(dict):
    """Chunk (what stands between single spaces) -> little-endian ids, or None where a chunk borders on white space.

    A chunk begins with a line end where one stands before it instead of a space, and with nothing at a text's start
    (``heads``). Single line ends between non-spaces, and signs after letters, are pre-tokens of their own, so chunks are
    put together from the parts between them, which repeat more often."""

    #: ASCII signs that make one pre-token together; an apostrophe may begin one of its own.
    SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")

    def __init__(self, encode, prefix: str, size: int, heads: "PieceCache | None" = None):
        super().__init__()
        self.encode, self.prefix, self.size, self.older = encode, prefix, size, {}
        self.heads, self.tails, self.line_end = (self if heads is None else heads), {}, encode("\n")

    def __missing__(self, chunk: str):
        found = self.older.get(chunk)
        if found is None:
            found = self.fresh(chunk)
        if len(chunk) <= 24:
            if len(self) >= self.size:  # the full generation becomes the older one; what is still in use comes back from it
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def tail(self, signs: str) -> bytes:
        if (found := self.tails.get(signs)) is None:
            found = self.encode(signs)
            if len(self.tails) < 4096 and len(signs) <= 16:
                self.tails[signs] = found
        return found

    def fresh(self, chunk: str):
        if chunk[:1] == "\n":
            rest = self.heads[chunk[1:]]
            return None if rest is None else self.line_end + rest
        if not chunk or chunk[0] in SPACES or chunk[-1] in SPACES:
            return None
        if len(head := chunk.rstrip(self.SIGNS)) < len(chunk) and letters_only(head):
            return self[head] + self.tail(chunk[len(head) :])
        return self.encode(self.prefix + chunk)


class ChunkedEncoder:
    """Splits texts where a single space or line end stands between non-spaces: the pre-tokenizer always splits there, so
    the encoding of a chunk does not depend on its neighbours. Special tokens are cut out first, as the library does."""

    def __init__(self, special: dict[str, int], encode, size: int = CACHE):
        import regex

        self.special, self.encode = special, encode
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.heads = PieceCache(encode, "", size)
        self.chunks = PieceCache(encode, " ", size, self.heads)

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is not None and any(s in text for s in self.special):
            out, at = [], 0
            for hit in self.cut.finditer(text):
                out += [self.plain(text[at : hit.start()]), np.uint32(self.special[hit[0]]).tobytes()]
                at = hit.end()
            return b"".join([*out, self.plain(text[at:])])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            return b"".join([self.heads[first], *map(self.chunks.__getitem__, rest)])
        except TypeError:  # a chunk borders on white space
            return self.encode(text)


class PrefixCoder:
    """Exact BPE of a byte-level ``tokenizer.json`` by the per-prefix recurrence."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        spec = checked(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.split = regex.compile(SPLIT)
        letters = byte_letters()
        self.to_letters = {b: c for b, c in enumerate(letters)}
        self.space = letters[0x20]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.single = {c: vocab[c] for c in letters if c in vocab}
        self.word = {i: t for t, i in vocab.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text_ids = ChunkedEncoder(special, self.encode_text)
        size = max([*vocab.values(), *special.values()], default=-1) + 1
        back = {c: b for b, c in enumerate(letters)}
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            raw[i] = token.encode()
        self.lengths = np.array([len(x) for x in raw], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def merged(self, ids: list[int]) -> list[int]:
        """Plain BPE of a few ids by lowest rank first: the test of one pair."""
        ids, rank = list(ids), self.rank
        while len(ids) > 1:
            best = min((rank.get(p, (1 << 60, 0)) + (k,) for k, p in enumerate(zip(ids, ids[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            ids[best[2] : best[2] + 2] = [best[1]]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        key = left << ID_BITS | right
        if (known := self.pairs.get(key)) is None:
            known = self.merged([self.single[c] for c in self.word[left] + self.word[right]]) == [left, right]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_piece(self, letters: str) -> bytes:
        """Ids of one pre-token, given in byte letters."""
        n = len(letters)
        last, came = [-1] * (n + 1), [0] * (n + 1)
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(letters):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                if (before := last[start]) < 0:
                    continue
                if (fits := pairs.get(before << ID_BITS | token)) is None:
                    fits = self.compatible(before, token)
                if not fits:
                    continue
            last[end], came[end] = token, start
        ids, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            ids.append(last[at])
            at = came[at]
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def encode_text(self, text: str) -> bytes:
        word = text[1:] if text[:1] == " " else text
        if word.isascii() and word.isalpha():  # one pre-token, whose bytes stand for themselves
            return self.encode_piece(f"{self.space}{word}" if word is not text else word)
        if letters_only(word):  # one pre-token
            return self.encode_piece(text.encode().decode("latin-1").translate(self.to_letters))
        out, pieces = [], self.pieces
        for piece in self.split.findall(text):
            if (ids := pieces.get(piece)) is None:
                ids = self.encode_piece(piece.encode().decode("latin-1").translate(self.to_letters))
                if len(piece) <= 32:
                    if len(pieces) >= CACHE:
                        pieces.clear()
                    pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids, as an array."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        at += np.arange(total)
        return self.flat[at]


def coder(spec: str) -> PrefixCoder:
    """One coder per Python worker and vocabulary."""
    key = hash(spec)
    if key not in _coders:
        _coders.clear()
        _coders[key] = PrefixCoder(spec)
    return _coders[key]


def _strings(raw: list[bytes]) -> pa.Array:
    return pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())


def _round_trip(spec: str, n: int):
    def make():
        model = coder(spec)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            encoded = [model.text_ids(x or "") for x in batch.column("t").to_pylist()]
            counts = np.array([len(x) // 4 for x in encoded], dtype=np.int64)
            ids = np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int32)
            offsets = np.zeros(len(counts) + 1, dtype=np.int32)
            np.cumsum(counts, out=offsets[1:])
            decoded = [model.decode(ids[offsets[k] : offsets[k + 1]]).tobytes() for k in range(len(counts))]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), lists, _strings(decoded)], [*(f"c{k}" for k in range(n)), "token_ids", "decoded"])

        return apply

    return make


def _kept(df: DataFrame, keep: tuple[str, ...], results: tuple[str, ...], value) -> tuple[DataFrame, list[str], str]:
    """Columns of ``keep`` by number and ``value`` as ``t``, their names, and the schema of the former: no name clashes,
    and a kept column with the name of a result is left out."""
    names = [c for c in dict.fromkeys(keep) if c not in results]
    source = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), value.alias("t"))
    return source, names, "".join(f"{c} {t}, " for c, t in source.dtypes if c != "t")


def _spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = f.read()  # travels with the plan: executors need no local copy
    checked(spec)
    return spec


def bpe_round_trip(df: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of ``keep`` plus ``token_ids array<int>`` and ``decoded string`` of every whole text.

    Null texts count as empty (no ids, empty string). Rows are never merged, so ties and repeated rows stay; other
    columns, whatever their names, are pruned before the scan, and a column of ``keep`` named like a result is left
    out. An empty table gives no rows. One narrow stage. ValueError for a tokenizer of another kind.
    """
    source, names, schema = _kept(df, keep, ("token_ids", "decoded"), F.col(f"`{text}`").cast("string"))
    return map_arrow(source, _round_trip(_spec(tokenizer_path), len(names)), f"{schema}token_ids array<int>, decoded string").toDF(*names, "token_ids", "decoded")


def bpe_encode(df: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return bpe_round_trip(df, tokenizer_path, text, keep).drop("decoded")


def bpe_decode(df: DataFrame, tokenizer_path: str, ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of ``keep`` plus ``decoded``; null id lists decode to the empty string."""
    spec = _spec(tokenizer_path)
    source, names, schema = _kept(df, keep, ("decoded",), F.col(f"`{ids}`").cast("array<int>"))

    def make():
        model = coder(spec)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [model.decode(np.array(x or [], dtype=np.int64)).tobytes() for x in batch.column("t").to_pylist()]
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), _strings(raw)], [*(f"c{k}" for k in range(len(names))), "decoded"])

        return apply

    return map_arrow(source, make, f"{schema}decoded string").toDF(*names, "decoded")


def bpe_digest(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """The digest of op1: counts and SHA-256 of ids and of the decoded text."""
    trip = bpe_round_trip(df, tokenizer_path)
    return trip.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
