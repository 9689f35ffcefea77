"""Charsets of unmarked text, by what its bytes make of it.

Valid UTF-8 is UTF-8. UTF-16 without a mark shows in zero bytes, and which half they are in. Among the 8-bit charsets of
western Europe, which share all of ASCII, the one is taken whose reading of the other bytes makes most sense: letters
that go with the case of their neighbours and quotes where quotes stand count for it, signs within words, capitals after
small letters and control characters against it. Readings that give the same text have the first one's name.

Only the other bytes and their neighbours are judged, those of a batch of rows at once, by tables of kinds of characters.
"""

from __future__ import annotations

import codecs
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names, and the codecs that their tables come from, in order of preference.
EIGHT_BIT = {"iso-8859-1": "latin-1", "windows-1252": "cp1252", "iso-8859-15": "iso8859-15", "macintosh": "mac_roman"}

#: Share of zero bytes from which bytes of even length are UTF-16.
ZEROS = 0.1


def table(codec: str) -> str:
    """Characters of the 256 bytes of a codec; bytes it does not know are those of ISO-8859-1."""
    return "".join(bytes([b]).decode(codec, errors="ignore") or chr(b) for b in range(256))


TABLES = {name: table(codec) for name, codec in EIGHT_BIT.items()}

#: What stands before and behind a text, beside its 256 bytes; zeros stand for it, five between texts.
OUTSIDE = 256


#: Letters that these charsets have as signs.
SIGNS = "ƒΩπµ"


class _Kinds:
    """Of one charset, kinds of characters by byte."""

    def __init__(self, chars: str):
        kind = [unicodedata.category(c) for c in chars] + ["outside"]
        of = lambda test: np.array([test(k, c) for k, c in zip(kind, [*chars, ""], strict=True)])
        self.small, self.large = of(lambda k, c: k == "Ll" and c not in SIGNS), of(lambda k, c: k == "Lu" and c not in SIGNS)
        self.letter, self.sign = of(lambda k, c: k[0] == "L" and c not in SIGNS), of(lambda k, c: k[0] == "S" or k == "No" or c != "" and c in SIGNS)
        self.number, self.mark = of(lambda k, c: k[0] == "N"), of(lambda k, c: k[0] == "P")
        self.odd = of(lambda k, c: "\x7f" < c not in "€£°©®™" and (k[0] == "S" or k in ("No", "Lo") or c in SIGNS))
        self.word, self.control = of(lambda k, c: "\x7f" < c not in "ªº" + SIGNS and k[0] == "L"), of(lambda k, c: "\x80" <= c <= "\x9f")
        among = lambda members: of(lambda k, c: c != "" and c in members)
        self.space, self.digit, self.ends, self.close, self.plural = map(among, (" \t\n\x0b\f\r", "0123456789", ".!?", "\"')]»”’", "sS"))
        self.apostrophe, self.opening, self.closing, self.guillemet, self.dash, self.dots, self.low, self.closing_low = map(among, ("’", "“‘«„", "”’»", "»", "–—", "…", "„", "“”"))
        # letters before and behind an apostrophe: l’été, qu’il, dell’arte, O’Neill, it’s, they’ll, we’re; d’hui
        self.elided, self.d, self.pair, self.u, self.q, self.before_h, self.h = map(among, ("cdjlmnstyCDJLMNSTYO", "dD", "lL", "uU", "qQ", "cdCD", "hH"))
        self.ending, self.stem, self.e = map(among, ("stdmSTDM", "rvRV", "eE"))
        self.inner = among("ÏË")  # stand within words
        self.unit, self.money, self.carons, self.caron, self.rare = map(among, ("€£°", "€£", "ŠŽšž", "šž", "ŠšŽžŸÿ"))


_KINDS = [_Kinds(chars) for chars in TABLES.values()]


def sense(kinds: _Kinds, own: np.ndarray, p2: np.ndarray, p: np.ndarray, c: np.ndarray, n: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """What each of the bytes ``c`` of texts ``own`` is worth, by the two before and behind it."""
    small, large, letter = kinds.small[c], kinds.large[c], kinds.letter[c]
    small_p, small_n, large_p, letter_p, letter_n = kinds.small[p], kinds.small[n], kinds.large[p], kinds.letter[p], kinds.letter[n]
    worded_p, worded_n, space_p, space_n = letter_p | kinds.number[p], letter_n | kinds.number[n], kinds.space[p], kinds.space[n]
    first, alone = (p == OUTSIDE) | (kinds.ends[p2] & space_p), ~letter_p & ~letter_n
    value = np.zeros(len(c), np.int32)
    value += 2 * (small & (small_p | small_n))
    value += 2 * (large & ((~worded_p & small_n) | (large_p & ~small_n) | (~letter_p & kinds.large[n])))
    value += first & large & (small_n | alone)
    value -= large & ~first & ~letter_p & small_n & ~kinds.rare[c]
    value += kinds.word[c] & alone
    value -= 3 * (large & (small_p | (large_p & small_n)))
    elided = (kinds.elided[p] & ~kinds.letter[p2] & (~kinds.d[p] | kinds.letter[n2])) | (kinds.pair[p] & (p2 == p)) | (kinds.u[p] & kinds.q[p2]) | (kinds.before_h[p] & kinds.h[n])
    ending = (kinds.ending[n] & ~kinds.letter[n2]) | (kinds.pair[n] & (n2 == n)) | (kinds.stem[n] & kinds.e[n2])
    value += (1 + (elided | ending)) * (kinds.apostrophe[c] & letter_p & letter_n)
    closing = (worded_p | kinds.mark[p]) & ~worded_n
    closed = (np.bincount(own, kinds.closing_low[c]) > 0)[own]
    value += 3 * (kinds.opening[c] & ~worded_p & (worded_n | space_n) & (closed | ~kinds.low[c]))
    value += np.where(kinds.apostrophe[c], 1 + kinds.plural[p], 2) * ((kinds.closing[c] & closing) | (kinds.guillemet[c] & space_p & ~worded_n))
    value += 2 * ((kinds.unit[c] & (kinds.digit[p] | space_p) & ~letter_n) | (kinds.money[c] & kinds.digit[n]))
    value += 2 * (kinds.dash[c] & space_p & space_n & (p2 != c) & (n2 != c))
    value += kinds.dots[c] * (1 + (space_n | (n == OUTSIDE) | kinds.close[n]) - 2 * letter_n) * ((p2 != c) & (n2 != c))
    value += 4 * (kinds.caron[c] & letter_p & kinds.carons[p2])
    value -= kinds.rare[c] | (kinds.inner[c] & ~letter_p & small_n)
    value -= 5 * kinds.control[c]
    value -= 3 * (kinds.sign[c] & letter_p & letter_n)
    value -= kinds.odd[c]
    return value


def _judged(raws: list[bytes]) -> list[int]:
    """Numbers of the charsets whose reading makes most sense; of equal sense, the first. What stands in a text several
    times, with the same neighbours, counts once."""
    size = np.array([len(x) for x in raws], np.int64)
    start = np.cumsum(size + 2) - size
    bytes_ = np.frombuffer(b"\0\0" + b"\0\0".join(raws) + b"\0\0", np.uint8)
    at = np.flatnonzero(bytes_ >= 0x80)
    own = np.searchsorted(start, at, side="right") - 1
    context = []
    for by in range(-2, 3):
        place = at + by
        inside = (place >= start[own]) & (place < start[own] + size[own])
        context.append(np.where(inside, bytes_[place], np.uint8(0)).astype(np.int64) + np.where(inside, 0, OUTSIDE))
    key = own
    for x in context:
        key = key << 9 | x
    once = np.unique(key, return_index=True)[1]
    own, context = own[once], [x[once] for x in context]
    return np.array([np.bincount(own, sense(k, own, *context), len(raws)) for k in _KINDS]).argmax(axis=0).tolist()


def _read(raw: bytes | None) -> tuple[str | None, str | None]:
    """Charset and text of what is no text of one of the 8-bit charsets; else nothing."""
    if raw is None:
        return None, None
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16", raw.decode("utf-16", "replace").removeprefix("\ufeff")
    zeros = raw.count(0)
    if raw and len(raw) % 2 == 0 and zeros >= ZEROS * len(raw):
        name = "utf-16le" if 2 * raw[1::2].count(0) >= zeros else "utf-16be"
        return name, raw.decode(name, "replace")
    try:
        return "utf-8", raw.decode().removeprefix("\ufeff")
    except UnicodeDecodeError:
        return None, None


#: Bytes that are judged together: a place takes some hundred.
RUN_BYTES = 1 << 22


def _detect(content: pa.Array) -> pa.Array:
    names, texts, waiting, held = [], [], [], 0

    def settle() -> None:
        nonlocal held
        if waiting:
            for (k, raw), best in zip(waiting, _judged([raw for _, raw in waiting]), strict=True):
                names[k], texts[k] = list(TABLES)[best], codecs.charmap_decode(raw, "strict", TABLES[list(TABLES)[best]])[0]
        waiting.clear()
        held = 0

    for k, value in enumerate(content):
        raw = value.as_py()
        name, text = _read(raw)
        names.append(name)
        texts.append(text)
        if raw is not None and name is None:
            waiting.append((k, raw))
            held += len(raw)
            if held > RUN_BYTES:
                settle()
    settle()
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["charset", "text"], mask=content.is_null())


def detected(content: Column) -> Column:
    """``struct<charset string, text string>`` of bytes: UTF-16 and UTF-8 marks are cut, null is null, empty is UTF-8. Text
    that is ASCII alone is UTF-8."""
    return F.arrow_udf(_detect, "charset string, text string")(content)


def _read_all(raws: pa.Array, name: str) -> pa.Array:
    return pa.array([None if x is None else codecs.charmap_decode(x, "strict", TABLES[name])[0] for x in raws.to_pylist()], pa.string())


def _write_all(texts: pa.Array, name: str) -> pa.Array:
    places = codecs.charmap_build(TABLES[name])
    return pa.array([None if x is None else codecs.charmap_encode(x, "strict", places)[0] for x in texts.to_pylist()], pa.binary())


def read_as(content: Column, name: str) -> Column:
    """Bytes as text of one of the 8-bit charsets."""
    return F.arrow_udf(lambda raws: _read_all(raws, name), "string")(content)


def written_as(text: Column, name: str) -> Column:
    """Text as bytes of one of the 8-bit charsets, which must have all its characters."""
    return F.arrow_udf(lambda texts: _write_all(texts, name), "binary")(text)
