"""Text functions of search: tokens, folded terms, fuzzy bounds. Column expressions only."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of tokens (line ends, Unicode separators and punctuation) and combining marks that are cut.
SEPARATORS = r"[\n\r\p{Z}\p{P}]+"
MARKS = "[̀-ͯ]"


def _stripped(c: str) -> str:
    return re.sub(MARKS, "", unicodedata.normalize("NFD", c))


#: Where syllables of Hangul start and end, and how many medial and final letters follow each other.
FIRST, LAST, MEDIALS, FINALS = 0xAC00, 0xD7A3, 21, 28


def _changed() -> dict[str, str]:
    """Characters that decompose, Hangul aside, without accents."""
    every = (chr(c) for c in range(0x80, 0x110000) if not FIRST <= c <= LAST and not 0xD800 <= c < 0xE000)
    return {c: b for c in every if unicodedata.decomposition(c)[:1] not in ("", "<") and (b := _stripped(c)) != c}


#: Lower case of the letters that Unicode 16 brought, which the JVM knows and older Pythons do not.
_NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}

_ONE = {c: b for c, b in _changed().items() if len(b) == 1}
_NONE = [c for c, b in _changed().items() if not b]
#: What becomes several characters (letters with vowel signs, nuktas, sound marks), by what it ends with and from its first one.
_MORE = {c: b for c, b in _changed().items() if len(b) > 1}


def _ranges(found: list[int], gap: int = 0x80) -> str:
    """A class of few ranges around code points that lie no more than ``gap`` apart: it may hold others too."""
    cuts = [k for k in range(1, len(found)) if found[k] - found[k - 1] > gap]
    return "[" + "".join(f"{chr(found[a])}-{chr(found[b - 1])}" for a, b in zip([0, *cuts], [*cuts, len(found)], strict=True)) + "]"


#: Only text with a character of this class is taken apart character by character.
_ODD = _ranges(sorted([*map(ord, _MORE), *range(FIRST, LAST + 1)]))


def _taken_apart(c: Column) -> Column:
    """One character as several: syllables of Hangul by arithmetic, others by a map."""
    s = F.ascii(c) - FIRST
    letter = lambda start, many, at: F.element_at(F.array(*(F.lit(chr(start + i)) for i in range(many))), at + 1)
    final = F.when(s % FINALS > 0, letter(0x11A8, FINALS - 1, s % FINALS - 1)).otherwise("")
    hangul = F.concat(letter(0x1100, 19, (s / (MEDIALS * FINALS)).cast("int")), letter(0x1161, MEDIALS, (s % (MEDIALS * FINALS) / FINALS).cast("int")), final)
    known = F.create_map(*(F.lit(x) for pair in _MORE.items() for x in pair))
    return F.when(c.between(chr(FIRST), chr(LAST)), hangul).otherwise(F.coalesce(F.try_element_at(known, c), c))


def fold(value: Column) -> Column:
    """Without accents, in lower case. Text without characters that become several is folded by one translation."""
    apart = F.when(value.rlike(_ODD), F.array_join(F.transform(F.split(value, ""), _taken_apart), "")).otherwise(value)
    plain = F.translate(apart, "".join(_ONE) + "".join(_NONE), "".join(_ONE.values()))
    return F.lower(F.regexp_replace(plain, MARKS, ""))


def fold_py(value: str) -> str:
    """``fold`` of a string: character by character, as columns are, so that both agree whatever the order of marks."""
    return "".join(map(_stripped, value)).lower().translate(_NEWER)


def tokens(value: Column) -> Column:
    """Raw tokens; separators at the ends give empty tokens."""
    return F.split(value, SEPARATORS, -1)


def tokens_py(value: str) -> list[str]:
    out, word = [], []
    split = [c in "\n\r" or unicodedata.category(c)[0] in "ZP" for c in value]
    for k, c in enumerate(value):
        if not split[k]:
            word.append(c)
        elif k == 0 or not split[k - 1]:
            out.append("".join(word))
            word = []
    return [*out, "".join(word)]


def max_distance(term: str, share: float = 0.2, most: int = 6) -> int:
    """Edits that a fuzzy match of a folded term may have: none for all-digit terms."""
    return 0 if re.fullmatch("[0-9]+", term) else min(most, int(share * len(term) + 0.5))
