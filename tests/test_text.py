"""Folding, tokens and fuzzy bounds against the standard library."""

import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.functions import text as T


def test_fold_matches_nfd(spark):
    words = ["PARACÉTAMOL", "œuf", "Ñandú", "ÅNGSTRÖM", "é", "", "ß", "Ǆ", "ΆΈ", "Việt Nam"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.fold(F.col("w")).alias("f")).collect()
    for r in rows:
        plain = "".join(c for c in unicodedata.normalize("NFD", r.w) if not "̀" <= c <= "ͯ")
        assert r.f == plain.lower()
        assert T.fold_py(r.w) == plain.lower()


def test_tokens_agree(spark):
    texts = ["a, b", ",a", "a,", "", "x+y=z\tq", "l'eau  d'or\n\nfin.", "5 mg/5 ml"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokens(F.col("t")).alias("x")).collect()
    assert all(r.x == T.tokens_py(r.t) for r in rows)
    assert T.tokens_py(",a") == ["", "a"]


@pytest.mark.parametrize(("size", "most"), [(1, 0), (2, 0), (3, 1), (7, 1), (8, 2), (12, 2), (13, 3), (18, 4), (28, 6), (90, 6)])
def test_max_distance(size, most):
    assert T.max_distance("x" * size) == most
    assert T.max_distance("7" * size) == 0


@given(st.text(max_size=30))
def test_tokens_keep_all_but_separators(value):
    assert "".join(T.tokens_py(value)) == "".join(c for c in value if c not in "\n\r" and unicodedata.category(c)[0] not in "ZP")


def test_fold_agrees_for_every_code_point(spark):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    words = ["".join(chars[k : k + 40]) for k in range(0, len(chars), 40)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").repartition(8).select("w", T.fold(F.col("w")).alias("f")).collect()
    assert [r.w for r in rows if r.f != T.fold_py(r.w)] == []
    for c in chars[:0xF000]:
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not "\u0300" <= x <= "\u036f")
        assert T.fold_py(c) == plain.lower().translate(T._NEWER)


def test_searches_in_hangul_arabic_and_kana(spark):
    from lexispark.operators import search as S

    rows = spark.createDataFrame([(1, "\uac00\ub098\ub2e4 \ub77c"), (2, "\u0622\u0628 \u0628\u0627\u0631\u062f"), (3, "\u304c\u304e"), (4, "plain")], "id long, text string")
    for query, id in (("\uac00\ub098", 1), ("\u0622\u0628", 2), ("\u304c\u304e", 3)):
        assert [r.id for r in S.ranked(rows, "id", ["text"], "text", query).collect()] == [id]
