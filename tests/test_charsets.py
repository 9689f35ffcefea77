"""Unmarked charsets: texts of western Europe come back from every encoding."""

import pytest
from pyspark.sql import functions as F

from lexispark.sources import charsets as C

TEXTS = [
    "Voilà l’été déjà fini, œuvre à 12 € – « ça va »", "Größe über Straße, Äpfel und Öl für 5 €", "El niño comió piñas, ¿qué más? Señor Núñez", "Ça coûte 10 £ près d’Évry", "ÉTÉ EN ÎLE-DE-FRANCE", "Dix-sept œufs, cœur et sœur", "“Smith’s” café – naïve façade", "Žižek und Šimko in Žilina", "Ångström, Malmö, Århus", "tiempo: 20 °C mañana",
]


def encodable(text, codec):
    return text.encode(codec, errors="ignore").decode(codec)


@pytest.mark.parametrize(("name", "codec"), [*C.EIGHT_BIT.items(), ("utf-8", "utf-8"), ("utf-16le", "utf-16-le"), ("utf-16be", "utf-16-be"), ("utf-16", "utf-16")])
def test_texts_come_back(spark, name, codec):
    texts = [encodable(t, codec) for t in TEXTS]
    frame = spark.createDataFrame([(k, bytearray(t.encode(codec))) for k, t in enumerate(texts)], "k int, content binary")
    got = {r.k: (r.d.charset, r.d.text) for r in frame.select("k", C.detected(F.col("content")).alias("d")).collect()}
    for k, t in enumerate(texts):
        assert got[k][1] == t
        alike = [n for n, c in C.EIGHT_BIT.items() if t.encode(codec).decode(c, errors="replace") == t]
        assert got[k][0] == ("utf-8" if t.isascii() and name in C.EIGHT_BIT else alike[0] if name in C.EIGHT_BIT else name)


def test_edges(spark):
    rows = [(0, None), (1, bytearray()), (2, bytearray(b"plain")), (3, bytearray("﻿é".encode())), (4, bytearray("aé\n".encode("utf-16-be"))), (5, bytearray(b"\x81\xff"))]
    got = {r.k: r.d and (r.d.charset, r.d.text) for r in spark.createDataFrame(rows, "k int, content binary").select("k", C.detected(F.col("content")).alias("d")).collect()}
    assert got[0] is None and got[1] == ("utf-8", "") and got[2] == ("utf-8", "plain") and got[3] == ("utf-8", "é") and got[4] == ("utf-16be", "aé\n") and got[5][0] in C.EIGHT_BIT


@pytest.mark.parametrize(("text", "name"), [("Oi évian éelleoi.", "macintosh"), ("Erau verteein üieber schung, Und öenge.", "macintosh"), ("DE!! ÉQUEAUX!! ÉANPA!! É!! MENTÈ!! CHÈ!!", "iso-8859-1"), ("and of.\nÓ ñci de osqueas", "iso-8859-1"), ("les re paon. Èonoioi mentieran la.", "macintosh")])
def test_close_readings(spark, text, name):
    raw = bytearray(text.encode(C.EIGHT_BIT[name]))
    got = spark.createDataFrame([(raw,)], "content binary").select(C.detected(F.col("content")).alias("d")).first().d
    assert (got.charset, got.text) == (name, text)


CLOSE = [("t Et çeau çeau çea", "iso-8859-1"), ("Répaaux la éaux pas è les. éaux on éréle.\nUne éaux", "iso-8859-1"), ("! ENSTERÖ,!! EIN", "macintosh"), ("Thorea œahso.29", "macintosh"), ("Und äöach tz", "macintosh"), ("Éaionque", "macintosh"), ("ardo adoí llar.", "macintosh"), ("du. Ê Ê Ê Ê", "macintosh"), ("e se se ó ó ó ó de", "macintosh"), ("as de osíarga.", "macintosh"), ("œahso.29", "iso-8859-15"), ("Ö Ö Ö Ö", "macintosh"), ("l’eau d’hui dell’arte it’s “so” … —", "windows-1252")]


def test_more_close_readings(spark):
    rows = [(k, bytearray(t.encode(C.EIGHT_BIT[name]))) for k, (t, name) in enumerate(CLOSE)]
    got = {r.k: (r.d.text, r.d.charset) for r in spark.createDataFrame(rows, "k int, content binary").select("k", C.detected(F.col("content")).alias("d")).collect()}
    assert [got[k] for k in range(len(CLOSE))] == CLOSE


def test_what_is_repeated_counts_once_and_runs_are_judged_alone():
    texts = ["De De. " + "éoi " * 50 + "l'été", "été", "", "Ûñé"] * 3
    raws = [t.encode("latin-1") for t in texts]
    alone = [C._judged([r])[0] for r in raws if not r.isascii()]
    assert C._judged([r for r in raws if not r.isascii()]) == alone and alone[0] == 0


def test_bytes_are_judged_in_batches(spark):
    rows = spark.createDataFrame([(bytearray(b"\xe9t\xe9"),)], "content binary")
    plan = rows.select(C.detected(F.col("content")).alias("d"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp" not in plan and "translate" not in plan


def test_written_and_read_again(spark):
    rows = spark.createDataFrame([("œuf à 5 €",), ("",), (None,)], "t string")
    for name in ("windows-1252", "iso-8859-15", "macintosh"):
        raw = C.written_as(F.col("t"), name)
        assert [(r.b and bytes(r.b).decode(C.EIGHT_BIT[name]), r.t) for r in rows.select(raw.alias("b"), C.read_as(raw, name).alias("t")).collect()] == [("œuf à 5 €", "œuf à 5 €"), (b"", ""), (None, None)]
