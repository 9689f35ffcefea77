"""Scans, nested details, pages, ranked search and ingest on small files."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexispark.operators import relational as R
from lexispark.operators import search as S
from lexispark.plans.engine import Engine
from lexispark.sources import ingest, tsv
from lexispark.sources.registry import DATASETS
from lexispark.sources.shared import load_snapshot, save_snapshot
from lexispark.streaming.refresh import refresh

DRUGS = [
    '60234100\tDOLIPRANE 1000 mg, comprimé\tcomprimé\torale\tAutorisation active\tP\tCommercialisée\t01/01/2000\t\t\t SANOFI \tNon',
    "61155773\tCLAMOXYL 125 mg/5 ml\tpoudre",
    "",
    '60000001\tDOLI "special"\tgel\t\t',
    "60234100\tDOLIPRANE second",
    "60000002\tTRAMADOL\tgélule\t\t\t\t\t\t\t\t\tNon\tsurplus",
]
FILES = {
    "CIS_bdpm.txt": "\r\n".join(DRUGS),
    "CIS_CIP_bdpm.txt": "60234100\t1111111\tplaquette\n60234100\t2222222\tflacon\n61155773\t3333333\tflacon doli\n",
    "CIS_COMPO_bdpm.txt": "60234100\tcomprimé\t02202\tPARACÉTAMOL\t1000 mg\n60000001\tgel\t02202\tPARACETAMOL AUTRE\n60000001\tgel\t02202\tx\n60000002\tg\t\tSANS CODE\n61155773\tp\t777\tAMOXICILLINE\n",
    "CIS_GENER_bdpm.txt": "145\tAMOXICILLINE 125\t61155773\t0\t1\n146\tAUTRE\t61155773\t0\t1\n145\tAMOXICILLINE 125\t60000002\t1\t2\n",
    "CIS_CPD_bdpm.txt": "60000002\tliste I\n60000002\tprescription limitée à 12 semaines\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    for name, text in FILES.items():
        (folder / name).write_bytes(text.encode("cp1252" if name == "CIS_CPD_bdpm.txt" else "utf-8"))
    return Engine(spark, str(folder))


def test_scan(engine):
    rows = engine.table("specialites").orderBy("_pos").collect()
    assert [r.cis for r in rows] == ["60234100", "61155773", "60000001", "60234100", "60000002"]
    assert rows[0].titulaire == "SANOFI" and rows[0].statut_bdm == "" and rows[1].voies_admin is None
    assert rows[2].denomination == 'DOLI "special"' and rows[2].statut_amm == "" and rows[2].type_amm is None
    assert rows[4].surveillance_renforcee == "Non"
    assert engine.table("ruptures").count() == 0
    assert [r.condition for r in engine.table("conditions").orderBy("_pos").collect()][1] == "prescription limitée à 12 semaines"
    with pytest.raises(KeyError):
        engine.table("infos")


def test_scan_large(spark, tmp_path):
    (tmp_path / "f.txt").write_text("a\tb\n\nc\n\xa0d \t e")
    rows = tsv.scan_large(spark, str(tmp_path / "f.txt"), DATASETS["conditions"]).orderBy("_pos").collect()
    assert [(r.cis, r.condition) for r in rows] == [("a", "b"), ("c", None), ("\xa0d", "e")]


def test_detail(engine):
    found = engine.detail("60234100")
    assert found["denomination"].startswith("DOLIPRANE 1000") and found["generiques"] is None
    assert [p["cip7"] for p in found["presentations"]] == ["1111111", "2222222"] and found["avis_smr"] == []
    assert engine.detail("00000000") is None
    group = engine.detail("61155773")["generiques"]
    assert group["id_groupe"] == "145" and [i["cis"] for i in group["items"]] == ["61155773", "60000002"]


def test_substances(engine):
    rows = {r.code: r for r in engine.table("substances").collect()}
    assert set(rows) == {"02202", "777"} and rows["02202"].denomination == "PARACÉTAMOL" and rows["02202"].medicaments_count == 3


def test_search(engine, tmp_path):
    first = lambda q: engine.list("specialites", q).data[0]["denomination"]
    assert first("doli").startswith("DOLI") and first("dolipranr").startswith("DOLIPRANE")
    assert engine.list("specialites", "60234100").data[0]["cis"] == "60234100"
    assert engine.list("compositions", "paracetamol").pagination["total"] == 2
    assert engine.list("specialites", "  ").data == [] and engine.list("specialites").pagination["total"] == 5
    assert engine.list("specialites", "60234101").data == []
    tagged = engine.search_all("doli")
    assert [r["type"] for r in tagged.data][0] == "specialite" and {r["type"] for r in tagged.data} == {"specialite", "presentation"}
    with pytest.raises(ValueError):
        engine.search_all("")
    with pytest.raises(TypeError):
        engine.search("specialites", ["a"])
    rows = engine.table("specialites")
    read = S.in_rank(S.ranked(rows, "_pos", list(DATASETS["specialites"].indexed), "denomination", "doli tramadol"), "_pos")
    assert [r.cis for r in read.collect()] == [r["cis"] for r in engine.list("specialites", "doli tramadol").data]


def test_pages(engine):
    pages = [engine.list("specialites", page=k, limit=2) for k in (1, 2, 3, 4)]
    assert [len(p.data) for p in pages] == [2, 2, 1, 0] and pages[0].pagination == {"total": 5, "page": 1, "limit": 2, "pages": 3}
    assert "voies_admin" not in json.loads(pages[0].json())["data"][1]
    assert json.loads(engine.health(pretty=True))["source"] == "CIS_bdpm.txt"
    with pytest.raises(ValueError):
        engine.list("specialites", page=0)


@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages(spark, monkeypatch, descending):
    rows = spark.range(1000).selectExpr("id % 37 as k", "id", "repeat('x', 5) as __row")
    order = [F.desc("k") if descending else F.col("k"), "id"]
    whole = [r.id for r in rows.orderBy(*order).collect()]
    monkeypatch.setattr(R, "TOP_ROWS", 0)
    for number, limit in ((1, 7), (20, 7), (3, 400), (143, 7), (1, 5000)):
        page = R.page(rows, order, number, limit)
        assert page.columns == rows.columns
        assert [r.id for r in page.collect()] == whole[(number - 1) * limit : number * limit]
    assert R.page(rows, order, 40_000_001, 25).count() == 0 and R.page(rows.limit(0), order, 1, 5).count() == 0


def test_detail_json(engine):
    found = json.loads(engine.detail_json("60234100"))
    assert found["generiques"] is None and found["presentations"][0] == {"cis": "60234100", "cip7": "1111111", "libelle": "plaquette"}
    assert engine.detail_json("00000000") is None


def test_reload(spark, tmp_path):
    (tmp_path / "CIS_bdpm.txt").write_text("1\tone")
    engine = Engine(spark, str(tmp_path))
    assert engine.list("specialites").pagination["total"] == 1
    (tmp_path / "CIS_bdpm.txt").write_text("1\tone\n2\ttwo")
    assert engine.list("specialites").pagination["total"] == 1 and engine.list("specialites", "two").data == []
    held = engine.table("specialites")
    assert engine.reload().list("specialites", "two").pagination["total"] == 1
    assert held.count() == 1 and engine.table("specialites").count() == 2
    assert engine.reload().list("specialites").pagination["total"] == 2


def test_charsets(spark):
    raw = ["déjà – vu".encode(x) for x in ("utf-8", "utf-16", "cp1252")] + ["déjà".encode("latin-1"), b"\x81\xe9", b""]
    rows = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(raw)], "k int, content binary")
    found = {r.k: (r.t, r.c) for r in rows.select("k", tsv.decode(F.col("content")).alias("t"), tsv.encoding_name(F.col("content")).alias("c")).collect()}
    assert found == {0: ("déjà – vu", "utf-8"), 1: ("déjà – vu", "utf-16"), 2: ("déjà – vu", "windows-1252"), 3: ("déjà", "iso-8859-1"), 4: ("\x81é", "windows-1252"), 5: ("", "utf-8")}
    for k, x in enumerate(raw):
        text, name = ingest.normalised(x)
        assert (text.decode(), name) == found[k]


def test_manifest_outlives_a_crash(tmp_path):
    class Stop(BaseException):
        pass

    def get(source, name):
        if name == "CIS_COMPO_bdpm.txt":
            raise Stop
        return b"x"

    with pytest.raises(Stop):
        ingest.refresh("s", str(tmp_path), datetime(2024, 1, 1, tzinfo=UTC), get)
    assert set(ingest.load_manifest(tmp_path)) == {"CIS_bdpm.txt", "CIS_CIP_bdpm.txt"}


def test_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    with pytest.raises(FileNotFoundError):
        load_snapshot(spark, folder)
    for n in (3, 5):
        save_snapshot(spark.range(n), folder)
        assert load_snapshot(spark, folder).count() == n


def test_ingest(tmp_path):
    source, target, now = tmp_path / "s", tmp_path / "t", datetime(2024, 1, 1, tzinfo=UTC)
    source.mkdir()
    for name, text in FILES.items():
        (source / name).write_bytes(text.encode("cp1252"))
    assert ingest.refresh(str(source), str(target), now)["CIS_bdpm.txt"] == "written"
    assert "comprimé" in (target / "CIS_bdpm.txt").read_text(encoding="utf-8")
    assert ingest.refresh(str(source), str(target), now + timedelta(hours=1))["CIS_bdpm.txt"] == "fresh"
    (source / "CIS_CPD_bdpm.txt").write_text("x\ty")
    later = ingest.refresh(str(source), str(target), now + timedelta(hours=25))
    assert later["CIS_bdpm.txt"] == "same" and later["CIS_CPD_bdpm.txt"] == "written" and later["CIS_MITM.txt"] == "failed"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1\tx\n2\ty")
    for k in range(2):
        refresh(spark, str(tmp_path / "in"), DATASETS["conditions"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2 + k
        (tmp_path / "in" / "b.txt").write_text("3\tz")


def test_union_and_empty(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2,)], "k int")
    assert [(r.type, r.k, r.v) for r in R.tagged_union([("a", a), ("b", b)]).orderBy("_src").collect()] == [("a", 1, "x"), ("b", 2, None)]
    assert R.page_info(a.limit(0)).first().pages == 0


@pytest.mark.parametrize("charset", ["utf-8", "latin-1", "utf-8-sig"])
def test_splits_number_lines_without_gaps(spark, tmp_path, charset):
    from pyspark.sql import functions as F

    folder = tmp_path / "CIS_bdpm.txt"
    folder.mkdir()
    lines = [f"{k}\tdéjà {'x' * (k % 50)}" for k in range(4000)]
    for part in range(3):
        own = lines[part * 1000 :: 1][: 1000 if part < 2 else 2000]
        (folder / f"part-{part}.txt").write_bytes("".join(x + ("\r\n" if k % 3 else "\n\n") for k, x in enumerate(own)).encode(charset))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = tsv.scan(spark, str(folder), DATASETS["specialites"])
        assert rows.rdd.getNumPartitions() > 10
        got = sorted((r._pos, r.cis, r.denomination) for r in rows.collect())
        assert rows.groupBy("denomination").agg(F.count("*")).count() == 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(k, *map(str.strip, x.split("\t"))) for k, x in enumerate(lines)]
