"""The data source of registry files: folders, a web server, failures, streams."""

import hashlib
import json
import threading
import time
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lexispark.sources import tsv
from lexispark.sources.folder_source import RegistryFiles, location


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(RegistryFiles)
    for name, text in (("a.txt", "1\tun\n"), ("b c.txt", "2\tdéjà\n")):
        (tmp_path / name).write_bytes(text.encode("latin-1"))
    return tmp_path


def test_a_missing_file_is_a_row(spark, folder):
    rows = spark.read.format("registry_files").option("base", str(folder)).option("files", json.dumps(["a.txt", "none.txt", "b c.txt"])).load()
    assert rows.rdd.getNumPartitions() == 3
    got = {r.file: r for r in rows.withColumn("text", tsv.decode(F.col("content"))).collect()}
    assert got["a.txt"].sha256 == hashlib.sha256(b"1\tun\n").hexdigest() and got["a.txt"].error is None and got["a.txt"].size == 5
    assert got["b c.txt"].text == "2\tdéjà\n" and got["none.txt"].content is None and "FileNotFoundError" in got["none.txt"].error
    with pytest.raises(Exception, match="base and files"):
        spark.read.format("registry_files").load().collect()


def test_web_server_and_own_urls(spark, folder):
    server = ThreadingHTTPServer(("127.0.0.1", 0), lambda *a: SimpleHTTPRequestHandler(*a, directory=str(folder)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        files = ["a.txt", "b%20c.txt", "none.txt", f"file://{folder}/a.txt"]
        got = {r.file: r for r in spark.read.format("registry_files").option("base", base).option("files", json.dumps(files)).load().collect()}
        assert got["a.txt"].sha256 == got[files[3]].sha256 and got["b%20c.txt"].size == 7 and "404" in got["none.txt"].error
    finally:
        server.shutdown()
    assert location("https://h/x", "y.txt") == "https://h/x/y.txt" and location("/d/", "y.txt") == "/d/y.txt" and location("/d", "https://o/z") == "https://o/z"


def test_a_stream_fetches_what_changed(spark, folder, tmp_path_factory):
    at, out = str(tmp_path_factory.mktemp("check")), str(tmp_path_factory.mktemp("out"))

    def run():
        rows = spark.readStream.format("registry_files").option("base", str(folder)).option("files", json.dumps(["a.txt", "b c.txt", "late.txt"])).load()
        rows.select("file", "sha256").writeStream.option("checkpointLocation", at).trigger(once=True).start(path=out, format="parquet").awaitTermination()
        return sorted(r.file for r in spark.read.schema("file string, sha256 string").parquet(out).collect())

    assert run() == ["a.txt", "b c.txt"]
    time.sleep(0.01)
    (folder / "a.txt").write_text("1\tdeux\n")
    (folder / "late.txt").write_text("3\n")
    assert run() == ["a.txt", "a.txt", "b c.txt", "late.txt"]
