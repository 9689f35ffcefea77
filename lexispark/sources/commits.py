"""Numbered versions of anything kept in a folder that several writers share.

A version is one small file ``<number>.json`` whose creation fails if it is there already: writers who read the same
version and both add the next one cannot both succeed, and the loser reads again and retries. Nothing is renamed or
deleted on the way, so a reader finds a whole version at any moment; files of old versions stay until ``expire``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Digits of a version's number, so that names sort as numbers do.
DIGITS = 20


def files(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with its whole content, or return False if it exists. On a local disk the content is written beside
    it and linked to the name, which fails if the name is taken; other file systems create files that way themselves."""
    where, system = files(spark, path)
    jvm = spark.sparkContext._jvm
    system.mkdirs(where.getParent())
    data = content.encode()
    if system.getScheme() == "file":
        target = jvm.java.nio.file.Path.of(jvm.java.net.URI.create("file://" + where.toUri().getRawPath()))
        fresh = jvm.java.nio.file.Files.createTempFile(target.getParent(), ".fresh", ".tmp", spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        try:
            jvm.java.nio.file.Files.write(fresh, data, spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 0))
            jvm.java.nio.file.Files.createLink(target, fresh)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            jvm.java.nio.file.Files.deleteIfExists(fresh)
    try:
        out = system.create(where, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(data)
    out.close()
    return True


def read(spark: SparkSession, path: str) -> str:
    where, system = files(spark, path)
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of all versions, rising."""
    where, system = files(spark, folder)
    if not system.exists(where):
        return []
    names = (s.getPath().getName() for s in system.listStatus(where))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def load(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, dict]:
    """A version, the latest unless it is named: its number and content. FileNotFoundError if there is none."""
    known = versions(spark, folder)
    number = known[-1] if version is None and known else version
    if number not in known:
        raise FileNotFoundError(folder if version is None else f"{folder}, version {version}")
    return number, json.loads(read(spark, f"{folder}/{number:0{DIGITS}}.json"))


def commit(spark: SparkSession, folder: str, change: Callable[[dict | None], dict]) -> tuple[int, dict]:
    """Add the version that ``change`` makes of the latest one (None if there is none), again and again until no other
    writer was faster: no change is lost. Returns its number and content."""
    while True:
        known = versions(spark, folder)
        base = load(spark, folder, known[-1])[1] if known else None
        number, content = (known[-1] if known else 0) + 1, change(base)
        if create(spark, f"{folder}/{number:0{DIGITS}}.json", json.dumps(content, ensure_ascii=False)):
            return number, content


def expire(spark: SparkSession, folder: str, keep: int, drop: Callable[[dict], None] = lambda content: None) -> list[int]:
    """Forget all versions but the last ``keep``; ``drop`` gets the content of each, to delete what it alone refers to."""
    gone = versions(spark, folder)[: -max(1, keep)]
    for number in gone:
        drop(load(spark, folder, number)[1])
        where, system = files(spark, f"{folder}/{number:0{DIGITS}}.json")
        system.delete(where, False)
    return gone
