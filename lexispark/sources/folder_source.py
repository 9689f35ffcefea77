"""Registry files by name from a folder or a web server, as a Spark data source: a partition for each file.

Executors fetch the files, not the driver; a file that cannot be fetched gives a row with its error and does not stop the
others. As a stream, the offset is a manifest of what each file's server or disk says of its version: a batch holds the
files that changed since, and nothing else is fetched.

    spark.dataSource.register(RegistryFiles)
    spark.read.format("registry_files").option("base", "https://host/files").option("files", '["a.txt", "b.txt"]').load()
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.request
from collections.abc import Iterator
from urllib.parse import unquote, urljoin, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, size long, sha256 string, content binary, error string"

#: Seconds that one file may take.
TIMEOUT = 30


def location(base: str, file: str) -> str:
    """Where a file is: a name below ``base``, or a whole URL of its own."""
    return file if urlparse(file).scheme else urljoin(base.rstrip("/") + "/", file) if urlparse(base).scheme in ("http", "https") else f"{base.rstrip('/')}/{file}"


def _local(where: str) -> str | None:
    parsed = urlparse(where)
    return None if parsed.scheme in ("http", "https") else unquote(parsed.path) if parsed.scheme == "file" else where


def fetch(where: str, timeout: float = TIMEOUT) -> bytes:
    if (path := _local(where)) is not None:
        with open(path, "rb") as f:
            return f.read()
    with urllib.request.urlopen(where, timeout=timeout) as answer:
        return answer.read()


def version(where: str, timeout: float = TIMEOUT) -> str:
    """What tells a version of a file from another without its content; the hour where nothing does, and empty where
    there is no file."""
    try:
        if (path := _local(where)) is not None:
            found = os.stat(path)
            return f"{found.st_mtime_ns}-{found.st_size}"
        with urllib.request.urlopen(urllib.request.Request(where, method="HEAD"), timeout=timeout) as answer:
            told = [answer.headers.get(h) for h in ("ETag", "Last-Modified", "Content-Length")]
            return "|".join(x or "" for x in told) if any(told[:2]) else f"hour {int(time.time() // 3600)}"
    except Exception:  # a file without a version now may have one later
        return ""


class _File(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


class _Files:
    def __init__(self, options: dict):
        if "base" not in options or "files" not in options:
            raise ValueError("options base and files (a JSON list of names or URLs) are needed")
        self.base, self.files, self.timeout = options["base"], json.loads(options["files"]), float(options.get("timeout", TIMEOUT))

    def read(self, partition: _File) -> Iterator[tuple]:
        try:
            raw = fetch(location(self.base, partition.file), self.timeout)
        except Exception as e:  # one file's failure is a row
            yield partition.file, None, None, None, f"{type(e).__name__}: {e}"
            return
        yield partition.file, len(raw), hashlib.sha256(raw).hexdigest(), raw, None


class _Reader(_Files, DataSourceReader):
    def partitions(self) -> list[_File]:
        return [_File(f) for f in self.files]


class _StreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: version(location(self.base, f), self.timeout) for f in self.files}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(f) for f, seen in end.items() if seen and start.get(f) != seen]


class RegistryFiles(DataSource):
    """Format ``registry_files``: ``file, size, sha256, content, error``. Options: ``base``, ``files``, ``timeout``."""

    @classmethod
    def name(cls) -> str:
        return "registry_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)
