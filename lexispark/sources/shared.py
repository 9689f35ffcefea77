"""The shared folder, and versioned snapshots of tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import commits

#: Folder of the numbered versions within a snapshot's folder.
VERSIONS = "_versions"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only for a local master that names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured is None:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="lexispark-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(configured)
    return configured


def save_snapshot(rows: DataFrame, folder: str) -> str:
    """Write a new version beside the old ones, then commit it: readers see one of them whole, at any moment, and of two
    writers none is lost. Returns its path."""
    spark, path = rows.sparkSession, f"{folder}/v-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    commits.commit(spark, f"{folder}/{VERSIONS}", lambda before: {"path": path})
    return path


def load_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version, the latest unless it is named; FileNotFoundError if there is none. The rows stay those of that version
    whatever is saved later, until ``expire_snapshots`` deletes it."""
    return spark.read.parquet(commits.load(spark, f"{folder}/{VERSIONS}", version)[1]["path"])


def expire_snapshots(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Delete all versions but the last ``keep``, which readers may still hold."""

    def drop(content: dict) -> None:
        where, system = commits.files(spark, content["path"])
        system.delete(where, True)

    return commits.expire(spark, f"{folder}/{VERSIONS}", keep, drop)
