"""Periodic refresh as a file stream: each new snapshot of a registry file becomes Parquet once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.registry import Dataset
from ..sources.tsv import decode, parse_lines


def refresh(spark: SparkSession, folder: str, dataset: Dataset, target: str, checkpoint: str):
    """Read what is new in ``folder`` and append it, with its file and time, to ``target``; ends when all is read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.select("path", "modificationTime", F.posexplode(F.split(decode(F.col("content")), "\r?\n", -1)).alias("_pos", "line"))
        rows = parse_lines(lines, dataset)
        rows.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/_batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
