"""Scans of headerless tab-separated files, positional and permissive, and of Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import Dataset

#: White space that is trimmed from fields (no-break spaces stay), and what windows-1252 puts at 0x80-0x9F.
TRIM = " \t\r\n\f\x0b"
C1 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def decode(content: Column) -> Column:
    """Text of bytes: UTF-16 if its mark is there, UTF-8 if valid, else Latin-1 with windows-1252 signs; marks go."""
    text = F.when(_utf16(content), F.decode(content, "UTF-16")).when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(_eight_bit(content))
    return F.regexp_replace(text, "^﻿", "")


def _eight_bit(content: Column) -> Column:
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, C1)), "".join(C1.values()))


def _utf16(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF") & (F.octet_length(content) % 2 == 0)


def encoding_name(content: Column) -> Column:
    """The charset as ``ingest.normalised`` names it."""
    eight = F.when(F.decode(content, "ISO-8859-1").rlike("[\u0080-\u009F]"), "windows-1252").otherwise("iso-8859-1")
    return F.when(_utf16(content), "utf-16").when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise(eight)


def parse_lines(lines: DataFrame, dataset: Dataset, line: str = "line", pos: str = "_pos") -> DataFrame:
    """Bind fields by position: quotes are ordinary signs, short rows end in NULLs, surplus fields go, blank lines too."""
    parts = F.split(F.col(line), "\t", -1)
    fields = [F.btrim(F.get("__parts", F.lit(i)), F.lit(TRIM)).alias(c) for i, c in enumerate(dataset.columns)]
    return lines.where(F.length(line) > 0).withColumn("__parts", parts).select(F.col(pos).cast("long").alias("_pos"), *fields)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of the lines that are not blank, as splits give them: ``file, block`` (where its split starts), ``raw``, and
    ``m``, which counts up without gaps within a split."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))
    return rows.where((F.octet_length("raw") > 0) & (F.col("raw") != F.unhex(F.lit("0D")))).withColumn("m", F.monotonically_increasing_id())


def _splits(lines: DataFrame) -> DataFrame:
    """A row per split: ``before``, the lines of all splits before it in the order of files and places, ``low``, its
    smallest ``m``, and of its file: ``utf8``, whether all lines are valid, and ``mark``, its first two bytes in hex."""
    valid = F.is_valid_utf8(F.col("raw").cast("string"))
    found = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("m").alias("low"), F.min(valid).alias("utf8"), F.min_by(F.hex(F.substring("raw", 1, 2)), "m").alias("mark"))
    earlier, own = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    return found.select("file", "block", "low", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.min("utf8").over(own).alias("utf8"), F.min_by("mark", "block").over(own).alias("mark"))


def scan(spark: SparkSession, path: str, dataset: Dataset) -> DataFrame:
    """A file, or a folder of files in the order of their names, of any known charset; a missing one is an empty table.
    ``_pos`` numbers the lines that are not blank, from 0 and without gaps.

    Files are read in splits: a first pass counts the lines of each split and finds the charset of each file, and sums
    over the splits before it number the lines of a split. UTF-16, whose line ends cannot be told apart in the middle of
    a file, is read whole."""
    if not _exists(spark, path):
        return spark.createDataFrame([], dataset.schema)
    lines = _lines(spark, path)
    splits = _splits(lines).cache()  # a row per split, read twice
    if splits.where(F.col("mark").isin("FFFE", "FEFF")).limit(1).count():
        whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.filter(F.split(decode(F.col("content")), "\r?\n", -1), lambda x: x != "").alias("lines"))
        before = F.coalesce(F.sum(F.size("lines")).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return parse_lines(whole.withColumn("before", before).select("before", F.posexplode("lines").alias("p", "line")).withColumn("_pos", F.col("before") + F.col("p")), dataset)
    joined = lines.join(F.broadcast(splits), ["file", "block"])  # a row per split
    text = F.when(F.col("utf8"), F.col("raw").cast("string")).otherwise(_eight_bit(F.col("raw")))
    line = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r$", "")
    return parse_lines(joined.select((F.col("before") + F.col("m") - F.col("low")).alias("_pos"), line.alias("line")), dataset)


def scan_large(spark: SparkSession, path: str, dataset: Dataset) -> DataFrame:
    """One pass over UTF-8 files; ``_pos`` grows along each file but has gaps."""
    if not _exists(spark, path):
        return spark.createDataFrame([], dataset.schema)
    return parse_lines(spark.read.text(path).select(F.monotonically_increasing_id().alias("_pos"), F.col("value").alias("line")), dataset)


def modified_at(spark: SparkSession, path: str) -> DataFrame:
    """One row ``last_updated, source``: the file's time as ISO text, now if there is none."""
    shown = F.date_format(F.coalesce(F.max("t"), F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    times = spark.read.format("binaryFile").load(path).select(F.col("modificationTime").alias("t")) if _exists(spark, path) else spark.createDataFrame([], T.StructType([T.StructField("t", T.TimestampType())]))
    return times.agg(shown.alias("last_updated")).withColumn("source", F.lit(path.rsplit("/", 1)[-1]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
