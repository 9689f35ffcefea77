"""Shared helpers: table access, the shared folder, bounded batches, connected components."""

from __future__ import annotations

import gc
import os
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Rows of a side of numbers that may be broadcast; beyond them, joins shuffle.
BROADCAST_ROWS = 1_000_000

#: Rows of one Python-side slice; an Arrow batch is walked in slices so that whole texts of few rows are alive at once.
SLICE_ROWS = 256


#: Rows of an Arrow batch where the session has Spark's default of 10,000: texts are long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, the default file system's where it names none."""
    context = spark.sparkContext
    own = context._jvm.org.apache.hadoop.fs.Path(path)
    found = own.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(own).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once the driver's handles are collected, which
    on a driver with little garbage may be long after the disks are full. A local session, whose heap is that of all
    tasks and slow to collect, is left alone."""
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return
    gc.collect()
    for _ in range(2):  # what the first pass finds dead still holds other objects
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.05)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write once as Parquet in the shared folder and read back: a survivor of lost executors, columnar and prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    tidy(spark)
    df.write.parquet(path, compression=compression)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that a finished task has freed back to the system: Python workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    release()


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over small slices; ``make`` runs once per task and returns the function of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for part in slices(batches):
            yield apply(part)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def drop_rows(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` without the rows whose key and text hash are in ``found`` (``k, h``), whatever its columns' names."""
    names = docs.columns
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    k, t = (f"c{names.index(c)}" for c in (key, text))
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    left = numbered.withColumn("own", F.xxhash64(F.col(t).cast("string"))).join(found, F.col(k).eqNullSafe(F.col("k")) & (F.col("own") == F.col("h")), "left_anti")
    return left.drop("own").toDF(*names)


#: Ranges for each shuffle partition, and sampled rows for each range: the sample does not grow with the rows.
RANGES_PER_PARTITION, SAMPLED_PER_RANGE = 2, 16


def _salt() -> Column:
    return F.rand(13)


def ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row ``cuts array<struct<keys, salt>>``: rising ends of ranges of like size, each the key of a row, from a sample
    of a size that depends on the number of shuffle partitions alone. Only where more rows than a range takes share a
    key do salts part them; else an end holds all rows of its key. ``rows`` has to give the same rows in the same order
    each time, as a scan of files does: rows keep their salts."""
    spark = rows.sparkSession
    pieces, n = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count()
    drawn = rows.select(*keys, _salt().alias("salt")).sample(min(1.0, SAMPLED_PER_RANGE * pieces / max(1, n)), 7)
    drawn = drawn.orderBy(*(F.asc_nulls_first(c) for c in [*keys, "salt"])).collect()
    picked = [tuple(r) for r in drawn[SAMPLED_PER_RANGE - 1 :: SAMPLED_PER_RANGE]]
    ends = [(*p[:-1], p[-1] if k + 1 < len(picked) and picked[k + 1][:-1] == p[:-1] else 2.0) for k, p in enumerate(picked)]
    kind = ", ".join(f"{c}: {rows.schema[c].dataType.simpleString()}" for c in keys)
    return spark.createDataFrame([(ends,)], f"cuts array<struct<{kind}, salt: double>>")


def with_range(rows: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``salt`` and ``range``, the number of cuts below the row: rows in rising order of keys, nulls first,
    have rising ranges."""
    own = F.struct(*keys, "salt")
    return rows.withColumn("salt", _salt()).crossJoin(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c < own))).drop("cuts")  # cuts is one row


def single_threaded() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Connected components of ``edges (a long, b long)``: rows ``(node, component)`` with the smallest node id.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each round checkpointed in the shared folder,
    until nothing changes; edges shrink to stars. The smallest neighbour of each node comes by broadcast while the edges
    are few, else by a join whose hot nodes are Spark's to split. Null ends are ignored, empty input gives no rows;
    nodes without edges do not appear.
    """
    live = edges.where("a is not null and b is not null and a <> b")
    live = cut(live.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct())
    seen, rounds = tuple(live.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()), 0
    while seen[0]:
        sent = F.broadcast if 2 * seen[0] <= BROADCAST_ROWS else lambda x: x
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: larger neighbours of a node point to its smallest neighbour
        large = both.join(sent(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sent(least), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        live = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        mark, rounds = tuple(live.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()), rounds + 1
        if mark == seen:
            break
        if rounds == max_rounds:
            raise RuntimeError("connected components did not settle")
        seen = mark
    return live.select(F.col("a").alias("node"), F.col("b").alias("component")).union(live.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
