"""Tables laid out on disk for one way of reading them: in sort order for pages, by key for details."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits
from .relational import nest

#: Low bits of ``monotonically_increasing_id`` count the rows of a partition.
ROW_BITS = 33


@dataclass(frozen=True)
class SortedTable:
    """Rows in order, a folder per range, with the number of rows of each: a page is cut from the one or two ranges that
    hold it, and within them from the row groups that do. Versions are committed: a reader keeps the one it opened."""

    spark: SparkSession
    path: str
    name: str
    counts: list[int]
    schema: str
    part: str
    row: str

    @staticmethod
    def save(rows: DataFrame, order: Sequence[Column | str], path: str, ranges: int | None = None) -> "SortedTable":
        """Sort once by ``order`` and keep. Rows that ``order`` does not tell apart stay in one fixed order."""
        spark, name = rows.sparkSession, uuid.uuid4().hex
        part, row = "_part", "_row"  # no column of the rows
        while {part, row} & set(rows.columns):
            part, row = f"{part}_", f"{row}_"
        dealt = rows.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
        dealt.select("*", place.alias(row), F.spark_partition_id().alias(part)).write.partitionBy(part).parquet(f"{path}/{name}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {row} long, {part} int"
        found = {r["p"]: r["n"] for r in spark.read.schema(schema).parquet(f"{path}/{name}").groupBy(F.col(part).alias("p")).agg(F.count("*").alias("n")).collect()}
        counts = [found.get(p, 0) for p in range(max(found, default=-1) + 1)]
        commits.commit(spark, f"{path}/versions", lambda before: {"name": name, "counts": counts, "schema": schema, "part": part, "row": row})
        return SortedTable(spark, path, name, counts, schema, part, row)

    @staticmethod
    def open(spark: SparkSession, path: str, version: int | None = None) -> "SortedTable":
        return SortedTable(spark, path, **commits.load(spark, f"{path}/versions", version)[1])

    @property
    def total(self) -> int:
        return sum(self.counts)

    def rows(self) -> DataFrame:
        """All rows, with the columns ``part`` and ``row``, by which they are in order."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.name}")

    def slice(self, first: int, limit: int) -> DataFrame:
        """``limit`` rows from place ``first`` (from 0), in order; nothing is sorted but them, nothing is shuffled."""
        at, wanted = 0, []
        for part, n in enumerate(self.counts):
            low, high = max(first, at), min(first + limit, at + n)
            if low < high:
                wanted.append((F.col(self.part) == part) & (F.col(self.row) >= low - at) & (F.col(self.row) < high - at))
            at += n
        rows = self.rows()
        found = rows.where(reduce(lambda a, b: a | b, wanted)) if wanted else rows.where(F.lit(False))
        return found.coalesce(1).sortWithinPartitions(self.part, self.row).drop(self.part, self.row)  # a page

    def page(self, number: int = 1, limit: int = 100) -> DataFrame:
        if number < 1 or limit < 1:
            raise ValueError("pages and limits start at 1")
        return self.slice((number - 1) * limit, limit)


@dataclass(frozen=True)
class DetailStore:
    """Parents and their children in tables bucketed and sorted by one key: nesting all of them needs no exchange, and
    the details of one key come from one bucket of each table."""

    spark: SparkSession
    key: str
    parent: str
    children: dict[str, tuple[str, str]]

    @staticmethod
    def save(parent: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str, path: str, buckets: int = 32) -> "DetailStore":
        """``children``: name of the nested column, its rows, and the column that orders them. All have ``key``."""
        spark, own = parent.sparkSession, f"kept_{uuid.uuid4().hex}"

        def keep(rows: DataFrame, name: str, order: list[str]) -> str:
            rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(*order).option("path", f"{path}/{own}/{name}").saveAsTable(f"{own}_{name}")
            return f"{own}_{name}"

        made = {name: (keep(rows, f"child{k}", [key, order]), order) for k, (name, (rows, order)) in enumerate(children.items())}
        return DetailStore(spark, key, keep(parent, "parent", [key]), made)

    def details(self) -> DataFrame:
        """Every parent with all its children, in their order; filter it by the key to read one bucket."""
        rows = self.spark.table(self.parent)
        for name, (table, order) in self.children.items():
            rows = nest(rows, self.spark.table(table), self.key, name, order)
        return rows

    def drop(self) -> None:
        for table in (self.parent, *(t for t, _ in self.children.values())):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
