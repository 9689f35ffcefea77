"""Pages, look-ups, nested children, group expansion, roll-ups, tagged unions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


#: Rows up to the end of a page that one top-k holds; pages beyond are cut out of the sorted table.
TOP_ROWS = 100_000


def page(rows: DataFrame, order: Sequence[Column | str], number: int = 1, limit: int = 100) -> DataFrame:
    """Exactly the ``limit`` rows of a page. Near the front it is one top-k with offset; further on, where a top-k would
    hold all rows before it, rows are counted, and the page is cut out of a sorted table, which is made for this page: keep a
    ``SortedTable`` for several of them."""
    if number < 1 or limit < 1:
        raise ValueError("pages and limits start at 1")
    first = (number - 1) * limit
    if first + limit <= TOP_ROWS:
        return rows.orderBy(*order).offset(first).limit(limit)
    if first >= rows.count():
        return rows.limit(0)
    from .kept import SortedTable

    return SortedTable.save(rows, order, f"{shared_dir(rows.sparkSession)}/page-{uuid.uuid4().hex}").slice(first, limit)


def page_info(rows: DataFrame, number: int = 1, limit: int = 100) -> DataFrame:
    """One row ``total, page, limit, pages``."""
    total = F.count("*")
    return rows.agg(total.alias("total"), F.lit(number).cast("long").alias("page"), F.lit(limit).cast("long").alias("limit"), F.ceil(total / limit).cast("long").alias("pages"))


def first_match(rows: DataFrame, condition: Column, order: Sequence[Column | str]) -> DataFrame:
    return rows.where(condition).orderBy(*order).limit(1)


def exists_any(rows: DataFrame, condition: Column, name: str = "found") -> DataFrame:
    """One row: whether any row meets the condition."""
    return rows.agg(F.coalesce(F.max(F.coalesce(condition, F.lit(False))), F.lit(False)).alias(name))


def present(*names: str) -> Column:
    """All fields are there and not empty."""
    out = F.lit(True)
    for n in names:
        out = out & (F.length(n) > 0)
    return F.coalesce(out, F.lit(False))


def nest(parent: DataFrame, child: DataFrame, key: str, name: str, order: str = "_pos") -> DataFrame:
    """All children of a row with the same key, in row order, as ``array<struct>``; none: empty. The key's filter reaches
    the child's scan; the child is aggregated before the join, so several nestings do not multiply rows."""
    columns = [c for c in child.columns if c != order]
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    bare = F.transform(rows, lambda x: F.struct(*(x[c].alias(c) for c in columns)))
    nested = child.groupBy(key).agg(bare.alias(name))
    kind = nested.schema[name].dataType.simpleString()
    return parent.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def first_group(members: DataFrame, key: str, group: str, order: Sequence[str], label: str | None = None) -> DataFrame:
    """The first group of each key: ``key, group[, label]``."""
    kept = [group, *([label] if label else [])]
    return members.groupBy(key).agg(F.min(F.struct(*order, *(c for c in kept if c not in order))).alias("f")).select(key, *(F.col(f"f.{c}").alias(c) for c in kept))


def group_items(members: DataFrame, group: str, order: str = "_pos") -> DataFrame:
    """All members of each group in row order: ``group, items``."""
    columns = [c for c in members.columns if c != order]
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns)))
    return members.groupBy(group).agg(items.alias("items"))


def with_group(parent: DataFrame, members: DataFrame, key: str, group: str, label: str, name: str, order: str = "_pos") -> DataFrame:
    """Two hops: a row's first group, then all members of that group, as a struct ``group, label, items``; NULL if none."""
    first = first_group(members, key, group, [order], label)
    found = first.join(group_items(members, group, order), group).select(key, F.struct(group, label, "items").alias(name))
    return parent.join(found, key, "left")


def first_and_count(rows: DataFrame, key: str, value: str, order: Sequence[str], count: str = "n") -> DataFrame:
    """Per key: the first value in row order, the number of rows, and the first place (``_first``)."""
    place = F.struct(*order)
    return rows.groupBy(key).agg(F.min_by(value, place).alias(value), F.count("*").alias(count), F.min(place).alias("_first"))


def tagged_union(parts: Sequence[tuple[str, DataFrame]], tag: str = "type") -> DataFrame:
    """UNION ALL of different tables with a tag and the ordinal ``_src``; columns that a table lacks are NULL."""
    out = None
    for k, (name, rows) in enumerate(parts):
        rows = rows.withColumns({tag: F.lit(name), "_src": F.lit(k)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def divide(rows: DataFrame, key: str, value: str, wanted: DataFrame) -> DataFrame:
    """Relational division: the keys of ``rows`` that have every value of ``wanted`` (one column). Nulls are no values; an
    empty ``wanted`` is had by every key. Values that nobody asks for end before the shuffle."""
    needed = wanted.select(F.col(wanted.columns[0]).alias("_v")).where("_v is not null").distinct()
    keys = rows.select(F.col(key)).where(F.col(key).isNotNull())
    many = needed.count()
    if not many:
        return keys.distinct()
    kept = rows.where(F.col(key).isNotNull()).join(needed, F.col(value) == F.col("_v"), "left_semi").select(key, value).distinct()
    return kept.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == many).select(key)
