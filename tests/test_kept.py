"""Sorted tables and bucketed details: plans and results."""

import pytest
from pyspark.sql import functions as F

from lexispark.operators import relational as R
from lexispark.operators.kept import DetailStore, SortedTable


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges", [1, 5])
def test_pages_of_a_sorted_table(spark, tmp_path, ranges):
    rows = spark.range(1000).selectExpr("id % 37 as k", "id", "if(id % 9 = 0, null, 'x') as `odd name`")
    order = [F.desc_nulls_last("odd name"), "k", F.desc("id")]
    whole = [r.id for r in rows.orderBy(*order).collect()]
    store = SortedTable.save(rows, order, str(tmp_path), ranges)
    assert store.total == 1000
    for number, limit in ((1, 7), (20, 7), (3, 400), (143, 7), (1, 5000), (40_000, 25)):
        page = store.page(number, limit)
        assert page.columns == rows.columns and [r.id for r in page.collect()] == whole[(number - 1) * limit : number * limit]
        assert "Exchange" not in plan(page)
    assert "PartitionFilters: [" in plan(store.page(20, 7)) and "GreaterThanOrEqual(_row" in plan(store.page(20, 7))
    SortedTable.save(rows.limit(3), order, str(tmp_path))
    assert SortedTable.open(spark, str(tmp_path)).total == 3 and SortedTable.open(spark, str(tmp_path), 1).page(1, 9).count() == 9
    assert store.page(1, 9).count() == 9
    with pytest.raises(ValueError):
        store.page(0)


def test_a_page_opens_one_or_two_ranges(spark, tmp_path):
    store = SortedTable.save(spark.range(5000).withColumn("v", F.col("id") * 2), ["id"], str(tmp_path), 8)
    parts = store.rows().where((F.col("_part") == 3) & (F.col("_row") >= 5) & (F.col("_row") < 10)).select(F.input_file_name()).distinct().count()
    assert parts == 1 and [r.v for r in store.page(100, 20).collect()] == [2 * k for k in range(1980, 2000)]


def test_empty_sorted_table(spark, tmp_path):
    store = SortedTable.save(spark.range(0), ["id"], str(tmp_path))
    assert store.total == 0 and store.page(1).count() == 0
    named = SortedTable.save(spark.range(9).withColumn("_row", -F.col("id")), ["_row"], str(tmp_path))
    assert [tuple(r) for r in named.page(2, 4).collect()] == [(4, -4), (3, -3), (2, -2), (1, -1)]


def test_details_without_an_exchange(spark, tmp_path):
    parents = spark.range(200).withColumnRenamed("id", "k")
    lines = spark.range(1000).selectExpr("id * 7 % 150 as k", "id as place", "id as v")
    notes = spark.range(30).selectExpr("id % 3 as k", "-id as place", "cast(id as string) as note")
    store = DetailStore.save(parents, {"lines": (lines, "place"), "notes": (notes, "place")}, "k", str(tmp_path), buckets=4)
    found = store.details()
    expected = R.nest(R.nest(parents, lines, "k", "lines", "place"), notes, "k", "notes", "place")
    assert sorted(map(str, found.select("k", "lines", "notes").collect())) == sorted(map(str, expected.select("k", "lines", "notes").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(found)
        one = found.where("k = 40")
        assert plan(one).count("SelectedBucketsCount: 1 out of 4") == 3 and "Exchange" not in plan(one)
        assert [len(r.lines) for r in one.collect()] == [len([i for i in range(1000) if i * 7 % 150 == 40])]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    store.drop()
