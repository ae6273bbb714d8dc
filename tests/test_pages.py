"""Pages by directory against the sorted list, with ties, nulls and keys of several types."""

import random

import pytest

from fleetscope.sources.pages import page_directory, read_page
from fleetscope.sources.records import page_with_total
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 17 == 0 else 5 if i % 3 == 0 else rng.randint(-50, 900)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, v int")
    return df.selectExpr("id", "v", "cast(v as double) / 4 as d", "date_add(date'2024-01-01', v) as day", "cast(timestamp_seconds(v * 1000) as timestamp_ntz) as at").cache()


@pytest.mark.parametrize("key", ["v", "d", "day", "at"])
@pytest.mark.parametrize("descending", [False, True])
def test_pages_are_slices_of_the_sorted_table(table, key, descending):
    directory = page_directory(table, key, 16)
    order = F.col(key).desc() if descending else F.col(key)
    whole = [r["id"] for r in table.orderBy(order, "id").collect()]
    assert directory.total == 1500 and len(directory.ranges) <= 16
    for page in (1, 4, 11, 22):
        got = read_page(table, directory, ["id"], page, 70, descending).collect()
        assert [r["id"] for r in got] == whole[(page - 1) * 70 : page * 70]
        assert all((r["total"], r["page"], r["page_size"]) == (1500, page, 70) for r in got)
    assert read_page(table, directory, ["id"], 99, 70, descending).count() == 0


def test_a_deep_page_reads_its_ranges_only(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    directory = page_directory(orders, "o_totalprice", 50)
    n = orders.count()
    page = n // 20 - 3
    deep = read_page(orders, directory, ["o_orderkey"], page, 20)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(o_totalprice" in plan and f"offset={(page - 1) * 20}" not in plan
    want = page_with_total(orders, ["o_totalprice", "o_orderkey"], page, 20)
    cols = ["o_orderkey", "total", "page", "page_size"]
    assert [tuple(r) for r in deep.select(cols).collect()] == [tuple(r) for r in want.select(cols).collect()]


def test_edges(spark):
    empty = spark.createDataFrame([], "id long, v int")
    assert page_directory(empty, "v").total == 0 and read_page(empty, page_directory(empty, "v")).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None)], "id long, v int")
    assert [r["id"] for r in read_page(nulls, page_directory(nulls, "v"), ["id"], 2, 1).collect()] == [2]
