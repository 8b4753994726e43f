"""Tiles by selection equal Spark's own ``ntile``."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from souk.operators import selection
from souk.operators.selection import Tiles, with_tiles

INF, NAN = float("inf"), float("nan")


def _same_as_builtin(df, windows):
    want = df
    for w in windows:
        order = [F.col(c).asc() if a else F.col(c).desc() for c, a in w.order]
        want = want.withColumn(f"want_{w.out}", F.ntile(w.tiles).over(Window.orderBy(*order)))
    got = with_tiles(want, windows)
    wrong = got.where(" or ".join(f"{w.out} <> want_{w.out}" for w in windows))
    assert wrong.count() == 0
    assert got.columns == [*want.columns, *[w.out for w in windows]]


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(1)
    rows = []
    for i in range(700):
        hot = i % 3 > 0                       # one value on two thirds of all rows
        rows.append((i * 7919 % 100_003, None if i % 50 == 0 else 1 if hot else rng.randrange(-5, 40),
                     rng.choice([None, NAN, INF, -INF, 0.0, -0.0, 1e-300, 1.7e308, -1.7e308, rng.random()]),
                     2 ** 62 + i % 5, f"person-with-a-long-common-prefix-{i:04d}" + "\0" * (i % 2)))
    df = spark.createDataFrame(rows, "id long, few int, odd double, big long, name string")
    return df.withColumn("money", (F.col("few") * 3.335).cast("decimal(30,3)")).repartition(5).cache()


@pytest.mark.parametrize("cells", [2, 7, 2048])
def test_several_windows_at_once(frame, cells, monkeypatch):
    monkeypatch.setattr(selection, "CELLS", cells)
    _same_as_builtin(frame, [
        Tiles([("few", True), ("id", True)], 5, "a"),
        Tiles([("odd", False), ("name", True)], 5, "b"),
        Tiles([("money", False), ("name", False)], 10, "c"),
        Tiles([("big", True), ("few", False), ("id", False)], 7, "d"),
    ])


def test_text_that_differs_behind_a_long_prefix_only(frame):
    _same_as_builtin(frame, [Tiles([("name", True)], 13, "a"), Tiles([("name", False)], 2, "b")])


@pytest.mark.parametrize("n", [0, 1, 3, 5, 11])
def test_fewer_rows_than_tiles(spark, n):
    df = spark.createDataFrame([(i, i % 2) for i in range(n)], "id long, v int")
    _same_as_builtin(df, [Tiles([("v", False), ("id", True)], 5, "a")])


def test_dates_and_times(spark):
    df = spark.range(60).select("id", F.expr("timestamp_micros(id * 1000003 % 977)").alias("t"),
                                F.expr("date_add(date'2020-01-01', cast(id * 7 % 31 as int))").alias("d"))
    _same_as_builtin(df, [Tiles([("t", True), ("id", True)], 4, "a"), Tiles([("d", False), ("id", True)], 4, "b")])


def test_no_sort_and_no_range_exchange(frame):
    plan = with_tiles(frame, [Tiles([("few", True), ("id", True)], 5, "a")])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort" not in plan and "Window" not in plan and "Join" not in plan


def test_repeated_rows_at_a_cut_are_no_total_order(spark):
    df = spark.createDataFrame([(1,)] * 8, "v int")
    with pytest.raises(ValueError):
        with_tiles(df, [Tiles([("v", True)], 3, "a")])
