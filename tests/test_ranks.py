"""The bucketed ranking operators equal Spark's single-partition windows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

import pytest

from souk.operators.ranks import (bucketize, global_ntile, global_percent_rank, global_rank, global_row_number, grouped_lag,
                                  ntile_of)

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

values = st.lists(st.one_of(st.none(), st.integers(0, 4), st.integers(0, 1000)), min_size=1, max_size=60)


def _frame(spark, vals):
    return spark.createDataFrame([(i, v, float(v) if v is not None else None) for i, v in enumerate(vals)],
                                 "id long, v long, d double")


@SETTINGS
@given(vals=values, asc=st.booleans(), tiles=st.integers(1, 7), buckets=st.integers(1, 6))
def test_global_ntile_matches_window(spark, vals, asc, tiles, buckets):
    df = _frame(spark, vals)
    order = F.col("v").asc() if asc else F.col("v").desc()
    want = {r.id: r.t for r in df.select("id", F.ntile(tiles).over(Window.orderBy(order, "id")).alias("t")).collect()}
    got = {r.id: r.t for r in global_ntile(df, [("v", asc), ("id", True)], tiles, "t", buckets=buckets).collect()}
    assert got == want


@SETTINGS
@given(vals=values, asc=st.booleans(), buckets=st.integers(1, 6))
def test_global_percent_rank_matches_window(spark, vals, asc, buckets):
    df = _frame(spark, vals)
    order = F.col("d").asc() if asc else F.col("d").desc()
    want = {r.id: r.p for r in df.select("id", F.percent_rank().over(Window.orderBy(order)).alias("p")).collect()}
    got = {r.id: r.p for r in global_percent_rank(df, [("d", asc), ("id", True)], 1, "p", buckets=buckets).collect()}
    assert got == want


@SETTINGS
@given(vals=values, buckets=st.integers(1, 6))
def test_global_row_number_is_a_permutation_in_order(spark, vals, buckets):
    df = _frame(spark, vals)
    want = {r.id: r.rn for r in df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("rn")).collect()}
    got = {r.id: r.rn for r in global_row_number(df, [("v", True), ("id", True)], rn="rn", buckets=buckets).collect()}
    assert got == want


@SETTINGS
@given(groups=st.lists(st.sampled_from([0, 0, 0, 1, 2, None]), min_size=1, max_size=60), buckets=st.integers(1, 6))
def test_grouped_lag_matches_window_with_hot_group(spark, groups, buckets):
    rows = [(i, g, (i * 7919) % 97) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "id long, g long, t long")
    w = Window.partitionBy("g").orderBy("t", "id")
    want = {r.id: r.prev for r in df.select("id", F.lag("t").over(w).alias("prev")).collect()}
    got = {r.id: r.prev for r in grouped_lag(df, ["g"], [("t", True), ("id", True)], "t", "prev",
                                             buckets=buckets).collect()}
    assert got == want


def test_ntile_formula_small_cases(spark):
    for n in range(1, 12):
        for tiles in (1, 3, 5, 10):
            df = spark.range(1, n + 1).select(F.col("id").alias("rn"), F.lit(n).alias("n"))
            got = [r.t for r in df.select(ntile_of(F.col("rn"), F.col("n"), tiles).alias("t")).orderBy("rn").collect()]
            want = [r.t for r in spark.range(1, n + 1).select(F.ntile(tiles).over(Window.orderBy("id")).alias("t"))
                    .orderBy("t").collect()]
            assert got == want, (n, tiles)


def test_heavy_value_spans_buckets(spark):
    # one value holds two thirds of the rows: it must be split, and ranks must stay exact
    rows = [(i, 7 if i % 3 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v long")
    want = {r.id: r.p for r in df.select("id", F.percent_rank().over(Window.orderBy("v")).alias("p")).collect()}
    got = {r.id: r.p for r in global_percent_rank(df, [("v", True), ("id", True)], 1, "p", buckets=8).collect()}
    assert got == want
    b = bucketize(df, [("v", True), ("id", True)], buckets=8)
    per_bucket = b.where("v = 7").groupBy("__bucket").count().collect()
    assert len(per_bucket) >= 4


def test_string_and_decimal_keys_render_exactly(spark):
    from decimal import Decimal

    names = ["a'b", "c\\d", "o'\\'x", "plain", "z", "", "é"]
    rows = [(f"{names[i % len(names)]}-{i:03d}", Decimal(i % 5) / Decimal(3) if i % 4 else None, float(i) / 7)
            for i in range(90)]
    df = spark.createDataFrame([(k, d.quantize(Decimal("0.000001")) if d is not None else None, f)
                                for k, d, f in rows], "k string, dec decimal(12,6), f double")
    for order, col in ((("dec", True), "dec"), (("f", False), "f")):
        spark_order = F.col(col).asc() if order[1] else F.col(col).desc()
        want = {r.k: r.t for r in df.select("k", F.ntile(4).over(Window.orderBy(spark_order, "k")).alias("t")).collect()}
        got = {r.k: r.t for r in global_ntile(df, [order, ("k", True)], 4, "t", buckets=5).collect()}
        assert got == want


def test_grouped_lag_descending_order_with_null_keys(spark):
    rows = [(i, i % 3 if i % 7 else None, (i * 37) % 11 if i % 5 else None) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, g long, t long")
    w = Window.partitionBy("g").orderBy(F.col("t").desc(), "id")
    want = {r.id: r.prev for r in df.select("id", F.lag("id").over(w).alias("prev")).collect()}
    got = {r.id: r.prev for r in grouped_lag(df, ["g"], [("t", False), ("id", True)], "id", "prev",
                                             buckets=6).collect()}
    assert got == want


@pytest.mark.parametrize("ranges", [3, 64, 5000])
def test_string_keys_and_one_heavy_value_at_any_number_of_ranges(spark, ranges):
    rows = [(f"id-{i:04d}", "heavy" if i % 3 else f"v{i % 50}") for i in range(900)]
    df = spark.createDataFrame(rows, "id string, v string")
    w = Window.orderBy(F.col("v").desc())
    want = {r.id: (r.r, r.p, r.t) for r in df.select(
        "id", F.rank().over(w).alias("r"), F.percent_rank().over(w).alias("p"),
        F.ntile(7).over(Window.orderBy(F.col("v").desc(), "id")).alias("t")).collect()}
    key = [("v", False), ("id", True)]
    ranked = {r.id: (r.r, r.n) for r in global_rank(df, key, 1, "r", "n", buckets=ranges).collect()}
    share = {r.id: r.p for r in global_percent_rank(df, key, 1, "p", buckets=ranges).collect()}
    tile = {r.id: r.t for r in global_ntile(df, key, 7, "t", buckets=ranges).collect()}
    assert {i: (ranked[i][0], share[i], tile[i]) for i in want} == want
    assert {n for _, n in ranked.values()} == {900}


def test_default_ranges_follow_the_shuffle_partitions_for_small_inputs_too(spark):
    df = spark.range(40).withColumn("v", F.col("id") % 3)
    used = bucketize(df, [("v", True), ("id", True)]).select("__bucket").distinct().count()
    assert used > 1


@pytest.mark.parametrize("ranges", [3, 64, 5000])
def test_running_sum_shares_sums_among_peers_across_ranges(spark, ranges):
    from souk.operators.ranks import global_running_sum

    rows = [(i, f"k{i % 7}" if i % 3 else "hot", None if i % 11 == 0 else i * 31 % 17 - 5) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, v long").withColumn(
        "m", (F.col("v") * 1.25).cast("decimal(20,3)"))
    for peers, order in ((1, [("g", True), ("id", True)]), (1, [("m", False), ("id", True)]),
                         (2, [("g", False), ("v", True), ("id", True)])):
        keys = [F.col(c).asc() if a else F.col(c).desc() for c, a in order[:peers]]
        want = {r.id: r.s for r in df.select("id", F.sum("m").over(Window.orderBy(*keys)).alias("s")).collect()}
        got = global_running_sum(df, order, peers, "m", "s", "t", buckets=ranges).collect()
        assert {r.id: r.s for r in got} == want
        assert {r.t for r in got} == {sum(x for x in (r.m for r in df.collect()) if x is not None)}
