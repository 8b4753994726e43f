"""CSV text load, try_cast normalisation, quality checks and the mart sink."""

import os
import re
import tempfile

from pyspark.sql import functions as F

from souk.sources import ingest


def _scratch():
    return tempfile.mkdtemp(prefix="souk-test-")


def test_compact_names():
    assert ingest.compact_name("shop_order_items_dataset") == "order_items"
    assert ingest.compact_name("shop_order_payments_dataset") == "payments"
    assert ingest.compact_name("product_category_name_translation") == "product_category_name_translation"
    assert ingest.compact_name("orders") == "orders"


def test_multiline_csv_and_countable_cast_failures(spark):
    path = os.path.join(_scratch(), "reviews.csv")
    with open(path, "w") as f:
        f.write("review_id,order_id,review_score,review_comment_title,review_comment_message,"
                "review_creation_date,review_answer_timestamp\n")
        f.write('r1,o1,5,,"great\nsecond line",2018-01-01 00:00:00,2018-01-02 10:00:00\n')
        f.write("r2,o2,five,,  ,1900-01-01 00:00:00,2018-01-03 00:00:00\n")
        f.write("r1,o3,1,,bad,2018-01-04 00:00:00,\n")
    spec = ingest.TYPE_SPEC["order_reviews"]
    raw = ingest.load_raw(spark, path, multi_line=True)
    assert raw.count() == 3
    typed = ingest.normalise(raw, spec, min_valid_ts="2000-01-01")
    rows = {r.order_id: r for r in typed.collect()}
    assert rows["o1"].review_comment_message == "great\nsecond line"
    assert rows["o2"].review_score is None and rows["o2"].review_comment_message is None
    assert rows["o2"].review_creation_date is None  # sentinel date nulled
    fails = {r.column_name: r.failed_casts for r in ingest.cast_failures(raw, spec, "order_reviews").collect()}
    assert fails["review_score"] == 1 and fails["review_creation_date"] == 0
    dup = ingest.key_violations({"order_reviews": typed}).collect()[0]
    assert (dup.duplicate_keys, dup.rows_in_duplicate_keys, dup.null_keys) == (1, 2, 0)
    assert [c[1] for c in ingest.schema_report(typed, "order_reviews")][:3] == ["review_id", "order_id", "review_score"]
    assert ingest.preview(typed, 2).count() == 2


def test_orphans_and_surrogate_keys(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(1, 10), (3, 11), (None, 12)], "pid long, v long")
    assert [r.v for r in ingest.orphans(child, "pid", parent, "id").collect()] == [11]
    keyed = ingest.add_surrogate_key(child, ["v"], "sk", buckets=2).orderBy("v").collect()
    assert [r.sk for r in keyed] == [1, 2, 3]


def test_mart_sink_partitions_by_cohort_year(spark):
    from souk.operators.mart import write_customer_360

    df = spark.createDataFrame([("a", "2017-03"), ("b", "2018-01")], "customer_unique_id string, "
                                                                        "acquisition_cohort_month string")
    out = os.path.join(_scratch(), "mart")
    write_customer_360(df, out)
    assert sorted(d for d in os.listdir(out) if d.startswith("cohort_year=")) == ["cohort_year=2017", "cohort_year=2018"]
    assert spark.read.parquet(out).count() == 2


def test_materialised_star_gives_identical_results(spark):
    from souk.plans import registry
    from souk.sources import fixtures

    sf, star = "/root/testdata/sf0.001", os.path.join(_scratch(), "star")
    names = ["customer_pareto", "local_vs_longhaul", "review_distribution", "seller_churn"]
    fixtures.materialize_star(spark, sf, star, partitions=3)
    for n in names:
        derived = registry.queries()[n](spark, sf).collect()
        assert sorted(map(tuple, derived)) == sorted(map(tuple, registry.queries(star)[n](spark, sf).collect()))


def test_every_read_sees_the_files_of_its_time(spark):
    from souk.sources.tables import read_table

    folder = _scratch()
    for rows in (3, 5):
        spark.range(rows).write.mode("overwrite").parquet(os.path.join(folder, "nation.parquet"))
        assert read_table(spark, folder, "nation").count() == rows


def test_two_ingest_frames_live_side_by_side(spark):
    from souk.plans import registry

    first = registry.queries()["ingest_cast_failures"](spark, "/root/testdata/sf0.001")
    second = registry.queries()["ingest_cast_failures"](spark, "/root/testdata/sf0.001")
    rows = {r.column_name: r.failed_casts for r in first.collect()}
    assert rows == {r.column_name: r.failed_casts for r in second.collect()}
    assert rows["order_delivered_customer_date"] > 0 and rows["order_approved_at"] == 0


def test_calendar_covers_the_data_and_refuses_a_stray_date(spark):
    import pytest

    from souk.sources.calendar import calendar_spanning

    dates = spark.createDataFrame([("1987-03-02",), ("2031-05-06",), (None,)], "d string").selectExpr("d::timestamp as d")
    cal = calendar_spanning(dates, "d", "d")
    assert cal.count() == 45 * 365 + 11 and cal.agg({"full_date": "min"}).first()[0].isoformat() == "1987-01-01"
    with pytest.raises(ValueError):
        calendar_spanning(dates.unionByName(spark.sql("select timestamp'0001-01-01' as d")), "d", "d")
    assert calendar_spanning(dates.where("d is null"), "d", "d").count() == 1


def test_load_star_schema_from_csv_files_end_to_end(spark):
    """Write the marketplace tables as reference-style CSV files, load them, rerun an analysis."""
    import __spark_entry__ as E
    from souk.operators import payments as pay
    from souk.sources import fixtures

    sf = "/root/testdata/sf0.001"
    m = fixtures.marketplace(spark, sf)
    out = _scratch()
    files = {"orders": "shop_orders_dataset", "customers": "shop_customers_dataset",
             "payments": "shop_order_payments_dataset"}
    fmt = "yyyy-MM-dd HH:mm:ss"
    for attr, stem in files.items():
        # Spark writes a folder named <stem>.csv; the loader reads it as one table
        (getattr(m, attr).write.option("header", True).option("timestampFormat", fmt)
         .option("timestampNTZFormat", fmt).csv(os.path.join(out, stem + ".csv")))
    star = ingest.load_star_schema(spark, "file://" + out, min_valid_ts="1990-01-01")
    paths = {stem: os.path.join(out, stem + ".csv") for stem in files.values()}
    assert set(ingest.load_star_schema(spark, paths).tables) == set(star.tables)
    assert set(star.tables) == {"orders", "customers", "payments"}
    assert {"purchase_datekey", "approved_datekey", "delivered_datekey", "estimated_datekey"} <= set(star.orders.columns)
    loaded = sorted(map(tuple, pay.boleto_by_state(star.payments, star.orders, star.customers).collect()))
    direct = sorted(map(tuple, E.queries()["boleto_by_state"](spark, sf).collect()))
    assert loaded == direct


def test_keys_and_references_in_one_pass(spark):
    tables = {
        "p": spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "x")], "id long, c string"),
        "q": spark.createDataFrame([("1", "12"), ("11", "2"), ("1", None), (None, None), ("1", "12")], "a string, b string"),
        "k": spark.createDataFrame([(1, 2), (3, 2), (3, None), (None, 9)], "pid int, pid2 long"),
        "none": spark.createDataFrame([], "id long"),
    }
    keys = {"p": ("id",), "q": ("a", "b"), "none": ("id",), "absent": ("id",)}
    links = [("k", "pid", "p", "id"), ("k", "pid2", "p", "id"), ("k", "pid", "none", "id"), ("k", "pid", "absent", "id"),
             ("k", "pid", "q", "a")]
    counts = ingest.key_counts(tables, keys, links)
    found = {r.table_name: tuple(r)[1:] for r in ingest.key_violations(tables, keys, counts).collect()}
    assert found == {"p": ("id", 1, 2, 1), "q": ("a,b", 1, 2, 2), "none": ("id", 0, 0, 0)}
    assert found == {r.table_name: tuple(r)[1:] for r in ingest.key_violations(tables, keys).collect()}
    for given in (counts, None):
        got = {tuple(r)[:4]: r.orphan_rows for r in ingest.foreign_key_report(tables, links, given).collect()}
        assert got == {(c, cc, p, pc): ingest.orphans(tables[c], cc, tables[p], pc).count()
                       for c, cc, p, pc in links if p != "absent"}


def test_integrity_reads_each_table_once(spark, tmp_path):
    for t in ("customers", "orders"):
        spark.range(5).select(F.col("id").alias("customer_id"), F.col("id").alias("order_id")).write.parquet(f"{tmp_path}/{t}")
    tables = {t: spark.read.parquet(f"{tmp_path}/{t}") for t in ("customers", "orders")}
    plan = ingest.key_counts(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Join" in plan and plan.count("Exchange hashpartitioning") == 2


def test_keys_are_counted_in_as_many_parts_as_the_rows_need(spark, monkeypatch):
    import souk.session as session

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    tables = {"p": spark.range(5).union(spark.range(2)).select(F.col("id").cast("string")),
              "c": spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("string").alias("pid"))}
    keys, links = {"p": ("id",)}, [("c", "pid", "p", "id")]
    counts = ingest.key_counts(tables, keys, links, sizes={"c": 5_000})
    plan = counts._jdf.queryExecution().executedPlan().toString()
    parts = session.tasks_for(counts, 5_000 + 7)
    assert parts >= 51 and sum(line.count(f", {parts})") for line in plan.splitlines() if "Exchange hashpartitioning" in line) == 2
    got = {r.domain: r for r in counts.collect()}["p(id)"]
    assert (got.duplicate_keys, got.rows_in_duplicate_keys, got.null_keys) == (2, 4, 0)
    assert list(got.orphans) == [tables["c"].where("pid in ('5', '6')").count()]


def test_numbered_items_and_payments_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    import souk.session as session
    from souk.sources import fixtures as fx

    monkeypatch.setattr(session, "TASK_ROWS", 2)
    i = F.col("id")
    spark.range(200).select(
        (i % 60).alias("l_orderkey"), (i % 7).alias("l_partkey"), (i % 5).alias("l_suppkey"), (i % 3).cast("int").alias("l_linenumber"),
        i.cast("double").alias("l_quantity"), (i * 10).cast("double").alias("l_extendedprice"), F.lit(0.1).alias("l_discount"),
        F.lit(0.05).alias("l_tax"), F.element_at(F.array(*map(F.lit, "ANR")), (i % 3 + 1).cast("int")).alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"), F.expr("timestamp'1996-01-01 00:00:00'").alias("l_shipdate")) \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    m = fx.marketplace(spark, str(tmp_path))
    for dealt, plain in ((m.numbered_items, m.order_items), (m.numbered_payments, m.payments)):
        assert ", 100)" in dealt._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))


def test_no_task_that_reads_a_large_table_spreads_its_rows_over_the_domains(spark, tmp_path, monkeypatch):
    import souk.session as session

    i = F.col("id")
    spark.range(700).select(F.when(i % 5 != 0, i % 350).alias("order_id"),        # repeated keys, NULL keys
                            F.when(i % 7 != 0, F.when(i % 3 != 0, 4).otherwise(i)).alias("customer_id")) \
        .unionByName(spark.range(300).selectExpr("3 as order_id", "4 as customer_id")).write.parquet(f"{tmp_path}/orders")
    spark.range(0, 400, 2).select(i.alias("customer_id")).write.parquet(f"{tmp_path}/customers")
    spark.range(600).select((i % 400).alias("order_id"), (i % 9).alias("order_item_id"), (i % 30).alias("seller_id")).write.parquet(f"{tmp_path}/order_items")
    spark.range(20).select(i.alias("seller_id")).write.parquet(f"{tmp_path}/sellers")
    tables = {t: spark.read.parquet(f"{tmp_path}/{t}") for t in ("orders", "customers", "order_items", "sellers")}
    whole = sorted(map(tuple, ingest.key_counts(tables).collect()), key=repr)
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    counts = ingest.key_counts(tables, in_parts=("order_items",))
    branches = counts._jdf.queryExecution().executedPlan().toString().split("Generate explode")[1:]
    dealt = {re.search("ReadSchema: struct<(.*)>", b)[1].replace(":bigint", ""): "Exchange" in b.split("FileScan")[0] for b in branches}
    assert dealt == {"order_id,customer_id": True, "customer_id": True, "order_id,order_item_id,seller_id": False, "seller_id": False}
    assert sorted(map(tuple, counts.collect()), key=repr) == whole
    report = {r.table_name: tuple(r)[2:] for r in ingest.key_violations(tables, counts=counts).collect()}
    o = tables["orders"].groupBy("order_id").count().where("order_id is not null and count > 1")
    assert report["orders"] == (o.count(), o.agg(F.sum("count")).first()[0], tables["orders"].where("order_id is null").count())
    orphans = ingest.orphans(tables["orders"], "customer_id", tables["customers"], "customer_id").count()
    assert {r.orphan_rows for r in ingest.foreign_key_report(tables, counts=counts).collect() if r.child_column == "customer_id"} \
        == {orphans} and orphans > 0


def test_numbered_payments_are_dealt_before_they_are_summed(spark, tmp_path, monkeypatch):
    import souk.session as session
    from souk.sources import fixtures as fx

    monkeypatch.setattr(session, "TASK_ROWS", 2)
    i = F.col("id")
    spark.range(200).select(
        F.when(i % 11 != 0, i % 60).alias("l_orderkey"), (i * 10).cast("double").alias("l_extendedprice"), F.lit(0.1).alias("l_discount"),
        F.when(i % 13 != 0, F.element_at(F.array(*map(F.lit, "ANR")), (i % 3 + 1).cast("int"))).alias("l_returnflag")) \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    m = fx.marketplace(spark, str(tmp_path))
    plan = m.numbered_payments._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan.split("Exchange hashpartitioning")[1]
    assert sorted(map(tuple, m.numbered_payments.collect()), key=repr) == sorted(map(tuple, m.payments.collect()), key=repr)
    assert m.dealt == ("order_items", "payments") and fx.marketplace(spark, str(tmp_path), str(tmp_path)).dealt == ()
