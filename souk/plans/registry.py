"""Query catalogue: name -> ``(spark, sf_dir) -> DataFrame``.

Each entry wires the reference-schema views (``souk.sources.fixtures``) into
one analysis operator with the parameters documented in FIXTURES.md. Building an
entry runs jobs where the operator stores an intermediate frame (ranges, order facts),
bounds a calendar by the data, or writes the files that an ingest entry reads back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.operators import delivery as dlv
from souk.operators import mart
from souk.operators import payments as pay
from souk.operators import retention as ret
from souk.operators import reviews as rev
from souk.operators import sales
from souk.operators import sellers as sel
from souk.operators import timeseries as ts
from souk.operators.mart_store import MartStore
from souk.sources import fixtures as fx
from souk.session import scratch_path as _scratch
from souk.session import stored_table
from souk.sources import ingest
from souk.sources.calendar import add_datekeys, calendar_check, calendar_spanning
from souk.sources.loads import IdentityKeys
from souk.sources.star import write_by_month
from souk.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

Make = Callable[[SparkSession, str], fx.Marketplace]


def _cal(m: fx.Marketplace) -> DataFrame:
    """A calendar that covers every purchase date in the data."""
    return calendar_spanning(m.orders, "order_purchase_timestamp", "order_purchase_timestamp")


def _payments_queries(_m: Make) -> dict[str, Query]:
    return {
        "payment_mix": lambda s, d: pay.payment_mix(_m(s, d).payments),
        "installment_stats": lambda s, d: pay.installment_stats(_m(s, d).payments),
        # line prices are 900-105,000 in the driver data, so the ticket is raised (FIXTURES.md)
        "installment_financing": lambda s, d: pay.installment_financing(_m(s, d).payments, ticket=50_000),
        "boleto_by_state": lambda s, d: (lambda m: pay.boleto_by_state(m.payments, m.orders, m.customers))(_m(s, d)),
    }


def _sales_queries(_m: Make) -> dict[str, Query]:
    return {
        "monthly_growth": lambda s, d: (lambda m: sales.monthly_growth(m.orders, m.payments, _cal(m)))(_m(s, d)),
        "category_volume_value": lambda s, d: (
            lambda m: sales.category_volume_value(m.order_items, m.products, m.orders))(_m(s, d)),
        "quarter_sales": lambda s, d: _quarter_sales(s, _m(s, d)),
        "rolling_revenue": lambda s, d: (lambda m: sales.rolling_revenue(m.orders, m.payments, _cal(m)))(_m(s, d)),
        "regional_profile": lambda s, d: (
            lambda m: sales.regional_profile(m.orders, m.customers, m.payments))(_m(s, d)),
        "aov_basket": lambda s, d: (
            lambda m: sales.aov_basket(m.orders, m.order_items, m.payments, _cal(m)))(_m(s, d)),
    }


def _delivery_queries(_m: Make) -> dict[str, Query]:
    return {
        "on_time_by_state": lambda s, d: (lambda m: dlv.on_time_by_state(m.orders, m.customers))(_m(s, d)),
        "freight_vs_speed": lambda s, d: (
            lambda m: dlv.freight_vs_speed(m.orders, m.customers, m.order_items))(_m(s, d)),
        "delivery_stages": lambda s, d: dlv.delivery_stages(_m(s, d).orders),
        "local_vs_longhaul": lambda s, d: (
            lambda m: dlv.local_vs_longhaul(m.orders, m.customers, m.order_items, m.sellers))(_m(s, d)),
        "freight_ratio": lambda s, d: (lambda m: dlv.freight_ratio(m.order_items, m.products))(_m(s, d)),
    }


def _seller_queries(_m: Make) -> dict[str, Query]:
    return {
        "slow_dispatch_sellers": lambda s, d: (
            lambda m: sel.slow_dispatch_sellers(m.orders, m.order_items))(_m(s, d)),
        "category_concentration": lambda s, d: (
            lambda m: sel.category_concentration(m.order_items, m.products, m.payments, m.orders))(_m(s, d)),
        "seller_pareto": lambda s, d: (lambda m: sel.seller_pareto(m.order_items, m.payments, m.orders))(_m(s, d)),
        "seller_churn": lambda s, d: (
            lambda m: sel.seller_churn(m.orders, m.order_items, base_year=1997, next_year=1998))(_m(s, d)),
        "bad_review_sellers": lambda s, d: (
            lambda m: sel.bad_review_sellers(m.order_items, m.orders, m.reviews))(_m(s, d)),
    }


def _review_queries(_m: Make) -> dict[str, Query]:
    return {
        "delay_vs_score": lambda s, d: (lambda m: rev.delay_vs_score(m.orders, m.reviews))(_m(s, d)),
        "delay_sentiment": lambda s, d: (lambda m: rev.delay_sentiment(m.orders, m.reviews))(_m(s, d)),
        "speed_quality_matrix": lambda s, d: (
            lambda m: rev.speed_quality_matrix(m.orders, m.order_items, m.products, m.reviews))(_m(s, d)),
        "category_archetypes": lambda s, d: (
            lambda m: rev.category_archetypes(m.orders, m.order_items, m.products, m.reviews))(_m(s, d)),
        "comment_effect": lambda s, d: rev.comment_effect(_m(s, d).reviews),
        "comment_feedback": lambda s, d: rev.comment_feedback(_m(s, d).reviews),
        "review_distribution": lambda s, d: (
            lambda m: rev.review_distribution(m.reviews, m.order_items, m.products, m.translation))(_m(s, d)),
        "review_polarization": lambda s, d: (lambda m: rev.review_polarization(m.reviews, m.order_items))(_m(s, d)),
        "one_star_sellers": lambda s, d: (lambda m: rev.one_star_sellers(m.reviews, m.order_items))(_m(s, d)),
        "response_time_effect": lambda s, d: rev.response_time_effect(_m(s, d).reviews),
    }


def _timeseries_queries(_m: Make) -> dict[str, Query]:
    def mop(fn):
        return lambda s, d: (lambda m: fn(m.orders, m.payments, _cal(m)))(_m(s, d))

    return {
        "growth_tiers": mop(ts.growth_tiers),
        "seasonality_index": mop(ts.seasonality_index),
        "cumulative_revenue": mop(ts.cumulative_revenue),
        "seasonality_report": mop(ts.seasonality_report),
        "cumulative_report": mop(ts.cumulative_report),
        # orders without a date form a NULL weekday and hour; nullable integers travel as DOUBLE
        "order_heatmap": lambda s, d: ts.order_heatmap(_m(s, d).orders).withColumns(
            {c: F.col(c).cast("double") for c in ("day_num", "hour_of_day")}),
        # order minutes are synthetic in the fixture; events carry real times of day (FIXTURES.md)
        "event_heatmap": lambda s, d: ts.activity_heatmap(read_table(s, d, "events"), "ts", "event_id"),
    }


def _retention_queries(_m: Make) -> dict[str, Query]:
    return {
        "rfm_segments": lambda s, d: (lambda m: ret.rfm_segments(m.orders, m.customers, m.payments))(_m(s, d)),
        "cohort_retention": lambda s, d: (lambda m: ret.cohort_retention(m.orders, m.customers))(_m(s, d)),
        "customer_pareto": lambda s, d: (lambda m: ret.customer_pareto(m.orders, m.customers, m.payments))(_m(s, d)),
        "customer_running_revenue": lambda s, d: (
            lambda m: ret.customer_running_revenue(m.orders, m.customers, m.payments))(_m(s, d)),
        "purchase_latency": lambda s, d: (lambda m: ret.purchase_latency(
            m.orders, m.customers, m.order_items, m.products, m.translation))(_m(s, d)),
        "churn_risk_count": lambda s, d: (lambda m: ret.churn_risk_count(m.orders, m.customers))(_m(s, d)),
    }


def _orders_csv(spark: SparkSession, m: fx.Marketplace) -> DataFrame:
    """Write the marketplace orders as CSV (as the reference receives them), load them back as text."""
    path = _scratch(spark, "orders-csv")
    fx.raw_orders(m).write.option("header", True).csv(path)
    return ingest.load_raw(spark, path, columns=list(ingest.TYPE_SPEC["orders"]))


def _load_profile(spark: SparkSession, m: fx.Marketplace) -> DataFrame:
    """Cast failures and date ranges of the orders, counted by the load itself; and the
    rows that the load stored."""
    spec = ingest.TYPE_SPEC["orders"]
    table, profile = ingest.load_typed(_orders_csv(spark, m), spec, "orders", _scratch(spark, "orders-typed"),
                                       min_valid_ts="1990-01-01")
    return profile.crossJoin(F.broadcast(table.agg(F.count(F.lit(1)).alias("loaded_rows"))))      # one row


RAW_FILES = {"customers": "shop_customers_dataset", "orders": "shop_orders_dataset", "order_items": "shop_order_items_dataset",
             "payments": "shop_order_payments_dataset", "sellers": "shop_sellers_dataset"}


def _star_from_files(spark: SparkSession, m: fx.Marketplace) -> DataFrame:
    """Raw files under their long names, loaded as a star; what came of each column."""
    folder = _scratch(spark, "raw-files")
    for name, stem in RAW_FILES.items():
        raw = fx.raw_orders(m) if name == "orders" else ingest.render_timestamps(getattr(m, name))
        raw.write.option("header", True).csv(f"{folder}/{stem}.csv")
    star = ingest.load_star_schema(spark, folder, min_valid_ts="1990-01-01")
    return ingest.column_profile(star.tables)


def _quarter_sales(spark: SparkSession, m: fx.Marketplace) -> DataFrame:
    """One quarter of the sales stored by month."""
    path = _scratch(spark, "sales-by-month")
    write_by_month(sales.dated_sales(m.orders, m.payments), path, "purchase_datekey", "order_id")
    return sales.quarter_sales(spark.read.parquet(path), _cal(m), 1996, 2)


def _reviews_csv(spark: SparkSession, m: fx.Marketplace) -> DataFrame:
    """Write the reviews as CSV with line breaks and quotes in the comments, load them back."""
    path = _scratch(spark, "reviews-csv")
    said = F.concat("review_comment_message", F.lit('\nso "good",\n\n'), F.col("review_id").cast("string"))
    ingest.render_timestamps(m.reviews.withColumn("review_comment_message", said)) \
        .write.option("header", True).option("escape", '"').csv(path)
    columns = [c for c in ingest.TYPE_SPEC["order_reviews"] if c in m.reviews.columns]
    raw = ingest.load_raw(spark, path, columns, multi_line=True)
    return ingest.render_timestamps(ingest.normalise(raw, ingest.TYPE_SPEC["order_reviews"])
                                    .withColumn("review_score", F.col("review_score").cast("double")))


def _review_identity_keys(spark: SparkSession, m: fx.Marketplace) -> DataFrame:
    """Reviews loaded twice; the second load brings those of the first again, and the rest."""
    keys = IdentityKeys(spark, _scratch(spark, "review-keys"))
    natural = ["review_id", "order_id"]
    early = m.reviews.where(F.col("order_id") % 3 == 0)
    keys.assign(early, natural, "review_sk")
    return ingest.render_timestamps(keys.assign(m.reviews, natural, "review_sk")
                                    .withColumn("review_score", F.col("review_score").cast("double")))


def _mart_read_back(spark: SparkSession, m: fx.Marketplace) -> DataFrame:
    """Write the mart, read it back as its consumers do, one row per cohort year."""
    path = _scratch(spark, "mart")
    mart.write_customer_360(_customer_360(m), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("cohort_year").cast("string").alias("cohort_year")).agg(
        F.count("customer_unique_id").alias("customers"), F.sum("total_orders").alias("orders"),
        F.max("last_purchase_date").alias("last_purchase_date"))


def _star(m: fx.Marketplace) -> dict[str, DataFrame]:
    orders = add_datekeys(m.orders, ingest.ORDER_DATEKEYS)
    return {"calendar": _data_calendar(m), "customers": m.customers, "orders": orders, "order_items": m.numbered_items,
            "payments": m.numbered_payments, "order_reviews": m.reviews, "products": m.products, "sellers": m.sellers}


def _sizes(m: fx.Marketplace) -> dict[str, int]:
    """Rows of the large tables, or a bound that costs less than counting them: an order has a
    customer row at most, an item a payment row at most."""
    orders, items = m.orders.count(), m.order_items.count()
    return {"orders": orders, "customers": orders, "order_items": items, "payments": items}


def _data_calendar(m: fx.Marketplace) -> DataFrame:
    return calendar_spanning(m.orders, "order_purchase_timestamp", "order_estimated_delivery_date")


def _integrity_report(spark: SparkSession, m: fx.Marketplace) -> DataFrame:
    """Both reports from one stored pass over the star schema."""
    tables = _star(m)
    counts = stored_table(ingest.key_counts(tables, sizes=_sizes(m), in_parts=m.dealt), "key-counts")
    bad = F.col("duplicate_keys") + F.col("null_keys")
    keys = ingest.key_violations(tables, counts=counts).select(
        F.lit("key").alias("constraint_type"), "table_name", F.col("key_columns").alias("column_names"),
        bad.alias("violations"))
    return keys.unionByName(ingest.foreign_key_report(tables, counts=counts).select(
        F.lit("foreign key").alias("constraint_type"), F.col("child_table").alias("table_name"),
        F.col("child_column").alias("column_names"), F.col("orphan_rows").alias("violations")))


def _ingest_queries(_m: Make) -> dict[str, Query]:
    spec = ingest.TYPE_SPEC["orders"]
    return {
        "ingest_orders_csv": lambda s, d: ingest.render_timestamps(
            ingest.normalise(_orders_csv(s, _m(s, d)), spec, min_valid_ts="1990-01-01")),
        "ingest_star_profile": lambda s, d: _star_from_files(s, _m(s, d)),
        "column_profile": lambda s, d: (lambda m: ingest.column_profile({
            "orders": m.orders, "payments": m.payments, "products": m.products, "order_reviews": m.reviews}))(_m(s, d)),
        "orders_preview": lambda s, d: ingest.render_timestamps(
            ingest.preview(_m(s, d).orders, 10, ["order_purchase_timestamp", "order_id"])),
        "ingest_load_profile": lambda s, d: _load_profile(s, _m(s, d)),
        "ingest_reviews_csv": lambda s, d: _reviews_csv(s, _m(s, d)),
        "review_identity_keys": lambda s, d: _review_identity_keys(s, _m(s, d)),
        "ingest_cast_failures": lambda s, d: ingest.cast_failures(_orders_csv(s, _m(s, d)), spec, "orders"),
        "date_range_profile": lambda s, d: (lambda m: ingest.date_range_profile([
            ("orders", m.orders, c) for c in (
                "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
                "order_delivered_customer_date", "order_estimated_delivery_date")
        ] + [("order_items", m.order_items, "shipping_limit_date"),
             ("order_reviews", m.reviews, "review_creation_date"),
             ("order_reviews", m.reviews, "review_answer_timestamp")]))(_m(s, d)),
        "calendar_dimension": lambda s, d: _data_calendar(_m(s, d)).withColumn(
            "full_date", F.date_format("full_date", "yyyy-MM-dd")),
        "calendar_check": lambda s, d: calendar_check(_data_calendar(_m(s, d))).select(
            F.date_format("min_date", "yyyy-MM-dd").alias("min_date"),
            F.date_format("max_date", "yyyy-MM-dd").alias("max_date"), "day_count"),
        "key_violations": lambda s, d: (lambda m: ingest.key_violations(_star(m), sizes=_sizes(m), in_parts=m.dealt))(_m(s, d)),
        "foreign_key_report": lambda s, d: (
            lambda m: ingest.foreign_key_report(_star(m), sizes=_sizes(m), in_parts=m.dealt))(_m(s, d)),
        "integrity_report": lambda s, d: _integrity_report(s, _m(s, d)),
        "review_surrogate_keys": lambda s, d: ingest.render_timestamps(
            ingest.add_surrogate_key(_m(s, d).reviews, ["review_id", "order_id"], "review_sk")
            .withColumn("review_score", F.col("review_score").cast("double"))),
    }


AS_OF_DATE = "2002-01-01"  # fixed "today" for the mart (the reference uses GETDATE())


def _customer_360(m: fx.Marketplace) -> DataFrame:
    return mart.customer_360(m.customers, m.geolocation, m.orders, m.order_items, m.payments, m.reviews, AS_OF_DATE)


def _mart_in_two_loads(spark: SparkSession, m: fx.Marketplace) -> DataFrame:
    """All orders in two loads. The first has the orders of the first years, and some
    later ones as shipped; the second brings the others, and those again as they ended."""
    store = MartStore(spark, _scratch(spark, "mart-store"))
    early = F.coalesce(F.year("order_purchase_timestamp") < 1996, F.lit(True))
    underway = F.col("order_id") % 17 == 0
    none = F.lit(None).cast("timestamp")
    shipped = m.orders.where(~early & underway).withColumns(
        {"order_status": F.lit("shipped"), "order_delivered_customer_date": none})
    for orders in (m.orders.where(early).unionByName(shipped), m.orders.where(~early)):
        ids = orders.select("order_id")
        items, pays, revs = (t.join(ids, "order_id", "left_semi") for t in (m.order_items, m.payments, m.reviews))
        store.load(orders, m.customers, items, pays, revs, m.geolocation)
    return store.mart(AS_OF_DATE)


def _mart_queries(_m: Make) -> dict[str, Query]:
    return {
        "customer_360": lambda s, d: _customer_360(_m(s, d)),
        "customer_360_two_loads": lambda s, d: _mart_in_two_loads(s, _m(s, d)),
        "customer_360_read_back": lambda s, d: _mart_read_back(s, _m(s, d)),
        "customer_delivery_median": lambda s, d: (lambda m: mart.delivery_median(m.orders, m.customers))(_m(s, d)),
        "customer_payment_mode": lambda s, d: (
            lambda m: mart.payment_type_mode(m.payments, m.orders, m.customers))(_m(s, d)),
    }


def queries(star_dir: str | None = None) -> dict[str, Query]:
    """All queries; with ``star_dir`` they read the star schema stored there."""

    def make(spark: SparkSession, sf_dir: str) -> fx.Marketplace:
        return fx.marketplace(spark, sf_dir, star_dir)

    out: dict[str, Query] = {}
    for part in (_retention_queries, _sales_queries, _delivery_queries, _seller_queries, _payments_queries,
                 _review_queries, _timeseries_queries, _mart_queries,
                 _ingest_queries):
        out.update(part(make))
    return out
