"""Customer segmentation and retention (BQ1-BQ5).

Scale notes:
* RFM scores and the Pareto split are ranking windows over *all* customers. The
  three scores are selected together (``with_tiles``: grouped counts, no sort); the
  percent rank is taken range by range. The per-customer base is stored in the
  shared folder first, because the passes read it.
* Payments are summed per order before any join, so no fan-out is counted.
* Inter-purchase gaps are ``lag`` per customer at order grain. ``grouped_lag``
  spreads a customer holding a large share of all orders over several tasks.
* Cohorts aggregate to distinct (customer, month) first, so the per-customer
  window sees at most one row per calendar month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import dates as D
from souk.functions import labels as L
from souk.functions.numeric import avg_double, pct, rnd
from souk.operators.ranks import global_percent_rank, global_running_sum, grouped_lag
from souk.operators.sales import order_payments, valid_orders
from souk.operators.selection import Tiles, with_tiles
from souk.session import stored_table


def _person_orders(orders: DataFrame, customers: DataFrame, cond) -> DataFrame:
    return (orders.where(cond).select("order_id", "customer_id", "order_purchase_timestamp")
            .join(customers.select("customer_id", "customer_unique_id"), "customer_id"))


def rfm_segments(orders: DataFrame, customers: DataFrame, payments: DataFrame,
                 checkpoint: bool = True) -> DataFrame:
    """RFM quintiles over delivered orders and the mean profile of each segment.

    Reference date = latest purchase over *all* orders. Scores: ntile(5) by
    recency descending, by frequency and by monetary ascending (ties broken by
    customer_unique_id). Segment rule uses ``(f + m) div 2``.
    -> customer_segment, customer_count, avg_recency_score, avg_frequency_score,
       avg_monetary_score, avg_days_since_last_order, avg_frequency_count, avg_lifetime_spend
    """
    max_date = orders.agg(F.max("order_purchase_timestamp").alias("__max_date"))  # one row
    base = (
        _person_orders(orders, customers, F.col("order_status") == "delivered")
        .join(order_payments(payments), "order_id")
        .groupBy("customer_unique_id")
        .agg(F.max("order_purchase_timestamp").alias("__last"),
             F.count("order_id").alias("frequency_count"),
             F.sum("payment_value").alias("monetary_value"))
        .crossJoin(F.broadcast(max_date))
        .select("customer_unique_id", "frequency_count", "monetary_value",
                D.days_between("__last", "__max_date").alias("recency_days"))
    )
    if checkpoint:
        base = stored_table(base, "rfm")
    key = ("customer_unique_id", True)
    scored = with_tiles(base, [Tiles([("recency_days", False), key], 5, "r_score"),
                               Tiles([("frequency_count", True), key], 5, "f_score"),
                               Tiles([("monetary_value", True), key], 5, "m_score")])
    rs, fm = F.col("r_score"), F.expr("(f_score + m_score) div 2")
    seg = (
        F.when((rs >= 4) & (fm >= 4), L.RFM_BQ[0]).when((rs >= 3) & (fm >= 3), L.RFM_BQ[1])
        .when((rs <= 2) & (fm >= 4), L.RFM_BQ[2]).when((rs <= 2) & (fm <= 2), L.RFM_BQ[3])
        .otherwise(L.RFM_BQ[4])
    )
    return scored.groupBy(seg.alias("customer_segment")).agg(
        F.count("customer_unique_id").alias("customer_count"),
        rnd(avg_double("r_score")).alias("avg_recency_score"),
        rnd(avg_double("f_score")).alias("avg_frequency_score"),
        rnd(avg_double("m_score")).alias("avg_monetary_score"),
        avg_double("recency_days").cast("long").alias("avg_days_since_last_order"),
        avg_double("frequency_count").cast("long").alias("avg_frequency_count"),
        rnd(avg_double("monetary_value")).alias("avg_lifetime_spend"),
    ).orderBy(F.desc("customer_count"))


def cohort_retention(orders: DataFrame, customers: DataFrame, months: tuple[int, ...] = (1, 3, 6),
                     min_size: int = 10) -> DataFrame:
    """Share of each monthly acquisition cohort that buys again k months later.

    month index = month boundaries crossed since the cohort month.
    -> cohort_month (yyyy-MM-dd), cohort_size, month_{k}_retention_pct for k in months
    """
    active = (
        _person_orders(orders, customers, valid_orders(orders))
        .select("customer_unique_id", D.month_start("order_purchase_timestamp").alias("__month"))
        .distinct()  # at most one row per customer and calendar month
    )
    first = F.min("__month").over(Window.partitionBy("customer_unique_id"))
    idx = active.withColumn("__cohort", first).withColumn(
        "__idx", D.months_between_boundaries("__cohort", "__month"))
    agg = idx.groupBy("__cohort").agg(
        F.count(F.when(F.col("__idx") == 0, 1)).alias("cohort_size"),
        *[F.count(F.when(F.col("__idx") == k, 1)).alias(f"__m{k}") for k in months],
    ).where(F.col("cohort_size") > min_size)
    return agg.select(
        F.date_format("__cohort", "yyyy-MM-dd").alias("cohort_month"),
        "cohort_size",
        *[rnd(pct(f"__m{k}", "cohort_size")).alias(f"month_{k}_retention_pct") for k in months],
    ).orderBy("cohort_month")


def customer_spend(orders: DataFrame, customers: DataFrame, payments: DataFrame) -> DataFrame:
    """``customer_unique_id, total_spend`` over valid orders."""
    return (
        _person_orders(orders, customers, valid_orders(orders))
        .join(order_payments(payments), "order_id")
        .groupBy("customer_unique_id").agg(F.sum("payment_value").alias("total_spend"))
    )


def customer_running_revenue(orders: DataFrame, customers: DataFrame, payments: DataFrame,
                             buckets: int | None = None) -> DataFrame:
    """Customers by spend with the revenue of all who spend at least as much.

    ``sum(total_spend) over (order by total_spend desc)``: its frame is RANGE, so customers
    with equal spend share one running total.
    -> customer_unique_id, total_spend, cumulative_revenue, cumulative_pct
    """
    running = global_running_sum(customer_spend(orders, customers, payments),
                                 [("total_spend", False), ("customer_unique_id", True)], 1,
                                 "total_spend", "__running", "__total", buckets)
    return running.select(
        "customer_unique_id", rnd("total_spend").alias("total_spend"),
        rnd("__running").alias("cumulative_revenue"), rnd(pct("__running", "__total")).alias("cumulative_pct"))


def customer_pareto(orders: DataFrame, customers: DataFrame, payments: DataFrame, top: float = 0.20,
                    buckets: int | None = None) -> DataFrame:
    """Customers in the top ``top`` spend percentile vs the rest, and their revenue share.

    -> customer_tier, customer_count, revenue_contribution, revenue_pct
    """
    spend = customer_spend(orders, customers, payments)
    ranked = global_percent_rank(spend, [("total_spend", False), ("customer_unique_id", True)], 1,
                                 "__pr", buckets)
    tier = F.when(F.col("__pr") <= top, L.PARETO_TIERS[0]).otherwise(L.PARETO_TIERS[1])
    tiers = ranked.groupBy(tier.alias("customer_tier")).agg(
        F.count("customer_unique_id").alias("customer_count"), F.sum("total_spend").alias("__rev"))
    total = F.sum("__rev").over(Window.partitionBy(F.lit(1)))  # two rows
    return tiers.select("customer_tier", "customer_count", rnd("__rev").alias("revenue_contribution"),
                        rnd(pct("__rev", total)).alias("revenue_pct")).orderBy(F.desc("revenue_pct"))


def purchase_latency(orders: DataFrame, customers: DataFrame, order_items: DataFrame, products: DataFrame,
                     translation: DataFrame, min_events: int = 5, buckets: int | None = None) -> DataFrame:
    """Days since the customer's previous purchase row, per product category.

    Purchase rows are items, in the order (purchase time, order_id, order_item_id).
    Items of one order follow each other with a 0-day gap, so only the order's first item
    has a gap to look up: the lag runs over one narrow row per order (person, time, category
    of the first item), and all other items are counted as 0-day events per category.
    -> product_category_name, product_category_name_english, repeat_purchase_events,
       avg_days_between_orders, min_days, max_days
    """
    lines = stored_table(
        order_items.select("order_id", "order_item_id", "product_id")
        .join(products.select("product_id", "product_category_name"), "product_id")
        .groupBy("order_id", "product_category_name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("order_item_id").alias("item"))
        .join(_person_orders(orders, customers, valid_orders(orders) & F.col("order_purchase_timestamp").isNotNull())
              .drop("customer_id"), "order_id"), "lines")
    baskets = lines.groupBy("order_id").agg(
        F.first("customer_unique_id").alias("customer_unique_id"),
        F.first("order_purchase_timestamp").alias("order_purchase_timestamp"),
        F.min_by("product_category_name", "item").alias("product_category_name"))
    lagged = grouped_lag(baskets, ["customer_unique_id"], [("order_purchase_timestamp", True), ("order_id", True)],
                         "order_purchase_timestamp", "__prev", buckets)
    gap = D.days_between("__prev", "order_purchase_timestamp")      # NULL on a customer's first order
    openings = lagged.groupBy("product_category_name").agg(
        F.count(F.lit(1)).alias("__opened"), F.count(gap).alias("__gaps"), F.sum(gap).alias("__days"),
        F.min(gap).alias("__min"), F.max(gap).alias("__max"))
    items = lines.groupBy(F.col("product_category_name").alias("__category")).agg(F.sum("n").alias("__items"))
    zeros = F.col("__items") - F.coalesce("__opened", F.lit(0))
    zero = F.when(zeros > 0, 0)
    agg = (                                                         # rows per category
        items.join(openings, F.col("__category").eqNullSafe(F.col("product_category_name")), "left")
        .select(F.col("__category").alias("product_category_name"),
                (zeros + F.coalesce("__gaps", F.lit(0))).alias("repeat_purchase_events"),
                F.coalesce("__days", F.lit(0)).cast("long").alias("__days"),
                F.least("__min", zero).cast("long").alias("min_days"),
                F.greatest("__max", zero).cast("long").alias("max_days"))
        .where(F.col("repeat_purchase_events") >= min_events)
    )
    return (
        agg.join(translation, "product_category_name", "left")  # one row per category
        .select("product_category_name", "product_category_name_english", "repeat_purchase_events",
                F.call_function("div", F.col("__days"), F.col("repeat_purchase_events"))
                .cast("long").alias("avg_days_between_orders"), "min_days", "max_days")
        .orderBy(F.desc("repeat_purchase_events"), "avg_days_between_orders")
    )


def churn_risk_count(orders: DataFrame, customers: DataFrame, k: float = 2,
                     buckets: int | None = None) -> DataFrame:
    """Customers whose days since last order exceed mean + k * stdev of repurchase gaps.

    -> high_risk_churn_customer_count
    """
    po = _person_orders(orders, customers, valid_orders(orders))
    lagged = grouped_lag(po, ["customer_unique_id"], [("order_purchase_timestamp", True), ("order_id", True)],
                         "order_purchase_timestamp", "__prev", buckets)
    gaps = lagged.where(F.col("__prev").isNotNull()).select(
        D.days_between("__prev", "order_purchase_timestamp").alias("__gap"))
    stats = gaps.agg((avg_double("__gap") + F.lit(k) * F.stddev_samp(F.col("__gap").cast("double")))
                     .alias("__threshold"))  # one row
    max_date = orders.agg(F.max("order_purchase_timestamp").alias("__max_date"))  # one row, all statuses
    last = lagged.groupBy("customer_unique_id").agg(F.max("order_purchase_timestamp").alias("__last"))
    flagged = (  # one row per customer
        last.crossJoin(F.broadcast(max_date)).crossJoin(F.broadcast(stats))
        .where(D.days_between("__last", "__max_date") > F.col("__threshold"))
    )
    return flagged.agg(F.count("customer_unique_id").alias("high_risk_churn_customer_count"))
