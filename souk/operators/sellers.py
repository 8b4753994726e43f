"""Seller performance and marketplace health (BQ16-BQ19, BQ17a).

Seller-grain global windows (``ntile(10)`` over all sellers) are selected by grouped
counts (``with_tiles``), so sellers are never sorted. Revenue that the reference takes from
items joined to payments is factorised: payments are summed per order first, so the join
has a row per item and the product is never made. Category totals that
the reference takes with ``sum(sum(x)) over (partition by category)`` are a
second partial aggregation here: a category holding most sellers is summed
map-side instead of landing in one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import dates as D
from souk.functions import labels as L
from souk.functions.numeric import avg_double, count_if, pct, rnd, rnd_decimal, safe_div
from souk.operators.sales import order_payments, order_scores, valid_orders
from souk.operators.selection import Tiles, with_tiles
from souk.session import stored_table, tasks_for


def slow_dispatch_sellers(orders: DataFrame, order_items: DataFrame, min_orders: int = 5,
                          tiles: int = 10) -> DataFrame:
    """Sellers in the slowest ``ntile(10)`` of average approval-to-carrier hours.

    Hours are averaged at item grain (an order with three items counts three
    times), negatives dropped; ties in the ntile order are broken by seller_id.
    -> seller_id, total_orders_fulfilled, avg_dispatch_hours, avg_dispatch_days
    """
    o = orders.where(valid_orders(orders) & F.col("order_approved_at").isNotNull()
                     & F.col("order_delivered_carrier_date").isNotNull())
    # both sides in as many parts as the items need: what a task sorts and counts does not grow
    items = order_items.select("order_id", "seller_id").where(F.col("order_id").isNotNull())
    parts = tasks_for(items, order_items.count())
    lead = (
        o.select("order_id", D.seconds_between("order_approved_at", "order_delivered_carrier_date").alias("secs"))
        .where((F.col("secs") >= 0) & F.col("order_id").isNotNull()).repartition(parts, "order_id")
        .join(items.repartition(parts, "order_id"), "order_id")
    )
    perf = (
        lead.groupBy("seller_id")
        .agg(F.count_distinct("order_id").alias("total_orders_fulfilled"),
             # exact integer sum, then one division: identical in every engine
             safe_div(F.sum("secs") / 3600.0, F.count("secs")).alias("__hours"))
        .where(F.col("total_orders_fulfilled") >= min_orders)
    )
    ranked = with_tiles(stored_table(perf, "sellers"),
                        [Tiles([("__hours", False), ("seller_id", True)], tiles, "__decile")])
    return ranked.where(F.col("__decile") == 1).orderBy(F.desc("__hours")).select(
        "seller_id",
        "total_orders_fulfilled",
        rnd("__hours").alias("avg_dispatch_hours"),
        rnd(F.col("__hours") / 24.0).alias("avg_dispatch_days"),
    )


def _item_revenue(order_items: DataFrame, payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Each item of a valid order with what was paid for the order.

    Summed over items this equals the reference's sum over items x payment rows: the payment
    rows of an order are added up before they meet its items.
    """
    paid = orders.where(valid_orders(orders)).select("order_id").join(order_payments(payments), "order_id")
    return order_items.select("order_id", "product_id", "seller_id").join(paid, "order_id")


def category_concentration(order_items: DataFrame, products: DataFrame, payments: DataFrame,
                           orders: DataFrame) -> DataFrame:
    """Leader share and vendor count per category (item x payment fan-out revenue).

    -> product_category_name, total_vendors, leader_market_share_pct, market_health_status
    """
    rev = (
        _item_revenue(order_items, payments, orders)
        .join(products.where(F.col("product_category_name").isNotNull()), "product_id")
        .groupBy("product_category_name", "seller_id")
        .agg(F.sum("payment_value").alias("__rev"))
    )
    cats = rev.groupBy("product_category_name").agg(
        F.count("seller_id").alias("total_vendors"),  # one row per (category, seller) already
        F.max("__rev").alias("__top"),
        F.sum("__rev").alias("__total"),
    )
    share = rnd(pct("__top", "__total"))
    v = F.col("total_vendors")
    label = (
        F.when((share >= 50) & (v < 5), L.MARKET_HEALTH[0])
        .when(share >= 30, L.MARKET_HEALTH[1])
        .when((share < 15) & (v > 20), L.MARKET_HEALTH[2])
        .otherwise(L.MARKET_HEALTH[3])
    )
    return cats.select("product_category_name", "total_vendors", share.alias("leader_market_share_pct"),
                       label.alias("market_health_status")).orderBy(F.desc("leader_market_share_pct"))


def seller_pareto(order_items: DataFrame, payments: DataFrame, orders: DataFrame, tiles: int = 10) -> DataFrame:
    """Revenue per seller decile (``ntile(10)`` by fan-out revenue, descending).

    The reference computes the deciles and the platform total but never groups
    by them; this operator completes the question.
    -> seller_decile, seller_count, revenue, revenue_share_pct
    """
    rev = (
        _item_revenue(order_items, payments, orders)
        .groupBy("seller_id").agg(F.sum("payment_value").alias("__rev"))
    )
    ranked = with_tiles(stored_table(rev, "sellers"),
                        [Tiles([("__rev", False), ("seller_id", True)], tiles, "seller_decile")])
    deciles = ranked.groupBy("seller_decile").agg(
        F.count(F.lit(1)).alias("seller_count"), F.sum("__rev").alias("__rev"))
    total = F.sum("__rev").over(Window.partitionBy(F.lit(1)))  # at most ``tiles`` rows
    return deciles.select(
        "seller_decile",
        "seller_count",
        rnd("__rev").alias("revenue"),
        rnd(pct("__rev", total)).alias("revenue_share_pct"),
    ).orderBy("seller_decile")


def seller_churn(orders: DataFrame, order_items: DataFrame, base_year: int = 2017,
                 next_year: int = 2018) -> DataFrame:
    """Sellers active in ``base_year`` with no item in ``next_year``, and their cancel rates.

    All statuses count; canceled is summed over item rows, so a rate can exceed
    100 as in the reference. The mean rate is over per-seller rates rounded to
    two decimals. One grouped pass over (seller, order) pairs counts both years.
    -> churn_status, seller_count, avg_cancellation_rate_pct, avg_{base_year}_order_volume
    """
    lines = order_items.groupBy("seller_id", "order_id").agg(F.count(F.lit(1)).alias("__items"))
    year = F.year("order_purchase_timestamp")
    dated = (orders.where(year.isin(base_year, next_year))
             .select("order_id", year.alias("__year"), (F.col("order_status") == "canceled").alias("__canceled")))
    base = F.col("__year") == base_year
    cohort = (
        lines.join(dated, "order_id").groupBy("seller_id")
        .agg(count_if(base).alias("__orders"), count_if(~base).alias("__next"),
             F.coalesce(F.sum(F.when(base & F.col("__canceled"), F.col("__items"))), F.lit(0)).alias("__cancels"))
        .where(F.col("__orders") > 0)
    )
    churned, retained = (t.format(next_year=next_year) for t in L.SELLER_CHURN)
    status = F.when(F.col("__next") == 0, churned).otherwise(retained)
    return cohort.groupBy(status.alias("churn_status")).agg(
        F.count("seller_id").alias("seller_count"),
        rnd(avg_double(rnd_decimal(pct("__cancels", "__orders")))).alias("avg_cancellation_rate_pct"),
        rnd(avg_double("__orders")).alias(f"avg_{base_year}_order_volume"),
    )


def bad_review_sellers(order_items: DataFrame, orders: DataFrame, reviews: DataFrame, min_orders: int = 50,
                       max_score: float = 3) -> DataFrame:
    """High-volume sellers with a low average review score (item x review grain, from the
    reviews' sums per order).

    -> seller_id, total_orders, avg_review_score, one_star_count, pct_of_platform_one_stars
    """
    # an order's items at one seller are one row with their number; its reviews are one row, too
    lines = order_items.groupBy("seller_id", "order_id").agg(F.count(F.lit(1)).alias("__items"))
    items = F.col("__items")
    stats = (
        lines.join(orders.select("order_id"), "order_id").join(order_scores(reviews), "order_id")
        .groupBy("seller_id")
        .agg(F.count("order_id").alias("total_orders"),
             safe_div(F.sum(items * F.col("score_sum")), F.sum(items * F.col("scored"))).alias("__avg"),
             F.sum(items * F.col("one_star")).alias("one_star_count"))
        .where((F.col("total_orders") > min_orders) & (F.col("__avg") < max_score))
    )
    # platform total: one global aggregate row, broadcast (size is exactly one row)
    platform = reviews.agg(count_if(F.col("review_score") == 1).alias("__all_one"))
    return stats.crossJoin(F.broadcast(platform)).select(
        "seller_id",
        "total_orders",
        rnd("__avg").alias("avg_review_score"),
        "one_star_count",
        rnd(pct("one_star_count", "__all_one")).alias("pct_of_platform_one_stars"),
    ).orderBy(F.desc("one_star_count"))
