"""Delivery and logistics (BQ11-BQ15).

National benchmarks are the mean of per-state means (not the order-weighted
mean), as in the reference; they are computed over the small per-state frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import dates as D
from souk.functions import labels as L
from souk.functions.numeric import avg_double, count_if, pct, rnd, safe_div

def _all() -> Window:
    """Whole-frame window; used only on one-row-per-state frames."""
    return Window.partitionBy(F.lit(1))


def _delivered(orders: DataFrame) -> DataFrame:
    return orders.where((F.col("order_status") == "delivered")
                        & F.col("order_delivered_customer_date").isNotNull())


def on_time_by_state(orders: DataFrame, customers: DataFrame, band: float = 2) -> DataFrame:
    """On-time rate and estimate accuracy (days of buffer) per customer state.

    -> customer_state, total_delivered_orders, on_time_rate, avg_accuracy_days,
       national_benchmark, relative_performance
    """
    d = (
        _delivered(orders).where(F.col("order_estimated_delivery_date").isNotNull())
        .select("order_id", "customer_id",
                (F.col("order_delivered_customer_date") <= F.col("order_estimated_delivery_date")).alias("on_time"),
                D.days_between("order_delivered_customer_date", "order_estimated_delivery_date").alias("variance"))
        .join(customers.select("customer_id", "customer_state"), "customer_id")
    )
    states = d.groupBy("customer_state").agg(
        F.count("order_id").alias("total_delivered_orders"),
        count_if(F.col("on_time")).alias("__on_time"),
        avg_double("variance").alias("__acc"),
    ).withColumn("__nat", F.avg("__acc").over(_all()))
    acc, nat = F.col("__acc"), F.col("__nat")
    label = (
        F.when(acc > nat + band, L.DELIVERY_BUFFER[0])
        .when(acc < nat - band, L.DELIVERY_BUFFER[1])
        .otherwise(L.DELIVERY_BUFFER[2])
    )
    return states.select(
        "customer_state",
        "total_delivered_orders",
        rnd(pct("__on_time", "total_delivered_orders")).alias("on_time_rate"),
        rnd(acc).alias("avg_accuracy_days"),
        rnd(nat).alias("national_benchmark"),
        label.alias("relative_performance"),
    ).orderBy(F.desc("avg_accuracy_days"))


def freight_vs_speed(orders: DataFrame, customers: DataFrame, order_items: DataFrame) -> DataFrame:
    """Order freight and delivery days per state vs the mean of state means.

    Items are summed per order before the state averages (order grain).
    -> customer_state, avg_freight, avg_delivery_days, logistics_classification
    """
    freight = order_items.groupBy("order_id").agg(F.sum("freight_value").alias("total_order_freight"))
    per_order = (
        _delivered(orders)
        .select("order_id", "customer_id",
                D.days_between("order_purchase_timestamp", "order_delivered_customer_date").alias("days"))
        .join(freight, "order_id")
        .join(customers.select("customer_id", "customer_state"), "customer_id")
    )
    states = per_order.groupBy("customer_state").agg(
        avg_double("total_order_freight").alias("__f"), avg_double("days").alias("__d"),
    ).withColumn("__nf", F.avg("__f").over(_all())).withColumn("__nd", F.avg("__d").over(_all()))
    f, d, nf, nd = F.col("__f"), F.col("__d"), F.col("__nf"), F.col("__nd")
    label = (
        F.when((f > nf) & (d > nd), L.LOGISTICS_CLASSES[0])
        .when((f > nf) & (d <= nd), L.LOGISTICS_CLASSES[1])
        .when((f <= nf) & (d > nd), L.LOGISTICS_CLASSES[2])
        .otherwise(L.LOGISTICS_CLASSES[3])
    )
    return states.orderBy(F.desc("__f"), F.desc("__d")).select(
        "customer_state",
        rnd(f).alias("avg_freight"),
        rnd(d).alias("avg_delivery_days"),
        label.alias("logistics_classification"),
    )


def delivery_stages(orders: DataFrame) -> DataFrame:
    """Average approval / dispatch / last-mile / total lead time and stage shares.

    Durations in seconds (bigint, no overflow); orders with a negative stage are
    dropped. One global aggregate row.
    -> avg_approval_days, avg_dispatch_days, avg_last_mile_days, avg_total_lead_days,
       approval_pct_contribution, dispatch_pct_contribution, last_mile_pct_contribution
    """
    o = _delivered(orders).where(F.col("order_approved_at").isNotNull()
                                 & F.col("order_delivered_carrier_date").isNotNull())
    secs = o.select(
        D.seconds_between("order_purchase_timestamp", "order_approved_at").alias("a"),
        D.seconds_between("order_approved_at", "order_delivered_carrier_date").alias("b"),
        D.seconds_between("order_delivered_carrier_date", "order_delivered_customer_date").alias("c"),
        D.seconds_between("order_purchase_timestamp", "order_delivered_customer_date").alias("t"),
    ).where((F.col("a") >= 0) & (F.col("b") >= 0) & (F.col("c") >= 0))
    hours = {k: safe_div(F.sum(k) / 3600.0, F.count(k)) for k in "abct"}
    agg = secs.agg(*[v.alias(f"__{k}") for k, v in hours.items()])
    days = {k: F.col(f"__{k}") / 24.0 for k in "abct"}
    return agg.select(
        rnd(days["a"]).alias("avg_approval_days"),
        rnd(days["b"]).alias("avg_dispatch_days"),
        rnd(days["c"]).alias("avg_last_mile_days"),
        rnd(days["t"]).alias("avg_total_lead_days"),
        rnd(pct("__a", "__t")).alias("approval_pct_contribution"),
        rnd(pct("__b", "__t")).alias("dispatch_pct_contribution"),
        rnd(pct("__c", "__t")).alias("last_mile_pct_contribution"),
    )


def local_vs_longhaul(orders: DataFrame, customers: DataFrame, order_items: DataFrame,
                      sellers: DataFrame) -> DataFrame:
    """Same-state vs cross-state shipments: speed, on-time rate, speed premium.

    Rows are distinct (order, customer state, seller state, dates) before
    aggregation, so an order with sellers in two states counts once per type.
    -> shipment_type, shipment_count, avg_delivery_days, on_time_rate_pct, speed_premium_days
    """
    o = _delivered(orders).select("order_id", "customer_id", "order_purchase_timestamp",
                                  "order_delivered_customer_date", "order_estimated_delivery_date")
    # facts first: orders and items of a star bucketed by order_id meet without an exchange.
    # Sellers and customers are not bounded by construction: AQE picks their joins by size
    shipments = o.join(order_items.select("order_id", "seller_id"), "order_id")
    rows = (
        shipments.join(sellers.select("seller_id", "seller_state"), "seller_id")
        .join(customers.select("customer_id", "customer_state"), "customer_id")
        .select("order_id", "customer_state", "seller_state", "order_purchase_timestamp",
                "order_delivered_customer_date", "order_estimated_delivery_date")
        .distinct()
        .withColumn("shipment_type", F.when(F.col("customer_state") == F.col("seller_state"), L.SHIPMENT_TYPES[0])
                    .otherwise(L.SHIPMENT_TYPES[1]))
    )
    stats = rows.groupBy("shipment_type").agg(
        F.count(F.lit(1)).alias("shipment_count"),
        safe_div(F.sum(D.seconds_between("order_purchase_timestamp", "order_delivered_customer_date")) / 86400.0,
                 F.count(F.lit(1))).alias("__days"),
        count_if(F.col("order_delivered_customer_date") <= F.col("order_estimated_delivery_date")).alias("__on"),
    )
    premium = F.lag("__days").over(Window.orderBy(F.desc("__days"))) - F.col("__days")  # two rows
    return stats.select(
        "shipment_type",
        "shipment_count",
        rnd("__days").alias("avg_delivery_days"),
        rnd(pct("__on", "shipment_count")).alias("on_time_rate_pct"),
        rnd(premium).alias("speed_premium_days"),
    )


def freight_ratio(order_items: DataFrame, products: DataFrame, high: float = 0.20, low: float = 0.10) -> DataFrame:
    """Freight as a share of price per category (all items, no status filter).

    -> product_category_name, avg_price, avg_freight, freight_ratio_pct, shipping_cost_impact
    """
    cats = (
        order_items.select("product_id", "price", "freight_value")
        .join(products.where(F.col("product_category_name").isNotNull()), "product_id")
        .groupBy("product_category_name")
        .agg(avg_double("price").alias("__p"), avg_double("freight_value").alias("__f"),
             F.sum("price").alias("__rev"), F.sum("freight_value").alias("__fr"))
    )
    ratio = safe_div("__fr", "__rev")
    label = (
        F.when(ratio > high, L.FREIGHT_IMPACT[0])
        .when(ratio.between(low, high), L.FREIGHT_IMPACT[1])
        .otherwise(L.FREIGHT_IMPACT[2])
    )
    return cats.select(
        "product_category_name",
        rnd("__p").alias("avg_price"),
        rnd("__f").alias("avg_freight"),
        rnd(pct("__fr", "__rev")).alias("freight_ratio_pct"),
        label.alias("shipping_cost_impact"),
    ).orderBy(F.desc("freight_ratio_pct"))
