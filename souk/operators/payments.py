"""Payments and financial risk (BQ20-BQ22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import labels as L
from souk.functions.numeric import avg_double, count_if, pct, rnd, safe_div


def payment_mix(payments: DataFrame) -> DataFrame:
    """Revenue, share and average ticket per payment type (all payment rows).

    -> payment_type, transaction_count, revenue_contribution, revenue_share_pct,
       atv, payment_profile
    """
    by_type = payments.groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("payment_value").alias("total_revenue"),
        avg_double("payment_value").alias("avg_value"),
    )
    # one row per payment type: the grand total is a window over a handful of rows
    grand = F.sum("total_revenue").over(Window.partitionBy(F.lit(1)))
    profile = (
        F.when(F.col("payment_type") == "credit_card", L.PAYMENT_PROFILES[0])
        .when(F.col("payment_type") == "boleto", L.PAYMENT_PROFILES[1])
        .otherwise(L.PAYMENT_PROFILES[2])
    )
    return by_type.select(
        "payment_type",
        "transaction_count",
        rnd("total_revenue").alias("revenue_contribution"),
        rnd(pct("total_revenue", grand)).alias("revenue_share_pct"),
        rnd("avg_value").alias("atv"),
        profile.alias("payment_profile"),
    ).orderBy(F.desc("revenue_contribution"))


def installment_stats(payments: DataFrame) -> DataFrame:
    """Credit-card payment rows per installment count.

    -> payment_installments, order_count, avg_payment_value
    """
    return (
        payments.where((F.col("payment_type") == "credit_card") & (F.col("payment_installments") > 0))
        .groupBy("payment_installments")
        .agg(F.count(F.lit(1)).alias("order_count"), rnd(avg_double("payment_value")).alias("avg_payment_value"))
        .orderBy("payment_installments")
    )


def installment_financing(payments: DataFrame, ticket: float = 500, min_installments: int = 5) -> DataFrame:
    """Share of high-ticket credit-card payment rows paid in many installments.

    One scan with conditional aggregates. Rows with 0 or unknown installments count
    as high-ticket rows; the two averages name their installment number anyway.
    -> total_high_ticket_orders, high_installment_count, high_ticket_financing_pct,
       avg_val_1_inst, avg_val_10_inst
    """
    cc = payments.where(F.col("payment_type") == "credit_card")
    inst, value = F.col("payment_installments"), F.col("payment_value")
    high = value > F.lit(ticket)
    agg = cc.agg(
        count_if(high).alias("total_high_ticket_orders"),
        count_if(high & (inst >= min_installments)).alias("high_installment_count"),
        safe_div(F.sum(F.when(inst == 1, value)), F.count(F.when(inst == 1, value))).alias("avg1"),
        safe_div(F.sum(F.when(inst == 10, value)), F.count(F.when(inst == 10, value))).alias("avg10"),
    )
    return agg.select(
        "total_high_ticket_orders",
        "high_installment_count",
        rnd(pct("high_installment_count", "total_high_ticket_orders")).alias("high_ticket_financing_pct"),
        rnd("avg1").alias("avg_val_1_inst"),
        rnd("avg10").alias("avg_val_10_inst"),
    )


def boleto_by_state(payments: DataFrame, orders: DataFrame, customers: DataFrame, band: float = 5) -> DataFrame:
    """Boleto share per customer state vs the mean of state shares.

    -> customer_state, total_payments, state_boleto_pct, national_avg_pct,
       percentage_point_diff, regional_payment_profile
    """
    joined = (
        payments.select("order_id", "payment_type")
        .join(orders.select("order_id", "customer_id"), "order_id")
        .join(customers.select("customer_id", "customer_state"), "customer_id")
    )
    states = joined.groupBy("customer_state").agg(
        F.count("payment_type").alias("total_payments"),
        count_if(F.col("payment_type") == "boleto").alias("boleto_count"),
    )
    share = pct("boleto_count", "total_payments")
    national = F.avg("__share").over(Window.partitionBy(F.lit(1)))  # one row per state
    s = states.withColumn("__share", share).withColumn("__national", national)
    state_pct = rnd("__share")
    profile = (
        F.when(state_pct > F.col("__national") + band, L.BOLETO_PROFILES[0])
        .when(state_pct < F.col("__national") - band, L.BOLETO_PROFILES[1])
        .otherwise(L.BOLETO_PROFILES[2])
    )
    return s.select(
        "customer_state",
        "total_payments",
        state_pct.alias("state_boleto_pct"),
        rnd("__national").alias("national_avg_pct"),
        rnd(state_pct - F.col("__national")).alias("percentage_point_diff"),
        profile.alias("regional_payment_profile"),
    ).orderBy(F.desc("state_boleto_pct"))
