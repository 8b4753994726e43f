"""``customer_360``: one row per person (customer_unique_id), 61 feature columns.

Plan shape:
* items, payments and reviews are reduced to one row per order and joined to the orders on
  ``order_id`` (one co-partitioned join chain): the *order facts*;
* everything else follows from two mergeable partials of the facts: sums, minima and maxima
  per (person, month) with map-side combine, and the traits (products, sellers and payment
  types of the person's orders, purchase days and numbers of delivery days) as arrays, one
  row per person. Distinct counts, the payment-type mode, the exact median and the gaps
  between purchase days all come from the second;
* a person with a third of all orders has its traits in many rows, each of about ``ORDERS``
  orders, and counted by value: no task and no group holds all of them;
* partials of several loads add up, so the mart can follow its tables (``mart_store``);
* the order facts, the traits and the assembled rows are stored in the shared folder, as each
  is read more than once;
* the three RFM scores are selected together by grouped counts over the stored rows
  (``with_tiles``: no sort, no join-back; NULLs lowest, ties by person).

Money sums are exact DECIMAL sums converted to DOUBLE once; averages are one
division of exact sums, so the values do not depend on summation order.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import dates as D
from souk.functions import labels as L
from souk.functions.numeric import count_if, safe_div
from souk.operators.selection import Tiles, with_tiles
from souk.session import stored_table

KEY = "customer_unique_id"

# ---- fixed values: the mart's output contract ----
OUTPUT_COLUMNS = (
    "customer_unique_id", "first_customer_id", "customer_city", "customer_state", "customer_zip_code_prefix",
    "customer_latitude", "customer_longitude",
    "first_purchase_date", "first_purchase_year", "first_purchase_month", "acquisition_cohort_month",
    "last_purchase_date", "customer_lifetime_days", "days_since_last_purchase", "is_churned_flag",
    "total_orders", "delivered_orders", "canceled_orders", "undelivered_orders", "distinct_products_purchased",
    "distinct_sellers_purchased", "avg_items_per_order", "is_repeat_buyer_flag",
    "total_revenue", "avg_order_value", "min_order_value", "max_order_value", "total_freight_value",
    "avg_freight_per_order", "freight_to_revenue_ratio", "total_payment_value", "avg_installments_per_order",
    "active_months_count", "purchase_frequency_per_month", "avg_days_between_orders",
    "first_to_second_order_days", "max_days_between_orders",
    "avg_delivery_days", "median_delivery_days", "on_time_deliveries", "late_deliveries",
    "on_time_delivery_rate", "late_delivery_rate", "avg_days_late",
    "total_reviews", "review_participation_rate", "avg_review_score", "min_review_score", "max_review_score",
    "negative_review_rate", "positive_review_rate",
    "most_used_payment_type", "credit_card_usage_rate", "installment_usage_rate",
    "recency_days", "frequency_orders", "monetary_value", "rfm_recency_score", "rfm_frequency_score",
    "rfm_monetary_score", "rfm_segment_label",
)
# ---- end of fixed values ----


NULLABLE_COUNTS = (
    "distinct_products_purchased", "distinct_sellers_purchased", "first_to_second_order_days",
    "max_days_between_orders", "total_reviews", "min_review_score", "max_review_score",
)


def _customers_geo(customers: DataFrame, geolocation: DataFrame) -> DataFrame:
    cust = customers.groupBy(KEY).agg(
        F.min("customer_id").alias("first_customer_id"),
        F.max("customer_city").alias("customer_city"),
        F.max("customer_state").alias("customer_state"),
        F.max("customer_zip_code_prefix").alias("customer_zip_code_prefix"),
    )
    geo = geolocation.groupBy("geolocation_zip_code_prefix", "geolocation_state").agg(
        safe_div(F.sum("geolocation_lat"), F.count("geolocation_lat")).alias("customer_latitude"),
        safe_div(F.sum("geolocation_lng"), F.count("geolocation_lng")).alias("customer_longitude"),
    )
    cond = ((cust["customer_zip_code_prefix"] == geo["geolocation_zip_code_prefix"])
            & (cust["customer_state"] == geo["geolocation_state"]))
    return cust.join(geo, cond, "left").drop("geolocation_zip_code_prefix", "geolocation_state")


def order_facts(orders: DataFrame, customers: DataFrame, items: DataFrame, payments: DataFrame,
                reviews: DataFrame) -> DataFrame:
    """One row per order and person with that order's item, payment and review sums.

    Each fact table is first reduced to one row per order (map-side partial
    aggregation), so the three left joins are order-to-order joins on the same
    key: in a star bucketed by ``order_id`` none of them has an exchange. The person is
    joined last. Items, payments or reviews of other orders drop out, as with the
    reference's inner joins.
    """
    ob = orders.select("order_id", "customer_id", "order_status", "order_purchase_timestamp",
                       "order_delivered_customer_date", "order_estimated_delivery_date",
                       F.to_date("order_purchase_timestamp").alias("purchase_date"))
    it = items.groupBy("order_id").agg(
        F.sum("price").alias("__order_value"),
        F.sum("freight_value").alias("__freight"),
        F.count(F.lit(1)).alias("__items"),
        # sets of one order: bounded by the order's lines
        F.collect_set("product_id").alias("__products"),
        F.collect_set("seller_id").alias("__sellers"),
    )
    pay = payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("__pay_rows"),
        F.sum("payment_value").alias("__paid"),
        F.max("payment_installments").alias("__inst"),
        F.max((F.col("payment_type") == "credit_card").cast("int")).alias("__cc"),
        F.collect_set("payment_type").alias("__types"),
    )
    s = F.col("review_score")
    rv = reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("__reviews"),
        F.count(s).alias("__scored"),
        F.sum(s).alias("__score_sum"),
        F.min(s).alias("__score_min"),
        F.max(s).alias("__score_max"),
        count_if(s <= 2).alias("__neg"),
        count_if(s >= 4).alias("__pos"),
    )
    facts = ob.join(it, "order_id", "left").join(pay, "order_id", "left").join(rv, "order_id", "left")
    return facts.join(customers.select("customer_id", KEY), "customer_id")


# how each column of the month partials merges with itself
MONTH_MIN = ("__first", "__ov_min", "__score_min")
MONTH_MAX = ("__last", "__ov_max", "__score_max")
MONTH_SUM = (
    "__orders", "__delivered", "__canceled", "__undelivered", "__on_time", "__late", "__dd_sum", "__dd_n",
    "__dl_sum", "__dl_n", "__rev", "__valued", "__freight", "__items", "__paid", "__inst_w", "__inst_rows",
    "__paid_orders", "__cc", "__inst_orders", "__reviews", "__scored", "__score_sum", "__neg", "__pos",
)


def month_partials(facts: DataFrame) -> DataFrame:
    """All order, monetary, payment and review sums per (person, calendar month).

    ``order_id`` is the orders primary key (declared by the reference, checked by
    ``key_violations``), so counting rows equals ``COUNT(DISTINCT order_id)``. Every column
    is a sum, count, min or max of per-order values, so partials compose exactly.
    """
    status = F.col("order_status")
    delivered = status == "delivered"
    has_dates = F.col("order_delivered_customer_date").isNotNull() & F.col("order_estimated_delivery_date").isNotNull()
    d_deliv = F.to_date("order_delivered_customer_date")
    d_est = F.to_date("order_estimated_delivery_date")
    on_time = delivered & has_dates & (d_deliv <= d_est)
    late = delivered & has_dates & (d_deliv > d_est)
    days_late = F.when(late, D.days_between("order_estimated_delivery_date", "order_delivered_customer_date"))
    month_key = F.year("purchase_date") * 100 + F.month("purchase_date")  # integer yyyyMM, cheaper than text
    return facts.groupBy(KEY, month_key.alias("__ym")).agg(
        F.min("purchase_date").alias("__first"),
        F.max("purchase_date").alias("__last"),
        F.count("order_id").alias("__orders"),
        count_if(delivered).alias("__delivered"),
        count_if(status == "canceled").alias("__canceled"),
        count_if(status != "delivered").alias("__undelivered"),
        count_if(on_time).alias("__on_time"),
        count_if(late).alias("__late"),
        F.sum(_delivery_days()).alias("__dd_sum"), F.count(_delivery_days()).alias("__dd_n"),
        F.sum(days_late).alias("__dl_sum"), F.count(days_late).alias("__dl_n"),
        # items (per order: value, freight, item count)
        F.sum("__order_value").alias("__rev"), F.count("__order_value").alias("__valued"),
        F.min("__order_value").alias("__ov_min"), F.max("__order_value").alias("__ov_max"),
        F.sum("__freight").alias("__freight"), F.sum("__items").alias("__items"),
        # payments (per order: rows, paid, max installments, any credit card)
        F.sum("__paid").alias("__paid"), F.sum(F.col("__pay_rows") * F.col("__inst")).alias("__inst_w"),
        F.sum(F.when(F.col("__inst").isNotNull(), F.col("__pay_rows"))).alias("__inst_rows"),
        F.count("__pay_rows").alias("__paid_orders"),
        F.sum("__cc").alias("__cc"), count_if(F.col("__inst") > 1).alias("__inst_orders"),
        # reviews (per order: count, score sum/min/max, negatives, positives)
        F.sum("__reviews").alias("__reviews"), F.sum("__scored").alias("__scored"),
        F.sum("__score_sum").alias("__score_sum"),
        F.min("__score_min").alias("__score_min"), F.max("__score_max").alias("__score_max"),
        F.sum("__neg").alias("__neg"), F.sum("__pos").alias("__pos"),
    )


def merged_months(months: DataFrame) -> DataFrame:
    """Month partials of several loads as those of all their orders."""
    return months.groupBy(KEY, "__ym").agg(
        *[F.min(c).alias(c) for c in MONTH_MIN], *[F.max(c).alias(c) for c in MONTH_MAX],
        *[F.sum(c).alias(c) for c in MONTH_SUM])


def _delivery_days() -> Column:
    return F.when((F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull(),
                  D.days_between("order_purchase_timestamp", "order_delivered_customer_date"))


# what the orders of a person name: distinct products and sellers, and, once for each order,
# payment types, the purchase day (days since 1970) and the number of delivery days
TRAITS = ("products", "sellers", "types", "days", "leads")
ORDERS = 2_000            # of a person in one trait row, about
VALUES = 100_000          # of a person that are put together in one group


def trait_partials(facts: DataFrame, most: int = ORDERS) -> DataFrame:
    """``person, products, sellers, types, days, leads, n``: the values as arrays, ``n`` of them
    in all, so an order's values travel as one row.

    A person with more than ``most`` orders has a row for about each ``most`` of them. Such
    persons are few (one for each ``most`` orders at the most) and broadcast.
    """
    known = facts.where(F.col(KEY).isNotNull())
    busy = known.groupBy(KEY).agg(F.ceil(F.count(F.lit(1)) / most).alias("__parts")).where(F.col("__parts") > 1)
    part = F.coalesce(F.pmod(F.xxhash64("order_id", "order_purchase_timestamp"), F.col("__parts")), F.lit(0))
    # a task holds few orders of a person: nothing to gather before the shuffle
    dealt = known.join(F.broadcast(busy), KEY, "left").withColumn("__part", part).repartition(KEY, "__part")
    rows = dealt.groupBy(KEY, "__part").agg(
        F.array_distinct(F.flatten(F.collect_list("__products"))).alias("products"),
        F.array_distinct(F.flatten(F.collect_list("__sellers"))).alias("sellers"),
        F.flatten(F.collect_list("__types")).alias("types"),
        F.collect_list(F.unix_date("purchase_date")).alias("days"),
        F.collect_list(_delivery_days()).alias("leads"))
    return rows.select(KEY, *TRAITS, sum(map(F.size, TRAITS), F.lit(0).cast("long")).alias("n"))


def _order_metrics(months: DataFrame) -> DataFrame:
    """All order, monetary, payment and review metrics per person from its month rows."""
    return months.groupBy(KEY).agg(
        F.min("__first").alias("__first"),
        F.max("__last").alias("__last"),
        F.sum("__orders").alias("total_orders"),
        F.sum("__delivered").alias("delivered_orders"),
        F.sum("__canceled").alias("canceled_orders"),
        F.sum("__undelivered").alias("undelivered_orders"),
        F.sum("__on_time").alias("on_time_deliveries"),
        F.sum("__late").alias("late_deliveries"),
        safe_div(F.sum("__dd_sum"), F.sum("__dd_n")).alias("avg_delivery_days"),
        safe_div(F.sum("__dl_sum"), F.sum("__dl_n")).alias("avg_days_late"),
        F.count("__ym").alias("active_months_count"),  # a month row without a date is none
        F.sum("__rev").cast("double").alias("total_revenue"),
        safe_div(F.sum("__rev"), F.sum("__valued")).alias("avg_order_value"),
        F.min("__ov_min").cast("double").alias("min_order_value"),
        F.max("__ov_max").cast("double").alias("max_order_value"),
        F.sum("__freight").cast("double").alias("total_freight_value"),
        F.sum("__items").alias("__total_items"),
        F.sum("__paid").cast("double").alias("total_payment_value"),
        # mean over payment rows of the order's max installments (row-weighted, as in the reference)
        safe_div(F.sum("__inst_w"), F.sum("__inst_rows")).alias("avg_installments_per_order"),
        F.sum("__paid_orders").alias("__paid_orders"),
        F.sum("__cc").alias("__cc_orders"),
        F.sum("__inst_orders").alias("__inst_orders"),
        F.sum("__reviews").alias("total_reviews"),
        safe_div(F.sum("__score_sum"), F.sum("__scored")).alias("avg_review_score"),
        F.min("__score_min").alias("min_review_score"),
        F.max("__score_max").alias("max_review_score"),
        safe_div(F.sum("__neg"), F.sum("__reviews")).alias("negative_review_rate"),
        safe_div(F.sum("__pos"), F.sum("__reviews")).alias("positive_review_rate"),
    )


def _trait_metrics(traits: DataFrame, most: int = VALUES) -> DataFrame:
    """Distinct products and sellers, payment-type mode, median delivery days and purchase gaps.
    ``traits`` (stored; of any number of loads) is read by both ways:

    * persons with up to ``most`` values have them put together,
    * the others (few, so broadcast) have them counted by value first.

    Mode: most orders, ties to the alphabetically first type. Median: exact over delivered
    orders. Gaps: orders are ranked by (purchase_date, order_id), so orders of one day are
    adjacent and 0 days apart. The gaps telescope to (last - first) / (orders - 1); the
    greatest is between consecutive days (0 if all orders share one); the second order
    falls on the first day if that day has two. Orders without a date are ignored.
    """
    many = F.broadcast(traits.groupBy(KEY).agg(F.sum("n").alias("__n")).where(F.col("__n") > most).select(KEY))
    return _by_person(traits.join(many, KEY, "left_anti")).unionByName(_by_value(traits.join(many, KEY, "left_semi")))


def _by_person(traits: DataFrame) -> DataFrame:
    """Trait metrics of persons whose values fit one group."""
    all_ = traits.groupBy(KEY).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in TRAITS]).select(
        KEY, *[F.array_distinct(c).alias(c) for c in TRAITS[:2]], "types",
        *[F.sort_array(c).alias(c) for c in TRAITS[3:]])
    days, leads, types = F.col("days"), F.col("leads"), F.col("types")
    n, size = F.size(days), F.size(leads)
    steps = F.transform(F.slice(days, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda d, i: d - F.get(days, i))
    used = F.transform(F.array_distinct(types), lambda t: F.struct(
        (-F.size(F.filter(types, lambda x: x == t))).alias("n"), t.alias("value")))

    def some(values: str) -> Column:
        return F.when(F.size(values) > 0, F.size(values)).cast("long")

    return all_.select(
        KEY, some("products").alias("distinct_products_purchased"), some("sellers").alias("distinct_sellers_purchased"),
        F.array_min(used)["value"].alias("most_used_payment_type"),
        F.when(size > 0, (F.get(leads, F.floor((size - 1) / 2).cast("int")) + F.get(leads, F.floor(size / 2).cast("int"))) / 2.0)
        .cast("double").alias("median_delivery_days"),
        F.when(n >= 2, safe_div(F.get(days, n - 1) - F.get(days, 0), n - 1)).alias("avg_days_between_orders"),
        F.when(n >= 2, F.array_max(steps)).cast("long").alias("max_days_between_orders"),
        F.when(n >= 2, F.get(days, 1) - F.get(days, 0)).cast("long").alias("first_to_second_order_days"),
    )


def _by_value(traits: DataFrame) -> DataFrame:
    """Trait metrics from counts per (person, trait, value): a person of any size is spread over
    its values; what is gathered is its purchase days, bounded by the calendar."""
    rows = None
    for c in TRAITS:
        part = traits.select(KEY, F.lit(c).alias("kind"), F.explode(F.col(c).cast("array<string>")).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    kind, n = F.col("kind"), F.col("n")

    def of(k: str, value: Column) -> Column:
        return F.when(kind == k, value)

    number = F.when(kind.isin("days", "leads"), F.col("value")).cast("int")
    agg = rows.groupBy(KEY, "kind", "value").agg(F.count(F.lit(1)).alias("n")).groupBy(KEY).agg(
        F.sum(of("products", F.lit(1))).alias("distinct_products_purchased"),
        F.sum(of("sellers", F.lit(1))).alias("distinct_sellers_purchased"),
        F.min_by(of("types", F.col("value")), of("types", F.struct(-n, "value"))).alias("most_used_payment_type"),
        F.percentile(of("leads", number), F.lit(0.5), n).alias("median_delivery_days"),
        F.sum(of("days", n)).alias("__n"),
        # at most one per calendar day
        F.array_sort(F.collect_list(of("days", F.struct(number.alias("day"), n.alias("n"))))).alias("__days"),
    )
    days, size, repeat = F.col("__days"), F.size("__days"), F.col("__n") >= 2
    steps = F.transform(F.slice(days, F.lit(2), F.greatest(size - 1, F.lit(0))),
                        lambda d, i: d["day"] - F.get(days, i)["day"])
    first, last = F.get(days, 0), F.get(days, size - 1)
    return agg.select(
        KEY, "distinct_products_purchased", "distinct_sellers_purchased", "most_used_payment_type",
        "median_delivery_days",
        F.when(repeat, safe_div(last["day"] - first["day"], F.col("__n") - 1)).alias("avg_days_between_orders"),
        F.when(repeat, F.coalesce(F.array_max(steps), F.lit(0))).cast("long").alias("max_days_between_orders"),
        F.when(repeat, F.when(first["n"] >= 2, 0).otherwise(F.get(days, 1)["day"] - first["day"]))
        .cast("long").alias("first_to_second_order_days"),
    )


def _median_agg(ob: DataFrame) -> DataFrame:
    """Exact median delivery days per person, over delivered orders only."""
    d = ob.where((F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull())
    days = D.days_between("order_purchase_timestamp", "order_delivered_customer_date")
    return d.groupBy(KEY).agg(F.percentile(days, F.lit(0.5)).alias("median_delivery_days"))


def _payment_mode(facts: DataFrame) -> DataFrame:
    """Most used type by distinct orders; ties go to the alphabetically first type.

    An order's set names each of its types once, so rows per type are distinct orders.
    """
    by_type = (facts.select(KEY, F.explode("__types").alias("payment_type"))
               .groupBy(KEY, "payment_type").agg(F.count(F.lit(1)).alias("__n")))
    return by_type.groupBy(KEY).agg(
        F.min_by("payment_type", F.struct(-F.col("__n"), F.col("payment_type"))).alias("most_used_payment_type"))


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def _segment(r: Column, f: Column, m: Column) -> Column:
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), L.RFM_MART[0])
        .when((f >= 4) & (r >= 3), L.RFM_MART[1])
        .when((r >= 4) & f.between(2, 3), L.RFM_MART[2])
        .when((r <= 2) & (f >= 3), L.RFM_MART[3])
        .when((r <= 2) & (f <= 2), L.RFM_MART[4])
        .otherwise(L.RFM_MART[5])
    )


def person_rows(customers: DataFrame, geolocation: DataFrame, months: DataFrame, traits: DataFrame) -> DataFrame:
    """One row per person of ``customers`` with all that does not depend on the day of asking."""
    return (_customers_geo(customers, geolocation)
            .join(_order_metrics(months), KEY, "left").join(_trait_metrics(traits), KEY, "left"))


def features(persons: DataFrame, as_of_date: str | _dt.date, churn_days: int = 180) -> DataFrame:
    """The mart's columns but for scores and label."""
    as_of = F.lit(_dt.date.fromisoformat(str(as_of_date)))
    first, last = F.col("__first"), F.col("__last")
    total_orders, delivered = F.col("total_orders"), F.col("delivered_orders")
    since = F.datediff(as_of, last)
    return persons.select(
        KEY, "first_customer_id", "customer_city", "customer_state", "customer_zip_code_prefix",
        "customer_latitude", "customer_longitude",
        F.date_format(first, "yyyy-MM-dd").alias("first_purchase_date"),
        F.year(first).alias("first_purchase_year"),
        F.month(first).alias("first_purchase_month"),
        D.year_month_text(first).alias("acquisition_cohort_month"),
        F.date_format(last, "yyyy-MM-dd").alias("last_purchase_date"),
        F.datediff(last, first).alias("customer_lifetime_days"),
        since.alias("days_since_last_purchase"),
        _flag(since >= churn_days).alias("is_churned_flag"),
        "total_orders", "delivered_orders", "canceled_orders", "undelivered_orders",
        "distinct_products_purchased", "distinct_sellers_purchased",
        safe_div("__total_items", total_orders).alias("avg_items_per_order"),
        _flag(total_orders >= 2).alias("is_repeat_buyer_flag"),
        "total_revenue", "avg_order_value", "min_order_value", "max_order_value", "total_freight_value",
        safe_div("total_freight_value", total_orders).alias("avg_freight_per_order"),
        safe_div("total_freight_value", "total_revenue").alias("freight_to_revenue_ratio"),
        "total_payment_value", "avg_installments_per_order",
        "active_months_count",
        safe_div(total_orders, "active_months_count").alias("purchase_frequency_per_month"),
        "avg_days_between_orders", "first_to_second_order_days", "max_days_between_orders",
        "avg_delivery_days", "median_delivery_days", "on_time_deliveries", "late_deliveries",
        safe_div("on_time_deliveries", delivered).alias("on_time_delivery_rate"),
        safe_div("late_deliveries", delivered).alias("late_delivery_rate"),
        "avg_days_late",
        "total_reviews",
        safe_div("total_reviews", delivered).alias("review_participation_rate"),
        "avg_review_score", "min_review_score", "max_review_score", "negative_review_rate", "positive_review_rate",
        "most_used_payment_type",
        safe_div("__cc_orders", "__paid_orders").alias("credit_card_usage_rate"),
        safe_div("__inst_orders", "__paid_orders").alias("installment_usage_rate"),
        since.alias("recency_days"),
        total_orders.alias("frequency_orders"),
        F.col("total_revenue").alias("monetary_value"),
    )


def with_scores(core: DataFrame) -> DataFrame:
    """The mart from its stored feature rows: RFM scores over all persons, and the label."""
    key = (KEY, True)
    scored = with_tiles(core, [Tiles([("recency_days", True), key], 5, "__r"),
                               Tiles([("frequency_orders", True), key], 5, "rfm_frequency_score"),
                               Tiles([("monetary_value", True), key], 5, "rfm_monetary_score")])
    scored = scored.withColumn("rfm_recency_score", 6 - F.col("__r"))
    label = _segment(F.col("rfm_recency_score"), F.col("rfm_frequency_score"), F.col("rfm_monetary_score"))
    out = scored.withColumn("rfm_segment_label", label)
    # counts that are NULL for people without items/reviews/repeat orders travel as DOUBLE,
    # the one numeric type every consumer maps identically when NULLs are present
    return out.withColumns({c: F.col(c).cast("double") for c in NULLABLE_COUNTS}).select(*OUTPUT_COLUMNS)


def customer_360(customers: DataFrame, geolocation: DataFrame, orders: DataFrame, order_items: DataFrame,
                 payments: DataFrame, reviews: DataFrame, as_of_date: str | _dt.date,
                 churn_days: int = 180, checkpoint: bool = True) -> DataFrame:
    """The customer feature mart. Dates are rendered as ``yyyy-MM-dd`` text.

    ``as_of_date`` replaces the reference's ``GETDATE()`` so results are
    reproducible.
    """
    facts = order_facts(orders, customers, order_items, payments, reviews)
    if checkpoint:
        facts = stored_table(facts, "facts")
    traits = trait_partials(facts)
    if checkpoint:
        traits = stored_table(traits, "traits")
    core = features(person_rows(customers, geolocation, month_partials(facts), traits), as_of_date, churn_days)
    if checkpoint:
        core = stored_table(core, "core")
    return with_scores(core)


def _person_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return (orders.join(customers.select("customer_id", KEY), "customer_id")
            .withColumn("purchase_date", F.to_date("order_purchase_timestamp")))


def delivery_median(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Median purchase-to-delivery days per person over delivered orders (exact, interpolated).

    ``percentile`` keeps a value->count map per group, so its memory follows the
    number of distinct day counts (a few hundred), not the person's order count.
    -> customer_unique_id, median_delivery_days
    """
    return _median_agg(_person_orders(orders, customers))


def payment_type_mode(payments: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Most used payment type per person by distinct orders; ties go to the alphabetically first type.

    Two partial aggregations and ``min_by`` (no per-person window).
    -> customer_unique_id, most_used_payment_type
    """
    types = payments.groupBy("order_id").agg(F.collect_set("payment_type").alias("__types"))
    return _payment_mode(types.join(orders.select("order_id", "customer_id"), "order_id")
                         .join(customers.select("customer_id", KEY), "customer_id"))


def write_customer_360(mart_df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist the mart (the reference exposes it as a view read by a BI tool).

    Written as Parquet partitioned by acquisition cohort year so BI reads of one
    cohort prune files.
    """
    (mart_df.withColumn("cohort_year", F.substring("acquisition_cohort_month", 1, 4))
     .write.mode(mode).partitionBy("cohort_year").parquet(path))
