"""Customer experience and reviews (BQ23-BQ28 and their variants).

Reviews join orders at order grain, so an order with several reviews and
several items multiplies rows; the reference's ``select distinct`` steps that
undo this (BQ25-BQ27) are kept as ``distinct`` before the aggregation. All
per-key frames here are small (delay days, categories, buckets) except the
product and seller aggregates, which are plain partial aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import dates as D
from souk.functions import labels as L
from souk.functions.numeric import avg_double, count_if, pct, rnd, rnd_decimal, safe_div
from souk.operators.sales import order_scores

# ---------------------------------------------------------------- delay vs score


def _delay_scores(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per delay day: review rows and their mean score (all delay days)."""
    d = (
        orders.where((F.col("order_status") == "delivered")
                     & F.col("order_delivered_customer_date").isNotNull()
                     & F.col("order_estimated_delivery_date").isNotNull())
        .select("order_id",
                D.days_between("order_estimated_delivery_date", "order_delivered_customer_date").alias("delay_days"))
        .join(reviews.select("order_id", "review_score"), "order_id")
    )
    return d.groupBy("delay_days").agg(F.count("order_id").alias("__volume"),
                                       avg_double("review_score").alias("__avg"))


def _delay_ladder(delay: Column, avg: Column, labels: tuple[str, ...]) -> Column:
    return (
        F.when(delay < 0, labels[0])
        .when(delay == 0, labels[1])
        .when((delay > 0) & (avg >= 3.0), labels[2])
        .when((delay > 0) & (avg < 3.0), labels[3])
        .otherwise(labels[4])
    )


def delay_vs_score(orders: DataFrame, reviews: DataFrame, min_volume: int = 5,
                   window: tuple[int, int] = (-10, 30)) -> DataFrame:
    """Mean review score per day of delivery delay, and its drop vs on-time orders.

    The on-time benchmark is taken before the volume/window filters.
    -> delay_days, order_volume, avg_rating, satisfaction_tier, pct_drop_from_ontime
    """
    agg = _delay_scores(orders, reviews)
    # one row per delay day: the scalar benchmark is a whole-frame window over that small frame
    ontime = F.max(F.when(F.col("delay_days") == 0, F.col("__avg"))).over(Window.partitionBy(F.lit(1)))
    out = agg.withColumn("__ontime", ontime).where(
        (F.col("__volume") > min_volume) & F.col("delay_days").between(*window))
    return out.select(
        "delay_days",
        F.col("__volume").alias("order_volume"),
        rnd("__avg").alias("avg_rating"),
        _delay_ladder(F.col("delay_days"), F.col("__avg"), L.DELAY_TIERS).alias("satisfaction_tier"),
        rnd(pct(F.col("__avg") - F.col("__ontime"), "__ontime")).alias("pct_drop_from_ontime"),
    ).orderBy("delay_days")


def delay_sentiment(orders: DataFrame, reviews: DataFrame, min_count: int = 10) -> DataFrame:
    """Variant of ``delay_vs_score``: no window, no benchmark, sentiment labels.

    -> delay_days, order_count, avg_rating, sentiment_profile
    """
    agg = _delay_scores(orders, reviews).where(F.col("__volume") > min_count)
    return agg.select(
        "delay_days",
        F.col("__volume").alias("order_count"),
        rnd("__avg").alias("avg_rating"),
        _delay_ladder(F.col("delay_days"), F.col("__avg"), L.DELAY_SENTIMENT).alias("sentiment_profile"),
    ).orderBy("delay_days")


# ---------------------------------------------------------------- speed vs quality


def _category_speed_quality(orders: DataFrame, order_items: DataFrame, products: DataFrame,
                            reviews: DataFrame) -> DataFrame:
    """Per category, over items x reviews of delivered orders: reviews are one row per order
    with their sums, an order's items of a category one row with their number."""
    lines = (
        order_items.select("order_id", "product_id")
        .join(products.where(F.col("product_category_name").isNotNull()), "product_id")
        .groupBy("product_category_name", "order_id").agg(F.count(F.lit(1)).alias("items"))
    )
    rows = (
        orders.where((F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull())
        .select("order_id", D.days_between("order_purchase_timestamp", "order_delivered_customer_date").alias("lead"))
        .join(order_scores(reviews), "order_id").join(lines, "order_id")
    )
    fan = F.col("items") * F.col("reviews")
    return rows.groupBy("product_category_name").agg(
        F.sum(fan).alias("__rows"),
        F.count("order_id").alias("__orders"),
        safe_div(F.sum(fan * F.col("lead")), F.sum(F.when(F.col("lead").isNotNull(), fan))).alias("__lead"),
        safe_div(F.sum(F.col("items") * F.col("score_sum")), F.sum(F.col("items") * F.col("scored"))).alias("__score"),
    )


def _category_ranks(cats: DataFrame) -> DataFrame:
    # one row per category
    return (cats.withColumn("__sr", F.percent_rank().over(Window.orderBy("__lead")))
            .withColumn("__rr", F.percent_rank().over(Window.orderBy("__score"))))


def speed_quality_matrix(orders: DataFrame, order_items: DataFrame, products: DataFrame, reviews: DataFrame,
                         min_rows: int = 30) -> DataFrame:
    """Categories by delivery-speed and rating percentile (item x review grain counts).

    -> product_category_name, total_orders, avg_lead_time_days, avg_rating, matrix_segment
    """
    cats = _category_ranks(_category_speed_quality(orders, order_items, products, reviews)
                           .where(F.col("__rows") > min_rows))
    s, r = F.col("__sr"), F.col("__rr")
    seg = (
        F.when((s <= 0.25) & (r <= 0.25), L.QUALITY_MATRIX[0])
        .when((s >= 0.75) & (r >= 0.75), L.QUALITY_MATRIX[1])
        .when((s <= 0.25) & (r >= 0.75), L.QUALITY_MATRIX[2])
        .when((s >= 0.75) & (r <= 0.25), L.QUALITY_MATRIX[3])
        .otherwise(L.QUALITY_MATRIX[4])
    )
    return cats.select(
        "product_category_name",
        F.col("__rows").alias("total_orders"),
        rnd("__lead").alias("avg_lead_time_days"),
        rnd("__score").alias("avg_rating"),
        seg.alias("matrix_segment"),
    ).orderBy("avg_rating")


def category_archetypes(orders: DataFrame, order_items: DataFrame, products: DataFrame, reviews: DataFrame,
                        min_orders: int = 50) -> DataFrame:
    """Variant: distinct orders > ``min_orders``, three archetype labels.

    -> product_category_name, total_orders, avg_delivery_speed, avg_rating, category_archetype
    """
    cats = _category_ranks(_category_speed_quality(orders, order_items, products, reviews)
                           .where(F.col("__orders") > min_orders))
    s, r = F.col("__sr"), F.col("__rr")
    seg = (
        F.when((s <= 0.25) & (r <= 0.25), L.CATEGORY_ARCHETYPES[0])
        .when((s <= 0.25) & (r >= 0.75), L.CATEGORY_ARCHETYPES[1])
        .when((s >= 0.75) & (r <= 0.25), L.CATEGORY_ARCHETYPES[2])
        .otherwise(L.CATEGORY_ARCHETYPES[3])
    )
    return cats.orderBy("__sr").select(
        "product_category_name",
        F.col("__orders").alias("total_orders"),
        rnd("__lead").alias("avg_delivery_speed"),
        rnd("__score").alias("avg_rating"),
        seg.alias("category_archetype"),
    )


# ---------------------------------------------------------------- comments


def comment_effect(reviews: DataFrame, labels: tuple[str, str] = L.COMMENT_TYPES,
                   names: tuple[str, ...] = ("review_type", "review_count", "avg_score",
                                             "one_star_comment_pct", "five_star_comment_pct")) -> DataFrame:
    """Written vs rating-only reviews, and the comment share among 1- and 5-star reviews.

    One scan, grouped by (has text, score): a handful of rows hold everything.
    -> review_type, review_count, avg_score, one_star_comment_pct, five_star_comment_pct
    """
    counts = (reviews.groupBy(F.col("review_comment_message").isNotNull().alias("__text"), "review_score")
              .agg(F.count(F.lit(1)).alias("__n")))
    score, n = F.col("review_score"), F.col("__n")
    every = Window.partitionBy(F.lit(1))                 # two rows

    def stars(k: int) -> Column:
        return F.coalesce(F.sum(F.when(score == k, n)), F.lit(0))

    by_type = counts.groupBy("__text").agg(
        F.sum(n).alias("__all"), safe_div(F.sum(score * n), F.sum(F.when(score.isNotNull(), n))).alias("__avg"),
        stars(1).alias("__one"), stars(5).alias("__five"))

    def share(c: str) -> Column:
        written = F.sum(F.when(F.col("__text"), F.col(c)).otherwise(0)).over(every)
        return rnd(pct(written, F.sum(c).over(every)))

    return by_type.select(
        F.when(F.col("__text"), labels[0]).otherwise(labels[1]).alias(names[0]),
        F.col("__all").alias(names[1]),
        rnd("__avg").alias(names[2]),
        share("__one").alias(names[3]),
        share("__five").alias(names[4]),
    )


def comment_feedback(reviews: DataFrame) -> DataFrame:
    """Variant of ``comment_effect`` with the second script's labels and names.

    -> feedback_type, total_reviews, avg_score, one_star_comment_intensity, five_star_comment_intensity
    """
    return comment_effect(reviews, L.COMMENT_TYPES_ALT,
                          ("feedback_type", "total_reviews", "avg_score",
                           "one_star_comment_intensity", "five_star_comment_intensity"))


# ---------------------------------------------------------------- distributions


def review_distribution(reviews: DataFrame, order_items: DataFrame, products: DataFrame,
                        translation: DataFrame, min_reviews: int = 50) -> DataFrame:
    """Star shares per English category over distinct (review, order, score, category).

    -> category, total_reviews, one_star_reviews, pct_one_star, pct_five_star
    """
    # dimension to dimension first: the few category names never meet the fact rows as a join key
    named = (products.select("product_id", "product_category_name")
             .join(translation, "product_category_name", "left")
             .select("product_id", F.col("product_category_name_english").alias("category_name")))
    rows = (
        reviews.where(F.col("review_score").isNotNull()).select("review_id", "order_id", "review_score")
        .join(order_items.select("order_id", "product_id"), "order_id")
        .join(named, "product_id")
        .select("review_id", "order_id", "review_score", "category_name")
        .distinct()
    )
    stats = rows.groupBy(F.coalesce("category_name", F.lit(L.UNKNOWN_CATEGORY)).alias("category")).agg(
        F.count("review_id").alias("total_reviews"),
        *[count_if(F.col("review_score") == k).alias(f"__s{k}") for k in range(1, 6)],
    ).where(F.col("total_reviews") >= min_reviews)
    return stats.select(
        "category",
        "total_reviews",
        F.col("__s1").alias("one_star_reviews"),
        rnd(pct("__s1", "total_reviews")).alias("pct_one_star"),
        rnd(pct("__s5", "total_reviews")).alias("pct_five_star"),
    ).orderBy(F.desc("pct_one_star"))


def review_polarization(reviews: DataFrame, order_items: DataFrame) -> DataFrame:
    """Products bucketed by review volume; extreme-score shares per bucket.

    -> volume_bucket, number_of_products, total_reviews_in_bucket, avg_score_in_bucket,
       pct_1_star, pct_5_star, pct_polarized
    """
    rows = (
        reviews.where(F.col("review_score").isNotNull()).select("review_id", "order_id", "review_score")
        .join(order_items.select("order_id", "product_id"), "order_id")
        .select("review_id", "order_id", "product_id", "review_score")
        .distinct()
    )
    prod = rows.groupBy("product_id").agg(
        F.count("review_id").alias("__n"),
        avg_double("review_score").alias("__avg"),
        count_if(F.col("review_score") == 1).alias("__c1"),
        count_if(F.col("review_score") == 5).alias("__c5"),
    )
    n = F.col("__n")
    bucket = (F.when(n.between(1, 10), L.VOLUME_BUCKETS[0]).when(n.between(11, 50), L.VOLUME_BUCKETS[1])
              .when(n.between(51, 100), L.VOLUME_BUCKETS[2]).otherwise(L.VOLUME_BUCKETS[3]))
    order_key = (F.when(n.between(1, 10), 1).when(n.between(11, 50), 2).when(n.between(51, 100), 3).otherwise(4))
    agg = prod.groupBy(bucket.alias("volume_bucket"), order_key.alias("__bucket_order")).agg(
        F.count("product_id").alias("number_of_products"),
        F.sum("__n").alias("total_reviews_in_bucket"),
        avg_double(rnd_decimal("__avg", 12)).alias("__avg"),  # an exact sum in any order
        F.sum("__c1").alias("__c1"),
        F.sum("__c5").alias("__c5"),
    )
    tot = F.col("total_reviews_in_bucket")
    return agg.orderBy("__bucket_order").select(
        "volume_bucket",
        "number_of_products",
        "total_reviews_in_bucket",
        rnd("__avg").alias("avg_score_in_bucket"),
        rnd(pct("__c1", tot)).alias("pct_1_star"),
        rnd(pct("__c5", tot)).alias("pct_5_star"),
        rnd(pct(F.col("__c1") + F.col("__c5"), tot)).alias("pct_polarized"),
    )


def one_star_sellers(reviews: DataFrame, order_items: DataFrame, min_reviews: int = 30) -> DataFrame:
    """1-star share per seller over distinct (seller, review, order, score).

    -> seller_id, total_reviews, count_1_star, pct_1_star, overall_avg_score
    """
    rows = (
        reviews.where(F.col("review_score").isNotNull()).select("review_id", "order_id", "review_score")
        .join(order_items.select("order_id", "seller_id"), "order_id")
        .select("seller_id", "review_id", "order_id", "review_score")
        .distinct()
    )
    stats = rows.groupBy("seller_id").agg(
        F.count("review_id").alias("total_reviews"),
        count_if(F.col("review_score") == 1).alias("count_1_star"),
        avg_double("review_score").alias("__avg"),
    ).where(F.col("total_reviews") >= min_reviews)
    return stats.select(
        "seller_id", "total_reviews", "count_1_star",
        rnd(pct("count_1_star", "total_reviews")).alias("pct_1_star"),
        rnd("__avg").alias("overall_avg_score"),
    ).orderBy(F.desc("pct_1_star"), F.desc("total_reviews"))


def response_time_effect(reviews: DataFrame) -> DataFrame:
    """Review score by how fast the survey was answered (hour boundaries crossed).

    -> response_speed_category, total_reviews, avg_response_time_hours, avg_review_score, pct_1_star, pct_5_star
    """
    r = reviews.where(F.col("review_score").isNotNull()).select(
        "review_id", "review_score", "review_answer_timestamp",
        D.hours_between_boundaries("review_creation_date", "review_answer_timestamp").alias("__h"))
    h = F.col("__h")
    cat = (
        F.when(F.col("review_answer_timestamp").isNull(), L.RESPONSE_SPEED[0])
        .when(h <= 24, L.RESPONSE_SPEED[1]).when(h <= 72, L.RESPONSE_SPEED[2])
        .when(h <= 168, L.RESPONSE_SPEED[3]).otherwise(L.RESPONSE_SPEED[4])
    )
    agg = r.groupBy(cat.alias("response_speed_category")).agg(
        F.count("review_id").alias("total_reviews"),
        avg_double("__h").alias("__avg_h"),
        avg_double("review_score").alias("__avg_s"),
        count_if(F.col("review_score") == 1).alias("__c1"),
        count_if(F.col("review_score") == 5).alias("__c5"),
    )
    return agg.select(
        "response_speed_category", "total_reviews",
        rnd("__avg_h").alias("avg_response_time_hours"),
        rnd("__avg_s").alias("avg_review_score"),
        rnd(pct("__c1", "total_reviews")).alias("pct_1_star"),
        rnd(pct("__c5", "total_reviews")).alias("pct_5_star"),
    ).orderBy("response_speed_category")
