"""Reference-schema views derived from the driver tables.

The analyses read a marketplace star schema (orders, customers, order_items,
payments, products, sellers, order_reviews, category translation, geolocation).
The driver ships TPC-H-like tables instead; this module derives the star
schema from them with deterministic column arithmetic so every operator runs
unchanged. The SQL oracle derives the same views independently
(``souk.plans.oracle``), so each oracle comparison also checks this mapping.

All derivations are row-local projections or joins on keys, except
``order_items`` (row number inside an order: a few rows per order) and
``payments`` (group by order and return flag), so they scale with the input.
"""

from __future__ import annotations

from functools import cached_property, partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.session import tasks_for
from souk.sources.star import read_bucketed, write_bucketed
from souk.sources.tables import read_table


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(mins=n.cast("int"))


def _hours(n: Column) -> Column:
    return F.make_dt_interval(hours=n.cast("int"))


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    k = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .when(k % 10 == 0, "canceled")
        .when(k % 10 == 1, "unavailable")
        .otherwise("delivered")
    )
    base = o.select(
        k.alias("order_id"),
        k.alias("customer_id"),
        status.alias("order_status"),
        # every 211th order has no purchase date
        F.when(k % 211 != 0, F.col("o_orderdate") + _minutes((k * 37) % 1440)).alias("order_purchase_timestamp"),
    )
    oid = F.col("order_id")
    approved = F.when(oid % 97 != 0, F.col("order_purchase_timestamp") + _minutes((oid * 11) % 2880))
    carrier = F.when(~F.col("order_status").isin("canceled", "unavailable"),
                     F.col("order_approved_at") + _hours((oid * 17) % 240))
    delivered = F.when(F.col("order_status") == "delivered",
                       F.col("order_delivered_carrier_date") + _days((oid * 13) % 20))
    estimated = F.to_date("order_purchase_timestamp").cast("timestamp") + _days(F.lit(15))
    return (
        base.withColumn("order_approved_at", approved)
        .withColumn("order_delivered_carrier_date", carrier)
        .withColumn("order_delivered_customer_date", delivered)
        .withColumn("order_estimated_delivery_date", estimated)
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order (``customer_id``); the person is ``customer_unique_id``."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation: 25 rows by definition
        .select(
            F.col("o_orderkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("c_nationkey").alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )


def order_items(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``dealt``: for readers of the row number; as many parts as the rows need, so what a task
    sorts does not grow with the table."""
    li = read_table(spark, sf_dir, "lineitem")
    if dealt:
        li = li.repartition(tasks_for(li, li.count()), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    price = F.col("l_extendedprice").cast("decimal(20,3)")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.row_number().over(w).alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(22,5)").alias("freight_value"),
    )


def payments(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Several payment rows per order: one per (order, return flag). ``dealt`` as for items; the
    rows are dealt before they are summed, so no task keeps the sums of all orders it has read."""
    li = read_table(spark, sf_dir, "lineitem")
    if dealt:
        li = li.repartition(tasks_for(li, li.count()), "l_orderkey")
    line_value = (F.col("l_extendedprice").cast("decimal(12,2)")
                  * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
    per_flag = li.groupBy(F.col("l_orderkey").alias("order_id"), "l_returnflag").agg(
        F.sum(line_value).cast("decimal(20,4)").alias("payment_value"))
    flag = F.col("l_returnflag")
    return per_flag.select(
        "order_id",
        F.row_number().over(Window.partitionBy("order_id").orderBy("l_returnflag")).alias("payment_sequential"),
        F.when(flag == "A", "credit_card").when(flag == "N", "boleto").otherwise("voucher").alias("payment_type"),
        # some card payments have an unknown or zero number of installments
        F.when((flag == "A") & (F.col("order_id") % 83 == 0), F.lit(None).cast("long"))
        .when((flag == "A") & (F.col("order_id") % 61 == 0), F.lit(0).cast("long"))
        .when(flag == "A", 1 + (F.col("order_id") * 7) % 12).otherwise(F.lit(1).cast("long"))
        .alias("payment_installments"),
        "payment_value",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        # some categories are missing, some blank
        F.when(F.col("p_partkey") % 50 == 25, F.lit("")).when(F.col("p_partkey") % 50 != 0, F.col("p_brand"))
        .alias("product_category_name"),
    )


def category_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category has a row; two of them have no English name."""
    p = read_table(spark, sf_dir, "part").select("p_brand").distinct()
    return p.select(
        F.col("p_brand").alias("product_category_name"),
        F.when(~F.col("p_brand").isin("Brand#7", "Brand#9"), F.concat(F.lit("category_"), F.col("p_brand")))
        .alias("product_category_name_english"),
    )


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").alias("seller_zip_code_prefix"),
        F.col("n_name").alias("seller_state"),
    )


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``review_id`` repeats; some scores, comments and answers are NULL."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "props")
    eid, v = F.col("event_id"), F.col("value")
    score = (F.when(eid % 89 == 0, F.lit(None).cast("int")).when(v < 10, 1).when(v < 25, 2).when(v < 45, 3).when(v < 80, 4).otherwise(5))
    return e.select(
        (eid % 9973).alias("review_id"),
        eid.alias("order_id"),
        score.alias("review_score"),
        F.when(F.col("event_type").isin("error", "view"), F.col("props")).alias("review_comment_message"),
        F.col("ts").alias("review_creation_date"),
        F.when(eid % 101 != 0, F.col("ts") + _hours((eid * 29) % 400)).alias("review_answer_timestamp"),
    )


def geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several points per (zip prefix, state): one per supplier of the nation."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("s_suppkey")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        F.col("s_nationkey").alias("geolocation_zip_code_prefix"),
        F.col("n_name").alias("geolocation_state"),
        (F.lit(-30) + (key % 61) * F.lit(0.25)).cast("decimal(9,6)").alias("geolocation_lat"),
        (F.lit(-60) + (key * 7 % 83) * F.lit(0.125)).cast("decimal(9,6)").alias("geolocation_lng"),
    )


STAR_TABLES = ("orders", "customers", "order_items", "payments", "products", "translation", "sellers",
               "reviews", "geolocation")
# key each stored table is hash-distributed on when the star schema is materialised
_STAR_KEYS = {"orders": "order_id", "customers": "customer_id", "order_items": "order_id",
              "payments": "order_id", "products": "product_id", "translation": "product_category_name",
              "sellers": "seller_id", "reviews": "order_id", "geolocation": "geolocation_zip_code_prefix"}


class Marketplace:
    """The star schema the analyses read; each view is built on first access.

    With ``star_dir`` (written by ``materialize_star``) the views read those stored
    tables instead of deriving them again.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, star_dir: str | None = None):
        self.spark, self.sf_dir, self.star_dir = spark, sf_dir, star_dir

    def _view(self, name: str, build) -> DataFrame:
        if self.star_dir:
            return read_bucketed(self.spark, f"{self.star_dir.rstrip('/')}/{name}.parquet")
        return build(self.spark, self.sf_dir)

    @cached_property
    def orders(self) -> DataFrame:
        return self._view("orders", orders)

    @cached_property
    def customers(self) -> DataFrame:
        return self._view("customers", customers)

    @cached_property
    def order_items(self) -> DataFrame:
        return self._view("order_items", order_items)

    @cached_property
    def payments(self) -> DataFrame:
        return self._view("payments", payments)

    @property
    def dealt(self) -> tuple[str, ...]:
        """Tables whose numbered form comes in parts of a bounded number of rows; stored ones do not."""
        return () if self.star_dir else ("order_items", "payments")

    @cached_property
    def numbered_items(self) -> DataFrame:
        return self._view("order_items", partial(order_items, dealt=True))

    @cached_property
    def numbered_payments(self) -> DataFrame:
        return self._view("payments", partial(payments, dealt=True))

    @cached_property
    def products(self) -> DataFrame:
        return self._view("products", products)

    @cached_property
    def translation(self) -> DataFrame:
        return self._view("translation", category_translation)

    @cached_property
    def sellers(self) -> DataFrame:
        return self._view("sellers", sellers)

    @cached_property
    def reviews(self) -> DataFrame:
        return self._view("reviews", order_reviews)

    @cached_property
    def geolocation(self) -> DataFrame:
        return self._view("geolocation", geolocation)


def marketplace(spark: SparkSession, sf_dir: str, star_dir: str | None = None) -> Marketplace:
    return Marketplace(spark, sf_dir, star_dir)


def raw_orders(m: Marketplace) -> DataFrame:
    """Orders as text, as the reference receives them: sentinel dates and uncastable text.

    Orders without an approval carry the sentinel 1900-01-01 if their id is even, and
    undelivered orders whose id ends in 0 or 5 say so in words.
    """
    text = m.orders.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if "_at" in c or "timestamp" in c or "date" in c
                             else F.col(c).cast("string").alias(c) for c in m.orders.columns])
    k = F.col("order_id").cast("long")
    return text.withColumns({
        "order_approved_at": F.when(F.col("order_approved_at").isNull() & (k % 2 == 0), "1900-01-01 00:00:00")
        .otherwise(F.col("order_approved_at")),
        "order_delivered_customer_date": F.when(F.col("order_delivered_customer_date").isNull() & (k % 5 == 0), "not yet")
        .otherwise(F.col("order_delivered_customer_date")),
    })


def materialize_star(spark: SparkSession, sf_dir: str, out_dir: str, partitions: int | None = None) -> None:
    """Load the star schema once, as the reference loads its tables before querying.

    Each table is written as Parquet in ``partitions`` buckets of its key (default: shuffle
    partitions), so the facts of an order lie together and joins on ``order_id`` need no
    exchange; ``marketplace(spark, sf_dir, out_dir)`` reads these tables instead of
    re-deriving them.
    """
    from concurrent.futures import ThreadPoolExecutor

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    derived = Marketplace(spark, sf_dir)
    frames = {name: getattr(derived, name) for name in STAR_TABLES}  # built on this thread

    def write(name: str) -> None:
        write_bucketed(frames[name], f"{out_dir.rstrip('/')}/{name}.parquet", _STAR_KEYS[name], n)

    # the nine writes are independent jobs; submitting them together lets the
    # scheduler overlap their scan stages instead of running them one by one
    with ThreadPoolExecutor(max_workers=len(frames)) as pool:
        list(pool.map(write, frames))
