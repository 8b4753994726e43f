"""The maintained mart equals a full build after every load."""

import tempfile

import pytest
from pyspark.sql import functions as F

from souk.operators import mart
from souk.operators.mart_store import MartStore
from souk.plans.registry import AS_OF_DATE
from souk.sources import fixtures

KEY = mart.KEY


@pytest.fixture(scope="module")
def m(spark):
    got = fixtures.marketplace(spark, "/root/testdata/sf0.001")
    return got


def _load(store, m, orders):
    ids = orders.select("order_id").distinct()
    parts = [t.join(ids, "order_id", "left_semi") for t in (m.order_items, m.payments, m.reviews)]
    return store.load(orders, m.customers, *parts, m.geolocation)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def _full(m, orders):
    return mart.customer_360(m.customers, m.geolocation, orders, m.order_items, m.payments, m.reviews, AS_OF_DATE)


def test_new_and_replaced_orders_in_three_loads(spark, m):
    store = MartStore(spark, tempfile.mkdtemp(prefix="souk-test-store-"))
    assert store.last_load() == 0
    first = m.orders.where(F.col("order_id") % 3 == 0)
    assert _load(store, m, first) == 1
    assert _rows(store.mart(AS_OF_DATE)) == _rows(_full(m, first))
    # a load that broke off before its last table leaves files that nobody reads
    store.write(mart.month_partials(mart.order_facts(m.orders, m.customers, m.order_items, m.payments, m.reviews)),
                 "months", 2)
    assert store.last_load() == 1 and _rows(store.mart(AS_OF_DATE)) == _rows(_full(m, first))
    # some orders change: earlier and later dates, other status
    changed = first.where(F.col("order_id") % 30 == 0).withColumns({
        "order_status": F.lit("delivered"),
        "order_purchase_timestamp": F.expr("timestamp'1996-05-05 10:00:00'"),
        "order_delivered_customer_date": F.expr("timestamp'1996-05-09 10:00:00'")})
    more = m.orders.where(F.col("order_id") % 3 == 1).unionByName(changed)
    assert _load(store, m, more) == 2
    now = first.join(changed.select("order_id"), "order_id", "left_anti").unionByName(more)
    assert _rows(store.mart(AS_OF_DATE)) == _rows(_full(m, now))
    # and back again, with the rest
    rest = m.orders.join(now.select("order_id"), "order_id", "left_anti") \
        .unionByName(first.where(F.col("order_id") % 60 == 0))
    assert _load(store, m, rest) == 3
    last = now.join(rest.select("order_id"), "order_id", "left_anti").unionByName(rest)
    assert _rows(store.mart(AS_OF_DATE)) == _rows(_full(m, last))


def test_only_touched_persons_are_written(spark, m):
    store = MartStore(spark, tempfile.mkdtemp(prefix="souk-test-store-"))
    _load(store, m, m.orders)
    before = _rows(store.mart(AS_OF_DATE))
    one = m.orders.where("order_status = 'delivered'").limit(1)
    order = one.first()["order_id"]
    person = m.orders.where(F.col("order_id") == order).join(m.customers, "customer_id").first()[KEY]
    assert _load(store, m, m.orders.where(F.col("order_id") == order)) == 2
    written = spark.read.parquet(f"{store.path}/persons/load=2")
    assert [r[KEY] for r in written.collect()] == [person]
    assert _rows(store.mart(AS_OF_DATE)) == before
    assert _load(store, m, m.orders.limit(0)) == 3      # an empty load changes nothing
    assert _rows(store.mart(AS_OF_DATE)) == before


def test_traits_are_a_row_per_person_and_split_for_persons_with_many_orders(spark, m):
    facts = mart.order_facts(m.orders, m.customers, m.order_items, m.payments, m.reviews).localCheckpoint()
    persons = facts.select(KEY).distinct().count()
    traits = mart.trait_partials(facts).localCheckpoint()
    assert traits.count() == persons        # an order's values travel as one row, not as a row each
    split = mart.trait_partials(facts, most=3).localCheckpoint()
    assert split.count() > persons
    most = facts.groupBy(KEY).count().agg(F.max("count")).first()[0]
    assert split.agg(F.max(F.size("days"))).first()[0] < most
    want = _rows(mart._trait_metrics(traits))
    assert len(want) == persons
    for rows in (traits, split):            # together, by value, and some of each
        for few in (0, 60):
            assert _rows(mart._trait_metrics(rows, most=few)) == want
    assert _rows(mart._trait_metrics(split)) == want
