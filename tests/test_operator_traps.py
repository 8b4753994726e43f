"""Hand-made 5-20 row frames for the semantic traps listed in FIXTURES.md."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from souk.functions import labels as L
from souk.operators import mart, payments, retention, reviews, sellers, timeseries
from souk.sources.calendar import calendar

T = dt.datetime

ORDERS_SCHEMA = ("order_id long, customer_id long, order_status string, order_purchase_timestamp timestamp, "
                 "order_approved_at timestamp, order_delivered_carrier_date timestamp, "
                 "order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp")


def _orders(spark, rows):
    return spark.createDataFrame(rows, ORDERS_SCHEMA)


def _customers(spark, pairs):
    return spark.createDataFrame([(c, u, 1, "city", "ST") for c, u in pairs],
                                 "customer_id long, customer_unique_id long, customer_zip_code_prefix int, "
                                 "customer_city string, customer_state string")


def test_delay_zero_and_average_exactly_three(spark):
    est = T(2020, 1, 10)
    orders = _orders(spark, [
        (1, 1, "delivered", T(2020, 1, 1), None, None, T(2020, 1, 10, 18), est),   # delay 0
        (2, 2, "delivered", T(2020, 1, 1), None, None, T(2020, 1, 12), est),       # delay 2
        (3, 3, "delivered", T(2020, 1, 1), None, None, T(2020, 1, 12), est),       # delay 2
    ])
    revs = spark.createDataFrame([(1, 1, 5), (2, 2, 2), (3, 3, 4)], "review_id long, order_id long, review_score int")
    out = {r.delay_days: r for r in reviews.delay_vs_score(orders, revs, min_volume=0).collect()}
    assert out[0].satisfaction_tier == L.DELAY_TIERS[1]
    assert out[2].avg_rating == 3.0 and out[2].satisfaction_tier == L.DELAY_TIERS[2]
    assert out[2].pct_drop_from_ontime == -40.0


def test_response_time_null_answer_and_hour_boundaries(spark):
    revs = spark.createDataFrame([
        (1, 1, 5, None, T(2020, 1, 1, 10, 59), T(2020, 1, 2, 10, 1)),  # 24 boundaries -> fast
        (2, 2, 1, None, T(2020, 1, 1, 10, 0), None),                    # no answer
    ], "review_id long, order_id long, review_score int, review_comment_message string, "
       "review_creation_date timestamp, review_answer_timestamp timestamp")
    out = {r.response_speed_category: r for r in reviews.response_time_effect(revs).collect()}
    assert out[L.RESPONSE_SPEED[0]].avg_response_time_hours is None
    assert out[L.RESPONSE_SPEED[1]].avg_response_time_hours == 24.0


def test_payment_mix_two_payments_per_order_and_shares(spark):
    p = spark.createDataFrame([
        (1, 1, "credit_card", 1, Decimal("10.005")), (1, 2, "voucher", 1, Decimal("5.000")),
        (2, 1, "boleto", 1, Decimal("4.995")),
    ], "order_id long, payment_sequential int, payment_type string, payment_installments int, "
       "payment_value decimal(20,3)")
    out = {r.payment_type: r for r in payments.payment_mix(p).collect()}
    assert out["credit_card"].revenue_contribution == 10.01  # half away from zero
    assert out["voucher"].payment_profile == L.PAYMENT_PROFILES[2]
    assert abs(sum(r.revenue_share_pct for r in out.values()) - 100.0) <= 0.015 * len(out)


def test_rfm_labels_cover_every_customer(spark):
    rows, pays, pairs = [], [], []
    for i in range(1, 21):
        for k in range(i % 4 + 1):
            oid = i * 10 + k
            rows.append((oid, oid, "delivered", T(2020, 1, 1) + dt.timedelta(days=i * 3 + k), None, None, None, None))
            pays.append((oid, 1, "boleto", 1, Decimal(i * 7 % 13 + 1)))
            pairs.append((oid, i))
    out = retention.rfm_segments(_orders(spark, rows), _customers(spark, pairs),
                                 spark.createDataFrame(pays, "order_id long, payment_sequential int, payment_type "
                                                             "string, payment_installments int, payment_value "
                                                             "decimal(20,3)"), checkpoint=False).collect()
    assert sum(r.customer_count for r in out) == 20
    assert {r.customer_segment for r in out} <= set(L.RFM_BQ)


def test_mart_same_day_orders_and_payment_mode_tie(spark):
    day = T(2020, 3, 1, 9)
    orders = _orders(spark, [
        (1, 1, "delivered", day, None, None, T(2020, 3, 5), T(2020, 3, 16)),
        (2, 2, "canceled", day.replace(hour=20), None, None, None, T(2020, 3, 16)),
        (3, 3, "delivered", T(2020, 4, 1), None, None, T(2020, 4, 3), T(2020, 4, 16)),
        (4, 4, "delivered", T(2020, 4, 1), None, None, T(2020, 4, 3), T(2020, 4, 16)),
    ])
    customers = _customers(spark, [(1, 100), (2, 100), (3, 200), (4, 300)])
    items = spark.createDataFrame([(1, 1, 7, 70, Decimal("10.000"), Decimal("1.00000")),
                                   (3, 1, 7, 70, Decimal("5.000"), Decimal("0.50000"))],
                                  "order_id long, order_item_id int, product_id long, seller_id long, "
                                  "price decimal(20,3), freight_value decimal(22,5)")
    pays = spark.createDataFrame([(1, 1, "voucher", 1, Decimal("5")), (2, 1, "boleto", 3, Decimal("5"))],
                                 "order_id long, payment_sequential int, payment_type string, "
                                 "payment_installments int, payment_value decimal(20,4)")
    revs = spark.createDataFrame([(1, 1, 2)], "review_id long, order_id long, review_score int")
    geo = spark.createDataFrame([(1, "ST", Decimal("1.5"), Decimal("2.5"))],
                                "geolocation_zip_code_prefix int, geolocation_state string, "
                                "geolocation_lat decimal(9,6), geolocation_lng decimal(9,6)")
    out = {r.customer_unique_id: r for r in mart.customer_360(
        customers, geo, orders, items, pays, revs, "2020-06-01", checkpoint=False).collect()}
    two = out[100]
    assert len(mart.OUTPUT_COLUMNS) == 61
    assert two.first_to_second_order_days == 0.0 and two.max_days_between_orders == 0.0
    assert two.most_used_payment_type == "boleto"  # 1 order each: alphabetical tie-break
    assert two.is_repeat_buyer_flag == 1 and two.canceled_orders == 1 and two.undelivered_orders == 1
    assert two.installment_usage_rate == 0.5 and two.negative_review_rate == 1.0
    assert out[200].first_to_second_order_days is None and out[200].total_reviews is None
    assert out[300].monetary_value is None  # no items: lowest monetary score
    assert out[300].rfm_monetary_score == 1


def test_union_report_has_separator_and_weekday_rows(spark):
    orders = _orders(spark, [(i, i, "delivered", T(2017, 1, 1 + i % 28, i % 24), None, None, None, None)
                             for i in range(1, 60)])
    pays = spark.createDataFrame([(i, 1, "boleto", 1, Decimal(i)) for i in range(1, 60)],
                                 "order_id long, payment_sequential int, payment_type string, "
                                 "payment_installments int, payment_value decimal(20,4)")
    rows = timeseries.seasonality_report(orders, pays, calendar(spark, "2016-01-01", "2018-12-31")).collect()
    seps = [r for r in rows if r.month_name == L.INTRADAY_SEPARATOR]
    assert len(seps) == 1 and seps[0].year is None
    assert any(r.month_name.startswith("Sunday at ") for r in rows)


def test_high_tickets_count_whatever_their_installments(spark):
    pays = spark.createDataFrame([(1, "credit_card", 0, 900.0), (2, "credit_card", 6, 900.0), (3, "credit_card", None, 900.0),
                                  (4, "credit_card", 1, 100.0), (5, "boleto", 1, 900.0)],
                                 "order_id long, payment_type string, payment_installments int, payment_value double")
    r = payments.installment_financing(pays).first()
    assert (r.total_high_ticket_orders, r.high_installment_count, r.high_ticket_financing_pct) == (3, 1, 33.33)
    assert r.avg_val_1_inst == 100.0 and r.avg_val_10_inst is None


def test_mart_measures_ignore_unknown_values(spark):
    day = T(2017, 3, 5)
    orders = _orders(spark, [(1, 1, "delivered", day, None, None, None, None), (2, 2, "shipped", None, None, None, None, None)])
    customers = _customers(spark, [(1, 7), (2, 7)])
    items = spark.createDataFrame([(1, 1, 5, 9, 10.0, 1.0), (1, 2, 5, 8, 10.0, 1.0), (2, 1, 6, 9, 5.0, 1.0)],
                                  "order_id long, order_item_id int, product_id long, seller_id long, price double, freight_value double")
    pays = spark.createDataFrame([(1, 1, "voucher", 4, 10.0), (2, 1, "boleto", None, 5.0)],
                                 "order_id long, payment_sequential int, payment_type string, payment_installments int, payment_value double")
    revs = spark.createDataFrame([(1, 1, 4), (2, 2, None)], "review_id long, order_id long, review_score int")
    geo = spark.createDataFrame([(1, "ST", 1.0, 2.0)], "geolocation_zip_code_prefix int, geolocation_state string, "
                                                       "geolocation_lat double, geolocation_lng double")
    r = mart.customer_360(customers, geo, orders, items, pays, revs, "2018-01-01").first()
    assert r.avg_review_score == 4.0 and r.total_reviews == 2
    assert r.avg_installments_per_order == 4.0
    assert r.active_months_count == 1 and r.total_orders == 2
    assert (r.distinct_products_purchased, r.distinct_sellers_purchased, r.most_used_payment_type) == (2, 2, "boleto")


def test_seller_churn_names_and_statuses(spark):
    from souk.operators.sellers import seller_churn

    orders = _orders(spark, [(1, 1, "delivered", T(2017, 1, 1), None, None, None, None),
                             (2, 2, "canceled", T(2017, 2, 1), None, None, None, None),
                             (3, 3, "delivered", T(2018, 1, 1), None, None, None, None),
                             (4, 4, "delivered", None, None, None, None, None)])
    items = spark.createDataFrame([(1, 1, 10), (2, 1, 10), (2, 2, 10), (2, 3, 20), (3, 1, 20), (3, 1, 30), (4, 1, 10)],
                                  "order_id long, order_item_id int, seller_id long")
    got = {r.churn_status: tuple(r)[1:] for r in seller_churn(orders, items).collect()}
    assert got == {L.SELLER_CHURN[0].format(next_year=2018): (1, 100.0, 2.0),   # two cancelled items over two orders
                   L.SELLER_CHURN[1].format(next_year=2018): (1, 100.0, 1.0)}
    assert seller_churn(orders, items, 2016, 2017).columns[-1] == "avg_2016_order_volume"


def test_latency_gaps_at_order_grain(spark):
    orders = _orders(spark, [(1, 1, "delivered", T(2017, 1, 1), None, None, None, None),
                             (2, 2, "delivered", T(2017, 1, 11), None, None, None, None),
                             (3, 3, "delivered", None, None, None, None, None)])
    items = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (3, 1, 1)],
                                  "order_id long, order_item_id int, product_id long")
    products = spark.createDataFrame([(1, "a"), (2, "b")], "product_id long, product_category_name string")
    names = spark.createDataFrame([("a", "A")], "product_category_name string, product_category_name_english string")
    got = {tuple(r) for r in retention.purchase_latency(orders, _customers(spark, [(1, 7), (2, 7), (3, 7)]), items,
                                                        products, names, min_events=1).collect()}
    # rows: a (first), b 0 days later, b 10 days later, a 0 days later
    assert got == {("a", "A", 1, 0, 0, 0), ("b", None, 2, 5, 0, 10)}


def test_fan_out_is_factorised(spark):
    """1,000 payments and 1,000 items on one order: a million pairs that no join makes."""
    from souk.operators import reviews as rv
    from souk.operators import sellers

    orders = spark.createDataFrame([(1, "delivered"), (2, "delivered"), (3, "canceled")], "order_id long, order_status string") \
        .withColumns({"order_purchase_timestamp": F.expr("timestamp'2020-01-01 00:00:00'"),
                      "order_delivered_customer_date": F.expr("timestamp'2020-01-05 00:00:00'")})
    items = spark.createDataFrame([(1, i, i % 2, i % 3) for i in range(1000)] + [(2, 0, 0, 0), (3, 0, 0, 0)],
                                  "order_id long, order_item_id long, product_id long, seller_id long")
    pays = spark.createDataFrame([(1, i, Decimal("0.5")) for i in range(1000)] + [(2, 0, Decimal("7")), (3, 0, Decimal("9"))],
                                 "order_id long, payment_sequential long, payment_value decimal(20,3)")
    products = spark.createDataFrame([(0, "a"), (1, "b")], "product_id long, product_category_name string")
    reviews = spark.createDataFrame([(1, i % 5 + 1 if i % 7 else None) for i in range(1000)] + [(2, 1)],
                                    "order_id long, review_score int")
    pareto = sellers.seller_pareto(items, pays, orders, tiles=3)
    assert sorted(r.revenue for r in pareto.collect()) == [166500.0, 166500.0, 167007.0]
    conc = {r.product_category_name: r for r in sellers.category_concentration(items, products, pays, orders).collect()}
    assert conc["a"].total_vendors == 3 and conc["a"].leader_market_share_pct == round(100 * 83507 / 250007, 2)
    speed = rv._category_speed_quality(orders, items, products, reviews)
    got = {r.product_category_name: r for r in speed.collect()}
    assert got["a"]["__rows"] == 500 * 1000 + 1 and got["b"]["__rows"] == 500 * 1000
    assert got["a"]["__orders"] == 2 and got["b"]["__lead"] == 4.0
    scores = [i % 5 + 1 for i in range(1000) if i % 7]
    assert got["b"]["__score"] == sum(scores) / len(scores)
    assert got["a"]["__score"] == (500 * sum(scores) + 1) / (500 * len(scores) + 1)
    bad = sellers.bad_review_sellers(items, orders, reviews, min_orders=0, max_score=6).collect()
    assert {r.seller_id: (r.total_orders, r.one_star_count) for r in bad} == {
        0: (2, 334 * scores.count(1) + 1), 1: (1, 333 * scores.count(1)), 2: (1, 333 * scores.count(1))}
    for df in (speed, sellers._item_revenue(items, pays, orders)):
        df.collect()
        for node in _joins(df._jdf.queryExecution().executedPlan()):
            assert node <= items.count()


def _joins(plan):
    """Output rows of the joins of an executed plan."""
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert found
    return found


def test_regional_ranks_by_threshold_equal_rank(spark):
    from pyspark.sql import Window

    from souk.operators.sales import _within

    for n in (0, 5, 30, 200):
        df = spark.createDataFrame([(i, None if i % 9 == 4 else i * 7 % 23) for i in range(n)], "id long, v int")
        got = _within(df, "v", (1, 10, 20, 50))
        ranked = df.withColumn("r", F.rank().over(Window.orderBy(F.desc("v"))))
        for k, cond in got.items():
            assert ranked.where(cond != (F.col("r") <= k)).count() == 0, (n, k)


def test_slow_dispatch_joins_in_as_many_parts_as_the_items_need(spark, monkeypatch):
    import souk.session as session

    monkeypatch.setattr(session, "TASK_ROWS", 2)
    stored, plans = sellers.stored_table, []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(sellers, "stored_table", seen)
    day = T(2020, 3, 1, 9)
    orders = _orders(spark, [(i, i, "delivered", day, day, day + dt.timedelta(hours=i % 10), None, None) for i in range(50)]
                     + [(None, 99, "delivered", day, day, day, None, None)])
    items = spark.createDataFrame([(i % 50, i % 10) for i in range(200)] + [(None, 3)], "order_id long, seller_id long")
    got = sellers.slow_dispatch_sellers(orders, items).collect()
    assert [tuple(r) for r in got] == [(9, 5, 9.0, 0.38)]
    parts = session.tasks_for(items, 201)
    assert parts == 101 and plans[0].count(f", {parts})") >= 2
