"""Label ladders the driver data cannot reach (FIXTURES.md asks for hand-made rows)."""

import datetime as dt
from decimal import Decimal

from souk.functions import labels as L
from souk.operators import reviews, sales, sellers

T = dt.datetime
ITEMS = "order_id long, order_item_id int, product_id long, seller_id long, price decimal(20,3)"
PAYS = "order_id long, payment_sequential int, payment_type string, payment_installments int, payment_value decimal(20,4)"
ORDERS = "order_id long, customer_id long, order_status string, order_purchase_timestamp timestamp"


def test_market_concentration_labels(spark):
    # category A: one seller holds everything (monopoly); B: 25 equal sellers (fragmented)
    items, pays, orders, prods = [], [], [], [(1, "A"), (2, "B")]
    oid = 0
    for seller in range(25):
        oid += 1
        items.append((oid, 1, 2, 100 + seller, Decimal("10")))
        pays.append((oid, 1, "boleto", 1, Decimal("10")))
        orders.append((oid, oid, "delivered", T(2017, 1, 1)))
    oid += 1
    items.append((oid, 1, 1, 7, Decimal("10")))
    pays.append((oid, 1, "boleto", 1, Decimal("99")))
    orders.append((oid, oid, "delivered", T(2017, 1, 1)))
    out = {r.product_category_name: r for r in sellers.category_concentration(
        spark.createDataFrame(items, ITEMS), spark.createDataFrame(prods, "product_id long, product_category_name string"),
        spark.createDataFrame(pays, PAYS), spark.createDataFrame(orders, ORDERS)).collect()}
    assert out["A"].market_health_status == L.MARKET_HEALTH[0] and out["A"].leader_market_share_pct == 100.0
    assert out["B"].market_health_status == L.MARKET_HEALTH[2] and out["B"].leader_market_share_pct == 4.0


def test_category_segmentation_ladder(spark):
    # 6 categories: volume and revenue ranks chosen to hit all four labels
    spec = {"hv_hr": (50, 100), "hv_lr": (40, 1), "lv_hr": (1, 500), "std1": (5, 5), "std2": (6, 6), "std3": (7, 7)}
    items, prods, orders, pid, oid = [], [], [], 0, 0
    for cat, (n, price) in spec.items():
        pid += 1
        prods.append((pid, cat))
        for _ in range(n):
            oid += 1
            items.append((oid, 1, pid, 1, Decimal(price)))
            orders.append((oid, oid, "delivered", T(2017, 1, 1)))
    out = {r.product_category_name: r.category_segmentation for r in sales.category_volume_value(
        spark.createDataFrame(items, ITEMS), spark.createDataFrame(prods, "product_id long, product_category_name string"),
        spark.createDataFrame(orders, ORDERS)).collect()}
    assert out["hv_hr"] == L.CATEGORY_SEGMENTS[0]
    assert out["hv_lr"] == L.CATEGORY_SEGMENTS[1]
    assert out["lv_hr"] == L.CATEGORY_SEGMENTS[2]
    assert out["std1"] == L.CATEGORY_SEGMENTS[3]


def test_regional_ladder_third_branch_is_unreachable(spark):
    rows, pays, custs = [], [], []
    for i in range(60):
        rows.append((i, i, "delivered", T(2017, 1, 1)))
        pays.append((i, 1, "boleto", 1, Decimal(1000 - i)))
        custs.append((i, i, 1, f"city{i}", "ST"))
    out = sales.regional_profile(spark.createDataFrame(rows, ORDERS),
                                 spark.createDataFrame(custs, "customer_id long, customer_unique_id long, "
                                                              "customer_zip_code_prefix int, customer_city string, "
                                                              "customer_state string"),
                                 spark.createDataFrame(pays, PAYS)).collect()
    labels = {r.regional_profile for r in out}
    assert L.REGIONAL_PROFILES[2] not in labels
    assert L.REGIONAL_PROFILES[0] in labels and L.REGIONAL_PROFILES[3] in labels


def test_polarization_upper_buckets_and_order(spark):
    revs, items, rid = [], [], 0
    for product, n in ((1, 5), (2, 30), (3, 75), (4, 150)):
        for k in range(n):
            rid += 1
            revs.append((rid, rid, 1 if k % 3 == 0 else 5))
            items.append((rid, 1, product, 1, Decimal("1")))
    out = reviews.review_polarization(spark.createDataFrame(revs, "review_id long, order_id long, review_score int"),
                                      spark.createDataFrame(items, ITEMS)).collect()
    assert [r.volume_bucket for r in out] == list(L.VOLUME_BUCKETS)  # ordered by the hidden bucket key
    assert [r.number_of_products for r in out] == [1, 1, 1, 1]
    assert all(r.pct_polarized == 100.0 for r in out)
