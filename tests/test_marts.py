"""Hand-made micro-frames per mart, with exact expected rows (FIXTURES §4)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest

from basketry.operators import marts as M
from basketry.operators import staging as S
from tests.conftest import rows

T0 = dt.datetime(2018, 1, 1, 10, 0, 0)


def ts(days=0.0):
    return (T0 + dt.timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S.%f")


@pytest.fixture()
def staged(spark):
    orders = spark.createDataFrame(
        [
            (1, 10, "delivered", ts(0)),
            (2, 10, "shipped", ts(0.05)),  # person 100: gap exactly 0.05 d
            (3, 11, "delivered", ts(40)),  # person 100 via a second customer id
            (4, 12, "canceled", ts(1)),  # person 101
            (5, 13, "unavailable", ts(2)),  # person 102
            (6, 14, None, ts(400)),  # person 103, NULL status
            (7, 15, "delivered", None),  # person 104, NULL timestamp -> 'No Order'
            (8, 16, "processing", ts(500)),  # person 105, no items
            (9, 17, "delivered", ts(500)),  # person 106, tie with order 10 at same time
            (10, 17, "delivered", ts(500)),
        ],
        "order_id bigint, customer_id bigint, order_status string, order_purchase_timestamp string",
    )
    for c in ["order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"]:
        from pyspark.sql import functions as F

        orders = orders.withColumn(c, F.lit(None).cast("string"))
    items = spark.createDataFrame(
        [
            (1, 1, 1000, 1, D("100.00"), D("10.00")),
            (1, 2, 1001, 1, D("2900.00"), D("0.00")),
            (2, 1, 1000, 1, D("100.00"), D("12.00")),
            (3, 1, 1002, 2, D("50.00"), D("5.00")),
            (3, 2, None, 2, D("1.00"), D("0.00")),  # NULL product id: not counted as an item
            (4, 1, 1000, 1, D("100.00"), D("11.00")),
            (5, 1, 1003, 3, D("10.00"), D("1.00")),
            (6, 1, 1002, 2, D("50.00"), D("5.00")),
            (7, 1, 1000, 1, D("100.00"), D("11.00")),
            (9, 1, 1004, 3, D("0.00"), D("0.00")),  # zero total
            (10, 1, 1003, 3, D("12.00"), D("1.00")),
        ],
        "order_id bigint, order_item_id int, product_id bigint, seller_id bigint, price decimal(18,2), freight_value decimal(18,2)",
    )
    customers = spark.createDataFrame(
        [
            (10, 100, "00001", "city_b", "S1"),
            (11, 100, "00002", "city_a", "S2"),  # person 100 has two cities: lowest customer id wins
            (12, 101, "00003", "c", "S"),
            (13, 102, "00003", "c", "S"),
            (14, 103, "00003", "c", "S"),
            (15, 104, "00003", "c", "S"),
            (16, 105, "00003", "c", "S"),
            (17, 106, "00003", "c", "S"),
            (18, 107, "00003", "c", "S"),  # person without orders
        ],
        "customer_id bigint, customer_unique_id bigint, customer_zip_code_prefix string, customer_city string, customer_state string",
    )
    products = spark.createDataFrame(
        [
            (1000, "STANDARD", 1.0, 1.0, 1.0, 100.0, 10.0, 2.0, 3.0),
            (1001, "STANDARD", 1.0, 1.0, 1.0, 100.0, 10.0, 2.0, None),
            (1002, "LARGE", 1.0, 1.0, 1.0, 100.0, 10.0, 2.0, 3.0),
            (1003, None, 1.0, 1.0, 1.0, 100.0, 10.0, 2.0, 3.0),
            (1004, "STANDARD", 1.0, 1.0, 1.0, 100.0, 10.0, 2.0, 3.0),
        ],
        "product_id bigint, product_category_name string, product_name_lenght double, product_description_lenght double, "
        "product_photos_qty double, product_weight_g double, product_length_cm double, product_height_cm double, product_width_cm double",
    )
    translation = spark.createDataFrame(
        [("STANDARD", "standard goods")], "product_category_name string, product_category_name_english string"
    )
    return {
        "stg_order": S.stg_order(orders),
        "stg_items": S.stg_order_items(items),
        "stg_customer": S.stg_customer(customers),
        "stg_products": S.stg_products(products),
        "stg_translate": S.stg_category_translate(translation),
    }


def test_fct_orders_zero_fills_and_counts_non_null_products(staged):
    f = M.fct_orders(staged["stg_order"], staged["stg_items"])
    got = {r.order_id: (r.total_price, r.total_freight, r.total_order_amount, r.total_items) for r in f.collect()}
    assert got[1] == (D("3000.00"), D("10.00"), D("3010.00"), 2)
    assert got[3] == (D("51.00"), D("5.00"), D("56.00"), 1)
    assert got[8] == (D("0.00"), D("0.00"), D("0.00"), 0)
    assert len(got) == 10


def test_monthly_revenue_filters_status_and_zero(staged):
    f = M.fct_orders(staged["stg_order"], staged["stg_items"])
    mr = M.monthly_revenue(f)
    got = rows(mr, "order_month", "total_fullfilled_orders", "revenue", "items_sold")
    # excluded: canceled (4), unavailable (5), NULL status (6), zero amount (8, 9)
    assert got == [
        (dt.date(2018, 1, 1), 2, D("3122.00"), 3),
        (dt.date(2018, 2, 1), 1, D("56.00"), 1),
        (dt.date(2019, 5, 1), 1, D("13.00"), 1),
        (None, 1, D("111.00"), 1),
    ]


def test_dim_customer_location_segments_and_leads(staged):
    f = M.fct_orders(staged["stg_order"], staged["stg_items"])
    d = M.dim_customer(f, staged["stg_customer"])
    got = {r.customer_unique_id: r for r in d.collect()}
    p = got[100]
    assert (p.customer_city, p.customer_state) == ("city_b", "S1")  # customer 10 < 11
    assert p.total_orders == 3 and p.lifetime_value == D("3178.00") and p.average_order_value == D("1059.33")
    assert p.customer_segment == "VIP"
    assert got[107].total_orders == 0 and got[107].lifetime_value == D("0.00")
    assert got[107].customer_segment == "Lead / No Purchase" and got[107].first_order_date is None
    assert got[105].customer_segment == "Lead / No Purchase"  # LTV exactly 0
    assert got[101].customer_segment == "Low Value"
    thr = M.dim_customer(f, staged["stg_customer"], thresholds=(3178, 111, 13))
    seg = {r.customer_unique_id: r.customer_segment for r in thr.collect()}
    assert seg[100] == "VIP" and seg[101] == "High Value" and seg[106] == "Medium Value"


def test_customer_retention_sequence_gaps_and_labels(staged, spark):
    f = M.fct_orders(staged["stg_order"], staged["stg_items"])
    r = M.customer_retention(f, staged["stg_customer"])
    got = {x.order_id: x for x in r.collect()}
    assert [got[i].order_sequence for i in (1, 2, 3)] == [1, 2, 3]
    assert got[2].previous_order_at == T0 and got[2].days_between_orders == D("0.05")
    assert got[3].days_between_orders == D("39.95") and got[3].retention_window == "Standard (30-90d)"
    assert got[2].retention_window == "Quick Return (<30d)"
    assert got[1].lifecycle_stage == "Initial Purchase (Loyalist)" and got[1].retention_window == "First Order"
    # tie at the same instant: order id decides
    assert (got[9].order_sequence, got[10].order_sequence) == (1, 2)
    assert got[10].days_between_orders == D("0.00")
    # NULL timestamp, single order: 'No Order'
    assert got[7].lifecycle_stage == "No Order" and got[7].recency_days is None
    # dataset max is 500 days after T0: order 4 (day 1) is lapsed, order 6 (day 400) is new
    assert got[4].recency_days == 499 and got[4].lifecycle_stage == "Lapsed (One-Time)"
    assert got[6].recency_days == 100 and got[6].lifecycle_stage == "New (Potential Repeat)"
    assert len(got) == 10


def test_retention_same_under_heavy_key_split(staged, spark, skew_conf):
    f = M.fct_orders(staged["stg_order"], staged["stg_items"])
    r = M.customer_retention(f, staged["stg_customer"])
    got = {x.order_id: (x.order_sequence, x.previous_order_at, x.total_customer_orders) for x in r.collect()}
    assert got[1] == (1, None, 3) and got[2] == (2, T0, 3) and got[3][0] == 3
    assert got[9][0] == 1 and got[10][0] == 2


def test_dim_products_and_category_revenue(staged):
    dp = M.dim_products(staged["stg_products"], staged["stg_translate"])
    cats = dict(rows(dp, "product_id", "category_name"))
    assert cats == {1000: "standard goods", 1001: "standard goods", 1002: "LARGE", 1003: None, 1004: "standard goods"}
    assert rows(dp.where("product_id = 1001"), "volume_cm3") == [(None,)]
    rc = M.monthly_revenue_by_cat(staged["stg_order"], staged["stg_items"], staged["stg_products"], staged["stg_translate"])
    got = {(r.revenue_year_month, r.product_category): (r.monthly_revenue, r.product_sold) for r in rc.collect()}
    # untranslated LARGE and missing category are both 'Unknown' here; cancelled orders are included
    assert got[("2018-01", "standard goods")] == (D("3233.00"), 4)
    assert got[("2018-01", "Unknown")] == (D("11.00"), 1)
    assert got[("2018-02", "Unknown")] == (D("55.00"), 1)  # NULL product id has no product row
    assert got[(None, "standard goods")] == (D("111.00"), 1)


@pytest.fixture()
def product_items(spark):
    data = []
    oid = 0

    def sale(pid, price, freight):
        nonlocal oid
        oid += 1
        data.append((oid, 1, pid, 1, D(price), D(freight)))

    sale(1, "10.00", "1.00")  # single sale
    for p, f in [("10.00", "1.00"), ("12.00", "1.00"), ("14.00", "1.00")]:
        sale(2, p, f)  # three sales
    for p, f in [("10.00", "3.00"), ("12.00", "1.00"), ("11.00", "2.00"), ("11.00", "2.00")]:
        sale(3, p, f)  # four sales, price and freight offset each other
    for _ in range(2):
        sale(4, "20.00", "0.00")  # tied revenue with product 5
    sale(5, "40.00", "0.00")
    sale(6, "1000.00", "0.00")  # one product far above 80% of its category
    sale(7, "0.00", "0.00")  # zero cost, alone in its category
    items = spark.createDataFrame(
        data, "order_id bigint, order_item_id int, product_id bigint, seller_id bigint, price decimal(18,2), freight_value decimal(18,2)"
    )
    dim = spark.createDataFrame(
        [(1, "A"), (2, "A"), (3, "A"), (4, "B"), (5, "B"), (6, "B"), (7, "C")], "product_id bigint, category_name string"
    )
    return S.stg_order_items(items), dim


def test_product_cost_decomposition(product_items):
    items, dim = product_items
    pcd = M.product_cost_decomposition(items, dim)
    got = {r.product_id: r for r in pcd.collect()}
    assert len(pcd.columns) == 24
    assert [got[i].reliability_score for i in (1, 2, 3)] == ["Single Sale", "Low Confidence", "High Confidence"]
    assert got[1].price_volatility == D("0.0000") and got[2].price_volatility == D("2.0000")
    assert got[3].avg_total_cost == D("13.00") and got[3].total_cost_volatility == D("0.0000")
    assert got[3].is_price_rebalanced is True and got[2].is_price_rebalanced is False and got[1].is_price_rebalanced is False
    assert got[7].total_cost_z_score is None and got[7].freight_share_pct is None and got[7].total_cost_cv is None
    assert got[7].is_revenue_workhorse is False  # zero category revenue
    # category B: revenues 40, 40, 1000 -> product 6 alone crosses 80%: no workhorse
    assert got[4].cumulative_category_revenue == got[5].cumulative_category_revenue == D("1080.00")
    assert got[6].cumulative_category_revenue == D("1000.00")
    assert [got[i].is_revenue_workhorse for i in (4, 5, 6)] == [False, False, False]
    assert got[6].pareto_revenue_pct == D("92.5926")
    # category A: product 3 (44) then 2 (36) then 1 (10) of 90
    assert got[3].is_revenue_workhorse is True and got[2].is_revenue_workhorse is False
    assert got[2].product_revenue_share_pct == D("40.0000") and got[2].pareto_revenue_pct == D("88.8889")


def test_pareto_same_under_heavy_key_split(product_items, skew_conf):
    items, dim = product_items
    got = {r.product_id: (r.cumulative_category_revenue, r.total_category_revenue) for r in M.product_cost_decomposition(items, dim).collect()}
    assert got[4] == (D("1080.00"), D("1080.00")) and got[6] == (D("1000.00"), D("1080.00"))
    assert got[3] == (D("44.00"), D("90.00")) and got[1] == (D("90.00"), D("90.00"))
