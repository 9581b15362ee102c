"""Small hand-made inputs, one per semantic decision (FIXTURES.md section 4)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from storepulse.operators import bonus, deals, latest, median, metrics, prices, stock
from storepulse.operators.events import split_log
from storepulse.operators.payload import store_payloads
from storepulse.operators.purchases import message_purchases
from storepulse.sources.logs import parse_messages, read_logs

EV = "store_id string, user_id string, product_id string, datetime timestamp_ntz"
PROD = "id_product long, id string, store_id string, name string, price decimal(10,2)"
T0 = dt.datetime(2024, 1, 1, 10, 0, 5)

LOG_TEXT = """timestamp;store_id;type;content;extra_1;extra_2
1700000000000000000;0_a;Audit;111;LOGIN
1700000001000000000;0_a;User;111;SCROLLING;HOME.
1700000002000000000;0_a;User;111;ZOOM;VIEW_PRODUCT 2000000001.
1700000003000000000;0_a;User;111;CLICK;CART with 2000000001.
1700000004000000000;0_a;User;111;CLICK;CHECKOUT with ['2000000001', '2000000002'].
1700000005000000000;0_a;Audit;111;BUY;2000000001
1700000006000000000;Error;3
1700000007000000000;0_a;Audit;111;EXIT
"""


def ev(spark, rows):
    return spark.createDataFrame(rows, EV)


def products(spark, rows):
    return spark.createDataFrame([(a, b, c, d, Decimal(e)) for a, b, c, d, e in rows], PROD)


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_parse_ragged_log(spark, tmp_path):
    (tmp_path / "store_0_a").mkdir()
    (tmp_path / "store_0_a" / "1log_simulation.txt").write_text(LOG_TEXT)
    log = read_logs(spark, str(tmp_path))
    rows = log.collect()
    assert len(rows) == 8
    err = [r for r in rows if r.store_id == "Error"][0]
    assert err.type == "3" and err.content is None and err.extra_1 is None and err.extra_2 is None
    parts = split_log(log)
    assert parts["buy"].count() == 1
    views = parts["view"].collect()
    assert len(views) == 1 and views[0].product_id == "2000000001"


def test_bad_timestamp_and_short_buy(spark):
    msgs = spark.createDataFrame([("junk;0_a;User;1;CLICK;BUY",)], "message string")
    parsed = parse_messages(msgs)
    assert parsed.collect()[0].datetime is None
    p = message_purchases(parsed).collect()[0]
    assert p.product_id is None and p.price is None


def test_nanoseconds(spark):
    msgs = spark.createDataFrame([("1700000000123456789;0_a;User;1;CLICK;BUY-2000-45.\n",)], "message string")
    p = message_purchases(parse_messages(msgs)).collect()[0]
    assert p.datetime == dt.datetime(2023, 11, 14, 22, 13, 20, 123456)
    assert p.product_id == "2000" and p.price == 45.0


def test_all_row_of_distinct_users(spark):
    v = ev(spark, [("a", "1", "p", T0), ("a", "2", "p", T0), ("b", "1", "p", T0)])
    pr = products(spark, [(1, "p", "a", "n", "1.00"), (2, "p", "b", "n", "1.00")])
    ref = as_dict(metrics.unique_users_per_minute(v, pr), "store_id", "unique_users")
    assert ref == {"a": 2, "b": 1, "All": 3}
    distinct = as_dict(metrics.unique_users_distinct_all(v, pr), "store_id", "unique_users")
    assert distinct == {"a": 2, "b": 1, "All": 2}


def test_revenue_truncates_prices(spark):
    v = ev(spark, [("a", "1", "p1", T0), ("a", "2", "p2", T0)])
    pr = products(spark, [(1, "p1", "a", "x", "9.99"), (2, "p2", "a", "y", "5.50")])
    assert as_dict(metrics.revenue_per_minute(v, pr), "store_id", "amount_earned") == {"a": 14, "All": 14}


def test_revenue_without_product_is_null(spark):
    from storepulse.operators import reports
    v = ev(spark, [("a", "1", "unknown", T0)])
    pr = products(spark, [(1, "p1", "a", "x", "9.99")])
    rev = metrics.revenue_per_minute(v, pr)
    assert as_dict(rev, "store_id", "amount_earned") == {"a": None, "All": None}
    line = reports.revenue_lines(rev.filter(F.col("store_id") == "a")).collect()[0].line
    assert line.endswith("$N/A")


def test_duplicate_products_keep_newest(spark):
    v = ev(spark, [("a", "1", "p", T0)])
    pr = prices.current_products(products(spark, [(1, "p", "a", "x", "10.00"), (101, "p", "a", "x", "12.00")]))
    out = metrics.revenue_per_minute(v, pr).filter(F.col("store_id") == "a").collect()
    assert len(out) == 1 and out[0].amount_earned == 12


def test_buy_without_views(spark):
    b = ev(spark, [("a", "1", "p1", T0)])
    v = ev(spark, [("a", "1", "p2", T0)])
    h = metrics.views_before_buy(v, b).filter(F.col("store_id") == "a").collect()
    assert [(r.views, r["count"]) for r in h] == [(0, 1)]


def _hist(spark, pairs):
    return spark.createDataFrame([("s", v, c) for v, c in pairs], "store_id string, views long, count long")


def test_median_rules(spark):
    for pairs, ref, true in (([(0, 1), (1, 1), (2, 1)], 0, 1.0), ([(0, 1), (1, 1)], 0, 0.5), ([(3, 1)], 3, 3.0)):
        h = _hist(spark, pairs)
        assert median.median_views_ref(h).collect()[0].median_views == ref
        assert median.median_views(h).collect()[0].median_views == true


def test_empty_stock_keeps_all_row(spark):
    s = spark.createDataFrame([], "product_id string, store_id string, quantity long")
    assert [tuple(r) for r in metrics.sold_without_stock(s).collect()] == [("All", None)]


def test_zero_stock(spark):
    s = spark.createDataFrame([("p1", "a", -1), ("p2", "a", 0), ("p3", "a", 5)],
                              "product_id string, store_id string, quantity long")
    assert metrics.negative_stock(s).count() == 1
    assert metrics.in_stock(s).count() == 1


def test_latest_window(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 10, m)
    rows = [("a", t(1)), ("a", t(2)), ("b", t(1)), ("All", t(1)), ("All", t(2))]
    df = spark.createDataFrame(rows, "store_id string, window_end timestamp_ntz")
    last = {(r.store_id, r.window_end.minute) for r in latest.last_window(df).collect()}
    older = {(r.store_id, r.window_end.minute) for r in latest.older_windows(df).collect()}
    assert last == {("a", 2), ("b", 1), ("All", 2)}
    assert older == {("a", 1), ("All", 1)}


def test_top10_tie_broken_by_name(spark):
    rows = [("s", f"n{i:02d}", 100 - i) for i in range(12)]
    rows[9] = ("s", "zz", 91)
    rows[10] = ("s", "aa", 91)  # ties with rank 10 at the cut
    df = spark.createDataFrame(rows, "store_id string, name string, views long")
    top = latest.top_n(df, "views", 10).collect()
    assert len(top) == 10
    names = {r.name for r in top}
    assert "aa" in names and "zz" not in names


def test_deal_bound_is_strict(spark):
    as_of = dt.datetime(2024, 1, 1)
    h = spark.createDataFrame([("p1", "a", Decimal("100.00"), dt.datetime(2023, 12, 15)),
                               ("p2", "a", Decimal("100.00"), dt.datetime(2023, 12, 15))],
                              "product_id string, store_id string, price decimal(10,2), recorded_at timestamp_ntz")
    cat = spark.createDataFrame([("p1", "a", "x", 90.00), ("p2", "a", "y", 89.99)],
                                "id string, store_id string, name string, price double")
    out = deals.price_deals(h, cat, as_of, 1, 10.0).collect()
    assert [r.product_id for r in out] == ["p2"]


def test_period_bound(spark):
    as_of = dt.datetime(2024, 1, 31)
    start = deals.period_start(as_of, 1)
    h = spark.createDataFrame([("p", "a", Decimal("10.00"), start),
                               ("p", "a", Decimal("99.00"), start - dt.timedelta(microseconds=1))],
                              "product_id string, store_id string, price decimal(10,2), recorded_at timestamp_ntz")
    assert deals.average_prices(h, as_of, 1).collect()[0].avg_price == 10.0


PUR = "user_id string, store_id string, product_id string, price float, datetime timestamp_ntz"


def _bonus_rows(spark, rows):
    d = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("u", "s", "p", float(v), d + dt.timedelta(hours=h, minutes=m)) for h, m, v in rows], PUR)


def test_bonus_reference_and_contained(spark):
    p = _bonus_rows(spark, [(0, 5, 600), (0, 15, 700), (7, 0, 2100)])
    ref = bonus.bonus_eligible(p, 500, 2000).collect()
    assert len(ref) == 1 and ref[0].pairs == 3
    assert bonus.bonus_contained(p, 500, 2000).count() == 1


def test_bonus_bound_is_strict(spark):
    # 6-hour total 2200 passes, but no 10-minute window is above 500
    p = _bonus_rows(spark, [(0, 5, 500), (1, 0, 500), (2, 0, 500), (3, 0, 500), (4, 0, 200)])
    assert bonus.bonus_eligible(p, 500, 2000).count() == 0
    assert bonus.bonus_contained(p, 500, 2000).count() == 0


def test_price_floor(spark):
    df = spark.createDataFrame([(Decimal("50.00"), -10000), (Decimal("50.00"), 1234)], "price decimal(10,2), cents long")
    out = [r[0] for r in df.select(prices.moved_price(F.col("price"), F.col("cents"))).collect()]
    assert out == [Decimal("1.00"), Decimal("62.34")]


def test_price_change_log(spark):
    old = products(spark, [(1, "p1", "a", "x", "10.00"), (2, "p2", "a", "y", "10.00")])
    new = products(spark, [(1, "p1", "a", "x", "10.00"), (2, "p2", "a", "y", "11.00")])
    out = prices.price_changes(old, new, dt.datetime(2024, 1, 1)).collect()
    assert [(r.product_id, r.price) for r in out] == [("p2", Decimal("11.00"))]


def test_stock_after_sales(spark):
    s = spark.createDataFrame([("p1", "a", 10), ("p2", "a", 3)], "product_id string, store_id string, quantity long")
    b = ev(spark, [("a", "u", p, T0) for p in ["p1"] * 4 + ["p2"] * 5 + ["p9"]])
    assert as_dict(stock.stock_after_sales(s, b), "product_id", "quantity") == {"p1": 6, "p2": -2}
    assert [r.product_id for r in stock.unmatched_sales(s, b).collect()] == ["p9"]


def test_order_rollup(spark):
    b = ev(spark, [("a", "u", "p1", T0), ("a", "u", "p1", T0), ("a", "u", "p2", T0)])
    assert as_dict(stock.order_rollup(b), "product_id", "quantity") == {"p1": 2, "p2": 1}


def test_payload_keeps_null_fields(spark):
    df = spark.createDataFrame([("a", None, "2024-01-01 00:00:00", dt.datetime(2024, 1, 1, 0, 1))],
                               "store_id string, amount_earned long, window_start string, window_end timestamp_ntz")
    p = store_payloads(df, "revenue_per_minute", ["amount_earned", "window_start", "window_end"],
                       [F.col("window_start")]).collect()[0].payload
    assert p == '{"0":{"amount_earned":null,"window_start":"2024-01-01 00:00:00","window_end":"2024-01-01 00:01:00"}}'


def test_merge_halves(spark):
    schema = "window_start string, window_end timestamp_ntz, store_id string, count long"
    a = spark.createDataFrame([("w", T0, "s", 2)], schema)
    b = spark.createDataFrame([("w", T0, "s", 3)], schema)
    out = latest.merge_partials(a, b, ["window_start", "window_end", "store_id"], "count").collect()
    assert out[0]["count"] == 5
