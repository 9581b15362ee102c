"""Null keys, ids over many tasks, orders, empty answers, scans of the six-task pass."""

import datetime as dt
import json
import pathlib

from conftest import SF_SMALL
from pyspark.sql import functions as F

from storepulse.functions import texts
from storepulse.operators import bonus, deals, flow, metrics, reports, stock
from storepulse.operators.events import split_log
from storepulse.operators.payload import decode_task_messages, store_payloads, task_messages
from storepulse.plans import store_pass
from storepulse.plans.inputs import AS_OF, StoreInputs
from storepulse.sources import logs
from storepulse.streaming import jobs

T0 = dt.datetime(2024, 1, 1, 12, 0)
EVENT = "store_id string, user_id string, product_id string, datetime timestamp_ntz"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_null_keys_join_nothing(spark):
    views = spark.createDataFrame([("a", "u", None, at(0)), ("a", "u", None, at(1)), ("a", "u", "p", at(0)),
                                   (None, "u", "p", at(0))], EVENT)
    buys = spark.createDataFrame([("a", "u", None, at(90)), ("a", "u", "p", at(90)), (None, "u", "p", at(90))], EVENT)
    for got in (metrics.views_before_buy(views, buys), metrics.views_strictly_before_buy(views, buys)):
        rows = {(r.store_id, r.views): r["count"] for r in got.collect()}
        assert rows == {("a", 0): 1, ("a", 1): 1, (None, 0): 1, ("All", 0): 2, ("All", 1): 1}


def test_a_null_user_is_one_sequence_across_hours(spark):
    rows = [("a", None, at(0), 1, "x"), ("a", None, at(10), 2, "y"), ("a", None, at(90), 3, "z")]
    df = spark.createDataFrame(rows, "store_id string, user_id string, ts timestamp_ntz, event_id long, event_type string")
    got = {(r.src, r.dst): r.n for r in flow.transitions(df).collect()}
    assert got == {("x", "y"): 1, ("y", "z"): 1}
    assert {(r.src, r.dst) for r in flow.node_transitions(df).collect()} == {("x", "y"), ("y", "z")}  # types without node stay


def test_batch_messages_are_bounded_and_whole(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("".join(f"line {i}\n" for i in range(25)))
    table, batches = str(tmp_path / "t"), str(tmp_path / "b")
    jobs.ingest_lines(spark, str(src), table, str(tmp_path / "ck"), batch_path=batches, lines_per_message=10).awaitTermination(120)
    lists = [json.loads(r.message) for r in spark.read.parquet(batches).collect()]
    assert sorted(len(x) for x in lists) == [6, 9, 10]  # ids 1-9, 10-19, 20-25
    assert sorted(x for one in lists for x in one) == sorted(f"line {i}" for i in range(25))


def test_two_checkouts_are_two_orders(spark):
    b = spark.createDataFrame([("a", "u", "p", at(0)), ("a", "u", "p", at(0)), ("a", "u", "p", at(5 * 24 * 60)),
                               ("a", "u", "p", None)], EVENT)
    assert sorted(r.quantity for r in stock.order_rollup(b).collect()) == [1, 2]


def test_error_lines_and_line_ends(spark):
    m = spark.createDataFrame([("1700000000000000000;Error;3\n",), ("1700000000000000000;s;User;u;CLICK;EXIT\r\n",)], "message string")
    error, click = sorted(logs.parse_messages(m).collect(), key=lambda r: r.type != "error")
    assert (error.store_id, error.type, error.user_id, error.details) == (None, "error", None, "3")
    assert click.details == "EXIT"


def test_one_absurd_request_leaves_the_others(spark):
    i = StoreInputs(spark, SF_SMALL)
    raw = ['{"time_window": 12, "discount_percentage": 10}', '{"time_window": 100000, "discount_percentage": 10}', "junk", None,
           '{"time_window": 0, "discount_percentage": 10}']
    req = deals.decode_requests(spark.createDataFrame(list(enumerate(raw)), "request_id int, value string"))
    got = deals.deals_for_requests(i.history, i.catalog, req, AS_OF)
    want = deals.price_deals(i.history, i.catalog, AS_OF, 12, 10.0)
    cols = ["product_id", "store_id", "price", "average_price"]
    assert got.select("request_id").distinct().collect()[0].request_id == 0
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0 and got.count() == want.count()
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_rejected_requests_are_answered(spark):
    raw = ['{"time_window": 12, "discount_percentage": 10}', '{"time_window": 100000, "discount_percentage": 10}', "junk", None,
           '{"time_window": 3, "discount_percentage": 0}']
    got = {r.request_id: json.loads(r.message) for r in deals.rejection_messages(
        spark.createDataFrame(list(enumerate(raw)), "request_id int, value string")).collect()}
    assert {k: (m["error"], m["request"]) for k, m in got.items()} == {
        1: (texts.NO_PERIOD, raw[1]), 2: (texts.NO_REQUEST, "junk"), 3: (texts.NO_REQUEST, ""), 4: (texts.NO_DISCOUNT, raw[4])}
    assert {m["status"] for m in got.values()} == {"error"}


def test_requests_of_many_periods_equal_single_ones(spark):
    i = StoreInputs(spark, SF_SMALL)
    periods = [1, 7, 12, 13, 60, 300, 20_000]
    req = spark.createDataFrame([(n, m, 10.0) for n, m in enumerate(periods)], "request_id int, months int, discount double")
    got = deals.deals_for_requests(i.history, i.catalog, req, AS_OF)
    cols = ["product_id", "store_id", "price", "average_price"]
    rows = [(r.request_id, *(r[c] for c in cols)) for r in got.collect()]
    for n, m in enumerate(periods):
        want = sorted(tuple(r[c] for c in cols) for r in deals.price_deals(i.history, i.catalog, AS_OF, m, 10.0).collect())
        assert sorted(r[1:] for r in rows if r[0] == n) == want, m
    assert deals.deals_for_requests(i.history, i.catalog, req.limit(0), AS_OF).collect() == []


def test_an_answer_without_deals_is_sent(spark):
    i = StoreInputs(spark, SF_SMALL)
    none = deals.price_deals(i.history, i.catalog, AS_OF, 12, 100.0)
    messages = deals.deal_messages(none, 12, 100.0, AS_OF)
    assert [json.loads(r.message)["deals"] for r in messages.collect()] == [[]]
    assert [r.line for r in deals.answer_lines(messages).collect()] == ["No deals found."]


def test_coupon_messages(spark):
    m = spark.createDataFrame([('{"user_id": "7", "store_id": "s"}',), ("junk",), (None,)], "value string")
    assert [r.line for r in bonus.coupon_lines(m).collect()] == ["========= USER 7 OF STORE s GOT A COUPON ========="]


def test_task_messages_round_trip(spark):
    df = spark.createDataFrame([('a"[x]', 3), ("All", 4)], "store_id string, products_sold_without_stock long")
    body = store_payloads(df, "without_stock", ["products_sold_without_stock"], [F.col("store_id")])
    message = task_messages(body)
    read = json.loads(message.collect()[0].message)
    assert read == {"task_name": "without_stock", 'a"[x]': {"0": {"products_sold_without_stock": 3}},
                    "All": {"0": {"products_sold_without_stock": 4}}}
    assert decode_task_messages(message).count() == 2


def test_empty_sections(spark):
    r = spark.createDataFrame([("s", "t1", 0, "x")], "store_id string, task string, line_no int, line string")
    got = {(x.store_id, x.task): x.line for x in reports.with_empty_sections(r, ["t1", "t2"]).collect()}
    assert got == {("s", "t1"): "x", ("s", "t2"): "No data available."}


def test_the_pass_reads_events_twice(spark):
    i = StoreInputs(spark, SF_SMALL)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    tagged = store_pass.tagged_events(i.events)
    n = tagged.count()
    counted = tagged.mapInArrow(count, tagged.schema)
    rows = store_pass.payloads(store_pass.task_results(counted, i.products, i.stock)).collect()
    assert rows and seen.value <= 2 * n


def test_the_pass_equals_the_metrics_over_all_events(spark):
    from storepulse.operators import latest
    i = StoreInputs(spark, SF_SMALL)
    got = store_pass.task_results(store_pass.tagged_events(i.events), i.products, i.stock)
    want = {"purchases_per_minute": metrics.purchases_per_minute(i.buys), "revenue_per_minute": metrics.revenue_per_minute(i.views, i.products),
            "ranking_viewed_products_per_hour": metrics.view_ranking_per_hour(i.views, i.products)}
    for name, whole in want.items():
        w = latest.last_window(whole)
        assert got[name].exceptAll(w).count() == 0 and w.exceptAll(got[name]).count() == 0, name


def test_revenue_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "logs")
    i = StoreInputs(spark, SF_SMALL)
    logs.write_logs(logs.render_log_rows(i.events).repartitionByRange(6, "timestamp"), src)
    stream = jobs.revenue_per_minute(logs.stream_logs(spark, src, max_files_per_trigger=100), i.products, watermark="5 minutes")
    q = (stream.writeStream.format("memory").queryName("revenue_stream").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("revenue_stream")
    closed = got.agg(F.max("window_end")).collect()[0][0]
    batch = metrics.revenue_per_minute(split_log(logs.read_logs(spark, src))["view"], i.products)
    exp = batch.filter(F.col("window_end") <= F.lit(closed))
    cols = ["window_start", "store_id", "amount_earned"]
    assert got.count() == exp.count() > 0 and exp.select(*cols).exceptAll(got.select(*cols)).count() == 0


def test_state_table_writes_only_updated_buckets(spark, tmp_path):
    src, table = tmp_path / "logs", str(tmp_path / "state")
    src.mkdir()
    head = "timestamp;store_id;type;content;extra_1;extra_2\n"
    for k in range(4):
        (src / f"{k}.txt").write_text(head + f"{k};s;User;u;ZOOM;VIEW_PRODUCT p.\n" + f"{k};s;Audit;u;BUY;p\n")
    jobs.views_per_buy_state(logs.stream_logs(spark, str(src), max_files_per_trigger=1), table,
                             str(tmp_path / "ck")).awaitTermination(300)
    files = sorted(p.relative_to(table) for p in pathlib.Path(table).rglob("*.parquet"))
    assert len(files) == 1  # one key, one bucket
    assert len(list(pathlib.Path(f"{table}.batches").glob("batch=*"))) == 1  # of the staged batches the last
    assert {(r.store_id, r.views, r["count"]) for r in jobs.views_before_buy_from_state(spark, table).collect()} == {
        ("s", 4, 4), ("All", 4, 4)}
