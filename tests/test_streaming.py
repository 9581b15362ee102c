"""Batch = stream, late data, restart."""

import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from storepulse.operators import bonus as bonus_ops
from storepulse.operators import metrics
from storepulse.operators.events import split_log
from storepulse.plans.inputs import StoreInputs
from storepulse.sources import logs
from storepulse.streaming import jobs


def _write_log_files(spark, root):
    """Log files per day of the month, like the simulator's cycle files."""
    ev = StoreInputs(spark, SF_SMALL).events
    rows = logs.render_log_rows(ev).withColumn("day", F.substring(F.col("timestamp"), 1, 5))
    rows.write.partitionBy("day").option("sep", ";").option("header", True).csv(root)
    return ev


def _run_available_now(df, name, ckpt, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
           .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(300)
    return q


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    src = str(tmp_path / "logs")
    _write_log_files(spark, src)
    stream = jobs.purchases_per_minute(logs.stream_logs(spark, src, max_files_per_trigger=3), watermark="5 minutes")
    q = _run_available_now(stream, "ppm_stream", str(tmp_path / "ck"))
    got = spark.table("ppm_stream")
    batch = metrics.purchases_per_minute(split_log(logs.read_logs(spark, src))["buy"])
    # append mode withholds windows the final watermark has not closed
    closed_until = got.agg(F.max("window_end")).collect()[0][0]
    assert got.count() > 0
    expect = batch.filter(F.col("window_end") <= F.lit(closed_until))
    assert got.count() == expect.count()
    assert expect.select("window_start", "store_id", "count").exceptAll(
        got.select("window_start", "store_id", "count")).count() == 0
    q.stop()


def test_restart_reads_nothing_twice(spark, tmp_path):
    src = str(tmp_path / "logs")
    _write_log_files(spark, src)
    ck, out = str(tmp_path / "ck"), str(tmp_path / "out")

    def run():
        q = (logs.stream_logs(spark, src).writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination(300)
        return spark.read.parquet(out).count()
    n1 = run()
    assert n1 == StoreInputs(spark, SF_SMALL).events.count()
    assert run() == n1


def test_late_event_is_dropped_and_counted(spark, tmp_path):
    src = tmp_path / "late"
    src.mkdir()
    head = "timestamp;store_id;type;content;extra_1;extra_2\n"
    ns = lambda t: str(int(t.replace(tzinfo=dt.timezone.utc).timestamp()) * 10**9)
    base = dt.datetime(2024, 1, 1, 12, 0)
    (src / "a.txt").write_text(head + f"{ns(base)};s;Audit;u;BUY;p\n" + f"{ns(base + dt.timedelta(hours=2))};s;Audit;u;BUY;p\n")
    stream = jobs.purchases_per_minute(logs.stream_logs(spark, str(src), max_files_per_trigger=1), watermark="10 minutes")
    q = (stream.writeStream.format("memory").queryName("late_out").outputMode("append")
               .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    (src / "b.txt").write_text(head + f"{ns(base + dt.timedelta(minutes=1))};s;Audit;u;BUY;p\n")
    q.processAllAvailable()
    dropped = sum(op.get("numRowsDroppedByWatermark", 0)
                  for p in q.recentProgress for op in p.get("stateOperators", []))
    q.stop()
    assert dropped >= 1


def test_bonus_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "msgs")
    ev = StoreInputs(spark, SF_SMALL).events
    logs.render_messages(ev).select(F.regexp_replace("message", "\n$", "").alias("value")) \
        .write.text(src)
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 2).load(src)
    stream = jobs.bonus_contained(jobs.purchases_from_lines(lines), watermark="10 minutes", min_short=50, min_long=100)
    q = _run_available_now(stream, "bonus_stream", str(tmp_path / "ck"))
    got = spark.table("bonus_stream")
    batch = bonus_ops.bonus_contained(StoreInputs(spark, SF_SMALL).purchases, 50, 100)
    closed = got.agg(F.max("window_end")).collect()[0][0]
    if closed is None:
        assert batch.count() <= 1
    else:
        exp = batch.filter(F.col("window_end").cast("timestamp") <= F.lit(closed))
        cols = ["user_id", "store_id", "total_6h", "windows_10m"]
        assert exp.select(*cols).exceptAll(got.select(*cols)).count() == 0
        assert got.count() == exp.count()
    q.stop()


def test_ingest_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("a;1\nb;2\n")
    (src / "2.txt").write_text("c;3\n")
    table, batches, ck = str(tmp_path / "events"), str(tmp_path / "batches"), str(tmp_path / "ck")
    jobs.ingest_lines(spark, str(src), table, ck, batch_path=batches, max_files_per_trigger=1).awaitTermination(120)
    first = spark.read.parquet(table)
    assert first.count() == 3 and first.select("id").distinct().count() == 3
    jobs.ingest_lines(spark, str(src), table, ck, batch_path=batches).awaitTermination(120)
    assert spark.read.parquet(table).count() == 3
    assert spark.read.parquet(batches).count() >= 2
    assert os.path.isdir(table)


def test_view_ranking_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "logs")
    _write_log_files(spark, src)
    i = StoreInputs(spark, SF_SMALL)
    stream = jobs.view_ranking_per_hour(logs.stream_logs(spark, src, max_files_per_trigger=4), i.products,
                                        watermark="1 hour")
    q = _run_available_now(stream, "vr_stream", str(tmp_path / "ck"))
    got = spark.table("vr_stream")
    batch = metrics.view_ranking_per_hour(split_log(logs.read_logs(spark, src))["view"], i.products)
    closed = got.agg(F.max("window_end")).collect()[0][0]
    assert got.count() > 0
    exp = batch.filter(F.col("window_end") <= F.lit(closed))
    cols = ["window_start", "name", "store_id", "views"]
    assert exp.select(*cols).exceptAll(got.select(*cols)).count() == 0
    assert got.count() == exp.count()
    q.stop()


def test_published_stream_ends_on_the_batch_payload(spark, tmp_path):
    from storepulse.operators import latest
    from storepulse.operators.payload import TASK_DETAILS, store_payloads
    from storepulse.plans.store_pass import task_order
    src = str(tmp_path / "logs")
    _write_log_files(spark, src)
    out = str(tmp_path / "published")
    stream = jobs.purchases_per_minute(logs.stream_logs(spark, src, max_files_per_trigger=3), watermark="5 minutes")
    jobs.publish_task(stream, "purchases_per_minute", out, str(tmp_path / "ck")).awaitTermination(300)
    pub = spark.read.json(out)
    newest = pub.groupBy("store_id").agg(F.max_by("payload", "batch_id").alias("payload"))
    # the batch result restricted to the windows the stream has closed
    batch = metrics.purchases_per_minute(split_log(logs.read_logs(spark, src))["buy"])
    closed = pub.select(F.get_json_object("payload", "$.0.window_end").alias("e")).agg(F.max("e")).collect()[0][0]
    expect = store_payloads(latest.last_window(batch.filter(F.col("window_end").cast("string") <= closed)),
                            "purchases_per_minute", TASK_DETAILS["purchases_per_minute"],
                            task_order("purchases_per_minute")).select("store_id", "payload")
    assert newest.exceptAll(expect).count() == 0 and expect.exceptAll(newest).count() == 0


def test_unique_users_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "logs")
    _write_log_files(spark, src)
    i = StoreInputs(spark, SF_SMALL)
    stream = jobs.unique_users_per_minute(logs.stream_logs(spark, src, max_files_per_trigger=4), i.products,
                                          watermark="5 minutes")
    q = _run_available_now(stream, "uu_stream", str(tmp_path / "ck"))
    got = spark.table("uu_stream")
    batch = metrics.unique_users_per_minute(split_log(logs.read_logs(spark, src))["view"], i.products)
    closed = got.agg(F.max("window_end")).collect()[0][0]
    assert got.count() > 0
    exp = batch.filter(F.col("window_end") <= F.lit(closed))
    cols = ["window_start", "name", "store_id", "unique_users"]
    assert exp.select(*cols).exceptAll(got.select(*cols)).count() == 0
    assert got.count() == exp.count()
    q.stop()


def test_bonus_stream_values_to_files(spark, tmp_path):
    import json

    from storepulse.sinks.writers import stream_values_to_files
    src = str(tmp_path / "msgs")
    ev = StoreInputs(spark, SF_SMALL).events
    logs.render_messages(ev).select(F.regexp_replace("message", "\n$", "").alias("value")).write.text(src)
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 2).load(src)
    eligible = jobs.bonus_contained(jobs.purchases_from_lines(lines), min_short=10, min_long=20) \
        .select("user_id", "store_id")
    q = stream_values_to_files(eligible, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(300)
    values = [json.loads(r.value) for r in spark.read.json(str(tmp_path / "out")).collect()]
    assert len(values) > 0
    assert all(set(v) == {"user_id", "store_id"} for v in values)


def test_all_time_views_before_buy_from_stream_state(spark, tmp_path):
    src = str(tmp_path / "logs")
    _write_log_files(spark, src)
    table = str(tmp_path / "state")
    jobs.views_per_buy_state(logs.stream_logs(spark, src, max_files_per_trigger=5), table,
                             str(tmp_path / "ck")).awaitTermination(300)
    got = jobs.views_before_buy_from_state(spark, table)
    parts = split_log(logs.read_logs(spark, src))
    want = metrics.views_before_buy(parts["view"], parts["buy"])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
