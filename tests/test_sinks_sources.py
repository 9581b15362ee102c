"""Sinks, file bookkeeping, malformed input."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from storepulse.plans.inputs import StoreInputs
from storepulse.sinks import writers
from storepulse.sources import logs
from storepulse.streaming import jobs


def test_new_files_lists_only_unseen(spark, tmp_path):
    root = tmp_path / "logs"
    (root / "store_a").mkdir(parents=True)
    head = "timestamp;store_id;type;content;extra_1;extra_2\n"
    (root / "store_a" / "1log_simulation.txt").write_text(head + "1;a;Audit;u;LOGIN\n")
    seen = spark.createDataFrame(logs.files_in(spark, str(root)).collect(), "file_path string, length long, modified timestamp")
    (root / "store_a" / "2log_simulation.txt").write_text(head + "2;a;Audit;u;EXIT\n")
    new = [r.file_path for r in logs.new_files(spark, str(root), seen).collect()]
    assert len(new) == 1 and new[0].endswith("2log_simulation.txt")
    (root / "store_a" / "3log_simulation.txt").write_text(head)  # a file without rows is a file
    assert len(logs.new_files(spark, str(root), seen).collect()) == 2


def test_csv_round_trip_and_observed_count(spark, tmp_path):
    ev = StoreInputs(spark, SF_SMALL).events
    rows = logs.render_log_rows(ev)
    out = str(tmp_path / "csv")
    writers.save_csv(rows, out, overwrite=True)
    writers.save_csv(rows, out)  # append
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 2 * ev.count()
    n = writers.write_observed(rows.filter(F.col("type") == "Audit"), str(tmp_path / "obs"))
    assert n == rows.filter(F.col("type") == "Audit").count()


def test_malformed_messages_never_fail(spark):
    msgs = spark.createDataFrame(
        [("x;y",), ("1;s;User;u;CLICK;BUY",), ("1;s;User;u;CLICK;BUY-p",), ("1;s;User;u;CLICK;BUY-p-abc.",),
         ("",), (None,), ("1700000000000000000;s;User;u;CLICK;BUY-p-12.5.\n",)], "message string")
    from storepulse.operators.purchases import message_purchases
    from storepulse.sources.logs import parse_messages
    rows = message_purchases(parse_messages(msgs)).collect()
    prices = sorted((r.price for r in rows if r.price is not None))
    assert prices == [12.5]
    assert len(rows) == 4


def test_latest_insight_stream_update_mode(spark, tmp_path):
    src = tmp_path / "msgs"
    t = dt.datetime(2024, 1, 1)
    rows = [("s1", "purchases_per_minute", '{"0":1}', t), ("s1", "purchases_per_minute", '{"0":2}', t + dt.timedelta(minutes=1)),
            ("s2", "purchases_per_minute", '{"0":3}', t)]
    spark.createDataFrame(rows, "store_id string, task_name string, payload string, ts timestamp") \
        .write.json(str(src))
    stream = spark.readStream.schema("store_id string, task_name string, payload string, ts timestamp").json(str(src))
    q = (jobs.latest_insights(stream).writeStream.format("memory").queryName("latest_mem").outputMode("update")
             .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.store_id: r.payload for r in spark.table("latest_mem").collect()}
    assert got == {"s1": '{"0":2}', "s2": '{"0":3}'}


def test_store_pass_job_writes_messages(spark, tmp_path):
    from storepulse.plans import store_pass
    i = StoreInputs(spark, SF_SMALL)
    out = store_pass.run_pass(i.events, i.products, i.stock, str(tmp_path / "tasks"))
    written = spark.read.json(out)
    assert written.select("task_name").distinct().count() == 6


def test_reset_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3).withColumnRenamed("id", "x")
    writers.reset_table(df.unionAll(df), path)
    assert spark.read.parquet(path).count() == 6
    writers.reset_table(df, path)
    assert spark.read.parquet(path).count() == 3
