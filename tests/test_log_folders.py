"""Log folders: pruned scans, rejected lines, the file manifest; dense ids of the ingest stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from storepulse.operators.purchases import message_purchases
from storepulse.schemas import LOG_COLUMNS
from storepulse.sinks.appends import next_id
from storepulse.sources import logs
from storepulse.streaming import jobs

HEADER = ";".join(LOG_COLUMNS)


def write(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join([HEADER, *lines]) + "\n")


def test_filters_choose_the_folders(spark, tmp_path):
    rows = spark.createDataFrame([(str(d * 10**15), f"s{k}", "User", "u", "ZOOM", "x", f"c{d}") for d in range(4) for k in range(3)],
                                 ", ".join(f"{c} string" for c in [*LOG_COLUMNS, "day"]))
    path = logs.write_store_logs(rows, str(tmp_path / "l"), F.col("day"))
    got = logs.read_store_logs(spark, path).where("store = 's1' and cycle >= 'c2'")
    read = {r[0] for r in got.select(F.input_file_name()).distinct().collect()}
    assert {p.split("/l/")[1].rsplit("/", 1)[0] for p in read} == {"store=s1/cycle=c2", "store=s1/cycle=c3"}
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "(store" in scan.split("PartitionFilters:")[1][:200]
    assert sorted(r.timestamp for r in got.collect()) == [str(2 * 10**15), str(3 * 10**15)]


def test_every_line_is_accepted_or_rejected(spark, tmp_path):
    good = ["1;s;Audit;u;BUY;3", "2;Error;4", "3;s;User;u;ZOOM", "-5;s;Audit;u;LOGIN;"]
    bad = {"6;s": logs.REASONS[0], "7": logs.REASONS[0], "8;s;a;b;c;d;e": logs.REASONS[1], "x;s;Audit;u;BUY;3": logs.REASONS[2],
           ";s;Audit;u;BUY;3": logs.REASONS[2], "9 9;Error;1": logs.REASONS[2]}
    write(str(tmp_path / "a" / "one.csv"), *good[:2], *list(bad)[:3])
    write(str(tmp_path / "b" / "c" / "two.csv"), *good[2:], *list(bad)[3:])
    accepted, rejected = logs.read_checked_logs(spark, str(tmp_path))
    assert {r.line: r.reason for r in rejected.collect()} == bad
    assert {os.path.basename(r.file) for r in rejected.collect()} == {"one.csv", "two.csv"}
    assert accepted.count() == len(good) and rejected.count() == len(bad)  # also where no column is asked for
    want = logs.read_logs(spark, str(tmp_path)).where("timestamp in ('1', '2', '3', '-5')")
    assert accepted.exceptAll(want).count() == 0 and want.exceptAll(accepted).count() == 0


def test_manifest_sees_rewritten_files(spark, tmp_path):
    source, manifest = str(tmp_path / "src"), logs.FileManifest(spark, str(tmp_path / "m"))
    a, b = f"{source}/a.csv", f"{source}/d/b.csv"
    write(a, "1;s;User;u;ZOOM;1")
    write(b, "1;s;User;u;ZOOM;1")
    names = lambda n: {os.path.basename(r.file_path) for r in manifest.fresh(source, n).collect()}
    assert names(0) == {"a.csv", "b.csv"}
    assert names(1) == {"a.csv", "b.csv"}  # pass 0 failed: nothing is recorded
    manifest.record(manifest.fresh(source, 1), 1)
    assert names(2) == set()
    os.utime(a, (1_700_000_000, 1_700_000_000))  # same path and length, another time
    write(b, "1;s;User;u;ZOOM;1", "2;s;User;u;ZOOM;1")
    write(f"{source}/c.csv")
    assert names(2) == {"a.csv", "b.csv", "c.csv"}
    manifest.record(manifest.fresh(source, 2), 2)
    assert names(3) == set()
    assert names(2) == {"a.csv", "b.csv", "c.csv"}  # pass 2 again reads what it read


@pytest.fixture
def lines(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(5):
        (source / f"{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(10 * k + 1)))
    return str(source)


def test_ingest_ids_are_dense_and_the_same_after_a_replay(spark, tmp_path, lines):
    table, ck, messages = str(tmp_path / "t"), str(tmp_path / "ck"), str(tmp_path / "m")
    run = lambda: jobs.ingest_lines(spark, lines, table, ck, batch_path=messages, max_files_per_trigger=2,
                                    lines_per_message=7).awaitTermination(120)
    run()
    read = lambda: {r.id: r.message for r in spark.read.schema("id long, message string").parquet(table).collect()}
    got = read()
    assert dict(spark.read.parquet(table).dtypes)["id"] == "bigint"
    assert sorted(got) == list(range(1, 106)) and len(set(got.values())) == 105
    # the last batch fails after its rows were written and before its commit: it runs again
    last = max(int(n) for n in os.listdir(f"{ck}/commits") if n.isdigit())
    for name in (f"{ck}/commits/{last}", f"{ck}/commits/.{last}.crc"):
        if os.path.exists(name):
            os.remove(name)
    run()
    assert read() == got
    with open(f"{lines}/new.txt", "w") as f:
        f.write("late\n")
    run()
    assert read() == got | {106: "late"}
    listed = [m for r in spark.read.parquet(messages).collect() for m in json.loads(r.message)]
    assert sorted(listed) == sorted(read().values())
    assert all(len(json.loads(r.message)) <= 7 for r in spark.read.parquet(messages).collect())


def test_an_empty_micro_batch_keeps_the_mark(spark, tmp_path):
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "e.txt").write_text("")
    table = str(tmp_path / "t")
    jobs.ingest_lines(spark, str(empty), table, str(tmp_path / "ck")).awaitTermination(120)
    assert next_id(spark, table, 99) == 1


def test_messages_are_split_once(spark):
    rows = spark.createDataFrame([("1000;s;User;u;CLICK;BUY-3-4.5.\n",), ("1000;Error;2\r\n",), ("",), (None,), ("x;;;;;",),
                                  ("1;s;User;u;CLICK;BUY;more",)], "message string")
    got = [tuple(r)[:6] for r in logs.parse_messages(rows).collect()]
    assert got == [("1000", "s", "User", "u", "CLICK", "BUY-3-4.5."), ("1000", None, "error", None, None, "2"), (None,) * 6, (None,) * 6,
                   ("x",) + (None,) * 5, ("1", "s", "User", "u", "CLICK", "BUY")]
    plan = message_purchases(logs.parse_messages(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_csv" not in plan
