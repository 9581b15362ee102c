"""Appends with the tables' own columns, topic records, partitioned reads, and keyed state that forgets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from storepulse.schemas import APPENDED_TABLES
from storepulse.sinks.appends import append_to, read_appended
from storepulse.sinks.writers import as_json_values
from storepulse.sources import logs, tables
from storepulse.sources.streams import decoded
from storepulse.streaming import forgetting as fg

ORDER = "user_id string, product_id string, quantity string, creation_date string, payment_date string, delivery_date string, store_id string"


def order(k, quantity="2", created="2024-01-01", store="s"):
    return (f"u{k}", "p", quantity, created, None, None, store)


def test_appended_rows_get_the_tables_keys(spark, tmp_path):
    path = str(tmp_path / "orders")
    first = spark.createDataFrame([order(k) for k in range(5)], ORDER).repartition(3)
    append_to("purchase_orders", first, path, 0)
    append_to("purchase_orders", spark.createDataFrame([order(9)], ORDER), path, 1)
    append_to("purchase_orders", spark.createDataFrame([order(9)], ORDER), path, 1)  # repeated: the same key
    got = read_appended(spark, "purchase_orders", path).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 5, 6] and {r.user_id for r in got if r.id == 6} == {"u9"}
    assert {r.quantity for r in got} == {2}


@pytest.mark.parametrize("rows,ddl", [
    ([order(1, quantity="many")], ORDER), ([order(1), order(2, store=None)], ORDER), ([order(1, store="s" * 43)], ORDER),
    ([("u", "p", "1", "2024-01-01")], "user_id string, product_id string, quantity string, creation_date string"),
    ([(*order(1), 3)], ORDER + ", id long")])
def test_a_batch_that_does_not_fit_is_refused_whole(spark, tmp_path, rows, ddl):
    path = str(tmp_path / "orders")
    with pytest.raises(ValueError):
        append_to("purchase_orders", spark.createDataFrame(rows, ddl), path, 0)
    append_to("purchase_orders", spark.createDataFrame([order(1)], ORDER), path, 1)
    assert [r.id for r in read_appended(spark, "purchase_orders", path).collect()] == [1]


def test_every_appended_table(spark, tmp_path):
    values = {"date": dt.date(2000, 1, 2), "int": 3, "decimal(10,2)": "4.50"}
    for table, (key, columns, _) in APPENDED_TABLES.items():
        row = {c.split()[0]: values.get(c.split(maxsplit=1)[1], "x") for c in columns}
        rows = spark.createDataFrame([row]).select(*reversed(list(row)))  # by name, not by place
        append_to(table, rows, str(tmp_path / table), 0)
        got = read_appended(spark, table, str(tmp_path / table)).first()
        assert got[key] == 1 and all(str(got[c]) == str(v) for c, v in row.items())


def test_topic_records(spark):
    ddl = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int"
    at = dt.datetime(2024, 1, 1)
    records = spark.createDataFrame([(None, bytearray(v) if v is not None else None, "t", 0, k, at, 0) for k, v in enumerate(
        ["1;s;User;ü;ZOOM;x".encode(), b"\xff\xfeA", b"", None])], ddl)
    got = {r.offset: r.value for r in decoded(records).collect()}
    assert got == {0: "1;s;User;ü;ZOOM;x", 1: "\ufffd\ufffdA", 2: ""}
    values = as_json_values(spark.createDataFrame([("7", None), ('a"b', "s")], "user_id string, store_id string"))
    assert values.dtypes == [("value", "string")]
    assert sorted(r.value for r in values.collect()) == ['{"user_id":"7"}', '{"user_id":"a\\"b","store_id":"s"}']


def test_ranges_of_a_partitioned_read():
    assert tables.read_ranges("id", 1, 10_000_000, 2_500_000, 1_000_000) == {
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "10000001", "numPartitions": "3"}
    assert tables.read_ranges("id", 5, 6, 2, 1)["numPartitions"] == "2"
    assert tables.read_ranges("id", 5, 5, 9, 1)["numPartitions"] == "1"
    assert tables.read_ranges("id", None, None, 0, 10) == {}
    assert tables.bounds_query("products", "id_product") == "SELECT MIN(id_product) AS lo, MAX(id_product) AS hi, COUNT(*) AS n FROM products"


def ns(day, minute=0):
    return str(int(dt.datetime(2024, 1, day, 0, minute, tzinfo=dt.timezone.utc).timestamp()) * 10**9)


def test_forgotten_counts(spark, tmp_path):
    src, table, ck = tmp_path / "logs", str(tmp_path / "t"), str(tmp_path / "ck")
    src.mkdir()

    def feed(name, *rows):
        (src / name).write_text("timestamp;store_id;type;content;extra_1;extra_2\n" + "".join(
            f"{t};s;User;{u};ZOOM;VIEW_PRODUCT p.\n" if kind == "v" else f"{t};s;Audit;{u};BUY;p\n" for t, u, kind in rows))
        stream = logs.stream_logs(spark, str(src), max_files_per_trigger=1)
        fg.keep_counts(fg.forgetting_counts(stream, "2 days"), table, ck, buckets=8).awaitTermination(300)
        return {r.user_id: (r.views, r.buys) for r in fg.kept(spark, fg.COUNTS, table).collect()}

    assert feed("0.txt", (ns(1), "a", "v"), (ns(1, 5), "a", "b"), (ns(1), "b", "v")) == {"a": (1, 1), "b": (1, 0)}
    assert feed("1.txt", (ns(2), "a", "v"), (ns(2), "c", "v"), (ns(2), "c", "v")) == {"a": (2, 1), "b": (1, 0), "c": (2, 0)}
    # b was last seen on the 1st; on the 4th it is gone, a and c (2nd) are not yet
    assert feed("2.txt", (ns(3, 30), "d", "v")) == {"a": (2, 1), "c": (2, 0), "d": (1, 0)}
    assert feed("3.txt", (ns(9), "b", "b")) == {"b": (0, 1)}  # all others are forgotten, b begins anew
    state = [p for p in (tmp_path / "ck" / "state").rglob("*") if p.is_file()]
    assert state


def test_forgotten_insights(spark, tmp_path):
    src, table, ck = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "ck")
    ddl = "store_id string, task_name string, payload string, ts timestamp"

    def feed(day, *rows):
        spark.createDataFrame([(s, "t", p, dt.datetime(2024, 1, d)) for s, p, d in rows], ddl).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(ddl).parquet(str(src))
        fg.keep_insights(fg.forgetting_insights(stream, "3 days"), table, ck, buckets=4).awaitTermination(300)
        return {r.store_id: r.payload for r in fg.kept(spark, fg.INSIGHTS, table).collect()}

    assert feed(1, ("x", "old", 1), ("x", "new", 2), ("y", "one", 1)) == {"x": "new", "y": "one"}
    assert feed(2, ("x", "late", 1), ("y", "two", 4)) == {"x": "new", "y": "two"}
    assert feed(3, ("y", "three", 6)) == {"y": "three"}
