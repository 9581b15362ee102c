"""Tables kept across passes: only the partitions met are rewritten, and repeating a batch changes nothing."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storepulse.operators import metrics, upkeep, viewers
from storepulse.plans.metric_table import MetricTable
from storepulse.sinks import merge
from tests.conftest import SF_SMALL

EVENT = "kind string, store_id string, product_id string, user_id string, datetime timestamp_ntz"


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


def events(spark, *rows):
    return spark.createDataFrame([(k, s, p, "u", t) for k, s, p, t in rows], EVENT)


def files_of(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def parts_of(path):
    return {os.path.dirname(f) for f in files_of(path)}


def purchases(table):
    return {(r.window_start, r.store_id): r["count"] for r in table.purchases().collect()}


def whole(spark, rows):
    got = metrics.purchases_per_minute(events(spark, *rows).where("kind = 'buy'"))
    return {(r.window_start, r.store_id): r["count"] for r in got.collect()}


def test_a_pass_rewrites_only_its_days(spark, tmp_path):
    table = MetricTable(spark, str(tmp_path / "t"))
    first = [("buy", "a", "1", at(d, 1)) for d in range(1, 6)] + [("view", None, None, at(2)), ("buy", None, "1", at(2))]
    second = [("buy", "a", "1", at(3, 1)), ("buy", "b", "1", at(7)), ("buy", "b", "1", None)]
    table.add(0, events(spark, *first))
    before = files_of(table.path)
    table.add(1, events(spark, *second))
    after = files_of(table.path)
    changed = {os.path.dirname(f) for f in before ^ after}
    assert changed == {"day=2024-01-03", "day=2024-01-07"}
    assert purchases(table) == whole(spark, first + [r for r in second if r[3]])
    # the same pass again, and an older one, change no file
    table.add(1, events(spark, *second))
    table.add(0, events(spark, *first))
    assert files_of(table.path) == after


def test_empty_passes(spark, tmp_path):
    table = MetricTable(spark, str(tmp_path / "t"))
    table.add(0, events(spark))
    assert purchases(table) == {}
    table.add(1, events(spark, ("buy", "a", "1", at(1))))
    table.add(2, events(spark))
    assert purchases(table) == whole(spark, [("buy", "a", "1", at(1))])


@pytest.mark.parametrize("lost", [False, True])
def test_a_pass_that_failed_is_taken_up(spark, tmp_path, monkeypatch, lost):
    """The table's write fails after the staged one (``lost``: a partition is gone by then)."""
    table = MetricTable(spark, str(tmp_path / "t"))
    rows = [("buy", "a", "1", at(1)), ("buy", "a", "1", at(2))]
    table.add(0, events(spark, *rows))

    def fail(*args):
        raise OSError("lost")

    monkeypatch.setattr(merge, "_staged", fail)
    with pytest.raises(OSError):
        table.add(1, events(spark, *rows))
    monkeypatch.undo()
    if lost:
        for f in files_of(table.path):
            if "day=2024-01-01" in f:
                os.remove(os.path.join(table.path, f))
    # what arrives meanwhile under the same number must not count: the staged rows are the batch
    table.add(1, events(spark, *rows))
    assert purchases(table) == whole(spark, rows + rows)


def test_late_rows_wait_and_are_corrected(spark, tmp_path):
    table = MetricTable(spark, str(tmp_path / "t"))
    first = [("buy", "a", "1", at(2, 12)), ("buy", "a", "1", at(2, 12, 30))]
    late = [("buy", "a", "1", at(2, 12)), ("buy", "b", "1", at(1, 5)), ("view", "b", "1", at(1, 5)), ("buy", "b", "1", at(1, 5, 0, 9))]
    near = [("buy", "a", "1", at(2, 12, 25)), ("buy", "a", "1", at(2, 13))]
    table.add_on_time(0, events(spark, *first), "10 minutes")
    table.add_on_time(2, events(spark, *late, *near), "10 minutes")
    assert purchases(table) == whole(spark, first + near)
    assert table.late(3).agg(F.sum("n")).first()[0] == len(late)
    before = files_of(table.path)
    assert table.correct(3) == 3  # two windows of purchases, one of views
    assert purchases(table) == whole(spark, first + near + late)
    assert {os.path.dirname(f) for f in before ^ files_of(table.path)} == {"day=2024-01-01", "day=2024-01-02"}
    # repeated and later corrections without new late rows
    assert table.correct(3) == 3 and table.correct(5) == 0
    table.add_on_time(2, events(spark, *late, *near), "10 minutes")
    assert purchases(table) == whole(spark, first + near + late)
    assert {str(r.minute) for r in table.corrected().where("kind = 'buy'").collect()} == {"2024-01-02 12:00:00", "2024-01-01 05:00:00"}


def test_stock_batches(spark, tmp_path):
    path = str(tmp_path / "stock")
    stock = spark.createDataFrame([(str(p), "s", 10) for p in range(60)], "product_id string, store_id string, quantity long")
    upkeep.create_stock(stock, path, 16)
    sold = spark.createDataFrame([("3", "s")] * 4 + [("7", "s"), ("999", "s"), (None, "s")], "product_id string, store_id string")
    before = files_of(path)
    changes = upkeep.sell(spark, path, 0, sold, 16)
    want = {("3", 10, 6), ("7", 10, 9)}
    assert {(r.product_id, r.before, r.after) for r in changes.collect()} == want
    after = files_of(path)
    assert {os.path.dirname(f) for f in before ^ after} <= parts_of(path)
    assert len({os.path.dirname(f) for f in before - after}) <= 4  # the buckets of four keys
    stored = {r.product_id: r.quantity for r in upkeep.read_stock(spark, path).collect()}
    assert stored == {str(p): {3: 6, 7: 9}.get(p, 10) for p in range(60)}
    # the batch again: the same changes are returned, no file is touched
    assert {(r.product_id, r.before, r.after) for r in upkeep.sell(spark, path, 0, sold, 16).collect()} == want
    assert files_of(path) == after
    upkeep.sell(spark, path, 1, sold.where("product_id = '3'"), 16)
    assert upkeep.sell(spark, path, 0, sold, 16).collect() == []
    assert {r.product_id: r.quantity for r in upkeep.read_stock(spark, path).collect()}["3"] == 2


def test_price_batches(spark, tmp_path):
    path = str(tmp_path / "products")
    rows = [(i, str(i), "s", f"p{i}", Decimal("5.00")) for i in range(40)]
    upkeep.create_products(spark.createDataFrame(rows, "id_product long, id string, store_id string, name string, price decimal(10,2)"), path, 8)
    moves = spark.createDataFrame([(1, 250), (2, -900), (3, 0), (77, 5)], "id_product long, cents long")
    before = files_of(path)
    got = {(r.product_id, str(r.price), r.recorded_at) for r in upkeep.move_prices(spark, path, 4, moves, at(9), 8).collect()}
    assert got == {("1", "7.50", at(9)), ("2", "1.00", at(9))}
    after = files_of(path)
    prices = {r.id_product: str(r.price) for r in upkeep.read_products(spark, path).collect()}
    assert prices == {i: {1: "7.50", 2: "1.00"}.get(i, "5.00") for i in range(40)}
    upkeep.move_prices(spark, path, 4, moves, at(9), 8)
    assert files_of(path) == after and before != after


def test_bitmaps_count_each_viewer_once(spark):
    from storepulse.plans.inputs import StoreInputs
    rows = [("a", str(p % 3), None if u == 7 else f"u{u}", at(1 + d)) for d in range(2) for p in range(3) for u in range(50)]
    views = spark.createDataFrame(rows + rows[:40], "store_id string, product_id string, user_id string, datetime timestamp_ntz")
    products = spark.createDataFrame([("0", "a", "x"), ("1", "a", "x")], "id string, store_id string, name string")
    half = F.col("user_id") < "u3"
    a, b = views.where(half), views.where(~F.coalesce(half, F.lit(False)) | (F.col("user_id") > "u2"))
    numbers = viewers.number_users(b, viewers.number_users(a))
    assert sorted(r.number for r in numbers.collect()) == list(range(1, 51))
    states = [viewers.viewer_bitmaps(p, products, numbers, "1 day") for p in (a, b)]
    # OR is idempotent: a part merged twice counts once
    got = viewers.unique_users_from_bitmaps(viewers.merge_bitmaps(*states, states[0]))
    want = metrics.unique_users_per_minute(views, products, "1 day")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    i = StoreInputs(spark, SF_SMALL)
    state = viewers.viewer_bitmaps(i.views, i.products, viewers.number_users(i.views), "1 day")
    assert state.agg(F.sum(F.bitmap_count("bits"))).first()[0] == metrics.viewer_sets(i.views, i.products, "1 day").count()
