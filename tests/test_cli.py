"""The command line runs the services end to end."""

from conftest import SF_SMALL

from storepulse.__main__ import main


def test_cli_services(spark, tmp_path):
    base = ["--master", "local[4]"]
    main(base + ["metrics", "--tables", SF_SMALL, "--out", str(tmp_path / "m")])
    assert spark.read.json(str(tmp_path / "m")).select("task_name").distinct().count() == 6
    main(base + ["prices", "--tables", SF_SMALL, "--n", "50", "--seed", "1", "--as-of", "2024-02-01T00:00:00",
                 "--out", str(tmp_path / "p")])
    hist = spark.read.parquet(str(tmp_path / "p" / "price_history"))
    assert hist.count() > 0
    main(base + ["report", "--tables", SF_SMALL, "--out", str(tmp_path / "r")])
    assert spark.read.json(str(tmp_path / "r")).count() > 0
    src = tmp_path / "lines"
    src.mkdir()
    (src / "a.txt").write_text("x\ny\n")
    main(base + ["ingest", "--source", str(src), "--table", str(tmp_path / "ev"),
                 "--checkpoint", str(tmp_path / "ck")])
    assert spark.read.parquet(str(tmp_path / "ev")).count() == 2


def test_cli_bonus_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from storepulse.plans.inputs import StoreInputs
    from storepulse.sources import logs
    src = str(tmp_path / "msgs")
    logs.render_messages(StoreInputs(spark, SF_SMALL).events) \
        .select(F.regexp_replace("message", "\n$", "").alias("value")).write.text(src)
    main(["--master", "local[4]", "bonus", "--stream", "--source", src, "--checkpoint", str(tmp_path / "ck"),
          "--out", str(tmp_path / "out"), "--min-short", "10", "--min-long", "20"])
    assert spark.read.json(str(tmp_path / "out")).count() > 0


def test_cli_metrics_from_explicit_tables_and_logs(spark, tmp_path):
    """The same data given as log files and operational tables gives the same messages."""
    from storepulse.plans.inputs import StoreInputs
    from storepulse.sources import logs
    i = StoreInputs(spark, SF_SMALL)
    logs.write_logs(logs.render_log_rows(i.events), str(tmp_path / "logs"))
    i.products_all_versions.write.parquet(str(tmp_path / "products"))
    i.stock.write.parquet(str(tmp_path / "stock"))
    base = ["--master", "local[4]", "metrics"]
    main(base + ["--tables", SF_SMALL, "--out", str(tmp_path / "a")])
    main(base + ["--logs", str(tmp_path / "logs"), "--products", str(tmp_path / "products"),
                 "--stock", str(tmp_path / "stock"), "--out", str(tmp_path / "b")])
    a = spark.read.json(str(tmp_path / "a")).select("task_name", "store_id", "payload")
    b = spark.read.json(str(tmp_path / "b")).select("task_name", "store_id", "payload")
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_cli_deals_from_explicit_tables(spark, tmp_path):
    from storepulse.operators import deals
    from storepulse.operators.prices import current_products
    from storepulse.plans.inputs import StoreInputs
    i = StoreInputs(spark, SF_SMALL)
    i.products_all_versions.write.parquet(str(tmp_path / "products"))
    i.history.write.parquet(str(tmp_path / "history"))
    main(["--master", "local[4]", "deals", "--products", str(tmp_path / "products"), "--history",
          str(tmp_path / "history"), "--request", '{"time_window": 48, "discount_percentage": 5}',
          "--as-of", "2001-11-04T00:00:00", "--out", str(tmp_path / "d")])
    got = spark.read.parquet(str(tmp_path / "d")).select("product_id", "store_id")
    import datetime as dt
    cat = current_products(i.products_all_versions).select("id", "store_id", "name", "price")
    want = deals.price_deals(i.history, cat, dt.datetime(2001, 11, 4), 48, 5.0).select("product_id", "store_id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
