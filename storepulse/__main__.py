"""Command line: the reference's services as Spark jobs.

    python -m storepulse metrics --tables DIR [--logs DIR] --out PATH
    python -m storepulse bonus   --tables DIR --out PATH [--min-short X --min-long Y] [--contained]
    python -m storepulse bonus   --stream --source DIR --checkpoint DIR (--out PATH | --brokers B --topic T)
    python -m storepulse deals   --tables DIR --request JSON [--request JSON ...] --as-of TS --out PATH
    python -m storepulse prices  --tables DIR --n 1000 --seed S --as-of TS --out PATH
    python -m storepulse ingest  --source DIR --table PATH --checkpoint DIR [--batch-messages PATH]
    python -m storepulse report  --tables DIR --out PATH

``--tables`` is a directory of the driver's parquet tables (events, part,
lineitem) read through the fixture views; ``--products``, ``--stock`` and
``--history`` read operational tables with the reference's column names
instead, and ``metrics --logs`` reads store log files. ``--master`` defaults
to whatever spark-submit provides.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

if __package__ in (None, ""):  # run as a file, e.g. by spark-submit
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _session(args):
    from storepulse.session import build_session
    return build_session(args.master, app=f"storepulse-{args.command}",
                         shuffle_partitions=args.shuffle_partitions)


def _inputs(spark, args):
    """Fixture views of ``--tables``, replaced by the operational tables given
    explicitly (parquet with the reference's column names)."""
    from storepulse.operators.prices import current_products
    from storepulse.plans.inputs import StoreInputs
    i = StoreInputs(spark, args.tables or "")
    if getattr(args, "products", None):
        i.products_all_versions = spark.read.parquet(args.products).select("id_product", "id", "store_id", "name",
                                                                           "price")
        i.catalog = current_products(i.products_all_versions).select("id", "store_id", "name", "price")
    if getattr(args, "stock", None):
        i.stock = spark.read.parquet(args.stock).select("product_id", "store_id", "quantity")
    if getattr(args, "jdbc_url", None):
        from storepulse.sources.tables import load_jdbc
        i.products_all_versions = load_jdbc(spark, args.jdbc_url, "products", "id_product").select("id_product", "id", "store_id", "name", "price")
        i.catalog = current_products(i.products_all_versions).select("id", "store_id", "name", "price")
        i.history = load_jdbc(spark, args.jdbc_url, "price_history", "id").select("product_id", "store_id", "price", "recorded_at")
    if getattr(args, "history", None):
        i.history = spark.read.parquet(args.history).select("product_id", "store_id", "price", "recorded_at")
    return i


def cmd_metrics(spark, args):
    from storepulse.plans import store_pass as sp
    from storepulse.sources import logs
    i = _inputs(spark, args)
    tagged = sp.tagged_log_events(logs.read_logs(spark, args.logs)) if args.logs else sp.tagged_events(i.events)
    res = sp.task_results(tagged, i.products, i.stock)
    sp.payloads(res).write.mode("overwrite").partitionBy("task_name").json(args.out)


def cmd_bonus(spark, args):
    from storepulse.operators import bonus
    from storepulse.plans.inputs import StoreInputs
    from storepulse.sinks.writers import write_observed
    if args.stream:
        return _bonus_stream(spark, args)
    p = StoreInputs(spark, args.tables).purchases
    if args.contained:
        out = bonus.bonus_contained(p, args.min_short, args.min_long)
    else:
        out = bonus.bonus_messages(bonus.bonus_eligible(p, args.min_short, args.min_long)).select("value")
    n = write_observed(out, args.out)
    print(f"eligible rows: {n}")


def _bonus_stream(spark, args):
    """Message lines (text files) -> eligible users once per closed 6-hour
    window -> JSON values to a topic or to files."""
    from storepulse.sinks.writers import stream_values_to_files, stream_values_to_topic
    from storepulse.streaming import jobs
    if args.source:
        lines = spark.readStream.format("text").load(args.source)
    else:  # messages come from a topic
        from storepulse.sources.streams import topic_lines
        lines = topic_lines(spark, args.source_brokers, args.source_topic).select("value")
    eligible = jobs.bonus_contained(jobs.purchases_from_lines(lines), watermark=args.watermark,
                                    min_short=args.min_short, min_long=args.min_long).select("user_id", "store_id")
    if args.brokers and args.topic:
        q = stream_values_to_topic(eligible, args.brokers, args.topic, args.checkpoint)
    else:
        q = stream_values_to_files(eligible, args.out, args.checkpoint, available_now=not args.continuous)
    q.awaitTermination()


def cmd_deals(spark, args):
    from storepulse.operators import deals
    i = _inputs(spark, args)
    raw = spark.createDataFrame(list(enumerate(args.request)), "request_id INT, value STRING")
    req = deals.decode_requests(raw)
    as_of = dt.datetime.fromisoformat(args.as_of)
    deals.deals_for_requests(i.history, i.catalog, req, as_of).write.mode("overwrite").parquet(args.out)


def cmd_prices(spark, args):
    from storepulse.operators import prices
    as_of = dt.datetime.fromisoformat(args.as_of)
    old = _inputs(spark, args).products_all_versions
    table = os.path.join(args.out, "products")
    prices.price_update(old, args.n, args.seed).write.mode("overwrite").parquet(table)
    new = spark.read.parquet(table)  # computed once
    changes = prices.price_changes(old, new, as_of)
    snapshot = prices.price_snapshot(prices.current_products(new), as_of)
    changes.unionByName(snapshot).write.mode("append").parquet(os.path.join(args.out, "price_history"))


def cmd_ingest(spark, args):
    from storepulse.streaming.jobs import ingest_lines
    from storepulse.sources.streams import topic_lines
    source = topic_lines(spark, args.brokers, args.topic) if args.brokers else args.source
    q = ingest_lines(spark, source, args.table, args.checkpoint, batch_path=args.batch_messages,
                     available_now=not args.continuous)
    q.awaitTermination()


def cmd_report(spark, args):
    from storepulse.plans.queries import store_report
    store_report(spark, args.tables).write.mode("overwrite").json(args.out)


def main(argv=None):
    ap = argparse.ArgumentParser(prog="storepulse")
    ap.add_argument("--master", default=None)
    ap.add_argument("--shuffle-partitions", type=int, default=None)
    sub = ap.add_subparsers(dest="command", required=True)
    m = sub.add_parser("metrics")
    m.add_argument("--tables", help="driver tables (fixture views); optional with --logs/--products/--stock")
    m.add_argument("--logs")
    m.add_argument("--products")
    m.add_argument("--stock")
    m.add_argument("--out", required=True)
    b = sub.add_parser("bonus")
    b.add_argument("--tables")
    b.add_argument("--out")
    b.add_argument("--stream", action="store_true", help="read message lines from --source as a stream")
    b.add_argument("--source")
    b.add_argument("--source-brokers")
    b.add_argument("--source-topic")
    b.add_argument("--checkpoint")
    b.add_argument("--watermark", default="10 minutes")
    b.add_argument("--brokers")
    b.add_argument("--topic")
    b.add_argument("--continuous", action="store_true")
    b.add_argument("--min-short", type=float, default=500.0)
    b.add_argument("--min-long", type=float, default=2000.0)
    b.add_argument("--contained", action="store_true")
    d = sub.add_parser("deals")
    d.add_argument("--tables")
    d.add_argument("--products")
    d.add_argument("--history")
    d.add_argument("--jdbc-url", help="read products and price_history from this database")
    d.add_argument("--request", action="append", required=True)
    d.add_argument("--as-of", required=True)
    d.add_argument("--out", required=True)
    p = sub.add_parser("prices")
    p.add_argument("--tables")
    p.add_argument("--products")
    p.add_argument("--n", type=int, default=1000)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--as-of", required=True)
    p.add_argument("--out", required=True)
    g = sub.add_parser("ingest")
    g.add_argument("--source", help="folder of text files; or --brokers and --topic")
    g.add_argument("--brokers")
    g.add_argument("--topic")
    g.add_argument("--table", required=True)
    g.add_argument("--checkpoint", required=True)
    g.add_argument("--batch-messages")
    g.add_argument("--continuous", action="store_true")
    r = sub.add_parser("report")
    r.add_argument("--tables", required=True)
    r.add_argument("--out", required=True)
    args = ap.parse_args(argv)
    spark = _session(args)
    {"metrics": cmd_metrics, "bonus": cmd_bonus, "deals": cmd_deals, "prices": cmd_prices,
     "ingest": cmd_ingest, "report": cmd_report}[args.command](spark, args)


if __name__ == "__main__":
    main()
