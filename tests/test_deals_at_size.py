"""Deal searches keep the catalogue out of the driver and a period out of one task."""

import datetime as dt
import re

from pyspark.sql import functions as F

AS_OF = dt.datetime(2001, 11, 4)


def rows(spark):
    """Forty products in three stores, one of them null; prices of several months."""
    prices = [(str(p), f"store_{s}" if s else None, 100.0 + p, AS_OF - dt.timedelta(days=20 * k))
              for p in range(40) for s in range(3) for k in range(1 + p % 5)]
    history = (spark.createDataFrame(prices, "product_id string, store_id string, price double, recorded_at timestamp_ntz")
               .withColumn("price", F.col("price").cast("decimal(10,2)")))
    catalog = spark.createDataFrame([(str(p), f"store_{s}" if s else None, f"name {p}", 50.0 + 2 * p)
                                     for p in range(45) for s in range(3)], "id string, store_id string, name string, price double")
    return history, catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_small_looking_catalogue_is_not_broadcast(spark):
    from storepulse.operators import deals
    history, catalog = rows(spark)
    d = deals.price_deals(history, catalog, AS_OF, 12, 10.0)
    low = [p for p in range(40) if 50 + 2 * p < 0.9 * (100 + p)]
    assert sorted((r.product_id, r.store_id) for r in d.collect()) == sorted((str(p), f"store_{s}") for p in low for s in (1, 2))
    for df in (d, deals.rank_deals(d), deals.deal_report(d, 12, 10.0, AS_OF)):
        df.collect()
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_a_requested_period_is_dealt_in_parts(spark):
    from storepulse.operators import deals
    history, catalog = rows(spark)
    req = spark.createDataFrame([(1, 12, 10.0), (2, 1, 5.5), (3, 12, 30.0), (4, 12, 10.0)], "request_id int, months int, discount double")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", was)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        got = deals.deals_for_requests(history, catalog, req, AS_OF)
        found = got.collect()
        text = plan(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", adaptive)
    # the products meet the requests by the period and a part of it
    assert re.search(r"SortMergeJoin \[months#\d+, part#\d+\]", text) and not re.search(r"SortMergeJoin \[months#\d+\]", text)
    for r in req.collect():
        want = deals.price_deals(history, catalog, AS_OF, r.months, r.discount).collect()
        assert sorted((x.product_id, x.store_id, x.price, x.average_price) for x in found if x.request_id == r.request_id) == \
            sorted((x.product_id, x.store_id, x.price, x.average_price) for x in want)
    assert {r.request_id for r in found} == {1, 2, 3, 4}
