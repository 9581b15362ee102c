"""Properties over the whole small tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL

from __spark_entry__ import queries

Q = queries()


def test_all_rows_are_sums_over_stores(spark):
    df = Q["purchases_per_minute"](spark, SF_SMALL)
    stores = df.filter(F.col("store_id") != "All").groupBy("window_start").agg(F.sum("count").alias("s"))
    alls = df.filter(F.col("store_id") == "All").select("window_start", F.col("count").alias("a"))
    j = stores.join(alls, "window_start", "full_outer")
    assert j.filter(F.col("s").isNull() | F.col("a").isNull() | (F.col("s") != F.col("a"))).count() == 0


def test_last_and_older_partition_the_input(spark):
    whole = Q["purchases_per_minute"](spark, SF_SMALL)
    last, older = Q["last_window"](spark, SF_SMALL), Q["older_windows"](spark, SF_SMALL)
    cols = whole.columns
    assert last.count() + older.count() == whole.count()
    assert last.select(*cols).unionByName(older.select(*cols)).exceptAll(whole).count() == 0


def test_merge_parts_share_windows_and_users(spark):
    """Both merge queries join parts that overlap in windows and users, and equal the undivided metric."""
    from storepulse.operators import metrics
    from storepulse.plans.inputs import StoreInputs
    from storepulse.plans.queries import MERGE_WINDOW, merge_parts
    i = StoreInputs(spark, SF_SMALL)
    a, b = (metrics.purchases_per_minute(x, MERGE_WINDOW) for x in merge_parts(i.buys))
    assert a.join(b, ["window_start", "store_id"]).count() > 0
    a, b = (metrics.viewer_sets(x, i.products, MERGE_WINDOW) for x in merge_parts(i.views))
    shared = a.join(b, ["window", "name", "store_id", "user_id"], "left_semi").count()
    same_window = a.join(b, ["window", "name", "store_id"], "left_semi").count()
    assert same_window > 0
    for name, whole in (("merge_partials", metrics.purchases_per_minute(i.buys, MERGE_WINDOW)),
                        ("merge_unique_users", metrics.unique_users_per_minute(i.views, i.products, MERGE_WINDOW))):
        got = Q[name](spark, SF_SMALL)
        assert got.exceptAll(whole.select(*got.columns)).count() == 0 and whole.count() == got.count()
    from conftest import SF_MID
    i = StoreInputs(spark, SF_MID)
    a, b = (metrics.viewer_sets(x, i.products, MERGE_WINDOW) for x in merge_parts(i.views))
    assert shared + a.join(b, ["window", "name", "store_id", "user_id"], "left_semi").count() > 0


def test_stock_before_minus_sales_is_after(spark):
    before = Q["stock_after_sales"](spark, SF_SMALL).agg(F.sum("quantity")).collect()[0][0]
    from storepulse.plans.inputs import StoreInputs
    i = StoreInputs(spark, SF_SMALL)
    base = i.stock.agg(F.sum("quantity")).collect()[0][0]
    sold = i.buys.join(i.stock.select("product_id", "store_id"), ["product_id", "store_id"], "left_semi").count()
    assert before == base - sold


def test_histogram_counts_every_buy(spark):
    from storepulse.plans.inputs import StoreInputs
    buys = StoreInputs(spark, SF_SMALL).buys.count()
    for name in ("views_before_buy", "views_strictly_before_buy"):
        h = Q[name](spark, SF_SMALL)
        assert h.filter(F.col("store_id") == "All").agg(F.sum("count")).collect()[0][0] == buys


def test_bonus_from_messages_equals_table_form(spark):
    a = Q["bonus_from_messages"](spark, SF_MID_OR_SMALL())
    b = Q["bonus_eligible"](spark, SF_MID_OR_SMALL())
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()


def SF_MID_OR_SMALL():
    from conftest import SF_MID
    return SF_MID


def test_latest_insight_equals_published_payload(spark):
    a = Q["latest_insight"](spark, SF_SMALL).select("store_id", "payload")
    b = Q["insight_payload"](spark, SF_SMALL).filter(F.col("task_name") == "purchases_per_minute") \
        .select("store_id", "payload")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_deal_messages_hold_consecutive_ranks(spark):
    import json
    from storepulse.operators import deals
    from storepulse.plans.inputs import AS_OF, StoreInputs
    i = StoreInputs(spark, SF_SMALL)
    d = deals.price_deals(i.history, i.catalog, AS_OF, 12, 10.0)
    msgs = sorted((json.loads(r.message) for r in deals.deal_messages(d, 12, 10.0, AS_OF, deals_per_message=7).collect()),
                  key=lambda m: m["part"])
    want = sorted(deals.rank_deals(d).collect(), key=lambda r: (-r.evaluated_discount, r.product_id, r.store_id))
    assert [(x["id"], x["store_id"]) for m in msgs for x in m["deals"]] == [(r.product_id, r.store_id) for r in want]
    assert all(len(m["deals"]) == 7 for m in msgs[:-1]) and {m["parts"] for m in msgs} == {len(msgs)}
    assert [m["first_rank"] for m in msgs] == [7 * k + 1 for k in range(len(msgs))]


def test_no_deal_message_grows_with_the_table(spark):
    sizes = [len(r.message) for r in Q["deal_messages"](spark, "/root/testdata/sf0.1").collect()]
    assert len(sizes) > 10 and max(sizes) < 256_000


def test_numbers_have_no_gaps(spark):
    from storepulse.operators.numbering import numbered
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"), "id")
    got = [tuple(r) for r in numbered(df, "n", [F.col("k").desc(), F.col("id")], start=10).orderBy("n").select("k", "id", "n").collect()]
    want = sorted(((k * 37 % 1000, k) for k in range(5000)), key=lambda r: (-r[0], r[1]))
    assert got == [(*r, n) for n, r in enumerate(want, 10)]
    assert sorted(r.n for r in numbered(df, "n").collect()) == list(range(1, 5001))
    assert numbered(df.limit(0), "n", [F.col("k")]).count() == 0


def test_sliding_bonus_equals_window_expansion(spark):
    """Brute force: every sliding window enumerated by window(ts, size, slide)."""
    from storepulse.operators import bonus
    from storepulse.plans.inputs import StoreInputs
    p = StoreInputs(spark, SF_SMALL).purchases

    def brute(size, slide, name):
        per_window = (p.groupBy(F.window("datetime", size, slide).alias("w"), "user_id", "store_id")
                       .agg(F.sum(F.col("price").cast("double").cast("decimal(20,6)")).alias("s")))
        return per_window.groupBy("user_id", "store_id").agg(F.max("s").cast("double").alias(name))
    want = (brute("10 minutes", "1 minute", "best_10m").join(brute("6 hours", "10 minutes", "best_6h"),
                                                             ["user_id", "store_id"])
            .filter((F.col("best_10m") > 20) & (F.col("best_6h") > 60)))
    got = bonus.bonus_sliding(p, 20, 60)
    cols = ["user_id", "store_id", "best_10m", "best_6h"]
    assert want.count() > 0
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0


def test_all_rows_sum_stores_for_revenue_and_ranking(spark):
    for name, keys, metric in (("revenue_per_minute", ["window_start"], "amount_earned"),
                               ("view_ranking_per_hour", ["window_start", "name"], "views")):
        df = Q[name](spark, SF_SMALL)
        stores = df.filter(F.col("store_id") != "All").groupBy(*keys).agg(F.sum(metric).alias("s"))
        alls = df.filter(F.col("store_id") == "All").select(*keys, F.col(metric).alias("a"))
        j = stores.join(alls, keys, "full_outer")
        assert j.filter(~F.col("s").eqNullSafe(F.col("a"))).count() == 0, name


