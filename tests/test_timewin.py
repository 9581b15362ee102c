"""tumble_start agrees with Spark's own window() bounds."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storepulse.functions.timewin import tumble_start

TS = st.datetimes(min_value=dt.datetime(1995, 1, 1), max_value=dt.datetime(2030, 12, 31))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TS, min_size=1, max_size=50), st.sampled_from(["1 minute", "10 minutes", "1 hour", "6 hours", "1 day"]))
def test_tumble_start_matches_window(spark, stamps, duration):
    for flavour in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame([(t,) for t in stamps], "t timestamp_ntz").select(F.col("t").cast(flavour).alias("t"))
        out = df.select(tumble_start(df, "t", duration).alias("mine"), F.window("t", duration).start.alias("spark"))
        assert out.filter(~F.col("mine").eqNullSafe(F.col("spark"))).count() == 0
