"""User-flow transitions estimated from events (FLOW-1, FLOW-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sequence import next_value

# The simulator's flow graph (source, target, probability).
REFERENCE_EDGES = [
    ("LOGIN", "HOME", 1.0),
    ("HOME", "VIEW_PRODUCT", 0.9),
    ("HOME", "EXIT", 0.1),
    ("VIEW_PRODUCT", "CART", 0.3),
    ("VIEW_PRODUCT", "HOME", 0.5),
    ("VIEW_PRODUCT", "EXIT", 0.2),
    ("CART", "HOME", 0.4),
    ("CART", "CHECKOUT", 0.5),
    ("CART", "EXIT", 0.1),
    ("CHECKOUT", "EXIT", 0.9),
    ("CHECKOUT", "HOME", 0.1),
]

# Fixture mapping (chosen here, not a reference value): event types as flow nodes.
EVENT_NODE = [
    ("signup", "LOGIN"),
    ("view", "VIEW_PRODUCT"),
    ("click", "CART"),
    ("purchase", "CHECKOUT"),
    ("error", "EXIT"),
]


def transitions(events: DataFrame, state: str = "event_type", bucket_size: str = "hour") -> DataFrame:
    """FLOW-1: count of src -> dst steps between consecutive events of one
    (store, user), and the share of each dst among the steps leaving src."""
    seq = events.select("store_id", "user_id", "ts", "event_id", F.col(state).alias("src"),
                        F.date_trunc(bucket_size, "ts").alias("_bucket"))
    steps = next_value(seq, ["store_id", "user_id"], ["ts", "event_id"], "src", "_bucket", out="dst")
    counts = steps.filter(F.col("dst").isNotNull()).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    # one row per (src, dst): a tiny frame, the per-src totals are a window over it
    from pyspark.sql import Window
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("src")))


def node_transitions(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    mapping = spark.createDataFrame(EVENT_NODE, "event_type STRING, node STRING")
    # five fixed rows: broadcast is bounded by construction; a type without node stays a step of its own name
    e = events.join(F.broadcast(mapping), "event_type", "left")
    return transitions(e.withColumn("node", F.coalesce("node", "event_type")).drop("event_type"), state="node")


def drift(spark: SparkSession, seen: DataFrame) -> DataFrame:
    """FLOW-2: expected against seen probability per edge (full outer join)."""
    expected = spark.createDataFrame(REFERENCE_EDGES, "src STRING, dst STRING, expected_prob DOUBLE")
    s = seen.select("src", "dst", F.col("n").alias("seen_n"), F.col("prob").alias("seen_prob"))
    return expected.join(s, ["src", "dst"], "full_outer")
