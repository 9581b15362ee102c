"""Sinks (SNK-1, SNK-6, SNK-9) and observed counts (AGG-12).

All writes are parallel (one file per task); nothing is funnelled through the
driver or a single task unless the caller asks for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def save_csv(df: DataFrame, path: str, overwrite: bool = False, single_file: bool = False) -> None:
    """SNK-6: CSV with a header, append or overwrite. ``single_file`` reproduces
    the reference's one-file output and is meant for small results only."""
    out = df.coalesce(1) if single_file else df
    out.write.option("header", True).mode("overwrite" if overwrite else "append").csv(path)


def reset_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-9: replace the table's contents (DELETE + load / DROP + CREATE)."""
    df.write.mode("overwrite").format(fmt).save(path)


def as_json_values(df: DataFrame) -> DataFrame:
    """FN-8: every row as one JSON ``value`` (the topic record body)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def to_topic(df: DataFrame, bootstrap_servers: str, topic: str) -> None:
    """SNK-1 (batch): rows as JSON values to a Kafka topic. Needs the Kafka
    connector on the classpath of the cluster."""
    (as_json_values(df).write.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
        .option("topic", topic).save())


def write_observed(df: DataFrame, path: str, name: str = "rows") -> int:
    """AGG-12: write and count in the same job (``observe``), instead of a
    second execution for ``count()``."""
    obs = Observation(name)
    df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return int(obs.get["n"])


def stream_values_to_topic(df: DataFrame, bootstrap_servers: str, topic: str, checkpoint: str,
                           interval: str = "10 seconds"):
    """SNK-1 (stream): each emitted row as one JSON value on a Kafka topic every
    ``interval`` (append mode; needs the Kafka connector on the cluster's classpath)."""
    return (as_json_values(df).writeStream.format("kafka").outputMode("append")
            .option("kafka.bootstrap.servers", bootstrap_servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).trigger(processingTime=interval).start())


def stream_values_to_files(df: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """SNK-1 (stream), file form: JSON values appended exactly once per
    micro-batch by the file sink."""
    w = (as_json_values(df).writeStream.format("json").outputMode("append").option("path", path)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
