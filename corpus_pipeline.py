"""The corpus pipeline: documents that are good, unique and clean, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storepulse.llm.decontaminate import keep_clean
from storepulse.llm.near import keep_one
from storepulse.llm.pack import pack_rest
from storepulse.llm.passages import cut_passages
from storepulse.llm.quality import keep_good
from storepulse.llm.tables import saved, table

# Each stage: (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents.
STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one),
    ("substring_dedup", cut_passages),
    ("decontaminate", keep_clean),
    ("pack", pack_rest),
]

# Trained trees, minhash joins and a tokenizer are beyond SQL; the tests hold the
# stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
