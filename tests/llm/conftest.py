"""Small tables with the hard cases that every text operator must take."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
# columns whose names operators use inside
CLASHING = ("label", "score", "n", "id", "a", "b", "node", "component", "spans", "tokens", "key", "starts", "rank", "class")
SENTENCE = " ".join(f"word{i}" for i in range(80))


def hard_rows():
    long = " ".join(f"w{i % 997}x{i // 997}" for i in range(20_000))
    return [
        (1, SENTENCE + " end.", "en", "s", 1), (2, SENTENCE + " end.", "en", "s", 1),  # an exact copy
        (2, SENTENCE + " end.", "en", "s", 1),  # a repeated row
        (3, SENTENCE.replace("word7 ", "other ") + " end.", None, None, None),  # a near copy
        (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, " \n\t ", "en", "s", 3), (7, "one", "en", "s", 3),
        (8, long, "de", "s", 1), (None, "a text without an id " * 30, "en", None, 1), (None, None, None, None, None),
        (9, "Ünïcödé ÀÉ ½ 東京 don't 12 " * 12, "fr", "t", 1), (10, "a" * 500, "en", "t", 500), (11, "x\x00y \x1f z", "en", "t", 5),
    ]


@pytest.fixture
def tables(spark, tmp_path):
    """A function that writes a table directory and returns its path."""
    def write(documents, labels=(), benchmark=(), name="t", clashing=True):
        out = tmp_path / name
        docs = spark.createDataFrame(documents, DOCS)
        for c in CLASHING if clashing else ():
            docs = docs.withColumn(c, docs.source)
        docs.coalesce(2).write.parquet(str(out / "documents.parquet"))
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
        spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
        return str(out)
    return write


def plain_words(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
