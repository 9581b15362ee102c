"""Quality rules by cross-document line frequency.

Per document, on whole texts: counts of words, symbols, repeated lines and
repeated five-word windows (``base_failed`` follows from them). Across documents:
every line is normalised (A-Z to lower case, runs of white space to one space) and
hashed; for each host (``source``) the distinct texts that hold a line are counted,
so that exact copies of one document count once. A line, whatever its length, in at
least ``MOST_TEXTS`` texts and ``SHARE`` of the host's texts is boilerplate and is
removed; a document that loses more than ``DEPLETED`` of its words is rejected.

A document's lines are made distinct in its own task, so a frequent line costs one
row for each text, pre-aggregated before the count; a frequent host is spread over
its lines. Null texts count as empty, have no words and fail; a null source is
a host of its own; repeated rows are judged each and alike.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm import arrays as A
from storepulse.llm.tables import DOC, saved, table, texts

MOST_TEXTS = 20
SHARE = 0.01
DEPLETED = 0.8
LEAST_WORDS = 10
REPEATED = 20  # percent of the words
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
BASE = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "source string, t1 long, t2 long, lines array<struct<hash: long, words: int>>")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(hashes: np.ndarray, size: int = 5) -> int:
    """Words in windows of ``size`` words that are found twice or more, the first time included."""
    if len(hashes) < size:
        return 0
    sh, _ = A.shingles(hashes, np.array([0, len(hashes)]), size)
    _, inverse, count = np.unique(sh, return_inverse=True, return_counts=True)
    step = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(count[inverse] > 1)
    step[at] += 1
    np.subtract.at(step, at + size, 1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def measured(docs: DataFrame) -> DataFrame:
    """The counts of each row, a 128-bit hash of its text, and its distinct normalised lines."""

    def rows(batches):
        for part in A.slices(batches):
            w = A.Words(part.column("text"), lower=False)  # the counts compare words as they are
            low = A.Words(part.column("text"))
            data, offs = w.data, w.offs
            n = len(offs) - 1
            follows = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])  # UTF-8 bytes that are no code point
            chars = (w.ends - w.starts) - (follows[w.ends] - follows[w.starts])
            sums = np.concatenate([[0], np.cumsum(chars)])
            out = {c: np.zeros(n, np.int64) for c in COUNTS}
            out["n_words"] = w.counts
            out["word_chars"] = sums[w.range[1:]] - sums[w.range[:-1]]
            out["n_symbols"] = A.per_document(SYMBOL[data], offs)
            # words of a line have no \n between them
            breaks = np.concatenate([[0], np.cumsum(data == 10)])
            line = breaks[w.starts]
            t = np.zeros((2, n), np.int64)
            lines = []
            for d in range(n):
                raw = data[offs[d]:offs[d + 1]].tobytes()
                t[:, d] = np.array([zlib.crc32(raw) << 31 | len(raw) % (1 << 31), hash128(raw)])
                spaced = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
                out["n_dup_lines"][d] = len(spaced) - len(set(spaced))
                a, b = w.range[d], w.range[d + 1]
                out["n_repeat_words"][d] = repeated_words(w.hashes[a:b])
                if a == b:
                    lines.append([])
                    continue
                # lines as ranges of the document's words
                first = np.flatnonzero(np.concatenate([[True], line[a + 1:b] != line[a:b - 1]]))
                size = np.diff(np.append(first, b - a))
                weighted = np.add.reduceat(A.mix(low.hashes[a:b] + (np.arange(b - a) - np.repeat(first, size)).astype(np.uint64)
                                                 * A.STEP[50]), first)
                own, index, count = np.unique(A.mix(weighted).view(np.int64), return_index=True, return_counts=True)
                total = size[index] * count
                lines.append([{"hash": int(h), "words": int(k)} for h, k in zip(own, total)])
            yield pa.RecordBatch.from_arrays(
                [part.column(DOC), *(pa.array(out[c]) for c in COUNTS), part.column("source"), pa.array(t[0]), pa.array(t[1]),
                 pa.array(lines, pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32())])))],
                [DOC, *COUNTS, "source", "t1", "t2", "lines"])

    return texts(docs, F.col("source").cast("string").alias("source")).mapInArrow(rows, BASE)


def hash128(raw: bytes) -> int:
    value = np.frombuffer(raw + b"\0" * (-len(raw) % 8), np.uint64)
    return int(A.mix(value * A.power_table(A.BASE, len(value)) + A.STEP[51]).sum().view(np.int64)) if len(value) else 0


def judged(docs: DataFrame) -> DataFrame:
    base = saved(measured(docs), "line-counts")
    text = ["source", "t1", "t2"]
    lines = (base.select(*text, F.explode("lines").alias("l"))
             .select(*text, F.col("l.hash").alias("hash"), F.col("l.words").alias("words")).distinct())
    hosts = base.select(*text).distinct().groupBy("source").agg(F.count("*").alias("texts"))
    often = (lines.groupBy("source", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= MOST_TEXTS)
             .join(hosts.withColumnRenamed("source", "host"), F.col("source").eqNullSafe(F.col("host")))
             .where(F.col("n") >= SHARE * F.col("texts"))
             .select(F.col("source").alias("s"), F.col("hash").alias("h")))
    removed = (lines.join(often, F.col("source").eqNullSafe(F.col("s")) & (F.col("hash") == F.col("h")))
               .groupBy(*text).agg(F.sum("words").alias("removed")).select(F.col("source").alias("s"), F.col("t1").alias("u1"),
                                                                           F.col("t2").alias("u2"), "removed"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    gone = F.coalesce("removed", F.lit(0))
    return (base.drop("lines").join(removed, F.col("source").eqNullSafe(F.col("s")) & (F.col("t1") == F.col("u1"))
                                    & (F.col("t2") == F.col("u2")), "left")
            .select(DOC, *COUNTS, failed.alias("base_failed"),
                    (~failed & (gone <= DEPLETED * F.col("n_words"))).alias("kept"), gone.cast("long").alias("n_removed_words")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
