"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed on whole texts inside ``mapInArrow``. The trees are
grown in numpy by histograms (each statistic cut into at most ``BINS`` bins
once), on a bounded sample of labelled rows: the ``sample`` rows with the
smallest hash of their id. The finished trees are flattened into four arrays
(feature, threshold, child, value), a few kilobytes, which go to every task;
scoring walks all documents of a batch through all trees level by level.

Labels with a null class or id are not used; a document labelled more than once
counts with its largest label. A null or empty text has statistics of zero and is
scored like any other. Without usable labels every score is ``NEUTRAL``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm import arrays as A
from storepulse.llm.tables import DOC, free_name, table, texts

BINS = 64
NEUTRAL = 0.5
SAMPLE = 20_000
HOLD = 5
THRESHOLD = 0.3
FEATURES = ("n_words", "n_bytes", "word_length", "upper", "digits", "marks", "symbols", "bars", "newlines",
            "non_ascii", "shouting", "symbol_ends", "no_letters", "line_words", "doubled", "distinct",
            "repeated_5", "doubled_count", "shouting_count", "symbol_count", "top_word", "long_words", "bangs")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER = _table(bytes(range(65, 91)))
LETTER = UPPER | _table(bytes(range(97, 123))) | _table(bytes(range(128, 256)))
LOWERCASE = _table(bytes(range(97, 123)))
DIGIT = _table(b"0123456789")
MARK = _table(b".,;:?'\"()-")
SYMBOL = _table(b"#*$%&|<>")


def statistics(column) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    w = A.Words(column)
    n, offs, data = len(w.offs) - 1, w.offs, w.data
    size = np.maximum(np.diff(offs), 1)
    words = np.maximum(w.counts, 1)
    x = np.zeros((n, len(FEATURES)))
    count = lambda mask: A.per_document(mask, offs)
    in_words = lambda mask: A.per_document(mask, w.range)
    x[:, 0], x[:, 1] = np.log1p(w.counts), np.log1p(np.diff(offs))
    length = w.ends - w.starts
    sums = np.concatenate([[0], np.cumsum(length)])
    x[:, 2] = (sums[w.range[1:]] - sums[w.range[:-1]]) / words
    for k, mask in ((3, UPPER), (4, DIGIT), (5, MARK), (6, SYMBOL)):
        x[:, k] = count(mask[data]) / size
    x[:, 7] = in_words((length == 1) & (data[w.starts] == ord("|"))) / words if len(length) else 0
    lines = count(data == 10)
    x[:, 8], x[:, 9] = lines / size, count(data > 127) / size
    if len(length):
        within = np.concatenate([[0], np.cumsum(LETTER[data])])
        small = np.concatenate([[0], np.cumsum(LOWERCASE[data])])
        letters = within[w.ends] - within[w.starts]
        shouting = (letters > 1) & (small[w.ends] == small[w.starts]) & UPPER[data[w.starts]]
        ends_symbol = SYMBOL[data[w.ends - 1]]
        x[:, 10], x[:, 18] = in_words(shouting) / words, np.log1p(in_words(shouting))
        x[:, 11], x[:, 19] = in_words(ends_symbol) / words, np.log1p(in_words(ends_symbol))
        x[:, 12] = in_words(letters == 0) / words
        same = np.zeros(len(length), bool)
        same[1:] = w.hashes[1:] == w.hashes[:-1]
        first = w.range[:-1][w.counts > 0]
        same[first] = False
        x[:, 14], x[:, 17] = in_words(same) / words, np.log1p(in_words(same))
        x[:, 21] = in_words(length > 20) / words
        x[:, 22] = in_words(data[w.ends - 1] == ord("!")) / words
    x[:, 13] = w.counts / (lines + 1)
    sh, ranges = A.shingles(w.hashes, w.range)
    for d in range(n):
        if w.counts[d]:
            _, c = np.unique(w.hashes[w.range[d]:w.range[d + 1]], return_counts=True)
            x[d, 15], x[d, 20] = len(c) / w.counts[d], c.max() / w.counts[d]
            own = sh[ranges[d]:ranges[d + 1]]
            x[d, 16] = 1 - len(np.unique(own)) / len(own)
    return x


class Trees:
    """Boosted trees in flat arrays: node ``i`` sends a row to ``child[i]`` if its
    statistic is at most the threshold, else to ``child[i] + 1``; leaves point to themselves."""

    def __init__(self, prior: float, roots, feature, threshold, child, value, depth: int):
        self.prior, self.depth = prior, depth
        self.roots = np.array(roots, np.int32)
        self.feature, self.child = np.array(feature, np.int32), np.array(child, np.int32)
        self.threshold, self.value = np.array(threshold), np.array(value)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.prior)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[at]] > self.threshold[at]
            at = np.where(self.child[at] < 0, at, self.child[at] + right)
        margin = self.prior + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15,
         least: float = 2.0, shrink: float = 1.0) -> Trees:
    """Fit the trees. One class alone gives a constant score of that class's frequency."""
    if len(y) == 0 or y.min() == y.max():
        return Trees(float(y.mean()) if len(y) else NEUTRAL, [], [], [], [], [], 0)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1).astype(np.int64)
    slot = binned + np.arange(m) * BINS
    prior = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, prior)
    roots, feature, threshold, child, value = [], [], [], [], []

    def node() -> int:
        for arr, v in ((feature, 0), (threshold, 0.0), (child, -1), (value, 0.0)):
            arr.append(v)
        return len(feature) - 1

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(n))]
        for d in range(depth + 1):
            below = []
            for k, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                best = None
                if d < depth and hs >= 2 * least:
                    flat_slots = slot[rows].ravel()
                    gl = np.bincount(flat_slots, np.repeat(g[rows], m), m * BINS).reshape(m, BINS).cumsum(1)
                    hl = np.bincount(flat_slots, np.repeat(h[rows], m), m * BINS).reshape(m, BINS).cumsum(1)
                    gain = (gl ** 2 / (hl + shrink) + (gs - gl) ** 2 / (hs - hl + shrink) - gs ** 2 / (hs + shrink))
                    gain[(hl < least) | (hs - hl < least)] = -1
                    j, b = divmod(int(gain.argmax()), BINS)
                    if gain[j, b] > 1e-6 and b < len(cuts[j]):
                        best = j, b
                if best is None:
                    value[k] = -rate * gs / (hs + shrink)
                    margin[rows] += value[k]
                    continue
                j, b = best
                feature[k], threshold[k] = j, float(cuts[j][b])
                left, right = node(), node()
                child[k] = left
                go = binned[rows, j] <= b
                below += [(left, rows[go]), (right, rows[~go])]
            level = below
    return Trees(prior, roots, feature, threshold, child, value, depth)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % HOLD == 0


def labelled(docs: DataFrame, labels: DataFrame, column: str, sample: int = SAMPLE) -> DataFrame:
    """The bounded training sample: (doc_id, label, text) of rows that are not held out."""
    wanted = (labels.select(F.col(DOC).cast("long").alias(DOC), F.col(column).cast("int").alias("label"))
              .where("doc_id is not null and label is not null")
              .where(~held_out(F.col(DOC)))
              .groupBy(DOC).agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64(DOC), DOC).limit(sample))
    return texts(docs).join(F.broadcast(wanted), DOC)  # at most ``sample`` rows of 12 bytes


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    schema = f"label int, x array<double>"

    def rows(batches):
        for part in A.slices(batches):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("label").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    got = labelled(docs, labels, "quality", sample).mapInArrow(rows, schema).toPandas()
    if not len(got):
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(got["x"].to_numpy()), got["label"].to_numpy(float)
    order = np.lexsort(np.c_[x, y].T)  # rows come in any order; sums must not depend on it
    return grow(x[order], np.clip(y[order], 0, 1))


def scores(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns of every document (text among them if wanted) and its score, under ``name``."""
    src = docs.select(*keep, *([] if "text" in keep else ["text"]))
    fields = [f for f in src.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}` double"

    def rows(batches):
        for part in A.slices(batches):
            s = model.score(statistics(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column(f.name) for f in fields] + [pa.array(s)],
                                             [f.name for f in fields] + [name])

    return src.mapInArrow(rows, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; see the module for null and empty texts."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scores(texts(docs), model)
    return out.select(DOC, held_out(F.col(DOC)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose score reaches ``THRESHOLD``, all columns as they were."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    columns, name = docs.columns, free_name(docs, "score")
    return scores(docs, model, tuple(columns), name).where(F.col(name) >= THRESHOLD).select(*columns)
