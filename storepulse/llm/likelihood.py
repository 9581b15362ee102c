"""Masked pseudo-likelihood: how well each word of a document follows from both its sides.

Words are counted exactly over all documents; the most frequent ones are tokens
of their own, the others share ``BUCKETS`` tokens by a hash. A window network
predicts the masked token from ``SIDE`` tokens on each side: a table per
position, a tanh layer and a softmax in two levels: over classes of ``CLASS`` tokens, then
over the tokens of the class, so every token has an exact probability. It is trained in numpy
where the documents are: in each of ``ROUNDS`` rounds every task starts from the
shared parameters, takes Adagrad steps over every ``MASK``-th position of its
documents (other positions each round, every position once over all rounds), and the parameters of all tasks are averaged
in one shuffle, weighted by their positions. All documents take part, so what is
gathered grows with the corpus; a model has a fixed size.

A document's score is the sum over all its tokens of the log-probability given both
sides; ``mean`` divides by their number. A word that shares a token counts with the
token's probability times the word's exact share in it: shares of the ``KNOWN`` most
frequent such words are sent to the tasks, the others meet their counts in a join. Null and empty texts have no tokens, sum 0
and a null mean. Repeated rows count each. Task boundaries change the averaged
parameters slightly, so scores are equal only for equal partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm import arrays as A
from storepulse.llm.tables import DOC, saved, table, texts

VOCABULARY = 512
CLASS = 32  # tokens of a class; ranks are dealt to the classes in turn
CLASSES = VOCABULARY // CLASS
BUCKETS = 64
WORDS = VOCABULARY - BUCKETS - 1  # the last token stands beyond a document's ends
BORDER = VOCABULARY - 1
SIDE = 2
HIDDEN = 16
ROUNDS = 2
MASK = ROUNDS  # every position is a target in one round
KNOWN = 1 << 16
GRAIN = 1 << 20
BATCH = 1024
RATE = 0.15
HELD = 400_000  # distinct words a task holds before it sends their counts


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, count) over all documents, counted within tasks first."""

    def rows(batches):
        key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["word", "n"])

        for part in A.slices(batches):
            more, count = np.unique(A.Words(part.column("text")).hashes, return_counts=True)
            both = np.concatenate([key, more])
            key, inverse = np.unique(both, return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n, count]), len(key)).astype(np.int64)
            if len(key) > HELD:
                yield sent()
                key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield sent()

    return texts(docs).mapInArrow(rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Tokens:
    """Token ids of words: rank among the most frequent, or a bucket."""

    def __init__(self, frequent: np.ndarray):
        self.order = np.argsort(frequent)
        self.key = frequent[self.order]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = WORDS + (hashes % A.U64(BUCKETS)).astype(np.int64)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, hashes), len(self.key) - 1)
            known = self.key[at] == hashes
            out[known] = self.order[at[known]]
        return out


def contexts(ids: np.ndarray, ranges: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The tokens around positions ``at``, left to right; beyond the document's ends ``BORDER``."""
    doc = np.searchsorted(ranges, at, "right") - 1
    first, last = ranges[doc], ranges[doc + 1]
    out = np.full((len(at), 2 * SIDE), BORDER)
    for j, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        ok = (at + step >= first) & (at + step < last)
        out[ok, j] = ids[at[ok] + step]
    return out


class Network:
    SHAPES = ((2 * SIDE, VOCABULARY, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, CLASS), (CLASSES, CLASS))

    def __init__(self, flat: np.ndarray):
        self.params, at = [], 0
        for shape in self.SHAPES:
            size = int(np.prod(shape))
            self.params.append(flat[at:at + size].reshape(shape).astype(np.float32))
            at += size

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES)

    @classmethod
    def fresh(cls) -> np.ndarray:
        rng = np.random.default_rng(5)
        flat = rng.normal(0, 0.1, cls.size())
        net = cls(flat)
        for bias in (net.params[3], net.params[5]):
            bias[:] = 0
        return net.flat().astype(float)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        table_, bias = self.params[:2]
        total = table_[0][around[:, 0]]
        for j in range(1, 2 * SIDE):
            total = total + table_[j][around[:, j]]
        return np.tanh(total + bias)

    def log_probability(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Each row by itself, so that its value does not depend on the rows beside it."""
        _, _, out, bias, inner, inner_bias = self.params
        group, place, row = token % CLASSES, token // CLASSES, np.arange(len(token))
        h = self.hidden(around)
        p, q = softmax(h @ out + bias), softmax(np.matmul(h[:, None], inner[group])[:, 0] + inner_bias[group])
        return np.log(np.maximum(p[row, group], TINY)) + np.log(np.maximum(q[row, place], TINY))

    def gradients(self, around: np.ndarray, token: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-probability."""
        table_, _, out, bias, inner, inner_bias = self.params
        # by class, so that each class's weights meet its rows in one product
        order = np.argsort((token % CLASSES).astype(np.int16), kind="stable")
        around, token, row = around[order], token[order], np.arange(len(token))
        group, place = token % CLASSES, token // CLASSES
        cuts = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
        h = self.hidden(around)
        q = np.empty((len(h), CLASS), h.dtype)
        for c in range(CLASSES):
            if cuts[c] < cuts[c + 1]:
                np.matmul(h[cuts[c]:cuts[c + 1]], inner[c], out=q[cuts[c]:cuts[c + 1]])
        q += inner_bias[group]
        p, q = softmax(h @ out + bias), softmax(q)
        p[row, group] -= 1
        q[row, place] -= 1
        p /= len(token)
        q /= len(token)
        dh = p @ out.T
        d_inner, d_inner_bias = np.zeros_like(inner), np.zeros_like(inner_bias)
        for c in range(CLASSES):
            if cuts[c] < cuts[c + 1]:
                own = slice(cuts[c], cuts[c + 1])
                dh[own] += q[own] @ inner[c].T
                d_inner[c] = h[own].T @ q[own]
                d_inner_bias[c] = q[own].sum(0)
        dh *= 1 - h * h
        dt = np.zeros_like(table_)
        for j in range(2 * SIDE):
            key = around[:, j].astype(np.int16)  # sorted by digits
            rows = np.argsort(key, kind="stable")
            key = key[rows]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            dt[j][key[first]] = np.add.reduceat(dh[rows], first)
        return [dt, dh.sum(0), h.T @ p, p.sum(0), d_inner, d_inner_bias]


TINY = np.float32(1e-30)



def softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def train_round(docs: DataFrame, tokens: Tokens, start: np.ndarray, offset: int) -> np.ndarray:
    """One pass: every task trains from ``start``; the average of all tasks' parameters."""
    sent = docs.sparkSession.sparkContext.broadcast((tokens, start))

    def rows(batches):
        tokens, start = sent.value
        net = Network(start)
        squares = [np.full_like(p, 1e-3) for p in net.params]
        seen = 0
        for part in A.slices(batches):
            w = A.Words(part.column("text"))
            ids = tokens.ids(w.hashes)
            doc = np.repeat(np.arange(len(w.counts)), w.counts)
            masked = np.flatnonzero((np.arange(len(ids)) - w.range[:-1][doc] + doc) % MASK == offset)
            for a in range(0, len(masked), BATCH):
                at = masked[a:a + BATCH]
                for p, s, g in zip(net.params, squares, net.gradients(contexts(ids, w.range, at), ids[at])):
                    s += g * g
                    p -= RATE * g / np.sqrt(s)
            seen += len(masked)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen], pa.int64()), pa.array([net.flat().astype(float)], pa.list_(pa.float64()))], ["n", "p"])

    sums = (texts(docs).mapInArrow(rows, "n long, p array<double>").select("n", F.posexplode("p").alias("k", "v"))
            .groupBy("k").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v")))
    out = start.copy()
    got = sums.toPandas()  # one row for each parameter
    out[got["k"].to_numpy(np.int64)] = got["v"].to_numpy()
    return out


class Shares:
    """Log of the share that words have of their bucket: of the most frequent ones, and the buckets' totals."""

    def __init__(self, words: np.ndarray, n: np.ndarray, totals: np.ndarray):
        order = np.argsort(words)
        self.key, self.totals = words[order], totals
        self.value = np.log(n[order] / totals[(self.key % A.U64(BUCKETS)).astype(np.int64)])

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shares, and whether each word is among those known here."""
        if not len(self.key):
            return np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.key, hashes), len(self.key) - 1)
        known = self.key[at] == hashes
        return np.where(known, self.value[at], 0), known


def fit(docs: DataFrame, known: int = KNOWN) -> tuple[Tokens, np.ndarray, Shares, DataFrame]:
    """Tokens, parameters, the shares of ``known`` words beyond the tokens, and the counts of all words."""
    counts = saved(word_counts(docs), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS + known).toPandas()
    word, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(float)
    tokens = Tokens(word[:WORDS])
    totals = np.zeros(BUCKETS)
    for r in counts.groupBy(F.col("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.sum("n").alias("n")).collect():
        totals[r["b"]] = r["n"]
    np.subtract.at(totals, (word[:WORDS] % A.U64(BUCKETS)).astype(np.int64), n[:WORDS])
    params = Network.fresh()
    for r in range(ROUNDS):
        params = train_round(docs, tokens, params, (r * MASK) // ROUNDS)
    return tokens, params, Shares(word[WORDS:], n[WORDS:], totals), counts


def likelihoods(docs: DataFrame, tokens: Tokens, params: np.ndarray, shares: Shares, counts: DataFrame) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((tokens, params, shares))
    rare_type = pa.list_(pa.struct([("word", pa.int64()), ("k", pa.int64())]))

    def rows(batches):
        tokens, params, shares = sent.value
        net = Network(params)
        for part in A.slices(batches):
            w = A.Words(part.column("text"))
            ids = tokens.ids(w.hashes)
            logp = np.zeros(len(ids) + 1)
            for a in range(0, len(ids), 4 * BATCH):
                at = np.arange(a, min(a + 4 * BATCH, len(ids)))
                # whole blocks, so that a position's value does not depend on its place in the batch
                full = np.minimum(np.arange(a, a + -(-len(at) // 64) * 64), at[-1])
                logp[at + 1] = net.log_probability(contexts(ids, w.range, full), ids[full])[:len(at)]
            share, known = shares.of(w.hashes)
            logp[1:] += np.where(ids >= WORDS, share, 0)
            sums = np.cumsum(np.round(logp * GRAIN) / GRAIN)  # exact sums
            total = sums[w.range[1:]] - sums[w.range[:-1]]
            left = np.flatnonzero((ids >= WORDS) & ~known)
            cuts = np.searchsorted(left, w.range)
            rare = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                word, k = np.unique(w.hashes[left[a:b]].view(np.int64), return_counts=True)
                rare.append([{"word": x, "k": y} for x, y in zip(word.tolist(), k.tolist())])
            yield pa.RecordBatch.from_arrays(
                [part.column(DOC), pa.array(w.counts), pa.array(total), pa.array(rare, rare_type)],
                [DOC, "n_tokens", "part", "rare"])

    base = saved(texts(docs).mapInArrow(rows, "doc_id long, n_tokens long, part double, rare array<struct<word: long, k: long>>")
                 .withColumn("row", F.monotonically_increasing_id()), "likelihood-parts")
    totals = F.array(*[F.lit(float(np.log(max(t, 1)))) for t in shares.totals])
    bucket = F.col("word").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    more = (base.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.k").alias("k"))
            .join(counts, "word").groupBy("row").agg(F.sum(F.col("k") * (F.log("n") - F.get(totals, bucket))).alias("more")))
    total = F.col("part") + F.coalesce("more", F.lit(0.0))
    return base.drop("rare").join(more, "row", "left").select(
        DOC, "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return likelihoods(docs, *fit(docs))
