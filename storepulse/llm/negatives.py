"""Hard negatives by Fagin's threshold algorithm.

Components become integers y = floor(256 x); a score is an integer inner product. All rows are dealt
into blocks of about ``BLOCK`` rows. The anchors, a stated set, are sent to every block and meet
its rows there: the block keeps, for each dimension, its rows sorted by that component. An
anchor reads these lists from the end that its own sign prefers, ``STRIDE`` rows of each list at
first and twice as far each time; each row met for the first time is scored whole (random access). The
threshold is the sum of the anchor's components times the last values read: no unread row scores
more. A window of scores is done once the threshold is strictly below its kth score (an equal
score could have a smaller id) or below its lower end. Each block returns its first k rows for
a window; Spark ranks those of all blocks.

Two rounds: the positives (the first rows of the anchor's label, any score), then, with the window that each positive's
score gives, the negatives of all windows of an anchor in one reading.

Defined cases: rows with a null label, a null vector or null or non-finite components take no part. Rows that
repeat a vec_id are rows of their own (a copy of an anchor is another row), and give repeated output as they are anchors.
A null vec_id is no anchor; as another row it comes after all ids of its score. Vectors of several lengths:
the shorter one continues in zeros. Components beyond 2^28 in size after scaling count as 2^28,
so that every score fits a long. An anchor without other rows of its label has no output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storepulse.llm.tables import saved, table
from storepulse.llm.whitening import clean_vectors

SCALE = 256
LARGEST = 1 << 28
EVERY = 100  # ids divisible by it are anchors
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score
MOVED, LABELS = 7, 10  # of every seventh id the label is the next of ten
BLOCK = 16384  # about 60 MB with its lists; anchors are sent once for each block
STRIDE = 16
LAST_ID = np.int64((1 << 63) - 1)  # stands for a null id in ties
EXACT = 1 << 53  # sums of products below it are exact as doubles


def integer_rows(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, y) of the rows that take part."""
    cut = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("y"))
    return (clean_vectors(own.where("label is not null"), "y")
            .withColumn("y", F.transform("y", cut).cast("array<int>"))
            .withColumn("label", F.expr(f"if(vec_id % {MOVED} = 0, (label + 1) % {LABELS}, label)")))


def _matrix(column, d: int) -> np.ndarray:
    """Rows of a list column as whole doubles, short ones continued in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), d), np.int64)
    out[np.arange(d) < size[:, None]] = flat
    return out


class Block:
    """Rows with their sorted lists; answers windows of scores by the threshold algorithm."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, label: np.ndarray, y: np.ndarray):
        self.uid, self.ids, self.label = uid, ids, label
        # a list of rows for each dimension, and its values
        self.order = np.stack([np.argsort(column, kind="stable").astype(np.int32) for column in y.T]) if y.size else np.zeros((y.shape[1], len(y)), np.int32)
        self.sorted = np.take_along_axis(y.T.astype(np.int32), self.order, 1)
        self.most = int(np.abs(y).max(initial=0))
        self.whole, self.real = y.astype(np.int32), y.astype(np.float64)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.most * int(np.abs(anchor).max(initial=0)) * len(anchor) < EXACT:
            return (self.real[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.whole[rows].astype(np.int64) @ anchor

    def search(self, anchor: np.ndarray, fit: np.ndarray, windows: list[tuple[int | None, int | None]], k: int
               ) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the rows where ``fit`` holds, the first ``k`` in each window (both ends belong to it): rows and scores,
        by falling score, then id."""
        n = len(self.uid)
        used = np.flatnonzero(anchor)
        lists, weight = self.order[used], anchor[used]
        # anchor-signed: the end of the list whose products are largest
        down = weight > 0
        new = fit.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        open_ = list(range(len(windows)))
        depth, step = 0, STRIDE if len(used) else n
        while open_ and depth < n:
            upto = min(n, depth + step)
            if len(used):
                met = np.concatenate([lists[down, n - upto:n - depth].ravel(), lists[~down, depth:upto].ravel()])
                edge = np.where(down, self.sorted[used, n - upto], self.sorted[used, upto - 1]).astype(np.int64)
                threshold = int((edge * weight).sum()) if upto < n else None  # products of 2^56 at most, and few
            else:
                met, threshold = np.arange(n), None
            mark = np.zeros(n, bool)
            mark[met] = True
            rows = np.flatnonzero(mark & new)
            new[rows] = False
            score = self.scores(rows, anchor)
            for w in list(open_):
                low, high = windows[w]
                inside = np.ones(len(rows), bool)
                if low is not None:
                    inside &= score >= low
                if high is not None:
                    inside &= score <= high
                r = np.concatenate([best[w][0], rows[inside]])
                s = np.concatenate([best[w][1], score[inside]])
                if len(r) > k:
                    first = np.lexsort((self.ids[r], -s))[:k]
                    r, s = r[first], s[first]
                best[w] = r, s
                if threshold is not None and (low is not None and threshold < low or len(s) >= k and threshold < s.min()):
                    open_.remove(w)
            depth, step = upto, 2 * step
        return best


def in_blocks(rows: DataFrame, asked: DataFrame, blocks: int, d: int, k: int, same: bool) -> DataFrame:
    """(uid, window, vec_id, score): each block's first ``k`` rows of the anchor's label (``same``) or of
    others, for every window of every anchor in ``asked`` (uid, label, y, low, high: arrays of one entry for a window)."""
    block = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("array<long>")
    mine = rows.select(block.alias("block"), F.lit(0).alias("kind"), "uid", "vec_id", "label", "y", none.alias("low"), none.alias("high"))
    theirs = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "uid",
                          F.lit(None).cast("long").alias("vec_id"), "label", "y", "low", "high")
    dealt = mine.unionByName(theirs).repartition(blocks, "block").sortWithinPartitions("block", "kind")

    def answers(batches):
        held, at, ready = [], None, None
        for batch in batches:
            number = batch.column("block").to_numpy(zero_copy_only=False)
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *turns], [*turns, len(number)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if number[a] != at:
                    held, at, ready = [], number[a], None
                if kind[a] == 0:
                    held.append(part)
                elif held:
                    if ready is None:
                        t = pa.Table.from_batches(held).combine_chunks()
                        ids = t.column("vec_id").fill_null(int(LAST_ID)).to_numpy()
                        ready = Block(t.column("uid").to_numpy(), ids, t.column("label").to_numpy(), _matrix(t.column("y").combine_chunks(), d))
                    yield from _asked(ready, part)

    def _asked(ready: Block, part: pa.RecordBatch):
        uid = part.column("uid").to_numpy(zero_copy_only=False)
        label = part.column("label").to_numpy(zero_copy_only=False)
        y = _matrix(part.column("y"), d)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i, (low, high) in enumerate(zip(part.column("low").to_pylist(), part.column("high").to_pylist())):
            fit = (ready.label == label[i]) & (ready.uid != uid[i]) if same else ready.label != label[i]
            for w, (rows, score) in enumerate(ready.search(y[i], fit, list(zip(low, high)), k)):
                for column, values in zip(out, (np.full(len(rows), uid[i]), np.full(len(rows), w), ready.ids[rows], score)):
                    column.append(values)
        u, w, ids, s = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(u), pa.array(w, pa.int32()), pa.array(ids, mask=ids == LAST_ID), pa.array(s)], ["uid", "window", "vec_id", "score"])

    return dealt.mapInArrow(answers, "uid long, window int, vec_id long, score long")


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` over all blocks of each anchor's window, numbered; the planner limits groups before the shuffle."""
    order = Window.partitionBy("uid", "window").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, **names: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; see the module."""
    out = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    # a written table: its row numbers stay the same however often it is read
    part = saved(integer_rows(rows, **names).withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")
    n, d = part.agg(F.count("*"), F.max(F.size("y"))).first()
    blocks = 1 + n // BLOCK
    anchors = part.where(F.col("vec_id") % every == 0).select("uid", F.col("vec_id").alias("anchor_id"), "label", "y")
    open_end = F.array(F.lit(None).cast("long"))
    near = first_of(in_blocks(part, anchors.select("uid", "label", "y", open_end.alias("low"), open_end.alias("high")),
                              blocks, d or 0, positives, True), positives)
    near = saved(near.select("uid", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
                 "negatives-positives")
    # an anchor's few positives, and 100 * score between low and high times theirs as whole bounds
    place = (near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("ps"))
             .select("uid", F.transform("ps", lambda p: p["positive_score"]).alias("scores")))
    ceil, floor = (F.expr(f"transform(scores, p -> cast({up}({share} * cast(p as decimal(30, 0)) / 100) as long))")
                   for up, share in (("ceil", low), ("floor", high)))
    asked = anchors.join(place, "uid").select("uid", "label", "y", ceil.alias("low"), floor.alias("high"))
    far = first_of(in_blocks(part, asked, blocks, d or 0, negatives, False), negatives)
    return (far.select("uid", (F.col("window") + 1).alias("place"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                       F.col("score").alias("negative_score"))
            .join(near, ["uid", "place"]).join(anchors.select("uid", "anchor_id"), "uid").select(*out))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))
