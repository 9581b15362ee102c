"""N-gram Jaccard join by a blocked sparse matrix product.

A document is a row of the incidence matrix: its set of distinct five-word shingles. Equal rows
are one row. Overlaps are entries of the matrix times its transpose; only those that can
reach the limit are ever accumulated, by bounds that follow from the sizes alone, so no link is lost.

1. Two linked rows of n and m shingles share at least limit * max(n, m) of them. In a fixed
   order of all shingles (their hashes) they therefore share ``spare(min(n, m))`` of each
   other's first ``n - needed(n) + spare(n)``. Only these are counted at first: a row whose first
   shingles meet too few others is linked with nothing and goes. Slices of the input count what they
   hold twice themselves and send each such shingle once, so a shingle of a third of all rows
   is no hot key.
2. Rows that stay are multiplied. Columns held once are nothing; a row with less than
   ``needed`` others goes. A row's rarest columns, as many as a partner can't avoid, give its meetings.
3. In each column rows are compared with a pivot, each row with the pivot it meets most often,
   by exact overlaps; components of these links join most copies in rows, not pairs (``WAVES`` times,
   with other pivots).
4. Columns that still hold several components tie rows to groups. A group is cut into blocks of at most
   about ``CELL_ROWS`` rows and ``CELL_BYTES``; each pair of blocks is one task's product, accumulated over ranges of columns;
   pairs of one component, of sizes too far apart, or whose count with all that is left stays below the bound are
   dropped. A forest of the links leaves the task.

Null, empty or blank texts have no shingles and are linked with nothing; fewer than five words are
one shingle. Rows that repeat a doc_id are one document with several texts. A null doc_id is returned, linked with nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storepulse.llm import arrays as A
from storepulse.llm.near import groups
from storepulse.llm.tables import DOC, bucketed, components, dropped, filtered_joins, saved, table, texts

SHINGLE = 5
LIMIT = 80  # percent
SPARE = 5  # one shingle of so many is asked for beyond the least
WAVES = 2
CELL_ROWS = 512
CELL_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
WIDTH = 4096  # columns multiplied at once


def rows_of(column) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = A.Words(column)
    return A.distinct_per_document(*A.shingles(w.hashes, w.range, SHINGLE))


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, in two columns."""
    out = np.zeros((2, len(sets)), np.uint64)
    for d, s in enumerate(sets):
        out[0, d] = A.mix(s * A.STEP[12]).sum()
        out[1, d] = A.mix(s ^ A.STEP[13]).sum()
    return out.view(np.int64)


def needed(n, limit: int):
    """Least overlap of a row of ``n`` with any partner."""
    return (limit * n + 99) // 100


def spare(n):
    return 1 + n // SPARE


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the key of each text's set."""

    def rows(batches):
        for part in A.slices(batches):
            sets = rows_of(part.column("text"))
            k = set_keys(sets)
            yield pa.RecordBatch.from_arrays([part.column(DOC), pa.array([len(s) for s in sets], pa.int64()), pa.array(k[0]), pa.array(k[1])],
                                             [DOC, "n_shingles", "k1", "k2"])

    return texts(docs).mapInArrow(rows, "doc_id long, n_shingles long, k1 long, k2 long")


def first_shingles(docs: DataFrame, limit: int) -> DataFrame:
    """(token, key, known): a set's first shingles in hash order. ``known`` is 0 for a shingle whose company is asked
    for, -1 for one that several sets of the slice hold, and a number of such shingles in a row for a key alone."""

    def rows(batches):
        for part in A.slices(batches):
            sets = [s for s in rows_of(part.column("text")) if len(s)]
            keys, first = np.unique(set_keys(sets)[0], return_index=True)
            heads = [sets[i][:len(sets[i]) - needed(len(sets[i]), limit) + spare(len(sets[i]))] for i in first]
            if not heads:
                continue
            token = np.concatenate(heads)
            owner = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            start = np.ones(len(token), bool)
            start[1:] = token[1:] != token[:-1]
            shared = ~start
            shared[:-1] |= ~start[1:]
            count = np.bincount(owner[shared], minlength=len(heads))
            send = start | ~shared
            has = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([token[send].view(np.int64), keys[has]])), pa.array(np.concatenate([keys[owner[send]], keys[has]])),
                 pa.array(np.concatenate([-shared[send].astype(np.int32), count[has].astype(np.int32)]))], ["token", "key", "known"])

    return texts(docs).mapInArrow(rows, "token long, key long, known int")


def met(asked: DataFrame) -> DataFrame:
    """(key, met): how many of a key's first shingles other sets hold too (more where a set has copies)."""

    def counted(keys):
        k, c = np.unique(keys, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int64))], ["key", "met"])

    def rows(batches):
        last, held, open_ = None, None, False  # token of the run so far, its only key until a second comes, and whether one came
        for batch in batches:
            token, key, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "key", "known"))
            given = known > 0
            if given.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[given]), pa.array(known[given].astype(np.int64))], ["key", "met"])
                token, key, known = token[~given], key[~given], known[~given]
            if not len(token):
                continue
            runs = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            several = (np.minimum.reduceat(key, runs) != np.maximum.reduceat(key, runs)) | (np.minimum.reduceat(known, runs) < 0)
            late = []
            if last == token[0]:
                if open_:
                    several[0] = True
                elif several[0] or key[0] != held:
                    several[0] = True
                    late = [held]
            size = np.diff(np.append(runs, len(token)))
            take = np.repeat(several, size) & (known == 0)
            take[1:] &= (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            found = np.append(key[take], np.array(late, np.int64))
            if len(found):
                yield counted(found)
            last, held, open_ = token[-1], key[-1], bool(several[-1])

    return asked.repartition("token").sortWithinPartitions("token", "key").mapInArrow(rows, "key long, met long")


def live_rows(docs: DataFrame, reps: DataFrame, limit: int, repeats: bool) -> DataFrame:
    """(node, id, k1, k2, n, s): the whole rows of the sets that may have a partner. ``repeats``: a doc_id may repeat a row."""
    enough = met(first_shingles(docs, limit)).groupBy("key").agg(F.sum("met").alias("met"))
    least = F.expr(f"1 + floor(floor(({limit} * n + 99) / 100) / {SPARE})")
    # written, so that its size is known before the join with the texts is planned
    live = saved(reps.join(enough, reps.k1 == enough.key).where(F.col("met") >= least)
                 .select(F.col("id").alias(DOC), "k1", "k2", "n"), "incidence-live")
    entries = live.agg(F.sum("n")).first()[0] or 0

    def rows(batches):
        for part in A.slices(batches):
            sets = rows_of(part.column("text"))
            k = set_keys(sets)
            same = (k[0] == part.column("k1").to_numpy()) & (k[1] == part.column("k2").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [part.column(DOC), part.column("k1"), part.column("k2"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "k1", "k2", "n", "s"]).filter(pa.array(same))

    # the filter on n says no more than that: live is the side that a Bloom filter is made of
    found = texts(docs).join(live.where("n > 0").drop("n"), DOC).mapInArrow(rows, "id long, k1 long, k2 long, n long, s binary")
    if repeats:
        found = found.dropDuplicates(["id", "k1", "k2"])
    with filtered_joins(docs.sparkSession):
        held = saved(found.withColumn("node", F.monotonically_increasing_id()), "incidence-rows")  # numbered once
    # the rows of a bucket fit a task; every later join by node moves keys, not rows
    return bucketed(held, "incidence-buckets", "node", int(1 + entries * 8 // BUCKET_BYTES))


def meetings(live: DataFrame, limit: int) -> DataFrame:
    """(token, node, n): each row's rarest columns; linked rows have one in common."""

    def entries(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                s = np.frombuffer(one.column("s")[0].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), one.column("node").take(pa.array(np.zeros(len(s), np.int32))),
                                                  one.column("n").take(pa.array(np.zeros(len(s), np.int32)))], ["token", "node", "n"])

    def merged(batches):  # small batches of single rows cost more than their entries
        held, size = [], 0
        for b in entries(batches):
            held.append(b)
            size += b.num_rows
            if size > 1 << 16:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    cells = live.select("node", "n", "s").mapInArrow(merged, "token long, node long, n long")
    columns = cells.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    own = Window.partitionBy("node")
    need = F.expr(f"floor(({limit} * n + 99) / 100)")
    return saved(cells.join(columns, "token").withColumn("m", F.count("*").over(own))
                 .withColumn("place", F.row_number().over(own.orderBy("held", "token")))
                 .where((F.col("m") >= need) & (F.col("place") <= F.col("m") - need + 1)).select("token", "node", "n"), "incidence-meetings")


def reaches(overlap, n, m, limit: int):
    return (100 + limit) * overlap >= limit * (n + m)


def confirmed(pairs: DataFrame, live: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) whose whole rows overlap enough."""
    side = lambda x: live.select(F.col("node").alias(x), F.col("s").alias(f"s{x}"))

    def rows(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                ok[i] = reaches(int((y[at] == x).sum()), len(x), len(y), limit)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(rows, "a long, b long")


def mixed_columns(columns: DataFrame, label: DataFrame | None, turn: int) -> DataFrame:
    """(token, node, n, label) of columns that hold several components, with the column's pivot of this ``turn``."""
    if label is None:
        rows = columns.withColumn("label", F.col("node"))
    else:
        rows = columns.join(label, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("label"))
    tops = (rows.groupBy("token").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "n", "label")).alias("p"),
                                      F.min("label").alias("lo"), F.max("label").alias("hi"))
            .where("lo < hi").select("token", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.label").alias("pivot_label")))
    return saved(rows.join(tops, "token"), "incidence-mixed")


def product_links(label: np.ndarray, sets: list[np.ndarray], limit: int = LIMIT) -> list[tuple[int, int]]:
    """A forest of the links between rows of different labels: rows' places in ``sets``."""
    k = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(k), n)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    column, owner = (np.cumsum(held > 1) - 1)[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    left = np.bincount(owner, minlength=k)  # shared columns of each row not multiplied yet
    overlap = np.zeros((k, k), np.int64)
    sizes = n[:, None] + n[None, :]
    possible = ((label[:, None] != label[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= limit * np.maximum(n[:, None], n[None, :]))
                & reaches(np.minimum(left[:, None], left[None, :]), sizes, 0, limit))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        rows = np.flatnonzero(possible.any(1))
        if not len(rows):
            break
        x, y = np.searchsorted(column, [a, a + WIDTH])
        part = np.zeros((k, min(WIDTH, int(column[-1]) + 1 - a)), np.float32)
        part[owner[x:y], column[x:y] - a] = 1
        part = part[rows]
        overlap[np.ix_(rows, rows)] += (part @ part.T).astype(np.int64)
        left = left - np.bincount(owner[x:y], minlength=k)
        possible &= reaches(overlap + np.minimum(left[:, None], left[None, :]), sizes, 0, limit)
    possible &= reaches(overlap, sizes, 0, limit)
    out, group = [], np.unique(label, return_inverse=True)[1]
    for i in np.flatnonzero(possible.any(1)):
        near = np.flatnonzero(possible[i] & (group != group[i]))
        others, first = np.unique(group[near], return_index=True)
        out += [(int(i), int(near[f])) for f in first]
        group[np.isin(group, others)] = group[i]
    return out


def block_products(mixed: DataFrame, live: DataFrame, limit: int) -> DataFrame:
    """(a, b): a forest of the links within each pair of blocks of the groups that mixed columns tie together."""
    group = components(mixed.select("node", "pivot"), "node", "pivot")
    rows = group.join(mixed.select("node", "label").distinct(), "node").join(live.select("node", "n", "s"), "node")
    size = (group.join(live.select("node", "n"), "node").groupBy("component")
            .agg(F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum("n") * 8 / CELL_BYTES)).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a pair of blocks is a cell; a row goes to the cells of its own block
    spread = (rows.join(size, "component").withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "label", "s"))

    def check(batches):
        for t in groups(batches, ("component", "x", "y")):
            node = t.column("node").to_numpy()
            found = product_links(t.column("label").to_numpy(), [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("s")], limit)
            if found:
                a, b = node[np.array(found)].T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return spread.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y").mapInArrow(check, "a long, b long")


def row_links(live: DataFrame, limit: int) -> DataFrame:
    """(node, component) of every linked row."""
    columns = meetings(live, limit)
    found: list[DataFrame] = []
    label = None
    for turn in range(WAVES + 1):
        mixed = mixed_columns(columns, label, turn)
        if mixed.isEmpty():
            break
        if turn < WAVES:
            star = (mixed.where("label <> pivot_label").where(100 * F.least("n", "pivot_n") >= limit * F.greatest("n", "pivot_n"))
                    .groupBy("node", "pivot").agg(F.count("*").alias("often"))
                    .groupBy("node").agg(F.max(F.struct("often", F.col("pivot").alias("b"))).alias("best"))
                    .select(F.col("node").alias("a"), F.col("best.b").alias("b")))
            found.append(saved(confirmed(star, live, limit), "incidence-links"))
        else:
            found.append(saved(block_products(mixed, live, limit), "incidence-links"))
        label = saved(components(reduce(DataFrame.unionByName, found)), "incidence-label")
    return label if label is not None else live.sparkSession.createDataFrame([], "node long, component long")


def jaccard_join(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable), one row for each row of ``docs``."""
    sigs = saved(sets_of(docs), "incidence-sets")
    key = ["k1", "k2", "n_shingles"]
    whole = sigs.where("n_shingles > 0 and doc_id is not null")
    reps = saved(whole.groupBy(*key).agg(F.min(DOC).alias("id")).withColumnRenamed("n_shingles", "n"), "incidence-reps")
    repeated = whole.groupBy(DOC).agg(F.count("*").alias("c")).where("c > 1").select(DOC)
    several = not repeated.isEmpty()
    live = live_rows(docs, reps, limit, several)
    label = row_links(live, limit).join(live.select("node", "id"), "node")
    least = label.groupBy("component").agg(F.min("id").alias("least"))
    linked = saved(label.join(least, "component").select("id", "least").distinct(), "incidence-linked")
    dropped(live)
    if several:  # their texts tie components together
        ties = (whole.join(repeated, DOC).join(reps.withColumnRenamed("n", "n_shingles"), key)
                .select(F.col(DOC).alias("id"), F.col("id").alias("least")))
        linked = components(linked.unionByName(ties), "id", "least").select(F.col("node").alias("id"), F.col("component").alias("least"))
    copies = reps.join(linked, "id", "left").select("k1", "k2", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
    out = sigs.join(copies, key, "left")
    return out.select(DOC, "n_shingles", F.when(F.col(DOC).isNotNull(), F.coalesce("component_id", DOC)).alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
