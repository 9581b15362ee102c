"""Near-duplicate documents by chosen-path set similarity join.

A document is its set of distinct five-word shingles. Equal sets are collapsed
first, so copies cost nothing. Each remaining set is embedded as ``TOKENS``
minwise tokens: two sets agree on a token with the probability of their Jaccard
similarity. Independent trees (``trees``: 6 at a limit of 85 percent, 8 at 80) branch
the documents: a node chooses token positions by a hash of its path and sends each
document to the child named by its token there. All documents of a node share the
path, so a pair above the limit stays together in some tree with high probability:
one position is chosen for the first level and two for the next, and all trees miss
a pair at the limit with a probability of at most ``MISSED``.

A node of at most ``LEAF`` documents is compared exhaustively; of a larger one every
document is compared with a pivot, and the node branches on. A comparison estimates
the similarity from sketches (the smallest hash of each of ``SKETCH`` hash ranges, one
byte of it) and links what is at most ``LOOSE`` below the limit, over five standard deviations.
A node gives only a spanning forest of its links, so their number follows the rows and
not the pairs, and a node whose documents are already connected is finished. Nodes
still large and mixed at ``DEPTH`` are compared block by block, each block pair in a
task of its own.

The components of these loose links are families: any two documents above the limit
are in one. Each document's full set is sent once to its family, where all pairs are
compared exactly; families beyond a block are compared block by block. Again only a
forest of the true links leaves the task, and its components are the result.

Null, empty or blank texts have no shingles and are linked with nothing. Fewer
than five words give one shingle of them all. Rows that repeat a doc_id are one
document with several texts. A null doc_id is returned, linked with nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm import arrays as A
from storepulse.llm.tables import DOC, components, saved, table, texts

SHINGLE = 5
LIMIT = 85  # percent, of the query
STAGE_LIMIT = 80  # percent, of the pipeline's stage
TOKENS = 32
SKETCH_BITS = 9
SKETCH = 1 << SKETCH_BITS
LOOSE = 10  # percent points below the limit
MISSED = 0.00003
LEAF = 1024
BLOCK = 512
DEPTH = 2
CHOICES = 2
_rng = np.random.default_rng(71)
FACTORS = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * A.U64(2) + A.U64(1)


def shingle_sets(column) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = A.Words(column)
    return A.distinct_per_document(*A.shingles(w.hashes, w.range, SHINGLE))


def sketch(values: np.ndarray) -> bytes:
    """One byte for each hash range: of its smallest value, or 0 if the range has none."""
    out = np.zeros(SKETCH, np.uint8)
    place = (values >> A.U64(64 - SKETCH_BITS)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = place[1:] != place[:-1]  # values are sorted
    out[place[first]] = (values[first] >> A.U64(8)) % A.U64(255) + A.U64(1)
    return out.tobytes()


def trees(limit: int) -> int:
    """As many as lose a pair at the limit on both levels with a probability of at most ``MISSED``."""
    p = limit / 100
    lost = 1 - p * (1 - (1 - p) ** CHOICES)
    return int(np.ceil(np.log(MISSED) / np.log(lost)))


def similar(one: np.ndarray, many: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Whether the sketches ``many`` (rows) may reach the limit with ``one``."""
    same = ((one == many) & (one > 0)).sum(-1)
    return 100 * same >= (limit - LOOSE) * ((one > 0) | (many > 0)).sum(-1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set, its minwise tokens and its sketch."""

    def rows(batches):
        for part in A.slices(batches):
            sets = shingle_sets(part.column("text"))
            keys = np.zeros((2, len(sets)), np.uint64)
            tokens, sketches = [], []
            for d, s in enumerate(sets):
                keys[0, d] = A.mix(s * A.STEP[10]).sum()
                keys[1, d] = A.mix(s ^ A.STEP[11]).sum()
                low = np.full(TOKENS, ~A.U64(0))
                for at in range(0, len(s), 4096):  # bounded for very long texts
                    low = np.minimum(low, (s[at:at + 4096, None] * FACTORS).min(0))
                tokens.append((low >> A.U64(32)).astype("<u4").tobytes())
                sketches.append(sketch(s))
            yield pa.RecordBatch.from_arrays(
                [part.column(DOC), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                 pa.array(tokens, pa.binary()), pa.array(sketches, pa.binary())],
                [DOC, "n_shingles", "k1", "k2", "tokens", "sketch"])

    return texts(docs).mapInArrow(rows, "doc_id long, n_shingles long, k1 long, k2 long, tokens binary, sketch binary")


def _token_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, TOKENS)


def _sketch_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, SKETCH)


def first_level(reps: DataFrame, limit: int) -> DataFrame:
    """(node, id): each document under one child of the root of each tree."""

    def rows(batches):
        for part in batches:
            if not part.num_rows:
                continue
            tok = _token_rows(part.column("tokens")).astype(np.uint64)
            for tree in range(trees(limit)):
                node = A.mix(tok[:, tree] * A.STEP[20] + A.STEP[30 + tree])
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), part.column("id")], ["node", "id"])

    return reps.select("id", "tokens").mapInArrow(rows, "node long, id long")


def next_level(rows_in: DataFrame) -> DataFrame:
    """(node, id, tokens) to (node, id) of the children: ``CHOICES`` positions chosen by the node's path."""

    def rows(batches):
        for part in batches:
            if not part.num_rows:
                continue
            tok = _token_rows(part.column("tokens")).astype(np.uint64)
            node = part.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            for c in range(CHOICES):
                # an odd stride keeps a node's chosen positions different
                where = (A.mix(node) + A.U64(c) * (A.mix(node ^ A.STEP[22]) | A.U64(1))) % A.U64(TOKENS)
                child = A.mix(node * A.STEP[23] + where * A.STEP[24]
                              + tok[np.arange(len(tok)), where.astype(np.int64)] * A.STEP[25])
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), part.column("id")], ["node", "id"])

    return rows_in.select("node", "id", "tokens").mapInArrow(rows, "node long, id long")


def alike(pairs: DataFrame, reps: DataFrame, limit: int) -> DataFrame:
    """Distinct pairs whose sizes allow the limit and whose sketches are similar."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = (pairs.distinct().join(side("a"), "a").join(side("b"), "b")
            .where(100 * F.least("na", "nb") >= limit * F.greatest("na", "nb")))

    def rows(batches):
        for part in batches:
            if part.num_rows:
                ok = similar(_sketch_rows(part.column("sa").to_pylist()), _sketch_rows(part.column("sb").to_pylist()), limit)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "sa", "sb").mapInArrow(rows, "a long, b long")


def groups(sorted_batches, key: tuple[str, ...]):
    """Consecutive rows of equal keys of a sorted stream, as Arrow tables. A key's rows are bounded by a block pair."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in sorted_batches:
        if not b.num_rows:
            continue
        keys = [b.column(k).to_numpy(zero_copy_only=False) for k in key]
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(new), b.num_rows]
        if held and last != tuple(k[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for x, y in zip(cuts[:-1], cuts[1:]):
            if x:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
        last = tuple(k[-1] for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def forest(label: np.ndarray, n: np.ndarray, sketches: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Row pairs that connect what the sketches' links connect, one for each connection; equal labels need none."""
    left = np.arange(len(n))  # rows not yet reached
    out = []
    while len(left):
        wave = left[:1]
        left = left[1:]
        while len(wave) and len(left):
            at, wave = wave[0], wave[1:]
            known = label[left] == label[at]
            near = known.copy()
            ask = np.flatnonzero(~known & (100 * np.minimum(n[at], n[left]) >= limit * np.maximum(n[at], n[left])))
            near[ask] = similar(sketches[at], sketches[left[ask]], limit)
            out += [(at, j) for j in left[near & ~known]]
            wave = np.concatenate([wave, left[near]])
            left = left[~near]
    return out


def _compared(rows_in: DataFrame, cell: tuple[str, ...], limit: int) -> DataFrame:
    """(a, b): a forest of the loose links in each cell of at most ``LEAF`` rows."""

    def rows(batches):
        for t in groups(batches, cell):
            ids = t.column("id").to_numpy()
            pairs = forest(t.column("label").to_numpy(), t.column("n").to_numpy(), _sketch_rows(t.column("sketch").to_pylist()), limit)
            if pairs:
                x, y = ids[np.array(pairs)].T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return (rows_in.select(*cell, "id", "label", "n", "sketch").repartition(*cell).sortWithinPartitions(*cell)
            .mapInArrow(rows, "a long, b long"))


def block_pairs(df: DataFrame, cell: str, size: str, block: int) -> DataFrame:
    """Each row once for every other block of its group: all pairs of rows meet in a cell (``cell``, x, y)
    of at most about two blocks."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    spread = df.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return spread.withColumn("x", F.least("_own", "_other")).withColumn("y", F.greatest("_own", "_other")).drop("_own", "_other")


def families(reps: DataFrame, limit: int) -> DataFrame:
    """(node, component) of every representative with loose links."""
    spark = reps.sparkSession
    edges: list[DataFrame] = []
    label = None

    def link(found: DataFrame) -> None:
        nonlocal label
        edges.append(saved(found, "near-edges"))
        label = saved(components(reduce(DataFrame.unionByName, edges)), "near-label")

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows (node, id, label) of nodes with several components, their node's size and pivot."""
        if label is not None:
            rows = (rows.join(label.withColumnRenamed("node", "id"), "id", "left")
                    .select("node", "id", F.coalesce("component", "id").alias("label")))
        else:
            rows = rows.withColumn("label", F.col("id"))
        nodes = (rows.groupBy("node")
                 .agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"),
                      F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id"))).alias("p"))
                 .where("lo < hi").select("node", "size", F.col("p.id").alias("pivot")))
        return saved(rows.join(nodes, "node"), "near-rows")

    own = reps.select("id", "n", "sketch")
    rows = mixed(first_level(reps, limit))
    for depth in range(1, DEPTH + 1):
        small, large = rows.where(F.col("size") <= LEAF), rows.where(F.col("size") > LEAF)
        more = not large.isEmpty()
        found = _compared(small.join(own, "id"), ("node",), limit)
        if more:
            star = large.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
            found = found.unionByName(alike(star, reps, limit))
        link(found)
        if not more:
            break
        rows = mixed(large.select("node", "id"))
        if rows.isEmpty():
            break
        if depth < DEPTH:
            rows = mixed(next_level(rows.join(reps.select("id", "tokens"), "id")))
        else:  # still large and mixed
            link(_compared(block_pairs(rows.join(own, "id"), "node", "size", LEAF // 2), ("node", "x", "y"), limit))
    return label if label is not None else spark.createDataFrame([], "node long, component long")


def true_links(ids: np.ndarray, sets: list[np.ndarray], limit: int = LIMIT) -> list[tuple[int, int]]:
    """A forest of the pairs whose full sets reach the limit."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[token] > 1
    rank = np.cumsum(count > 1) - 1
    owner, token = owner[shared], rank[token[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    width = max(256, (4 << 20) // len(sets))  # tokens of one matrix of 16 MB
    for a in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        x, y = np.searchsorted(token, [a, a + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[x:y], token[x:y] - a] = 1
        both += m @ m.T
    linked = 100 * both >= limit * (n[:, None] + n[None, :] - both)
    out, left = [], np.arange(len(sets))
    while len(left):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            at, wave = wave[0], wave[1:]
            near = linked[at, left]
            out += [(ids[at], ids[j]) for j in left[near]]
            wave = np.concatenate([wave, left[near]])
            left = left[~near]
    return out


def links(docs: DataFrame, reps: DataFrame, limit: int) -> DataFrame:
    """(node, component) of every representative that is linked; see the module."""
    family = families(reps, limit)
    size = family.groupBy("component").agg(F.count("*").alias("size"))
    member = family.join(size, "component").select(F.col("node").alias(DOC), "component", "size")

    def sets(batches):
        for part in A.slices(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(DOC), part.column("component"), part.column("size"),
                 pa.array([s.tobytes() for s in shingle_sets(part.column("text"))], pa.binary())],
                ["id", "component", "size", "s"])

    def check(batches):
        for t in groups(batches, ("component", "x", "y")):
            # the same id may have several texts
            pairs = true_links(t.column("id").to_numpy(), [np.frombuffer(v, np.uint64) for v in t.column("s").to_pylist()], limit)
            if pairs:
                a, b = np.array(pairs, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    full = texts(docs).join(member, DOC).mapInArrow(sets, "id long, component long, size long, s binary")
    cells = (block_pairs(full, "component", "size", BLOCK).select("component", "x", "y", "id", "s")
             .repartition("component", "x", "y").sortWithinPartitions("component", "x", "y"))
    return saved(components(cells.mapInArrow(check, "a long, b long")), "near-components")


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of ``docs``; pairs of ``limit`` percent link."""
    sigs = saved(signatures(docs), "near-signatures")
    sets = ["k1", "k2", "n_shingles"]
    reps = saved(sigs.where("n_shingles > 0 and doc_id is not null").groupBy(*sets)
                 .agg(F.min(F.struct(DOC, "tokens", "sketch")).alias("r"))
                 .select(*sets, F.col("r.doc_id").alias("id"), F.col("n_shingles").alias("n"), F.col("r.tokens").alias("tokens"),
                         F.col("r.sketch").alias("sketch")),
                 "near-reps")
    # a doc_id with several texts ties their sets together
    shared = (sigs.where("doc_id is not null").groupBy(DOC).agg(F.count("*").alias("c")).where("c > 1").select(DOC))
    label = links(docs, reps, limit)
    if not shared.isEmpty():
        ties = (sigs.join(shared, DOC).where("n_shingles > 0").join(reps.select(*sets, "id"), sets)
                .select(F.col(DOC).alias("a"), F.col("id").alias("b")))
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(ties))
    rep = reps.select(*sets, F.col("id").alias("node")).join(label, "node", "left").select(
        *sets, F.coalesce("component", "node").alias("component_id"))
    own = label.select(F.col("node").alias(DOC), F.col("component").alias("own"))
    out = sigs.drop("tokens", "sketch").join(rep, sets, "left")
    if not shared.isEmpty():
        out = out.join(own, DOC, "left").withColumn("component_id", F.coalesce("own", "component_id"))
    component = F.when(F.col(DOC).isNull(), None).otherwise(F.coalesce("component_id", DOC))
    return out.select(DOC, "n_shingles", component.alias("component_id"), F.col(DOC).eqNullSafe(component).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (``STAGE_LIMIT``) the document with the smallest id.
    Rows that repeat a kept id all stay; documents without id or words stay."""
    gone = near_duplicates(docs, STAGE_LIMIT).where("not kept").select(DOC).distinct()
    return docs.join(gone, DOC, "left_anti").select(*docs.columns)
