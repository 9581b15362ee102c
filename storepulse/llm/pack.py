"""Packing of tokenised documents into sequences, by cutting-stock column generation.

A document's tokens are cut at every ``LENGTH`` ids; the rest is one piece. Most
pieces stay whole. Pieces are counted by length class (``GRAIN`` tokens wide, at most ``LENGTH / GRAIN`` classes, the
only thing that reaches the driver). A linear program over patterns (how many
pieces of each class share a sequence) is solved by column generation: a knapsack
dynamic program prices the next pattern with the duals of a numpy simplex.
Pattern counts are rounded down; what remains, at most a few pieces of a pattern,
is filled by exact subset sums around the longest piece left. The patterns are
then assigned to the pieces of each class in the order of (doc_id, start): a
piece's rank, computed in two levels so that a frequent length is spread over
tasks, determines its sequence, and its offset is a running sum in the sequence.

What whole pieces leave empty is filled by cut ones: the classes that the duals
show as hardest to place give up pieces, and these are laid end to end over the
empty room of all sequences and cut where a sequence ends. A position in that
room determines its sequence by arithmetic over the patterns, so this too is one
map over the pieces; only documents that are cut anew are tokenised twice.

Null and empty texts have the end id alone. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storepulse.llm import arrays as A
from storepulse.llm.tables import DOC, saved, table, texts
from storepulse.llm.tokens import TEXT_BYTES, VOCABULARY, encoder

LENGTH = 2048
GRAIN = 8
PADDING = 0.002  # of all tokens; more empty room than this is filled by cut pieces
END = 1
CHUNKS = 64
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECE + ", class long, sequence_id long, slot long"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end: int = END,
           ids_too: bool = False) -> DataFrame:
    """Every document's pieces: start, length, checksum of the ids, and the document's ids in all
    (with ``ids_too``, the ids themselves)."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def rows(batches):
        own_encoder = encoder(vocabulary)
        for part in A.slices(batches, limit=TEXT_BYTES):
            ids, offs = own_encoder.encode(part.column("text"))
            out, raw = [], []
            for d, doc in enumerate(part.column(DOC).to_pylist()):
                own = np.append(ids[offs[d]:offs[d + 1]], end).astype("<u4")
                for at in range(0, len(own), length):
                    piece = own[at:at + length]
                    out.append((doc, at, len(piece), zlib.crc32(piece), len(own)))
                    if ids_too:
                        raw.append(piece.tobytes())
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            if ids_too:
                yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())], names + ["ids"])
            else:
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts(docs).mapInArrow(rows, PIECE + ", ids binary" * ids_too)


def knapsack(worth: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """Most valuable multiset of sizes 1..room (``worth[size]``) that fits, sizes repeatable."""
    best = np.zeros(room + 1)
    pick = np.zeros(room + 1, np.int64)
    for w in range(1, room + 1):
        total = worth[1:w + 1] + best[w - 1::-1]
        k = int(total.argmax())
        if total[k] > best[w - 1] + 1e-12:
            best[w], pick[w] = total[k], k + 1
        else:
            best[w] = best[w - 1]
    pattern: dict[int, int] = {}
    w = room
    while w:
        if pick[w]:
            pattern[int(pick[w])] = pattern.get(int(pick[w]), 0) + 1
            w -= int(pick[w])
        else:
            w -= 1
    return float(best[room]), pattern


def relaxed(demand: dict[int, int], room: int, gap: float = 1e-4,
            most: int = 6000) -> tuple[list[tuple[dict[int, int], float]], dict[int, float]]:
    """Patterns and fractional counts that cover ``demand`` with nearly the fewest sequences,
    and the duals: what a piece of each class costs, in sequences.

    Revised simplex from one pattern for each size; ends when the pricing
    problem proves the total within ``gap`` (or half a sequence) of the optimum.
    """
    sizes = sorted(demand)
    if not sizes:
        return [], {}
    row = {s: i for i, s in enumerate(sizes)}
    need = np.array([demand[s] for s in sizes], float)
    patterns = [{s: room // s} for s in sizes]
    inverse = np.diag([1.0 / (room // s) for s in sizes])
    count = inverse @ need
    worth = np.zeros(room + 1)
    for _ in range(most):
        dual = inverse.sum(0)
        worth[sizes] = dual
        value, pattern = knapsack(worth, room)
        if value <= 1 + 1e-9 or count.sum() * (1 - 1 / value) < max(0.5, gap * count.sum()):
            break
        column = np.zeros(len(sizes))
        for s, k in pattern.items():
            if s in row:
                column[row[s]] = k
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, count / step, np.inf)
        leave = int(ratio.argmin())
        move = ratio[leave]
        count -= move * step
        count[leave] = move
        pivot = inverse[leave] / step[leave]
        inverse -= np.outer(step, pivot)
        inverse[leave] = pivot
        patterns[leave] = {s: k for s, k in pattern.items() if s in row}
    return list(zip(patterns, np.maximum(count, 0))), dict(zip(sizes, inverse.sum(0)))


def filled(left: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Sequences for the few pieces left: the longest one, and the best subset sum beside it."""
    left = {s: k for s, k in left.items() if k > 0}
    out = []
    while left:
        longest = max(left)
        pattern = {longest: 1}
        left[longest] -= 1
        free = room - longest
        reach, steps = 1, []
        for s in sorted(left, reverse=True):
            for _ in range(min(left[s], free // s)):
                steps.append((s, reach))
                reach |= (reach << s) & ((1 << (free + 1)) - 1)
        at = reach.bit_length() - 1
        for s, before in reversed(steps):
            if not before >> at & 1:
                pattern[s] = pattern.get(s, 0) + 1
                left[s] -= 1
                at -= s
        left = {s: k for s, k in left.items() if k > 0}
        out.append((pattern, 1))
    return out


def plan(demand: dict[int, int], room: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Patterns with whole counts, and how many pieces of each class are given up as filling.

    Every other piece has its place in a pattern exactly once.
    """
    total = sum(s * k for s, k in demand.items())
    give: dict[int, int] = {}
    while True:
        whole = {s: k - give.get(s, 0) for s, k in demand.items() if k > give.get(s, 0)}
        fractions, duals = relaxed(whole, room)
        left, out = dict(whole), []
        for pattern, count in fractions:
            times = min([int(count + 1e-6), *(left[s] // k for s, k in pattern.items())])
            if times > 0:
                out.append((pattern, times))
                for s, k in pattern.items():
                    left[s] -= k * times
        out += filled(left, room)
        empty = sum(times * (room - sum(s * k for s, k in p.items())) for p, times in out)
        short = empty - sum(s * k for s, k in give.items())
        if short <= PADDING * total or not whole:
            return out, give
        # a piece given up saves its dual in sequences, so much less room is empty or wanting
        for s in sorted((s for s in whole if s < room), key=lambda s: (s / room - duals[s], -s)):
            saves = max(duals[s], s / room) * room
            more = min(whole[s], int(-(-short // saves)))
            give[s] = give.get(s, 0) + more
            short -= more * saves
            if short <= 0:
                break
        else:
            if all(s >= room for s in whole):
                return out, give


def ranges(patterns: list[tuple[dict[int, int], int]], give: dict[int, int]) -> dict[int, np.ndarray]:
    """For each class, rows (first rank, first sequence, pieces of a sequence) by rank; the ranks given up come first."""
    used = dict(give)
    rows: dict[int, list] = {}
    sequence = 0
    for pattern, times in patterns:
        for s, k in pattern.items():
            rows.setdefault(s, []).append((used.get(s, 0), sequence, k))
            used[s] = used.get(s, 0) + k * times
        sequence += times
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def room_left(patterns: list[tuple[dict[int, int], int]], room: int) -> np.ndarray:
    """Rows (first position in the empty room, first sequence, tokens empty in each); the last row never ends."""
    rows, at, sequence = [], 0, 0
    for pattern, times in patterns:
        empty = (room - sum(s * k for s, k in pattern.items())) * GRAIN
        if empty:
            rows.append((at, sequence, empty))
            at += empty * times
        sequence += times
    return np.array(rows + [(at, sequence, room * GRAIN)], np.int64)


def ranked(df: DataFrame) -> DataFrame:
    """``rank`` of each piece in its class by chunk and (doc_id, start), without a task for a whole class."""
    chunk = F.pmod(F.xxhash64(DOC, "start"), F.lit(CHUNKS))
    df = df.withColumn("chunk", chunk)
    # classes times CHUNKS rows
    before = Window.partitionBy("class").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (df.groupBy("class", "chunk").agg(F.count("*").alias("c"))
            .select("class", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base")))
    own = Window.partitionBy("class", "chunk").orderBy(DOC, "start", "ids_crc32", "doc_tokens")
    return (df.withColumn("own", F.row_number().over(own) - 1).join(base, ["class", "chunk"])
            .withColumn("rank", F.col("base") + F.col("own")).drop("base", "own"))


def filling(docs: DataFrame, given: DataFrame, empty: np.ndarray, vocabulary: str, length: int) -> DataFrame:
    """The given-up pieces laid over the empty room and cut at the ends of sequences."""
    groups = given.groupBy("class", "chunk").agg(F.sum("length").alias("tokens"))
    # one row for each class and chunk, so bounded by their number
    before = Window.orderBy("class", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("class", "chunk", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("x0"))
    own = (Window.partitionBy("class", "chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = (given.withColumn("x1", F.coalesce(F.sum("length").over(own), F.lit(0))).join(base, ["class", "chunk"])
              .select(*key, (F.col("x0") + F.col("x1")).alias("x")))
    # ids may be null: they are equal here
    wanted = given.select(F.col(DOC).alias("_doc")).distinct()
    again = texts(docs).join(wanted, F.col(DOC).eqNullSafe(F.col("_doc")), "left_semi")
    cut_again = pieces(again, vocabulary, length, ids_too=True).dropDuplicates(key)
    cut_again = cut_again.select(*[F.col(k).alias(f"_{k}") for k in key], "ids")
    same = F.col(DOC).eqNullSafe(F.col(f"_{DOC}"))
    for k in key[1:]:
        same = same & (F.col(k) == F.col(f"_{k}"))
    with_ids = placed.join(cut_again, same).select(*key, "x", "ids")

    def rows(batches):
        for b in batches:
            out = []
            for doc, start, size, _, total, x, ids in zip(*(b.column(c).to_pylist() for c in [*key, "x", "ids"])):
                at = 0
                while at < size:
                    k = int(np.searchsorted(empty[:, 0], x + at, "right")) - 1
                    first, sequence, each = empty[k].tolist()
                    done, inside = divmod(x + at - first, each)
                    n = min(size - at, each - inside)
                    out.append((doc, start + at, n, zlib.crc32(ids[4 * at:4 * (at + n)]), total,
                                0, sequence + done, x + at))
                    at += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 [*key, "class", "sequence_id", "slot"])

    return with_ids.mapInArrow(rows, PLACED)


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """One row for each piece, with its sequence and its offset there."""
    room = length // GRAIN
    parts = saved(pieces(docs, vocabulary, length).withColumn("class", F.ceil(F.col("length") / GRAIN)), "pieces")
    demand = {r["class"]: r["count"] for r in parts.groupBy("class").count().collect()}  # at most ``room`` rows
    patterns, give = plan(demand, room)
    where, empty = ranges(patterns, give), room_left(patterns, room)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def rows(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cls = b.column("class").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                at = np.flatnonzero(cls == c)
                first, base, per = where[int(c)].T
                k = np.searchsorted(first, rank[at], "right") - 1
                inside = rank[at] - first[k]
                seq[at], slot[at] = base[k] + inside // per[k], inside % per[k]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [b.column("class"), pa.array(seq), pa.array(slot)],
                                             columns + ["class", "sequence_id", "slot"])

    ranks = ranked(parts)
    if give:
        ranks = saved(ranks, "ranks")
        limit = F.coalesce(F.create_map(*[F.lit(x) for kv in give.items() for x in kv])[F.col("class").cast("int")], F.lit(0))
        given, ranks = ranks.where(F.col("rank") < limit), ranks.where(F.col("rank") >= limit)
    placed = ranks.select(*columns, "class", "rank").mapInArrow(rows, PLACED)
    if give:
        placed = placed.unionByName(filling(docs, given, empty, vocabulary, length))
    before = (Window.partitionBy("sequence_id").orderBy(F.desc("class"), "slot")
              .rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every document that is left, as pieces of sequences."""
    return packed(docs)
