"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as UTF-8 bytes with A-Z in lower case and runs of
white space as one space. An item of ``n`` bytes may appear with up to
``n // PER_ERROR`` edits. It is split into one piece more than that, so any such
appearance holds at least one piece unchanged: all pieces of all items are sought
at once by an Aho-Corasick automaton, and the text around each hit is verified by
Myers' bit-parallel edit distance.

Items are taken in blocks of at most ``BLOCK_BYTES`` (one automaton, sent to
every task); a larger benchmark takes several passes over the documents, so
nothing sent out grows with the tables. Items of fewer than ``LEAST`` bytes are sought
without edits and between word borders, so that they are not found within other words;
null and empty texts match nothing.
A doc_id or item_id that is null is kept in the result as null; repeated items or
documents give one row for each pair of ids (the closest match).
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm import arrays as A
from storepulse.llm.tables import DOC, saved, table, texts

PER_ERROR = 16
LEAST = 32
BLOCK_BYTES = 4 << 20
_FOLD = bytes(A.LOWER)
WORD = [48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)]  # of folded text
SCHEMA = "doc_id long, item_id long, distance long, start long"


def folded(raw: bytes) -> bytes:
    return b" ".join(raw.translate(_FOLD).split())


def edits(item: bytes) -> int:
    return len(item) // PER_ERROR if len(item) >= LEAST else 0


def bordered(text: bytes, start: int, end: int) -> bool:
    """Whether no word of ``text`` goes on over either end of the range."""
    return not any(0 < at < len(text) and WORD[text[at - 1]] and WORD[text[at]] for at in (start, end))


def nearest(item: bytes, text: bytes) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to a substring of ``text``, and that substring's (first) end."""
    n = len(item)
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for i, c in enumerate(text):
        eq = where.get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        gain, loss = down | (full & ~(diag | up)), up & diag
        score += bool(gain & top) - bool(loss & top)
        gain, loss = (gain << 1) & full, (loss << 1) & full  # row 0 stays 0: a match may start anywhere
        up, down = loss | (full & ~(diag | gain)), gain & diag
        if score < best:
            best, end = score, i + 1
    return best, end


class Finder:
    """The items of one block: pieces in an automaton, built once in each task."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.items = items
        pieces: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(items):
            parts = edits(item) + 1
            for j in range(parts):
                a, b = j * len(item) // parts, (j + 1) * len(item) // parts
                pieces.setdefault(item[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(item number, distance, start) of the closest match of each item found in the text."""
        text = folded(raw)
        hits: dict[int, set[int]] = {}
        if self.items:
            for last, (size, places) in self.automaton.iter(text.decode("latin-1")):
                for k, a in places:
                    hits.setdefault(k, set()).add(last + 1 - size - a)
        found = []
        for k, starts in hits.items():
            item = self.items[k][1]
            budget = edits(item)
            best = (budget + 1, 0)
            exact = [s for s in starts if s >= 0 and text.startswith(item, s)
                     and (len(item) >= LEAST or bordered(text, s, s + len(item)))]
            if exact:
                best = (0, min(exact))
            elif budget:
                done = -1
                for s in sorted(starts):
                    if s <= done:  # the window before this one covers it
                        continue
                    a, b = max(0, s - budget), s + len(item) + 2 * budget
                    done = s + budget
                    distance, end = nearest(item, text[a:b + budget])
                    best = min(best, (distance, max(0, a + end - len(item))))
            if best[0] <= budget:
                found.append((k, *best))
        return found


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES):
    """Lists of distinct folded items, each list of at most ``size`` bytes or one item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    block, used = [], 0
    for row in items.toLocalIterator():
        item = folded(row["text"].encode())
        if not item:
            continue
        if block and used + len(item) > size:
            yield block
            block, used = [], 0
        block.append((row["item_id"], item))
        used += len(item)
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance and start (byte in the folded text) of every pair that matches."""
    spark = docs.sparkSession
    src = texts(docs)
    out = None
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def rows(batches, sent=sent):
            finder = Finder(sent.value)
            for part in A.slices(batches):
                got = [(i, finder.items[k][0], d, s) for i, t in zip(part.column(DOC).to_pylist(), part.column("text"))
                       if t.is_valid for k, d, s in finder.matches(t.as_buffer().to_pybytes())]
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*got)], ["doc_id", "item_id", "distance", "start"])

        found = src.mapInArrow(rows, SCHEMA)
        out = found if out is None else saved(out.unionByName(found), "leaks")
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    return (out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start")).alias("m"))
            .select("doc_id", "item_id", "m.distance", "m.start"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents in which no benchmark item appears, unchanged."""
    hit = leaks(docs, table(spark, sf_dir, "benchmark")).select(DOC).distinct()
    return docs.join(hit, DOC, "left_anti").select(*docs.columns)
