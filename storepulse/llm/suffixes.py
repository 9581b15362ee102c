"""Exact substring dedup: repeated byte strings by induced suffix sorting.

Every byte that lies in a ``WIDTH``-byte string which also starts earlier (in a
document of smaller id, or earlier in the same one) is removed.

1. The start of every ``WIDTH``-byte window is assigned to its anchor, the window's
   ``GRAM``-byte string of the smallest hash (leftmost if equal). Equal windows have
   equal anchors, so all places of a string meet in the shard of their anchor. The
   consecutive windows of one anchor are one fragment, sent as two hashes and its place.
2. Spark's external sort orders each shard (it spills to disk, so a shard may be
   far larger than memory). A stream over it drops fragments that nothing shares,
   marks all but the first of equal fragments as repeats, and keeps one of each
   where an anchor has several: only at the borders of copies.
3. These fragments' bytes are sorted by suffix, anchor groups in batches of
   ``BATCH`` bytes: suffixes are classified, the leftmost S-type substrings are sorted by
   induction and named, the string of names is solved recursively, and its order
   induces that of all suffixes. A bucket's queue is read in waves, as whole
   arrays. Neighbours in the order with ``WIDTH`` common bytes are places of one
   string; all but the first are repeats. Groups of over ``HUGE`` fragments, which no
   task should hold, are taken apart into windows, whose first places are found by
   a combining aggregation on their hashes.
4. Each document's repeats are merged and cut out.

Null and empty texts have no bytes; matches never cross documents. A doc_id is
taken to name one text: rows that repeat both count as one document and get the
same result; spans beyond the end of another text of the same id are ignored. Rows
with a null id are returned whole and compared with nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm import arrays as A
from storepulse.llm.passages import sliding_minimum
from storepulse.llm.tables import DOC, saved, table, texts

WIDTH = 100
GRAM = 37
BATCH = 1 << 20
WINDOW_BYTES = 256 << 10
HUGE = 20_000
FEW = 4096  # symbols for which buckets are worth their loop


def fragments(data: np.ndarray, offs: np.ndarray):
    """(document, anchor, content hash, start, windows) of every fragment."""
    n = len(data)
    if n < WIDTH:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(A.BYTE_VALUE[data] * A.power_table(A.BASE, n), out=sums[1:])
    inverse = A.power_table(A.BASE_INVERSE, n + 1)
    h = A.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:n - GRAM + 1])
    bits = A.U64(max(20, n.bit_length()))
    at = sliding_minimum((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), WIDTH - GRAM + 1)
    at = (at & ((A.U64(1) << bits) - A.U64(1))).astype(np.int64)
    place = np.arange(len(at))
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:len(at)]
    inside = place + WIDTH <= offs[doc + 1]
    cut = np.ones(len(at), bool)
    cut[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    first = np.flatnonzero(cut & inside)
    stops = np.flatnonzero(np.append(cut[1:] | ~inside[1:], True))
    last = stops[np.searchsorted(stops, first)]
    content = A.mix((sums[last + WIDTH] - sums[first]) * inverse[first] + A.STEP[5] * (last - first).astype(np.uint64))
    return doc[first], h[at[first]], content, first - offs[doc[first]], last - first + 1


def fragment_rows(docs: DataFrame) -> DataFrame:
    """anchor, content, doc_id, place (start * 64 + windows - 1)."""

    def rows(batches):
        for part in A.slices(batches):
            data, offs = A.flat(part.column("text"))
            ids = part.column(DOC).to_numpy(zero_copy_only=False)
            doc, anchor, content, start, n = fragments(data, offs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[doc], pa.int64()),
                 pa.array(start * 64 + n - 1)], ["anchor", "content", DOC, "place"])

    return texts(docs).where("doc_id is not null").mapInArrow(rows, "anchor long, content long, doc_id long, place long")


def sifted(sorted_rows: DataFrame) -> DataFrame:
    """Of a stream sorted by (anchor, content, doc_id, place): repeats (``again``), and the first
    of each fragment of an anchor that has several."""
    schema = "anchor long, doc_id long, place long, again boolean"

    def rows(batches):
        carried = None  # rows of the last anchor so far, as (anchor, content, doc_id, place) of its first fragment
        several = False  # whether that anchor has shown several fragments
        last_content = None
        for b in batches:
            if not b.num_rows:
                continue
            a, c, d, p = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            new_anchor = np.ones(len(a), bool)
            new_anchor[1:] = a[1:] != a[:-1]
            new_content = new_anchor.copy()
            new_content[1:] |= c[1:] != c[:-1]
            if carried is not None and carried[0] == a[0]:
                new_anchor[0] = False
                new_content[0] = c[0] != last_content
            # repeated rows of one document are one place
            twin = np.zeros(len(a), bool)
            twin[1:] = ~new_content[1:] & (d[1:] == d[:-1]) & (p[1:] == p[:-1])
            if not new_content[0]:
                twin[0] = (d[0], p[0]) == last_place
            again = ~new_content & ~twin
            first = np.flatnonzero(new_content)
            group = np.cumsum(new_anchor)[first]  # 0: the carried anchor's
            size = np.bincount(group, minlength=int(new_anchor.sum()) + 1)
            emit = np.zeros(len(a), bool)
            emit[first] = size[group] > 1
            if group.size and group[0] == 0:
                emit[first[group == 0]] = True
            out = [(a[again], d[again], p[again], True), (a[emit], d[emit], p[emit], False)]
            if size[0] and not several and carried is not None:
                out.append((np.array([carried[0]]), np.array([carried[1]]), np.array([carried[2]]), False))
            # the last anchor goes on in the next batch
            start = np.flatnonzero(new_anchor)
            if len(start):
                k = start[-1]
                carried, several = (int(a[k]), int(d[k]), int(p[k])), bool(size[-1] > 1)
            else:
                several = several or bool(size[0])
            last_content, last_place = c[-1], (d[-1], p[-1])
            for x, y, z, flag in out:
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.int64()),
                                                      pa.array(np.full(len(x), flag))], ["anchor", DOC, "place", "again"])

    return sorted_rows.mapInArrow(rows, schema)


def _by_symbol(at: np.ndarray, symbol: np.ndarray):
    order = np.argsort(symbol, kind="stable")
    at, symbol = at[order], symbol[order]
    cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    for part, s in zip(np.split(at, cuts), symbol[np.concatenate([[0], cuts])] if len(symbol) else []):
        yield int(s), part


def induced(text: np.ndarray, kind: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Order of all suffixes, induced from the order of the leftmost S-type ones (``seeds``).

    Buckets are read in turn; a wave is all of a bucket's queue that is known so far.
    """
    size = int(text.max()) + 1
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    small: list[list[np.ndarray]] = [[] for _ in range(size)]
    small[0].append(np.array([len(text) - 1]))  # no suffix after it induces it
    begin: list[np.ndarray] = [np.zeros(0, np.int64)] * size
    for s, part in _by_symbol(seeds, text[seeds]):
        begin[s] = part

    def push(wave: np.ndarray, s_type: bool, queue: list[list[np.ndarray]], own: int) -> np.ndarray:
        """Send the predecessors of the right type to their queues; returns those of the same bucket."""
        before = wave[wave > 0] - 1
        before = before[kind[before] == s_type]
        symbol = text[before]
        here = symbol == own
        for s, part in _by_symbol(before[~here], symbol[~here]):
            queue[s].append(part)
        return before[here]

    done_large: list[np.ndarray] = []
    for c in range(size):
        waves = []
        wave = np.concatenate(large[c]) if large[c] else begin[c][:0]
        while len(wave):
            waves.append(wave)
            wave = push(wave, False, large, c)
        done_large.append(np.concatenate(waves) if waves else begin[c][:0])
        push(begin[c], False, large, c)  # S-type, so their L-type predecessors are in larger buckets
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        waves = []
        wave = np.concatenate(small[c]) if small[c] else begin[c][:0]
        while len(wave):
            waves.append(wave)
            wave = push(wave, True, small, c)
        out += [*waves, done_large[c][::-1]]
        push(done_large[c][::-1], True, small, c)
    return np.concatenate(out)[::-1]


def doubled(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` symbols, by prefix doubling: the bottom of the recursion."""
    _, rank = np.unique(text, return_inverse=True)
    step, n = 1, len(text)
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= min(n, depth):
            return order


def suffix_order(text: np.ndarray, depth: int = 1 << 30) -> np.ndarray:
    """Order of all suffixes of ``text``, whose last symbol is 0 and smaller than all others.

    Suffixes that agree in their first ``depth`` symbols may come in any order.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    # S-type: smaller than the suffix after it; equal symbols take the type of the next different one
    differs = np.flatnonzero(text[:-1] != text[1:])
    nearest = differs[np.searchsorted(differs, np.arange(n - 1))] if len(differs) else np.zeros(0, np.int64)
    kind = np.ones(n, bool)
    kind[:-1] = text[nearest] < text[nearest + 1]
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    order = induced(text, kind, lms)
    mark = np.zeros(n, bool)
    mark[lms] = True
    ranked = order[mark[order]]
    # equal substrings, from one leftmost S-type position through the next, get equal names
    end = np.full(n, n)
    end[lms[:-1]] = lms[1:] + 1
    low = A.mix(text.astype(np.uint64) + A.U64(1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * A.power_table(A.BASE, n))])
    value = A.mix((sums[end[ranked]] - sums[ranked]) * A.power_table(A.BASE_INVERSE, n)[ranked]
                  + (end[ranked] - ranked).astype(np.uint64))
    name = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])])
    names = np.zeros(n, np.int64)
    names[ranked] = name
    names = names[lms]
    if name[-1] + 1 < len(lms):
        inner = suffix_order(names, depth) if name[-1] < FEW else doubled(names, depth)
        ranked = lms[inner]
    return induced(text, kind, ranked)


def repeats(raws: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of all windows of the fragments that are also found earlier."""
    size = np.array([len(r) for r in raws])
    data = np.frombuffer(b"".join(raws), np.uint8)
    begin = np.cumsum(size) - size
    text = np.ones(len(data) + len(raws) + 1, np.int64)  # 1 ends a fragment, 0 the batch
    text[np.arange(len(data)) + np.repeat(np.arange(len(raws)), size)] = data.astype(np.int64) + 2
    text[-1] = 0
    owner = np.repeat(np.arange(len(raws)), size + 1)
    offset = np.arange(len(owner)) - np.repeat(begin + np.arange(len(raws)), size + 1)
    whole = np.append(offset + WIDTH <= np.repeat(size, size + 1), False)
    order = suffix_order(text, WIDTH)
    order = order[whole[order]]
    equal = np.ones(len(order), bool)  # with the one before
    equal[:1] = False
    for a in range(0, len(order) - 1, 1 << 15):
        x, y = order[a:a + (1 << 15) + 1][:-1], order[a + 1:a + (1 << 15) + 1]
        m = min(len(x), len(y))
        x, y = x[:m], y[:m]
        live = np.arange(m)
        for k in (0, 50):  # most neighbours differ soon
            span = np.arange(k, k + 50)
            live = live[(text[x[live, None] + span] == text[y[live, None] + span]).all(1)]
        same = np.zeros(m, bool)
        same[live] = True
        equal[a + 1:a + 1 + m] = same
    group = np.cumsum(~equal) - 1
    doc, at = docs[owner[order]], starts[owner[order]] + offset[order]
    by = np.lexsort((at, doc, group))
    later = np.ones(len(by), bool)
    g = group[by]
    later[:1] = False
    later[1:] = g[1:] == g[:-1]
    # one place may come in two fragments of repeated rows
    doc, at = doc[by], at[by]
    twin = np.zeros(len(by), bool)
    twin[1:] = later[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
    first = np.flatnonzero(~later)
    lead = first[np.searchsorted(first, np.arange(len(by)), "right") - 1] if len(by) else first
    later &= ~(twin & (doc == doc[lead]) & (at == at[lead]))
    return doc[later], at[later]


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of each document joined."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    cut = np.ones(len(doc), bool)
    reach = b.copy()
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    for x, y in zip(edges, np.append(edges[1:], len(doc))):
        reach[x:y] = np.maximum.accumulate(b[x:y])
    cut[1:] = (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1])
    first = np.flatnonzero(cut)
    return doc[first], a[first], reach[np.append(first[1:], len(doc)) - 1]


SPANS = "doc_id long, a long, b long"


def _pieces(docs: DataFrame, amb: DataFrame) -> DataFrame:
    """anchor, doc_id, start, raw: the bytes of fragments."""
    wanted = amb.groupBy(DOC).agg(F.collect_list(F.struct("anchor", "place")).alias("f"))

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                          ["anchor", DOC, "start", "raw"])

    def rows(batches):
        out = []
        for part in A.slices(batches):
            for doc, t, f in zip(part.column(DOC).to_pylist(), part.column("text"), part.column("f").to_pylist()):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                for x in f:
                    start, n = x["place"] >> 6, (x["place"] & 63) + 1
                    piece = raw[start:start + n + WIDTH - 1]
                    if len(piece) >= WIDTH:
                        out.append((x["anchor"], doc, start, piece))
                    if len(out) >= 10_000:
                        yield batch(out)
                        out = []
        if out:
            yield batch(out)

    return texts(docs).join(wanted, DOC).mapInArrow(rows, "anchor long, doc_id long, start long, raw binary")


def border_spans(docs: DataFrame, amb: DataFrame) -> DataFrame:
    """Spans found by suffix sorting of the kept fragments' bytes, groups of one anchor in one batch."""

    def sort(batches):
        def solved():
            doc, at = repeats(raws, np.array(ids, np.int64), np.array(starts, np.int64))
            doc, a, b = _merged(doc, at, at + WIDTH)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(a), pa.array(b)], [DOC, "a", "b"])

        raws, ids, starts, held, last = [], [], [], 0, None
        for b in batches:
            for key, doc, start, raw in zip(*(b.column(k).to_pylist() for k in range(4))):
                if held >= BATCH and key != last:
                    yield solved()
                    raws, ids, starts, held = [], [], [], 0
                raws.append(raw)
                ids.append(doc)
                starts.append(start)
                held += len(raw)
                last = key
        if raws:
            yield solved()

    return _pieces(docs, amb).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, SPANS)


def window_spans(docs: DataFrame, amb: DataFrame) -> DataFrame:
    """The same for anchors of too many fragments: first places by the hash of each window, combined before the shuffle."""

    def rows(batches):
        for part in A.slices(batches, "raw", WINDOW_BYTES):
            data, offs = A.flat(part.column("raw"))
            n = np.diff(offs) - WIDTH + 1
            at = A.ragged(offs[:-1], n)
            own = np.repeat(np.arange(len(n)), n)
            ids = part.column(DOC).to_numpy(zero_copy_only=False)[own]
            start = part.column("start").to_numpy(zero_copy_only=False)[own] + at - offs[own]
            # two independent hashes make 128 bits
            k1, k2 = (A.span_hashes(x, at, at + WIDTH).view(np.int64) for x in (data, data ^ np.uint8(0xA5)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k1, k2, ids, start)], ["k1", "k2", DOC, "start"])

    windows = _pieces(docs, amb).mapInArrow(rows, "k1 long, k2 long, doc_id long, start long")
    first = windows.groupBy("k1", "k2").agg(F.min(F.struct(DOC, "start")).alias("first"))
    return (windows.join(first, ["k1", "k2"])
            .where((F.col(DOC) != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
            .select(DOC, F.col("start").alias("a"), (F.col("start") + WIDTH).alias("b")))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (start, end) of bytes that are repeats."""
    rows = fragment_rows(docs).repartition("anchor").sortWithinPartitions("anchor", "content", DOC, "place")
    found = saved(sifted(rows), "fragments")
    start, n = F.shiftright("place", 6), F.col("place").bitwiseAND(63) + 1
    whole = found.where("again").select(DOC, start.alias("a"), (start + n + WIDTH - 1).alias("b"))
    kept = found.where("not again").drop("again")
    huge = saved(kept.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HUGE).select("anchor"), "huge-anchors")
    if huge.isEmpty():
        border = border_spans(docs, kept)
    else:
        border = border_spans(docs, kept.join(huge, "anchor", "left_anti")).unionByName(
            window_spans(docs, kept.join(huge, "anchor", "left_semi")))
    return (whole.unionByName(border).groupBy(DOC)
            .agg(F.collect_list(F.struct("a", "b")).alias("spans")))  # at most one document's


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of what is left, one row for each row of ``docs``."""

    def rows(batches):
        for part in A.slices(batches):
            data, offs = A.flat(part.column("text"))
            out = []
            for d, spans in enumerate(part.column("spans").to_pylist()):
                raw = data[offs[d]:offs[d + 1]].tobytes()
                keep, at, gone, k = [], 0, 0, 0
                if spans:
                    a = np.array([x["a"] for x in spans])
                    b = np.minimum([x["b"] for x in spans], len(raw))
                    some = a < b
                    _, a, b = _merged(np.zeros(some.sum(), np.int64), a[some], b[some])
                    for x, y in zip(a.tolist(), b.tolist()):
                        keep.append(raw[at:x])
                        gone += y - x
                        k += 1
                        at = y
                keep.append(raw[at:])
                out.append((len(raw), gone, k, hashlib.sha256(b"".join(keep)).hexdigest()))
            n, gone, k, digest = zip(*out)
            yield pa.RecordBatch.from_arrays([part.column(DOC), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(k, pa.int64()), pa.array(digest)],
                                             [DOC, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return (texts(docs).join(removed(docs), DOC, "left").select(DOC, "text", "spans")
            .mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))
