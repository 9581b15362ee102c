"""Toxicity by noisy-channel restoration.

Words may be written with look-alike characters (``1d10t``), with gaps
(``i d i o t``) or with repeated letters (``stuuupid``). Each suspicious token becomes
a lattice: a position offers its own character and the letters it may stand for, a
gap is an arc that says nothing or ends a word, a run of one letter may shrink to one or two. Viterbi decoding
under a character trigram model, trained on the words of all documents, picks
the best path; the restored words are added to the text. Short fragments side by side (``id iot``) are lattices
of their letters and gaps too; each gap's two arcs are compared at once for a whole batch. The marks ``CLOSING`` at a token's
end may also stand for nothing; what is then written as it stood is not added again.

The restored text is scored by words and word beginnings: their log-odds in toxic
and other labelled documents make a lexicon (of all that ``LEAST_DOCS`` and ``LEAST_WEIGHT`` leave, from at
most ``SAMPLE`` labelled rows, the smallest by a hash of the id). What the lexicon
finds in a document (how many words, their weights, the share of the text) goes
through boosted trees. The trees are trained on lexicon counts of the other half of
the sample, so that they see evidence as weak as on new documents.

Null or empty texts have no words and score low, like any text without finds.
Null labels and ids are not learnt from; without both classes the score is constant.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm import arrays as A
from storepulse.llm.quality import Trees, grow, held_out, labelled
from storepulse.llm.tables import DOC, table, texts

SAMPLE = 12_000
LEAST_DOCS = 3
LEAST_WEIGHT = 2.0
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.5
# the letters a character may stand for
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "il", "+": "t", "|": "il"}
ALPHABET = " abcdefghijklmnopqrstuvwxyz~"  # word border and any other letter
SIZE = len(ALPHABET)
_CODE = np.full(256, SIZE - 1, np.int64)
_CODE[97:123] = np.arange(1, 27)
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
# of a letter and a look-alike in any places, or three equal letters; of look-alikes alone: with @ or two marks, not all equal
SUSPICIOUS = re.compile(
    rb"(?=[a-z0-9@$!+|]*[a-z])(?=[a-z]*[0-9@$!+|])[a-z0-9@$!+|]+"
    rb"|(?<![0-9@$!+|])(?=[0-9$!+|]*@|[0-9]*[$!+|][0-9]*[$!+|])(?!(.)\1*(?![0-9@$!+|]))[0-9@$!+|]{3,}"
    rb"|[a-z]*([a-z])\2\2[a-z]*")
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[97:123] = True
LOOK = np.zeros(256, bool)
LOOK[list(b"0123456789@$!+|")] = True
PART = ASCII_LETTER | LOOK
GAP = np.zeros(256, bool)
GAP[list(b" ._*-")] = True
MARK = np.zeros(256, bool)
MARK[list(b"@$!+|")] = True
GAPS = re.compile(r"[ ._*-]+")
CLOSING = "!|"  # marks that often only end a word
SPELT = 3  # single characters with gaps that make a spelt word
LONGEST = 64  # characters of a lattice; longer ones are decoded in windows that overlap by ``OVERLAP``
OVERLAP = 24
WIDE = 1.5  # what it costs to read on over a gap of two characters
FRAGMENT = 4  # letters of a fragment at most
MARGIN = 0.5  # by which reading on must be likelier than a word's end between fragments


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams within words over all documents: one bounded vector."""

    def rows(batches):
        total = np.zeros(SIZE ** 3, np.int64)
        for part in A.slices(batches):
            data, offs = A.flat(part.column("text"))
            low = A.LOWER[data]
            start, end = A.spans(LETTER[low], offs)
            keep = np.zeros(len(low), bool)
            keep[A.ragged(start, end - start)] = True
            c = np.where(keep, _CODE[low], 0)
            c = np.concatenate([[0, 0], c, [0, 0]])
            total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(SIZE ** 3)
    got = texts(docs).mapInArrow(rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for r in got.collect():  # at most 28 ** 3 rows
        out[r["gram"]] = r["n"]
    return out.reshape(SIZE, SIZE, SIZE)


class Channel:
    """Decodes suspicious tokens under the character model."""

    def __init__(self, counts: np.ndarray):
        pair = counts.sum(2, keepdims=True)
        single = counts.sum((0, 1))
        back = (single + 1) / (single.sum() + SIZE)
        middle = (counts.sum(0) + 4 * back) / (counts.sum((0, 2))[:, None] + 4)
        self.table = np.log((counts + 2 * middle) / (pair + 2))
        self.model = self.table.tolist()
        self.known: dict[bytes, bytes] = {}

    def restore(self, token: bytes) -> bytes:
        if token not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            text = GAPS.sub(lambda m: " " if len(m[0]) == 1 else "_", token.decode("ascii", "replace"))
            found = [self.decode(text[at:at + LONGEST]) for at in range(0, max(1, len(text) - OVERLAP), LONGEST - OVERLAP)]
            self.known[token] = " ".join(found).encode()
        return self.known[token]

    def decode(self, text: str) -> str:
        """The most likely words: Viterbi over (last two letters), one step for each run of equal characters or gap."""
        runs = [(m[0][0], len(m[0]), m.start()) for m in re.finditer(r"(.)\1*", text)]
        core = len(text.rstrip(CLOSING)) or len(text)
        paths = {(0, 0): (0.0, "")}
        for char, n, at in runs:
            if char in " _":
                cost = WIDE if char == "_" else 0.0
                ends = max((s + self.model[x][y][0], w + " ") for (x, y), (s, w) in paths.items())
                paths = {k: (s - cost, w) for k, (s, w) in paths.items()}
                if (0, 0) not in paths or paths[0, 0][0] < ends[0]:
                    paths[0, 0] = ends
                continue
            letters = [char] if char.isalpha() else list(LOOKS.get(char, "")) or [""]
            step: dict[tuple[int, int], tuple[float, str]] = dict(paths) if at >= core else {}
            for (x, y), (score, word) in paths.items():
                for letter in letters:
                    if not letter:  # no letter looks like it: it ends nothing and says nothing
                        if (x, y) not in step or step[x, y][0] < score:
                            step[x, y] = score, word
                        continue
                    c = ord(letter) - 96
                    a, b, s, w = x, y, score, word
                    for _ in range(min(n, 2)):  # a run stands for one letter or two
                        s += self.model[a][b][c]
                        w += letter
                        a, b = b, c
                        if (a, b) not in step or step[a, b][0] < s:
                            step[a, b] = s, w
            paths = step
        return max((s + self.model[x][y][0], w) for (x, y), (s, w) in paths.items())[1]

    def joined_fragments(self, low: np.ndarray, offs: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of short fragments whose gaps are likelier nothing than a word's end: for each gap, the letters around
        it under both arcs."""
        start, end = A.spans(LETTER[low], offs)
        if len(start) < 2:
            return []
        a, b = slice(0, -1), slice(1, None)
        size = end - start
        short = (size <= FRAGMENT) & ASCII_LETTER[low[start]]
        near = short[a] & short[b] & (start[b] - end[a] == 1) & GAP[low[end[a]]]
        near &= np.searchsorted(offs, start[b], "right") == np.searchsorted(offs, start[a], "right")
        at = np.flatnonzero(near)
        if not len(at):
            return []
        code = _CODE[low]
        x1, y1 = code[end[at] - 1], code[start[at + 1]]
        x2 = np.where(size[at] > 1, code[np.maximum(end[at] - 2, 0)], 0)
        y2 = np.where(size[at + 1] > 1, code[np.minimum(start[at + 1] + 1, len(code) - 1)], 0)
        m = self.table
        on, over = m[x2, x1, y1] + m[x1, y1, y2], m[x2, x1, 0] + m[0, 0, y1] + m[0, y1, y2]
        joined = np.zeros(len(start), bool)
        joined[at[on > over + MARGIN]] = True
        first, last = A.spans(joined, np.array([0, len(joined)]))
        return [(int(start[i]), int(end[j])) for i, j in zip(first, last)]

    def restored(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The texts in lower case, each followed by its restored words: bytes and offsets."""
        data, offs = A.flat(column)
        low = A.LOWER[data]
        extra: dict[int, set[bytes]] = {}
        for start, end in suspicious_words(low, offs):
            doc = int(np.searchsorted(offs, start, "right")) - 1
            for m in SUSPICIOUS.finditer(low[start:end].tobytes()):
                if (word := self.restore(m[0])) != m[0].rstrip(CLOSING.encode()):
                    extra.setdefault(doc, set()).add(word)
        for start, end in spelt_words(low, offs):
            doc = int(np.searchsorted(offs, start, "right")) - 1
            extra.setdefault(doc, set()).add(self.restore(low[start:end].tobytes()))
        for start, end in self.joined_fragments(low, offs):
            doc = int(np.searchsorted(offs, start, "right")) - 1
            extra.setdefault(doc, set()).add(GAPS.sub("", low[start:end].tobytes().decode()).encode())
        if not extra:
            return low, offs
        parts, at = [], 0
        size = np.diff(offs)
        for doc in sorted(extra):
            more = b"\n" + b" ".join(sorted(extra[doc])) + b"\n"
            parts += [low[at:offs[doc + 1]], np.frombuffer(more, np.uint8)]
            size[doc] += len(more)
            at = offs[doc + 1]
        return np.concatenate([*parts, low[at:]]), np.concatenate([[0], np.cumsum(size)])


def suspicious_words(low: np.ndarray, offs: np.ndarray) -> list[tuple[int, int]]:
    """Words between white space that hold a look-alike and a letter or two marks or @, or three equal letters."""
    if len(low) < 2:
        return []
    letter = ASCII_LETTER[low]
    start, end = A.spans(~A.SPACE[low], offs)
    word = lambda at: np.searchsorted(start, np.flatnonzero(at), "right") - 1
    look = np.unique(word(LOOK[low]))
    marks = np.bincount(word(MARK[low]), minlength=len(start))
    has = np.append(0, np.cumsum(letter))
    hit = look[(has[end[look]] > has[start[look]]) | (marks[look] > 1)]
    at = np.zeros(len(low), bool)
    at[:-2] = letter[:-2] & (low[:-2] == low[1:-1]) & (low[:-2] == low[2:])
    hit = np.union1d(hit, np.concatenate([word(at), word(low == ord("@"))]))
    return list(zip(start[hit].tolist(), end[hit].tolist()))


def spelt_words(low: np.ndarray, offs: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of at least ``SPELT`` characters, each alone or doubled, with one or two gap characters between them."""
    start, end = A.spans(PART[low] | (low >= 128), offs)
    if not len(start):
        return []
    twice = (end - start == 2) & (low[start] == low[end - 1])
    one = ((end - start == 1) | twice) & PART[low[start]]
    if one.sum() < SPELT:
        return []
    apart = start[1:] - end[:-1]
    border = np.searchsorted(offs, start, "right")
    joined = one[1:] & one[:-1] & (apart <= 2) & GAP[low[end[:-1]]] & GAP[low[start[1:] - 1]] & (border[1:] == border[:-1])
    first, last = A.spans(joined, np.array([0, len(joined)]))
    return [(int(start[a]), int(end[b])) for a, b in zip(first, last) if b - a + 1 >= SPELT]


def features(column, channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and word beginnings of the restored texts (rows: words), and documents' ranges."""
    data, offs = channel.restored(column)
    start, end = A.spans(LETTER[data], offs)
    keep = end - start >= 3
    start, end = start[keep], end[keep]
    kinds = [A.span_hashes(data, start, end)]
    for k, n in enumerate(BEGINNINGS):
        long = end - start > n
        h = A.span_hashes(data, start, np.minimum(end, start + n)) ^ A.STEP[k]
        kinds.append(np.where(long, h, A.U64(0)))
    return np.stack(kinds, 1), np.searchsorted(start, offs)


def fold(doc_id) -> F.Column:
    return (F.floor(F.crc32(doc_id.cast("string")) / 5) % 2).cast("int")


class Lexicon:
    def __init__(self, key: np.ndarray, toxic: np.ndarray, other: np.ndarray, totals: tuple[float, float]):
        weight = np.log((toxic + 0.5) / (totals[0] + 1)) - np.log((other + 0.5) / (totals[1] + 1))
        keep = (toxic >= LEAST_DOCS) & (weight >= LEAST_WEIGHT)
        order = np.argsort(key[keep])
        self.key, self.weight = key[keep][order], weight[keep][order]

    def statistics(self, hashes: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        n = len(ranges) - 1
        x = np.zeros((n, 7))
        counts = np.diff(ranges)
        x[:, 0] = np.log1p(counts)
        if not len(self.key) or not len(hashes):
            return x
        at = np.minimum(np.searchsorted(self.key, hashes), len(self.key) - 1)
        weight = np.where(self.key[at] == hashes, self.weight[at], 0).max(1)
        hit = np.flatnonzero(weight)
        doc = np.searchsorted(ranges, hit, "right") - 1
        w = weight[hit]
        x[:, 1] = np.bincount(doc, minlength=n)
        x[:, 2] = np.bincount(doc, w, minlength=n)
        np.maximum.at(x[:, 3], doc, w)
        x[:, 4] = x[:, 1] / np.maximum(counts, 1)
        x[:, 5] = np.bincount(doc, w > 4, minlength=n)
        x[:, 6] = x[:, 5] / np.maximum(counts, 1)
        return x


class Model:
    def __init__(self, channel: Channel, lexicon: Lexicon, trees: Trees):
        self.channel, self.lexicon, self.trees = channel, lexicon, trees

    def score(self, column) -> np.ndarray:
        return self.trees.score(self.lexicon.statistics(*features(column, self.channel)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    channel = Channel(trigram_counts(docs))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(channel)
    chosen = labelled(docs, labels, "toxic", sample).withColumn("half", fold(F.col(DOC)))

    def counted(batches):
        for part in A.slices(batches):
            hashes, ranges = features(part.column("text"), sent.value)
            toxic = part.column("label").to_numpy(zero_copy_only=False) > 0
            half = part.column("half").to_numpy(zero_copy_only=False)
            for h in (0, 1):
                # a zero feature counts the documents themselves
                own = [(toxic[d], np.unique(np.append(hashes[ranges[d]:ranges[d + 1]], A.U64(0)))) for d in np.flatnonzero(half == h)]
                for kind in (True, False):
                    some = [x for t, x in own if t == kind]
                    if some:
                        key, n = np.unique(np.concatenate(some), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.view(np.int64)), pa.array(n * (kind and h == 0)), pa.array(n * (not kind and h == 0)),
                             pa.array(n * (kind and h == 1)), pa.array(n * (not kind and h == 1))], ["key", "t0", "o0", "t1", "o1"])

    sums = (chosen.mapInArrow(counted, "key long, t0 long, o0 long, t1 long, o1 long").groupBy("key")
            .agg(*[F.sum(c).alias(c) for c in ("t0", "o0", "t1", "o1")])
            .where(F.col("t0") + F.col("t1") >= LEAST_DOCS)
            .where((F.col("key") == 0) | ((F.col("t0") + F.col("t1")) * 2 > F.col("o0") + F.col("o1")))).toPandas()  # features of at most ``sample`` documents
    total = sums[sums["key"] == 0]
    sums = sums[sums["key"] != 0]
    key = sums["key"].to_numpy(np.int64).view(np.uint64)

    def lexicon(*halves: int) -> Lexicon:
        t, o = (sum(sums[f"{c}{h}"].to_numpy(float) for h in halves) for c in "to")
        totals = tuple(float(sum(total[f"{c}{h}"].sum() for h in halves)) for c in "to")
        return Lexicon(key, t, o, totals)

    crossed = spark.sparkContext.broadcast((lexicon(1), lexicon(0)))  # each half is judged by the other

    def stats(batches):
        for part in A.slices(batches):
            hashes, ranges = features(part.column("text"), sent.value)
            half = part.column("half").to_numpy(zero_copy_only=False)
            x = np.where((half == 0)[:, None], *(lex.statistics(hashes, ranges) for lex in crossed.value))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    got = chosen.mapInArrow(stats, "label int, x array<double>").toPandas()  # at most ``sample`` rows
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, 7))
    y = (got["label"].to_numpy(float) > 0).astype(float)
    order = np.lexsort(np.c_[x, y].T)
    return Model(channel, lexicon(0, 1), grow(x[order], y[order], rounds=40, depth=3))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for part in A.slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(DOC), pa.array(sent.value.score(part.column("text")))], [DOC, "score"])

    return texts(docs).mapInArrow(rows, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(DOC, held_out(F.col(DOC)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
