"""The Jaccard join against plain sets."""

import numpy as np
import pytest

from storepulse.llm import incidence as I
from storepulse.llm.tables import table
from tests.llm.conftest import hard_rows, lower, plain_words


def plain_sets(rows):
    out = {}
    for doc, text, *_ in rows:
        w = plain_words(lower(text))
        got = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        out.setdefault(doc, []).append(got)
    return out


def plain_components(rows, limit):
    """Smallest id reachable, over all pairs of texts; ids with several texts tie them together."""
    nodes = [(d, s) for d, sets in plain_sets(rows).items() if d is not None for s in sets]
    up = {d: d for d, _ in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(nodes):
        for b, t in nodes[:i]:
            if s and t and 100 * len(s & t) >= limit * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in up}


def close_copies(rng, n, words=60, change=(0, 8)):
    """Copies of one text with some words changed, so that pairs lie on both sides of the limit."""
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, words, rng.integers(*change)):
            w[at] = f"x{rng.integers(10**9)}"
        out.append(" ".join(w))
    return out


def run(spark, path, limit=I.LIMIT):
    return I.jaccard_join(table(spark, path, "documents"), limit).collect()


def test_hard_rows(spark, tables):
    rows = hard_rows()
    got = run(spark, tables(rows))
    want = plain_components(rows, I.LIMIT)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    sizes = sorted((len(s) for sets in plain_sets(rows).values() for s in sets))
    assert sorted(r.n_shingles for r in got) == sizes


def test_empty_table(spark, tables):
    assert run(spark, tables([])) == []


@pytest.mark.parametrize("limit", [80, 60])
def test_pairs_around_the_limit(spark, tables, limit):
    """Groups of copies whose pairs lie on both sides, common lines that make frequent columns, and short texts."""
    rng = np.random.default_rng(limit)
    line = " ".join(f"c{i}" for i in range(30))
    texts = close_copies(rng, 60) + close_copies(rng, 40, words=25, change=(0, 3)) + [
        f"{line} " + " ".join(f"own{d}w{i}" for i in range(rng.integers(0, 20))) for d in range(60)]
    texts += [f"{line} a b", f"{line} a c", "one two", "one two", "one two three", "ONE two"]
    ids = rng.permutation(len(texts))
    rows = [(int(i), t, "en", "s", 1) for i, t in zip(ids, texts)]
    want = plain_components(rows, limit)
    got = {r.doc_id: r.component_id for r in run(spark, tables(rows), limit)}
    assert got == want


def test_blocks_when_waves_are_not_enough(spark, tables, monkeypatch):
    """Without pivots, and with blocks of few rows, the products alone find every link."""
    monkeypatch.setattr(I, "WAVES", 0)
    monkeypatch.setattr(I, "CELL_ROWS", 8)
    rng = np.random.default_rng(3)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(close_copies(rng, 70, change=(0, 6)))]
    got = {r.doc_id: r.component_id for r in run(spark, tables(rows))}
    assert got == plain_components(rows, I.LIMIT)


def test_product_links_against_all_pairs(monkeypatch):
    monkeypatch.setattr(I, "WIDTH", 16)
    rng = np.random.default_rng(1)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype(np.uint64) for _ in range(25)]
        label = rng.integers(0, 12, 25)
        up = {int(v): int(v) for v in label}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        def join(pairs):
            for a, b in pairs:
                x, y = sorted((root(int(label[a])), root(int(label[b]))))
                up[y] = x
            return [root(int(v)) for v in label]

        pairs = [(a, b) for a in range(25) for b in range(a) if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))]
        want = join(pairs)
        up.update({int(v): int(v) for v in label})
        found = I.product_links(label, sets)
        assert all(100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b])) for a, b in found)
        assert join(found) == want


def test_one_text_longer_than_a_slice(spark, tables):
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(5, long, "en", "s", 1), (3, long + " more", "en", "s", 1), (4, "short", "en", "s", 1)]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in run(spark, tables(rows))}
    assert got == {5: (3, 399_996), 3: (3, 399_997), 4: (4, 1)}
