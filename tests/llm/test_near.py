"""Near-duplicate join against all pairs, hard cases, large groups."""

import collections
import random

import pytest
from conftest import SF_SMALL

from llm.conftest import hard_rows, lower, plain_words
from storepulse.llm import near
from storepulse.llm.tables import components


def shingle_set(text):
    w = plain_words(lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = collections.defaultdict(set)
    for i, t in rows:
        if i is not None and (s := shingle_set(t)):
            sets[frozenset(s)].add(i)
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def union(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    kinds = list(sets)
    for s in kinds:
        first = min(sets[s])
        for i in sets[s]:
            union(first, i)
    for k, x in enumerate(kinds):
        for y in kinds[:k]:
            both = len(x & y)
            if 100 * both >= 85 * (len(x) + len(y) - both):
                union(min(sets[x]), min(sets[y]))
    return {i: find(i) for i in parent}


def check(spark, path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = near.op1_near_dedup(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id == r.component_id)
    sizes = sorted((r.doc_id or -1, r.n_shingles) for r in got)
    assert sizes == sorted((i or -1, len(shingle_set(t))) for i, t in rows)


def test_equals_all_pairs_on_the_small_tables(spark):
    check(spark, SF_SMALL)


def test_hard_cases_and_one_id_with_two_texts(spark, tables):
    check(spark, tables(hard_rows() + [(12, "lone text of its own kind here", "en", "s", 1), (12, hard_rows()[0][1], "en", "s", 1)]))


def test_empty_table(spark, tables):
    assert near.op1_near_dedup(spark, tables([])).count() == 0


def test_a_group_larger_than_a_leaf_goes_through_all_paths(spark, tables, monkeypatch):
    """Many near copies and near misses with tiny leaves: recursion and block pairs lose no link."""
    monkeypatch.setattr(near, "LEAF", 4)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"r{rng.randrange(4)}"
        rows.append((100 - i, " ".join(w), "en", "s", 1))
    check(spark, tables(rows, clashing=False))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (41, 39), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 42) if i in got) and all(got[i] == 100 for i in range(100, 140))


def test_stage_keeps_one_of_each_group(spark, tables):
    path = tables(hard_rows())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = near.keep_one(spark, docs, path)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {1, 4, 5, 6, 7, 8, 9, 10, 11, None}


@pytest.mark.parametrize("similarity", [0.85, 0.9])
def test_sketches_pass_pairs_at_the_limit(similarity):
    import numpy as np
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(40, 800))
        union = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        keep = int(np.ceil(similarity * len(union)))
        half = (len(union) - keep) // 2
        a, b = np.sort(union[:keep + half]), np.sort(np.concatenate([union[:keep], union[keep + half:]]))
        x, y = (np.frombuffer(near.sketch(s), np.uint8) for s in (a, b))
        assert near.similar(x, y[None])[0]


def test_stage_links_pairs_of_eighty_percent(spark, tables):
    """The stage against all pairs at 0.8; pairs between 0.8 and the query's limit are among them."""
    rng = random.Random(8)
    rows = []
    for k in range(40):
        base = [f"g{k}w{i}" for i in range(204)]  # 200 shingles
        rows.append((2 * k, " ".join(base), "en", "s", 1))
        size = 36 + k // 4  # words cut from the end: similarity (200 - size) / 200, from 0.82 down to 0.775
        rows.append((2 * k + 1, " ".join(base[:len(base) - size]), "en", "s", 1))
    rng.shuffle(rows)
    path = tables(rows)
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    gone = {2 * k + 1 for k in range(40) if alike(2 * k, 2 * k + 1) >= 0.8}
    assert 10 < len(gone) < 40 and all(alike(i - 1, i) < 0.85 for i in gone)
    out = near.keep_one(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert {r.doc_id for r in out.collect()} == set(sets) - gone
