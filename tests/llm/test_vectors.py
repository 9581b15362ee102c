"""Whitening against a full eigendecomposition, hard negatives against all pairs."""

import math

import numpy as np
import pytest

from storepulse.llm import negatives as N
from storepulse.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, score int, x int, uid string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, 2, "u") for i, v, l in rows], SCHEMA).repartition(3)


def exact(rows):
    kept = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in list(v) + [0.0] * (d - len(v))] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    return [i for i, _ in kept], x, n, sums


def hard_vectors(d=12, n=300):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(d) * np.linspace(1, 3, d)).astype(np.float32).tolist(), int(rng.integers(0, 10))) for i in range(n)]
    rows += [rows[3], rows[100], rows[7], (None, rows[9][1], 3), (1000, None, 1), (1001, [1.0] * (d - 1) + [None], 1),
             (1002, [float("nan")] * d, 2), (1003, [float("inf")] + [0.0] * (d - 1), 2), (1004, rows[5][1], None),
             (1100, [0.0] * d, 4), (1200, rows[0][1], rows[0][2]), (1005, rows[6][1][:4], 5)]
    return rows


def test_whitening_against_eigh(spark):
    rows = hard_vectors()
    got = W.whiten(vectors(spark, rows), 8).collect()
    ids, x, n, sums = exact(rows)
    x = np.array(x)
    c = (n * x - np.array(sums)) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    white = c @ u / np.sqrt(e)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    signs = {}
    for k in range(1, 9):
        mine = sorted(((r.deviation, r.whitened) for r in got if r.component == k))
        theirs = sorted((sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)), w) for row, w in zip(x, white[:, k - 1]))
        assert [m[0] for m in mine] == [t[0] for t in theirs]
        sign = np.sign(sum(a[1] * b[1] for a, b in zip(mine, theirs)))
        theirs = sorted((d, sign * w) for d, w in theirs)
        assert np.allclose([m[1] for m in mine], [t[1] for t in theirs], atol=1e-9)
        signs[k] = sign
        share = {r.explained for r in got if r.component == k}
        assert len(share) == 1 and abs(share.pop() - e[k - 1] / np.trace(c.T @ c / n)) < 1e-12
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    assert sorted((str(r.vec_id) for r in got if r.component == 1)) == sorted(map(str, ids))
    assert all(r.deviation == r.deviation_exact for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [0.5, 0.25], 0)], [(1, [0.5], 0), (2, [0.5], 1)], [(1, [], 0), (2, [], 1)]])
def test_nothing_to_whiten(spark, rows):
    assert W.whiten(vectors(spark, rows)).collect() == []


def test_flat_directions_are_left_out(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), float(a), float(b), 0.0], 0) for i, (a, b) in enumerate(rng.integers(-50, 50, (40, 2)))]
    got = W.whiten(vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-10


def test_large_entries(spark):
    got = W.whiten(vectors(spark, [(1, [1e30, 0.0], 0), (2, [-1e30, 1.0], 0), (3, [0.0, 5.0], 0)])).collect()
    assert got and all(r.deviation is None and r.deviation_exact > 1 << 63 for r in got if r.vec_id != 3)


@pytest.mark.parametrize("d,k", [(200, 32), (90, 5), (40, 40)])
def test_jacobi_davidson_to_double_precision(d, k):
    """Clustered, repeated and vanishing eigenvalues, by products alone."""
    rng = np.random.default_rng(d)
    e = np.sort(np.concatenate([np.full(4, 9.0), 5 + 1e-6 * np.arange(6), rng.random(d - 14), np.zeros(4)]))[::-1]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * e) @ q.T
    values, u = W.leading(lambda b: a @ b, d, k)
    assert np.abs(values - e[:k]).max() < 1e-13 * e[0] * 10
    assert np.linalg.norm(a @ u - u * values, axis=0).max() < 1e-12 * e[0]
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b, shift = rng.standard_normal((30, 3)), np.array([0.1, -0.2, 0.3])
    x = W.minres(lambda v: a @ v, lambda v: v, shift, b, 60)
    assert np.abs(a @ x - x * shift - b).max() < 1e-8


def plain_negatives(rows):
    table = []
    for i, v, label in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        moved = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        table.append((i, moved, [math.floor(256 * float(np.float32(c))) for c in v]))
    place = lambda r: (-r[0], math.inf if r[1] is None else r[1])
    out = []
    for at, (i, label, y) in enumerate(table):
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(y, z)), j, m) for k, (j, m, z) in enumerate(table) if k != at]
        for s, p, _ in sorted((r for r in scored if r[2] == label), key=place)[:5]:
            fit = sorted((r for r in scored if r[2] != label and 30 * s <= 100 * r[0] <= 90 * s), key=place)
            out += [(i, p, rank, j, s, t) for rank, (t, j, _) in enumerate(fit[:10], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("block,stride", [(4096, 16), (40, 1)])
def test_negatives_against_all_pairs(spark, monkeypatch, block, stride):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "STRIDE", stride)
    rows = hard_vectors()
    got = sorted(str(tuple(r)) for r in N.hard_negatives(vectors(spark, rows)).collect())
    assert got == plain_negatives(rows) and len(got) > 50


@pytest.mark.parametrize("rows", [[], [(100, [1.0], 1)], [(100, None, 1), (200, [1.0], None)], [(1, [1.0], 1), (2, [1.0], 2)]])
def test_no_negatives(spark, rows):
    assert N.hard_negatives(vectors(spark, rows)).collect() == []


def test_search_stops_early_and_keeps_ties():
    """One strong dimension: few rows are read; equal scores go by id although the larger id is met first."""
    rng = np.random.default_rng(2)
    y = rng.integers(-3, 4, (5000, 6))
    y[:, 0] = np.sort(rng.integers(0, 50, 5000)) * 100
    ids = np.arange(5000)[::-1].copy()
    block = N.Block(np.arange(5000), ids, np.zeros(5000, int), y)
    read = []
    scores = block.scores
    block.scores = lambda rows, a: read.append(len(rows)) or scores(rows, a)
    anchor = np.array([9, 1, 0, -1, 0, 0])
    rows, s = block.search(anchor, np.ones(5000, bool), [(None, None)], 10)[0]
    all_scores = y @ anchor
    want = np.lexsort((ids, -all_scores))[:10]
    assert rows.tolist() == want.tolist() and s.tolist() == all_scores[want].tolist()
    assert sum(read) < 2500


def test_scores_beyond_double_precision():
    y = np.array([[1 << 28, (1 << 28) - 1], [-(1 << 28), 5], [1 << 28, 1 << 28]])
    block = N.Block(np.arange(3), np.arange(3), np.zeros(3, int), y)
    a = np.array([(1 << 28) - 3, 1 << 28])
    assert block.scores(np.arange(3), a).tolist() == [sum(int(p) * int(q) for p, q in zip(r, a)) for r in y]
