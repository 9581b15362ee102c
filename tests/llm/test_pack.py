"""Packing: exact ids, gapless sequences, little padding, the programs inside."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import SF_SMALL
from tokenizers import Tokenizer

from llm.conftest import hard_rows
from storepulse.llm import pack
from storepulse.llm.tokens import Encoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(spark, path, tokenizer, padding):
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    ids = sorted(((r.doc_id is None, r.doc_id or 0), tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs)
    got = pack.op2_packing(spark, path).toPandas()
    seq = got.sort_values(["sequence_id", "offset"])
    assert ((seq.groupby("sequence_id").length.cumsum() - seq.length) == seq.offset).all()
    total = seq.groupby("sequence_id").length.sum()
    assert total.max() <= 2048
    wasted = sum(0 if t & (t - 1) == 0 else 2048 - t for t in total)
    assert wasted <= padding * total.sum() + 2048
    pieces = sorted(zip(got.doc_id.isna(), got.doc_id.fillna(0), got.start, got.length, got.ids_crc32, got.doc_tokens))
    want = [(none, doc, own) for (none, doc), own in ids]
    # every piece's checksum is that of its ids, and together the pieces of a document hold each id once
    by_doc = {}
    for none, doc, own in want:
        by_doc.setdefault((none, doc if not none else 0), []).append(own)
    counts = {}
    for none, doc, start, length, crc, tokens in pieces:
        options = [o for o in by_doc[(none, doc)] if len(o) == tokens and zlib.crc32(np.array(o[start:start + length], "<u4")) == crc]
        assert options
        counts[(none, doc)] = counts.get((none, doc), 0) + length
    assert counts == {k: sum(map(len, v)) for k, v in by_doc.items()}


def test_small_tables(spark, tokenizer):
    check(spark, SF_SMALL, tokenizer, 0.02)


def test_hard_cases(spark, tables, tokenizer):
    check(spark, tables(hard_rows()), tokenizer, 0.2)


def test_filling_cuts_pieces_where_whole_ones_leave_room(spark, tables, tokenizer):
    """Documents of about 1100 tokens share no sequence whole."""
    rows = [(i, "tree " * (1100 + i), "en", "s", 1) for i in range(40)]
    path = tables(rows, clashing=False)
    check(spark, path, tokenizer, 0.02)
    assert pack.op2_packing(spark, path).count() > 40


def test_empty_table(spark, tables):
    assert pack.op2_packing(spark, tables([])).count() == 0


def test_encoder_equals_the_tokenizer(tokenizer):
    texts = ["Don't stop!'s 12ab ½ café×3 ΟΔΟΣ x é ÀÖ÷", "<|endoftext|> Hi<|endoftext|>there", None, "", "  \n ",
             "a\x1fb \x7f", "x'll 'tis !'d", "３４ ⅷ İstanbul ǅ ﬁ", "İ", "é ́a", "A.B..c 1234 #$% ßÿ", "naïve space"]
    ids, offs = Encoder().encode(pa.array(texts))
    for d, t in enumerate(texts):
        assert ids[offs[d]:offs[d + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_knapsack_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(50):
        room = int(rng.integers(3, 12))
        worth = np.concatenate([[0], np.where(rng.random(room) < 0.5, rng.random(room), 0)])
        best = max(sum(worth[s] for s in c) for k in range(room + 1)
                   for c in itertools.combinations_with_replacement(range(1, room + 1), k) if sum(c) <= room)
        value, pattern = pack.knapsack(worth, room)
        assert abs(value - best) < 1e-9
        assert sum(s * k for s, k in pattern.items()) <= room and abs(sum(worth[s] * k for s, k in pattern.items()) - value) < 1e-9


def test_plan_places_every_piece_once_near_the_bound():
    rng = np.random.default_rng(2)
    demand = {int(s): int(k) for s, k in zip(range(1, 65), rng.integers(0, 50, 64)) if k}
    patterns, give = pack.plan(demand, 64)
    used = dict(give)
    for p, times in patterns:
        assert sum(s * k for s, k in p.items()) <= 64
        for s, k in p.items():
            used[s] = used.get(s, 0) + k * times
    assert used == demand
    kept = {s: k - give.get(s, 0) for s, k in demand.items()}
    bound = max(sum(s * k for s, k in kept.items()) / 64, sum(k for s, k in kept.items() if s > 32))
    sequences = sum(times for _, times in patterns)
    fractional = sum(count for _, count in pack.relaxed(kept, 64)[0])
    assert bound - 1 <= fractional and sequences <= fractional * 1.02 + 2
    assert sequences * 64 - sum(s * k for s, k in demand.items()) <= 0.02 * sequences * 64  # filled up
