"""Learnt operators: held-out accuracy, hard cases, constant answers without labels."""

import collections
import random

import numpy as np
import pytest

from conftest import SF_MID
from llm.conftest import hard_rows
from storepulse.llm import likelihood, quality, toxicity
from storepulse.llm.tables import table


def held(spark, path, query, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = query(spark, path).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels], rows


def auc(pairs):
    good = [s for y, s, _ in pairs if y]
    bad = [s for y, s, _ in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_on_held_out_labels(spark):
    pairs, rows = held(spark, SF_MID, quality.op9_quality, "quality")
    assert len(rows) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    assert auc(pairs) > 0.97 and np.mean([y == p for y, _, p in pairs]) > 0.95
    assert all((s >= 0.3) == bool(p) for _, s, p in pairs)


def test_toxicity_on_held_out_labels(spark):
    pairs, rows = held(spark, SF_MID, toxicity.op5_toxicity, "toxic")
    assert auc(pairs) > 0.85 and np.mean([y == p for y, _, p in pairs]) > 0.93
    assert all((s >= 0.5) == bool(p) for _, s, p in pairs)


def obfuscated(rng, word):
    kind = rng.randrange(4)
    if kind == 0:
        return word.replace("i", "1").replace("o", "0").replace("e", "3").replace("s", "5")
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        at = rng.randrange(1, len(word))
        return word[:at] + word[at] * 4 + word[at + 1:]
    return word


BAD = ["idiot", "moron", "loser", "stupid"]
CLEAN = ["river", "stone", "garden", "music", "window", "paper", "silver", "morning", "doctor", "listen", "region"]
SPACINGS = {
    "any": lambda rng, one, two: [obfuscated(rng, one), obfuscated(rng, two)],
    "spelt": lambda rng, one, two: [" ".join(one), " ".join(two)],
    "together": lambda rng, one, two: [" ".join(one + two)],
    "double gap": lambda rng, one, two: [" ".join(one) + "  " + " ".join(two)],
    "doubled": lambda rng, one, two: [" ".join(2 * c for c in one), " ".join(2 * c for c in two)],
    "split": lambda rng, one, two: [split_in_two(rng, one), split_in_two(rng, two)],
}


def split_in_two(rng, word):
    at = rng.randint(max(1, len(word) - 4), min(4, len(word) - 1))
    return word[:at] + " " + word[at:]


def test_obfuscated_words_are_restored_and_scored(spark, tables):
    """Every way of spacing is caught; documents have the same lengths in both classes."""
    rng = random.Random(3)
    docs, labels, ways = [], [], {}

    def add(bad, label=None):
        w = [rng.choice(CLEAN) for _ in range(rng.randint(30, 60))]
        for word in bad or rng.choices(CLEAN, k=2):
            w.insert(rng.randrange(len(w)), word)
        docs.append((len(docs), " ".join(w), "en", "s", 1))
        if label is not None:
            labels.append((len(docs) - 1, 1, label))
        return len(docs) - 1

    for i in range(400):
        add(rng.choices(BAD, k=2) if i % 4 == 0 else None, int(i % 4 == 0))
    for name, way in SPACINGS.items():
        ways[name] = [add(way(rng, *rng.choices(BAD, k=2))) for _ in range(25)]
    clean = [add(None) for _ in range(100)]
    got = {r.doc_id: r.predicted for r in toxicity.op5_toxicity(spark, tables(docs, labels, clashing=False)).collect()}
    caught = {name: np.mean([got[i] for i in ids]) for name, ids in ways.items()}
    assert min(caught.values()) >= 0.9, caught
    assert np.mean([got[i] for i in clean]) < 0.02


def test_junk_longer_than_a_lattice_loses_no_word():
    words = "idiot moron river stone garden music".split()
    rng = random.Random(5)
    channel = toxicity.Channel(plain_trigrams(" ".join(rng.choice(words) for _ in range(4000))))
    for before in range(0, 90, 7):
        token = "1" * before + "m0r0n" + "2" * 40
        assert "moron" in channel.restore(token.encode()).decode(), before
        spelt = " ".join("rivr" * 10)[:2 * before] + " " + " ".join("idiot") + " " + " ".join("stone" * 9)
        assert "idiot" in channel.restore(spelt.strip().encode()).decode(), before


def plain_trigrams(text):
    out = np.zeros((toxicity.SIZE,) * 3)
    codes = [0, 0, *(ord(c) - 96 if "a" <= c <= "z" else 0 for c in text), 0, 0]
    for x, y, z in zip(codes, codes[1:], codes[2:]):
        out[x, y, z] += 1
    return out


@pytest.mark.parametrize("query", [quality.op9_quality, toxicity.op5_toxicity, likelihood.op7_lm_scoring])
def test_hard_cases_and_empty_tables(spark, tables, query):
    rows = hard_rows()
    path = tables(rows, [(1, 1, 0), (3, 0, 1), (8, None, None), (None, 1, 1), (7, 0, 0), (7, 1, 1), (9, 1, 0)])
    got = query(spark, path)
    assert got.count() == len(rows)
    column = "mean" if "mean" in got.columns else "score"
    answers = collections.defaultdict(set)
    for r in got.collect():
        if r.doc_id == 2:
            answers[2].add(r[column])
    assert len(answers[2]) == 1  # repeated rows are scored alike
    assert query(spark, tables(rows, name="no_labels")).count() == len(rows)
    assert query(spark, tables([], name="empty")).count() == 0


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality.grow(x, y)
    assert np.mean((t.score(x) > 0.5) == y) > 0.97
    i = 17  # the arrays walked by hand give the same score

    def walk(k):
        while t.child[k] >= 0:
            k = t.child[k] + (x[i, t.feature[k]] > t.threshold[k])
        return t.value[k]

    assert abs(1 / (1 + np.exp(-t.prior - sum(walk(r) for r in t.roots))) - t.score(x[i:i + 1])[0]) < 1e-9
    assert quality.grow(x, np.ones(2000)).score(x).tolist() == [1.0] * 2000


def test_gradients_are_those_of_the_likelihood():
    net = likelihood.Network(likelihood.Network.fresh())
    net.params = [p.astype(np.float64) for p in net.params]
    rng = np.random.default_rng(1)
    around, token = rng.integers(0, likelihood.VOCABULARY, (5, 4)), rng.integers(0, likelihood.VOCABULARY - 1, 5)
    grads = net.gradients(around, token)
    group, place = int(token[1]) % likelihood.CLASSES, int(token[1]) // likelihood.CLASSES
    for k, at in ((0, (1, around[2, 1], 3)), (1, (4,)), (2, (3, group)), (3, (group,)), (4, (group, 3, place)), (5, (group, place)),
                  (4, (group, 2, (place + 1) % likelihood.CLASS))):
        p, e = net.params[k], 1e-6
        p[at] += e
        up = -net.log_probability(around, token).mean()
        p[at] -= 2 * e
        down = -net.log_probability(around, token).mean()
        p[at] += e
        assert abs(grads[k][at] - (up - down) / (2 * e)) < 1e-6


def test_both_sides_make_ordered_text_likelier_than_shuffled(spark, tables):
    rng = random.Random(2)
    cycle = [f"t{i}" for i in range(12)]
    docs = []
    for i in range(300):
        a = rng.randrange(12)
        w = [cycle[(a + j) % 12] for j in range(200)]
        if i >= 280:
            rng.shuffle(w)
        docs.append((i, " ".join(w), "en", "s", 1))
    got = {r.doc_id: r for r in likelihood.op7_lm_scoring(spark, tables(docs, clashing=False)).collect()}
    assert min(got[i]["mean"] for i in range(280)) > max(got[i]["mean"] for i in range(280, 300)) + 0.5
    assert all(abs(r.log_likelihood - r.n_tokens * r["mean"]) < 1e-6 for r in got.values())


def test_word_counts_are_exact(spark, tables, monkeypatch):
    monkeypatch.setattr(likelihood, "HELD", 10)  # many flushes
    rows = hard_rows()
    path = tables(rows)
    counts = likelihood.word_counts(spark.read.parquet(f"{path}/documents.parquet"))
    from llm.conftest import lower, plain_words
    want = collections.Counter(w for _, t, *_ in rows for w in plain_words(lower(t)))
    assert sorted(r.n for r in counts.collect()) == sorted(want.values())


def test_every_position_is_a_target_in_one_round():
    offsets = [(r * likelihood.MASK) // likelihood.ROUNDS % likelihood.MASK for r in range(likelihood.ROUNDS)]
    assert sorted(offsets) == list(range(likelihood.MASK))


def test_words_of_one_bucket_score_by_their_own_counts(spark, tables):
    """Two documents that differ in one word of the same bucket differ by the log of the words' counts."""
    import pyarrow as pa
    names = [f"w{i}" for i in range(2000)]
    bucket = dict(zip(names, (likelihood.A.Words(pa.array([" ".join(names)])).hashes % np.uint64(likelihood.BUCKETS)).tolist()))
    own = likelihood.WORDS + 9  # more than have a token of their own
    common, rest = names[:own + 100], names[own + 100:]
    usual = common[-1]
    rare = next(w for w in rest if bucket[w] == bucket[usual])
    docs = [(i, " ".join(common[:own] * 2 + common[own:]), "en", "s", 1) for i in range(20)]
    docs += [(100, f"{common[0]} {usual} {common[1]}", "en", "s", 1), (101, f"{common[0]} {rare} {common[1]}", "en", "s", 1)]
    frame = table(spark, tables(docs, clashing=False), "documents")
    for known in (likelihood.KNOWN, 5, 0):
        got = {r.doc_id: r.log_likelihood for r in likelihood.likelihoods(frame, *likelihood.fit(frame, known)).collect()}
        assert abs(got[100] - got[101] - np.log(21)) < 1e-3, known


def test_look_alikes_in_last_place_and_short_spelt_words_are_restored(spark, tables):
    import pyarrow as pa
    words = "shit idiot ass cunt word stone river paper class glass grass bass mass the and devil".split()
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words) for _ in range(100)), "en", "s", 1) for i in range(20)]
    frame = table(spark, tables(rows, clashing=False), "documents")
    channel = toxicity.Channel(toxicity.trigram_counts(frame))
    for text, want in (("shi7", {"shit"}), ("idi07", {"idiot"}), ("a$$", {"ass"}), ("@$$", {"ass"}), ("cun+", {"cunt"}), ("an a s s", {"ass"}),
                       ("(shi7)", {"shit"}), ("1d10t", {"idiot"}), ("word!! and river!", set()), ("dev!l", {"devil"}), ("$100 100! !!! 2020", set())):
        data, offs = channel.restored(pa.array([text]))
        got = set(data.tobytes().decode()[len(text):].split())
        assert got >= want if want else not got, (text, got)
