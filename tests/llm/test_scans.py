"""Licence scan, line rules and decontamination against plain readings."""

import collections
import random
import re

import pyarrow as pa
import pytest
from conftest import SF_SMALL

from llm.conftest import hard_rows, lower, plain_words
from storepulse.llm import decontaminate, licenses, lines

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_base(text):
    w = WORD.findall(lower(text))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


NOTICES = [
    (20, "Under the MIT-License! cc by\nnc, apache license, version 2 under the mit license", None, "s", 1),
    (21, "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nmore", None, "s", 1),
    (22, "SPDX-License-Identifier: MIT AND AND\nunder the\tMIT license", None, "s", 1),
    (23, "Permission is hereby granted, free of charge, to any person obtaining a copy", None, "s", 1),
    (24, "cc by nc cc by nc CC-BY-NC é under the mit licenses", None, "s", 1),
]


@pytest.mark.parametrize("small", [True, False])
def test_licenses_equal_a_plain_reading(spark, tables, small):
    path = SF_SMALL if small else tables(hard_rows() + NOTICES)
    texts = collections.defaultdict(list)
    for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect():
        texts[r.doc_id].append(license_base(r.text))
    got = licenses.op3_licenses(spark, path).collect()
    assert len(got) == sum(map(len, texts.values()))
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    if not small:
        labels = {r.doc_id: (r.labels, r.score) for r in got}
        assert labels[21] == ("apache-2,gpl-2.0,mit", 1.0) and labels[22] == ("mit", 1.0) and labels[23][0] == "mit"


def test_expressions():
    assert licenses.evaluated("gpl-2.0-only with classpath-exception-2.0") == ({"gpl-2.0"}, 0.7)
    assert licenses.evaluated("mit or gpl-3.0 and cc-by-nc-4.0") == ({"mit", "gpl-3.0", "cc-by-nc"}, 1.0)
    assert licenses.evaluated("(mit or gpl-3.0) and cc-by-nc-4.0") == ({"mit", "gpl-3.0", "cc-by-nc"}, 0.2)
    for bad in ("", "and", "mit gpl", "(mit", "mit)", "mit or", "()", "mit ( gpl )", "??"):
        assert licenses.evaluated(bad) is None, bad


def base_counts(text):
    w = plain_words(text)
    rows = [x for x in (text or "").split("\n") if plain_words(x)]
    count = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    covered = set()
    for k in range(len(w) - 4):
        if count[tuple(w[k:k + 5])] > 1:
            covered.update(range(k, k + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(rows) - len(set(rows)), len(covered)


def line_brute(rows):
    texts = collections.defaultdict(set)
    for _, t, s in rows:
        texts[s].add(t or "")
    count = collections.Counter()
    for s, own in texts.items():
        for t in own:
            for line in {tuple(plain_words(lower(x))) for x in t.split("\n")}:
                if line:
                    count[s, line] += 1
    out = []
    for i, t, s in rows:
        c = base_counts(t)
        gone = sum(len(x) for x in (tuple(plain_words(lower(y))) for y in (t or "").split("\n"))
                   if count.get((s, x), 0) >= max(lines.MOST_TEXTS, lines.SHARE * len(texts[s])))
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        out.append((i or -1, *c, failed, not failed and gone <= lines.DEPLETED * c[0], gone))
    return sorted(out)


def line_rows():
    rng = random.Random(4)
    rows = []
    for i in range(60):
        own = " ".join(f"n{rng.randrange(9999)}" for _ in range(rng.choice([0, 3, 30])))
        rows.append((100 + i, f"Home | About  us | Contact | Login | Terms and more and so on today\n{own}\n{own.upper()}", "en",
                     "host" if i < 45 else None, 1))
    notice = " ".join(f"term{k}" for k in range(35))  # a long line is a line too
    rows += [(200 + i, f"page {i} of this\n{notice}\n" + "own words here " * (i % 3), "en", "legal", 1) for i in range(40)]
    return rows


def check_lines(spark, path):
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = sorted((r.doc_id or -1, *(r[c] for c in lines.COUNTS), r.base_failed, r.kept, r.n_removed_words)
                 for r in lines.op6_quality_rules(spark, path).collect())
    assert got == line_brute(rows)
    return got


def test_line_rules_equal_a_plain_reading(spark, tables):
    check_lines(spark, SF_SMALL)
    got = check_lines(spark, tables(hard_rows() + line_rows()))
    assert any(g[-1] > 0 and not g[-2] for g in got) and any(g[-1] > 0 and g[-2] for g in got)
    assert {g[-1] for g in got if 200 <= g[0] < 240} == {35}


def edit_distance(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, d in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return min(prev), prev.index(min(prev))


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(500):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 70)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90)))
        assert decontaminate.nearest(item, text) == edit_distance(item, text)


def test_leaks_equal_brute_force(spark, tables, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)  # several passes
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(6, 20)))) for k in range(8)] + [(8, "short"), (9, None), (None, " ".join(word() for _ in range(12)))]
    docs = []
    for d in range(60):
        _, item = items[rng.randrange(8)]
        t = list(item)
        for _ in range(rng.randint(0, len(item) // 8)):
            at = rng.randrange(len(t))
            t[at:at + 1] = rng.choice([[], [rng.choice("xyz")], [t[at], rng.choice("xyz")]])
        docs.append((d, " ".join(word() for _ in range(9)) + " " + "".join(t).upper() + "\n\n" + word() * rng.randint(0, 2), "en", "s", 1))
    path = tables(docs + [(None, items[10][1], None, None, 1)] + hard_rows(), benchmark=items)
    want = set()
    fold = lambda t: " ".join(lower(t).encode().decode().split()).encode()
    for d, text, *_ in docs + [(None, items[10][1], None, None, 1)]:
        for k, item in items:
            if item and len(fold(item)) >= decontaminate.LEAST:
                distance, _ = edit_distance(fold(item), fold(text))
                if distance <= len(fold(item)) // decontaminate.PER_ERROR:
                    want.add((d, k, distance))
    got = decontaminate.op10_decontaminate(spark, path)
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == want and got.count() == len(want)
    frame = spark.read.parquet(f"{path}/documents.parquet")
    kept = decontaminate.keep_clean(spark, frame, path)
    assert kept.columns == frame.columns
    hit = {d for d, _, _ in want}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {d for d, *_ in docs + hard_rows() if d is not None} - hit


def test_empty_tables(spark, tables):
    path = tables([])
    assert licenses.op3_licenses(spark, path).count() == lines.op6_quality_rules(spark, path).count() == 0
    assert decontaminate.op10_decontaminate(spark, path).count() == 0
    path = tables(hard_rows(), name="no_items")
    assert decontaminate.op10_decontaminate(spark, path).count() == 0
    assert decontaminate.keep_clean(spark, spark.read.parquet(f"{path}/documents.parquet"), path).count() == len(hard_rows())


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "", "b" * 25, "c"]})
    parts = list(licenses.A.slices([batch], limit=12))
    assert [p.num_rows for p in parts] == [3, 1, 1]


def test_a_tag_is_read_up_to_where_its_expression_ends():
    scan = licenses.Scanner().scan
    for text, labels in (("SPDX-License-Identifier: MIT Copyright 2020 The Authors", "mit"),
                         ('SPDX-License-Identifier: Apache-2.0" and more', "apache-2"),
                         ("<p>SPDX-License-Identifier: (MIT OR ISC) AND GPL-2.0-only<br>text", "gpl-2.0,isc,mit"),
                         ("SPDX-License-Identifier: MIT OR (ISC text", "mit"),
                         ("SPDX-License-Identifier: MIT OR", "mit"), ("SPDX-License-Identifier: MIT) x", "mit"),
                         ("SPDX-License-Identifier: AND MIT", ""), ("SPDX-License-Identifier: ?? MIT", "")):
        assert scan(text.encode())[5] == labels, text


def test_short_items_are_sought_whole_between_word_borders(spark, tables):
    items = [(1, "What is the capital of Peru?"), (2, "Lima"), (3, "  "), (4, "$5.")]
    docs = [(1, "He asked: what is  the CAPITAL of Peru? Nobody knew.", "en", "s", 1), (2, "in lima, they say", "en", "s", 1),
            (3, "the limage of a climate", "en", "s", 1), (4, "what is the capital of Cuba?", "en", "s", 1), (5, "it costs $5.", "en", "s", 1),
            (6, "climates of Lima", "en", "s", 1)]
    path = tables(docs, benchmark=items)
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.op10_decontaminate(spark, path).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (5, 4, 0), (6, 2, 0)}
    kept = decontaminate.keep_clean(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert {r.doc_id for r in kept.collect()} == {3, 4}


def test_long_lines_of_a_host_are_boilerplate_too(spark, tables):
    notice = " ".join(f"clause{i}" for i in range(45))
    rows = [(i, f"{notice}\nown words of text {i} which are not many", "en", "host", 1) for i in range(25)]
    got = lines.op6_quality_rules(spark, tables(rows)).collect()
    assert {(r.n_removed_words, r.kept) for r in got} == {(45, False)}
