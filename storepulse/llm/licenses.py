"""Licence scan: Aho-Corasick over words, licence expressions by a shunting-yard parser.

A text's words (A-Z in lower case; ASCII letters, digits and all non-ASCII
characters belong to words) are written with single spaces, and one automaton
finds every place of every phrase, so a phrase is found across punctuation and
line breaks. Identifier tags (``SPDX-License-Identifier:`` up to the end of the
line) are parsed as expressions: ``WITH`` binds closest, then ``AND``, then
``OR``; parentheses group. The longest valid expression at the tag's start counts, whatever
follows it on the line; a tag that does not begin with one gives no label.

The base phrases alone make ``n_base``, ``first_word``, ``last_word`` and
``base_labels``. ``labels`` adds those of the notice phrases and tags. ``score`` says
how freely the text may be used by what it states: each label has a level,
``AND`` takes the lowest, ``OR`` the highest, an exception (``WITH``) lifts its
licence half way to 1, and several statements in one text hold together (lowest).
A text that states nothing has score 0. Null and empty texts have no words.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from storepulse.llm import arrays as A
from storepulse.llm.tables import DOC, table, texts

# fixed by the contract of the query: phrase (words) and label
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# phrases of well-known notices
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the apache license version 2 0": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
# how freely a text under the label may be used, 0 to 1; by the beginning of the label
LEVELS = (("mit", 1.0), ("apache", 1.0), ("bsd", 1.0), ("isc", 1.0), ("cc0", 1.0), ("public-domain", 1.0),
          ("unlicense", 1.0), ("cc-by-nc", 0.2), ("cc-by-nd", 0.3), ("cc-by-sa", 0.6), ("cc-by", 0.9), ("mpl", 0.7),
          ("lgpl", 0.6), ("agpl", 0.3), ("gpl", 0.4), ("all-rights-reserved", 0.05))
UNKNOWN = 0.5
TAG = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)")
TOKEN = re.compile(r"\s*(?:([()])|([a-z0-9][a-z0-9.+:-]*))")
BINDING = {"or": 1, "and": 2, "with": 3}
_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def level(label: str) -> float:
    return next((v for begin, v in LEVELS if label.startswith(begin)), UNKNOWN)


def canonical(name: str) -> str:
    """A label for a licence identifier: version suffixes of the labels used here are unified."""
    name = re.sub(r"-(only|or-later)$|\+$", "", name)
    return "apache-2" if name.startswith("apache-2") else re.sub(r"^(cc-by(?:-nc|-nd|-sa)*)-[0-9.]+$", r"\1", name)


def postfix(text: str) -> list[str] | None:
    """Shunting-yard: the expression's tokens in postfix order, or None if it is not valid."""
    out: list[str] = []
    stack: list[str] = []
    operand, at = True, 0  # whether an operand must come next
    text = text.rstrip(" \t*/#->")
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        token = m[1] or m[2]
        if token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in BINDING:
            if operand:
                return None
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def leading(text: str) -> str:
    """The longest valid expression at the beginning of ``text``, or nothing.

    It ends before an operand that follows an operand, a parenthesis that does not fit or
    a foreign character; before that, the last place where an expression was complete.
    """
    operand, depth, at, end = True, 0, 0, 0
    while m := TOKEN.match(text, at):
        token = m[1] or m[2]
        if token in BINDING:
            if operand:
                break
            operand = True
        elif token == "(":
            if not operand:
                break
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            depth -= 1
        elif not operand:
            break
        else:
            operand = False
        at = m.end()
        if not operand and not depth:
            end = at
    return text[:end]


def evaluated(expression: str) -> tuple[set[str], float] | None:
    """Labels and level of a licence expression; None if it is not valid."""
    tokens = postfix(expression)
    if tokens is None:
        return None
    stack: list[tuple[set[str], float]] = []
    for token in tokens:
        if token in BINDING:
            (names, value), (more, other) = stack[-2:]
            del stack[-2:]
            if token == "with":  # an exception is no licence of its own
                stack.append((names, (1 + value) / 2))
            else:
                stack.append((names | more, min(value, other) if token == "and" else max(value, other)))
        else:
            label = canonical(token)
            stack.append(({label}, level(label)))
    return stack[0]


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES):
        self.automaton = ahocorasick.Automaton()
        for phrase in {**base, **notices}:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, base.get(phrase), notices.get(phrase)))
        self.automaton.make_automaton()

    def scan(self, raw: bytes) -> tuple:
        words = raw.translate(_WORD).split()
        flat = b" " + b" ".join(words) + b" "
        labels: set[str] = set()
        base: set[str] = set()
        places = 0
        first = last = None
        found, before, seen = 1.0, 0, 0
        for end, (size, own, notice) in self.automaton.iter(flat.decode("latin-1")):
            if own:
                begin = end + 1 - size  # the space before the first word
                if begin >= before:
                    seen += flat.count(b" ", before, begin)
                    at = seen
                    before = begin
                else:
                    at = seen - flat.count(b" ", begin, before)
                places += 1
                first = at if first is None else min(first, at)
                last = at if last is None else max(last, at)
                base.add(own)
            label = own or notice
            labels.add(label)
            found = min(found, level(label))
        if b"-" in raw:
            for m in TAG.finditer(raw.translate(bytes(A.LOWER))):
                if got := evaluated(leading(m[1].decode("utf-8", "replace"))):
                    labels |= got[0]
                    found = min(found, got[1])
        return (len(words), places, first, last, ",".join(sorted(base)), ",".join(sorted(labels)),
                found if labels else 0.0)


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())


def licenses(docs: DataFrame) -> DataFrame:
    def rows(batches):
        scanner = Scanner()
        for part in A.slices(batches):
            got = [scanner.scan(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column(DOC), *(pa.array(c, t) for c, t in zip(zip(*got), TYPES))],
                                             [DOC, *COLUMNS])

    return texts(docs).mapInArrow(rows, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                        "base_labels string, labels string, score double")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
