"""Token ids of whole texts with a public word-level BPE tokenizer.

The tokenizer splits on white space and never joins what it has split, so the
ids of a text are the ids of its pre-tokens one after the other. Texts of ASCII
and Latin-1 letters (the usual case) are cut into pre-tokens by byte classes;
each distinct pre-token is encoded once per task by the tokenizers library and
its ids are then gathered for all its places at once. Texts with any other
character, an apostrophe or a control character are encoded word by word by the
full tokenizer. Both give the ids of ``Tokenizer.encode(text)``.

The vocabulary file is read from the installed package on each executor; its
name is a parameter. Null texts count as empty.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, pre_tokenizers

from storepulse.llm import arrays as A

VOCABULARY = "word_bpe_49k.json"
CACHE = 1_000_000  # distinct pre-tokens a worker remembers
TEXT_BYTES = 256 << 10  # of texts encoded at once
AT_ONCE = 1000  # new pre-tokens handed to the tokenizer at once
_held: dict[str, "Encoder"] = {}

NONE, LETTER, DIGIT, OTHER, ODD = 0, 1, 2, 3, 4
KIND = np.full(256, OTHER, np.uint8)
KIND[:32] = ODD
KIND[[127, 39]] = ODD  # delete; the apostrophe starts contractions
KIND[A.SPACE] = NONE
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[128:] = ODD  # letters of Latin-1 are told apart below


def encoder(vocabulary: str = VOCABULARY) -> "Encoder":
    """The worker process's only encoder of this vocabulary: the next task finds it with all that it remembers."""
    if vocabulary not in _held:
        _held.clear()
        _held[vocabulary] = Encoder(vocabulary)
    return _held[vocabulary]


class Encoder:
    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        # whole texts, and pre-tokens, which are already folded and split
        self.forms = {True: (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer),
                      False: (None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))}
        self.form = True
        self.words: dict[bytes, np.ndarray] = {}
        self._clear()

    def _lists(self, texts: list[str], whole: bool) -> list[list[int]]:
        if whole != self.form:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.forms[whole]
            self.form = whole
        out = []
        for a in range(0, len(texts), AT_ONCE):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[a:a + AT_ONCE], add_special_tokens=False)]
        return out

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)  # of each key, a place in starts and sizes
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's offsets."""
        data, offs = A.flat(column)
        n = len(offs) - 1
        low = A.LOWER[data]
        kind = KIND[low]
        lead = data == 0xC3
        trail = np.zeros(len(data), bool)
        trail[1:] = lead[:-1]
        letter = trail & (data != 0x97) & (data != 0xB7)
        low[letter & (data < 0x9F)] += 0x20
        kind[letter] = LETTER
        kind[:-1][letter[1:]] = LETTER
        kind[:-1][(data[:-1] == 60) & (data[1:] == 124)] = ODD  # "<|" may begin a special token
        odd = A.per_document(kind == ODD, offs) > 0
        starts, ends = self._spans(kind, offs)
        doc = np.searchsorted(offs, starts, "right") - 1
        if odd.any():
            keep = ~odd[doc]
            starts, ends, doc = starts[keep], ends[keep], doc[keep]
        hashes = A.span_hashes(low, starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slot = self._slots(distinct, low, starts[first], ends[first])[inverse]
        sizes = self.sizes[slot]
        flat_ids = self.ids[A.ragged(self.starts[slot], sizes)]
        counts = np.bincount(doc, sizes, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
        if not odd.any():
            return flat_ids, np.concatenate([[0], np.cumsum(counts)])
        plain = np.concatenate([[0], np.cumsum(counts)])
        parts = [self._whole(data[offs[d]:offs[d + 1]].tobytes()) if odd[d] else flat_ids[plain[d]:plain[d + 1]]
                 for d in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    @staticmethod
    def _spans(kind: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(kind):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.ones(len(kind) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        cut[offs] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        keep = kind[starts] != NONE
        return starts[keep], ends[keep]

    def _slots(self, distinct, low, starts, ends) -> np.ndarray:
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > CACHE and len(self.keys):
                self._clear()
                return self._slots(distinct, low, starts, ends)
            raw = low.tobytes()
            lists = self._lists([raw[a:b].decode() for a, b in zip(starts[new], ends[new])], False)
            sizes = np.array([len(x) for x in lists], np.int64)
            ids = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
            base = len(self.starts)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
            where = np.searchsorted(self.keys, distinct[new])
            self.keys = np.insert(self.keys, where, distinct[new])
            self.slot = np.insert(self.slot, where, base + np.arange(len(new)))
            at = np.searchsorted(self.keys, distinct)
        return self.slot[at]

    def _whole(self, raw: bytes) -> np.ndarray:
        words = raw.split()
        new = list({w for w in words if w not in self.words})
        if new:
            if len(self.words) + len(new) > CACHE // 4:
                self.words.clear()
                new = list(set(words))
            for w, ids in zip(new, self._lists([w.decode() for w in new], True)):
                self.words[w] = np.array(ids, np.uint32)
        return np.concatenate([self.words[w] for w in words]) if words else np.zeros(0, np.uint32)
