"""Byte-level BPE ids of whole texts at numpy speed.

The tokenizer splits a text into pieces by character class before it merges bytes, and a piece
always has the same ids. So the pieces are found with numpy, each distinct piece is merged once
(by tiktoken, from the vocabulary of the ``tokenizers`` file: its per-call cost is a tenth), and
the ids of all others are looked up by hash. Texts with contractions, which the split treats
apart, go through the ``tokenizers`` library whole. The tests hold both ways against each other.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from tagwright.llm.kernels import span_hashes, trim

#: Unicode's White_Space characters.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The contractions that the split takes as pieces of their own.
CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")

OTHER, LETTER, NUMBER, GAP = range(4)


def _raw_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the rest for 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _classes() -> np.ndarray:
    table = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = GAP
    return table


def split(points: np.ndarray, classes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where pieces start. points: code points of the joined texts; docs: where each text starts."""
    first = np.zeros(len(points) + 1, bool)
    first[docs[docs < len(points)]] = True
    first[-1] = True
    kind = classes[points]
    start = first[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    gap = kind == GAP
    last = np.flatnonzero(gap[:-1] & ~gap[1:] & ~first[1:-1])  # the white space just before a word
    start[last] = True
    start[last[points[last] == 32] + 1] = False  # a plain space belongs to the word
    return np.flatnonzero(start)


class Encoder:
    """ids of many texts. slots bounds the pieces that are remembered, and with them the memory."""

    def __init__(self, path: str, slots: int = 1 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tiktoken

        self.path, self._tokenizer = path, None
        raw = _raw_bytes()
        with open(path, encoding="utf-8") as f:
            words = json.load(f)["model"]["vocab"]
        ranks = {bytes(raw[c] for c in word): i for word, i in words.items() if raw.keys() >= set(word)}
        self.pieces = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.classes, self.slots = _classes(), slots
        self.forget()

    @property
    def tokenizer(self):
        """The library's tokenizer, loaded when a text first needs it."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.encode_special_tokens = True
        return self._tokenizer

    def forget(self) -> None:
        self.keys, self.entry = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.at, self.size, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.store, self.used = np.zeros(1 << 18, np.int32), 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> int:
        """Append the pieces' ids; the number of the first new entry."""
        found = [self.pieces.encode_ordinary(p) for p in pieces]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))
        while self.n + len(sizes) > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.store):
            self.store = np.resize(self.store, 2 * len(self.store))
        base = self.n
        self.at[base : base + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[base : base + len(sizes)] = sizes
        self.store[self.used : self.used + len(flat)] = flat
        self.n, self.used = base + len(sizes), self.used + len(flat)
        return base

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = split(points, self.classes, np.concatenate([[0], ends[:-1]]))
        stops = np.append(starts[1:], len(points))
        if self.n > self.slots:
            self.forget()
        h = span_hashes(points, starts, stops)
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        entry = self.entry[slot]
        missed = np.flatnonzero(self.keys[slot] != h)
        if len(missed):
            new, one, back = np.unique(h[missed], return_index=True, return_inverse=True)
            at = missed[one]
            base = self._learn([joined[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)])
            entry[missed] = base + back
            self.keys[slot[at]], self.entry[slot[at]] = new, base + np.arange(len(new), dtype=np.int32)
        size = self.size[entry].astype(np.int64)
        before = np.cumsum(size) - size
        ids = self.store[np.repeat(self.at[entry] - before, size) + np.arange(int(size.sum()))]
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, ends)]
        return ids, np.diff(upto, prepend=0)

    def encode(self, texts: list[str], most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, and how many each has."""
        ids, counts, lo = [], [], 0
        odd = [bool("'" in t and CONTRACTION.search(t)) for t in texts]
        while lo < len(texts):
            hi, chars = lo + 1, len(texts[lo])
            while hi < len(texts) and odd[hi] == odd[lo] and chars + len(texts[hi]) <= most:
                chars += len(texts[hi])
                hi += 1
            if odd[lo]:
                found = self._library(texts[lo:hi])
                one, n = np.fromiter((i for x in found for i in x), np.int32), np.fromiter(map(len, found), np.int64)
            else:
                one, n = self._plain(texts[lo:hi])
            ids.append(one)
            counts.append(n)
            lo = hi
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, slots: int = 1 << 20) -> Encoder:
    """One per Python worker, kept between tasks."""
    if (path, slots) not in _encoders:
        _encoders[path, slots] = Encoder(path, slots)
    return _encoders[path, slots]


def drop_encoders() -> None:
    """Give back what encoders hold in this worker, for work that needs none."""
    if _encoders:
        _encoders.clear()
        trim()
