"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is bound from its letters' vectors, each
rotated by its place, by multiplying them; a text is the sum of its n-grams' vectors, a language
the sum of its texts. The language whose vector has the largest cosine with a text's is
predicted. Other characters than letters only separate words, and a word's n-grams hold the gaps
before and after it.

Cases: a text that is null or has no letter is ``und`` with score 0, and so are all if nothing
was learned; rows with a null language or text teach nothing; equal cosines go to the language
first in order.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.kernels import mix

DIMENSIONS = 1024
GRAM = 3
#: How sharply the score turns from the cosines' differences.
SHARPNESS = 20.0
#: The prototypes are sent to all tasks: 32 MB at most.
MAX_LANGUAGES = 4096

_letter: dict[int, bool] = {}


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased letters, with one 0 before, between and after a text's words, and each one's text."""
    joined = "".join(f"\x00{t}\x01" for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    some, back = np.unique(points, return_inverse=True)
    for c in some.tolist():
        if c not in _letter:
            _letter[c] = unicodedata.category(chr(c))[0] == "L"
    row = np.cumsum(points == 0) - 1
    points = np.where(np.array([_letter[c] for c in some.tolist()], bool)[back], points, np.uint32(0))
    keep = (points != 0) | np.concatenate([[True], (points[:-1] != 0) | (row[1:] != row[:-1])])
    return points[keep], row[keep]


def gram_counts(texts: list[str], gram: int = GRAM, most: int = 1 << 62) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram number and count of each text's n-grams, and the n-grams' code points. Where plain keys would pass ``most``, those that there are get numbers."""
    points, row = _symbols([t.replace("\x00", " ").replace("\x01", " ") for t in texts])
    alphabet, code = np.unique(points, return_inverse=True)
    size, n = max(1, len(alphabet)), max(0, len(code) - gram + 1)
    key, middle = code[:n].astype(np.int64), points[:n] != 0
    few = size**gram * max(1, len(texts)) < most
    for k in range(1, gram):
        if not few:  # many kinds of letters: number the beginnings that there are
            _, key = np.unique(key, return_inverse=True)
        key = key * size + code[k : k + n]
        middle |= points[k : k + n] != 0
    at = np.flatnonzero((row[:n] == row[gram - 1 :][:n]) & middle)
    if few:
        upto = size**gram
        pairs, counts = np.unique(row[at] * upto + key[at], return_counts=True)
        grams, number = np.unique(pairs % upto, return_inverse=True)
        letters = np.stack([alphabet[grams // size ** (gram - 1 - k) % size] for k in range(gram)], 1) if len(grams) else np.zeros((0, gram), np.uint32)
        return pairs // upto, number, counts, letters
    grams, first, own = np.unique(key[at], return_index=True, return_inverse=True)
    pairs, counts = np.unique(row[at] * max(1, len(grams)) + own, return_counts=True)
    letters = np.stack([points[at[first] + k] for k in range(gram)], 1) if len(grams) else np.zeros((0, gram), np.uint32)
    return pairs // max(1, len(grams)), pairs % max(1, len(grams)), counts, letters


def vectors(letters: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The n-grams' vectors: products of their letters' vectors, rotated by place."""
    some, back = np.unique(letters, return_inverse=True)
    seed = mix(some.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(dimensions // 64, dtype=np.uint64)[None, :])
    own = np.unpackbits(np.ascontiguousarray(seed).view(np.uint8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
    back = back.reshape(letters.shape)
    out = np.ones((len(letters), dimensions), np.int8)
    for k in range(letters.shape[1]):
        out *= np.roll(own, letters.shape[1] - 1 - k, axis=1)[back[:, k]]
    return out


def _parts(batch: pa.RecordBatch, most: int = 1 << 20):
    texts = [t or "" for t in batch.column("text").to_pylist()]
    lo = 0
    while lo < len(texts):
        hi, chars = lo + 1, len(texts[lo])
        while hi < len(texts) and chars + len(texts[hi]) <= most:
            chars += len(texts[hi])
            hi += 1
        yield lo, hi, texts[lo:hi]
        lo = hi


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes from every row of ``docs(text, lang)``. Each task adds up what it reads, by language."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, texts in _parts(batch):
                names = sorted(set(langs[lo:hi]))
                rows, number, counts, letters = gram_counts(texts)
                if not len(rows):
                    continue
                which = np.array([names.index(x) for x in langs[lo:hi]])
                weight = np.zeros((len(names), len(letters)), np.float32)
                np.add.at(weight, (which[rows], number), counts)
                for name, v in zip(names, weight @ vectors(letters, dimensions).astype(np.float32), strict=True):
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x")))["x"].alias("v")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: np.array(r["v"]) for r in found}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keys: list[str]) -> DataFrame:
    """lang_pred and score for each row, beside the columns ``keys``."""
    names = sorted(prototypes)
    units = np.stack([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1) for n in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)

    def run(batches):
        for batch in batches:
            best, score = [], []
            for lo, hi, texts in _parts(batch):
                n = hi - lo
                rows, number, counts, letters = gram_counts(texts)
                if not names or not len(rows):
                    best += ["und"] * n
                    score += [0.0] * n
                    continue
                bound = vectors(letters, units.shape[1]).astype(np.float32)
                cosines, some = np.zeros((n, len(names))), np.zeros(n, bool)
                some[rows] = True
                for a in range(0, n, 256):  # a block of texts as a dense matrix of counts
                    i, j = np.searchsorted(rows, [a, a + 256])
                    if i == j:
                        continue
                    own, at = np.unique(number[i:j], return_inverse=True)
                    dense = np.zeros((min(256, n - a), len(own)), np.float32)
                    dense[rows[i:j] - a, at] = counts[i:j]
                    text = dense @ bound[own]
                    cosines[a : a + 256] = (text @ units.T) / np.maximum(np.linalg.norm(text, axis=1), 1e-30)[:, None]
                top = cosines.argmax(1)
                soft = 1 / np.exp(SHARPNESS * (cosines - cosines.max(1, keepdims=True))).sum(1)
                best += [names[k] if ok else "und" for k, ok in zip(top.tolist(), some.tolist(), strict=True)]
                score += np.where(some, soft, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(best, pa.string()), pa.array(score, pa.float64())], [*keys, "lang_pred", "score"])

    rows = docs.select(*keys, "text")
    from pyspark.sql.types import StringType, StructType

    return rows.mapInArrow(run, StructType([*rows.select(*keys).schema.fields]).add("lang_pred", StringType()).add("score", "double"))
