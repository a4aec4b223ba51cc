"""Quality by compression: texts like the good ones get shorter with a dictionary of good text.

Two zstandard dictionaries are built from labelled text, one of good and one of bad documents.
A document is compressed with each, block by block, so that the dictionaries count as much at
a long text's end as at its start. The difference of the two sizes over their sum is the
signal; a logistic curve, fitted on labelled documents that the dictionaries haven't seen,
makes a probability of it.

Cases: null and empty texts get the labels' mean; a label without a document, or null, isn't used;
a document with several labels counts once for each, one with several texts by the first in
order; where a class has no labelled text, its
dictionary is empty and every score is near the labels' mean (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagwright.llm.kernels import buffers, trim
from tagwright.llm.storage import materialise

#: The fit is on a sample: so many labelled documents of each class for the dictionaries, and
#: as many for the calibration, none longer than MAX_CHARS. They go to the driver: 4 * SAMPLE texts at most.
SAMPLE = 1500
MAX_CHARS = 16_384
DICTIONARY = 112_640
BLOCK = 1024
LEVEL = 3
#: Bytes of text at which the signal weighs as much as the labels' mean.
SHRINK = 32


def remainder(doc_id: str, divisor: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    signals: list[float]
    scores: list[float]
    mean: float
    block: int = BLOCK
    level: int = LEVEL

    def sizer(self):
        """A function from a text's bytes to its signal."""
        import zstandard

        def compressor(dictionary: bytes):
            if not dictionary:
                return zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_dict_id=False)
            known = zstandard.ZstdCompressionDict(dictionary)
            known.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(level=self.level, dict_data=known, write_content_size=False, write_dict_id=False)

        good, bad = compressor(self.good).compress, compressor(self.bad).compress

        def signal(text: bytes | memoryview) -> float:
            a = b = 0
            for at in range(0, len(text), self.block):
                part = text[at : at + self.block]
                a += len(good(part))
                b += len(bad(part))
            return (b - a) / len(text) if len(text) else 0.0

        return signal

    def score(self, signals: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The shorter a text, the less its signal says and the nearer its score to the labels' mean."""
        return (sizes * np.interp(signals, self.signals, self.scores) + SHRINK * self.mean) / (sizes + SHRINK)


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of the rising curve of least squares: neighbours out of order are pooled. Between knots the curve is a line."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, weighted y, weighted x
    for at, label, w in zip(x[order], y[order], weight[order], strict=True):
        pools.append([w, w * label, w * at])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    w = np.array(pools)
    mean = weight @ y / weight.sum()
    return (w[:, 2] / w[:, 0]).tolist(), ((w[:, 1] + mean) / (w[:, 0] + 1)).tolist()


def _dictionary(texts: list[bytes], block: int, size: int) -> bytes:
    import zstandard

    parts = [t[i : i + block] for t in texts for i in range(0, len(t), block)]
    try:
        return zstandard.train_dictionary(size, parts, threads=1, k=400, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself
        return b"\n".join(parts)[:size]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> Model:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, quality)``: rows of the smallest hashes, ``sample`` for each class and purpose."""
    marked = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id")
    ids = [marked.where(F.col("quality") == k).orderBy(order, "doc_id").limit(2 * sample) for k in (0, 1)]
    some = F.broadcast(materialise(ids[0].unionByName(ids[1]), "labelled"))  # 4 * sample rows at most
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, max_chars))
    found: list[list[bytes]] = [[], []]
    # one text of each document, so that repeated rows neither count more nor fill the driver
    one = texts.join(some.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    for r in sorted(one.join(some, "doc_id").select("quality", order.alias("h"), "doc_id", "text").collect(), key=lambda r: (r["h"], r["doc_id"], r["text"])):
        found[r["quality"]].append(r["text"].encode())
    rows = {(k, part): found[k][part::2] for k in (0, 1) for part in (0, 1)}
    good, bad = (_dictionary(rows[k, 0], BLOCK, DICTIONARY) for k in (1, 0))
    # each class counts as often as it is labelled, whatever the sample holds of it
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not rows[0, 1] or not rows[1, 1]:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(good, bad, [0.0], [share], share)
    signal = Model(good, bad, [], [], 0.5).sizer()
    x = np.array([signal(t) for k in (0, 1) for t in rows[k, 1]])
    y = np.repeat([0, 1], [len(rows[0, 1]), len(rows[1, 1])])
    weight = np.array([counts[k] / len(rows[k, 1]) for k in (0, 1)])[y] * len(y) / sum(counts.values())
    return Model(good, bad, *_isotonic(x, y, weight), counts[1] / sum(counts.values()))


def _scorer(model: Model):
    signal = model.sizer()

    def run(column: pa.Array) -> np.ndarray:
        data, at = buffers(column)
        view = memoryview(data)
        found = np.array([signal(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], float)
        return model.score(found, np.diff(at))

    return run


def score(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole ``text``, in a column that isn't there yet."""
    if column in docs.columns:
        raise ValueError(f"documents have a column {column} already")

    def run(batches):
        scores = _scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column("text")))], [*batch.schema.names, column])
            trim()

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(column, "double"))


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, and those without a text."""

    def run(batches):
        scores = _scorer(model)
        for batch in batches:
            text = batch.column("text")
            yield batch.filter(pa.array((scores(text) >= least) | text.is_null().to_numpy(zero_copy_only=False)))
            trim()

    return docs.mapInArrow(run, docs.schema)
