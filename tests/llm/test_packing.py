import gc
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tagwright.llm import packing
from tagwright.llm.bpe import Encoder
from tagwright.llm.queries import tokenizer

ROWS = [(1, "a word or two", "s", 7), (2, None, "s", 7), (3, "", None, 7), (4, "it's <|endoftext|> 're\n\n  x éè " * 40, "t", 7), (4, "it's", "t", 7), (5, "a word or two", "s", 7), (6, "long " * 30_000, "u", 7)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    t.encode_special_tokens = True
    return t


def check(rows, pieces, library, length):
    got = {}
    for p in pieces:
        got.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    want = {}
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.setdefault((doc, len(ids)), []).append(ids)
    assert got.keys() == want.keys()
    for key, many in want.items():
        ids = many[0]
        assert sum(p.length for p in got[key]) == len(many) * len(ids)
        for p in got[key]:
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for sequence, parts in by.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == length or sequence == max(by) and at < length


@pytest.mark.parametrize("weights", [None, {"s": 1.0, "u": 3.0}])
def test_every_id_lies_in_one_piece(spark, library, weights):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, pid int")
    pieces = packing.digest(packing.pack(docs, tokenizer(), weights, length=64, window=1024)).collect()
    check(ROWS, pieces, library, 64)


@pytest.mark.parametrize("weights", [None, {"s1": 2.0, "big": 1.0, "absent": 5.0}])
def test_rare_sources_share_queues(spark, library, weights):
    """Sources are told as they are; large ones keep their proportions whatever the number of others."""
    rows = [(k, f"text {k}", f"s{k}") for k in range(300)] + [(1000 + k, "many words here " * 20, "big") for k in range(60)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, source string, queue string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    pieces = packing.pack(docs, tokenizer(), weights, length=16, window=64, pools=8)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    told = {(r.doc_id, r.source) for r in pieces.select("doc_id", "source").collect()}
    assert told == {(i, s) for i, _, s in rows}
    check(rows, packing.digest(pieces).collect(), library, 16)
    if weights is None:
        sizes = pieces.groupBy("window_id", "source").sum("length").collect()
        all_, last = sum(r[2] for r in sizes), max(r[0] for r in sizes)
        big = [r[2] for r in sizes if r[1] == "big"]
        assert len(big) == last + 1 and max(big) - min(big) <= 1 and abs(sum(big) / all_ - sum(len(library.encode(t).ids) + 1 for _, t, s in rows if s == "big") / all_) < 1e-9


def test_shares_of_long_corpora():
    """Window starts are exact where products pass 64 bits."""
    for scale in (10**10, 10**12):
        check_shares({"a": 3000 * scale + 7, "b": 10 * scale + 1, "c": 5})


def check_shares(totals):
    schedule = packing.Schedule(totals, window=1 << 16)
    windows = schedule.phases[0][3]
    for j in (0, 1, windows // 3, windows - 1):
        at, want = 0, []
        for n in totals.values():
            at += n * j // windows
        for n in totals.values():
            want.append(at)
            at += n * (j + 1) // windows - n * j // windows
        assert schedule._laid(0, j).tolist() == want


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string"), tokenizer()).count() == 0


def test_windows_keep_the_proportions():
    schedule = packing.Schedule({"a": 70_001, "b": 20_003, "c": 9_999, "d": 1}, window=1000)
    sent, at = {}, {}
    for q, n in {"a": 70_001, "b": 20_003, "c": 9_999, "d": 1}.items():
        for pos, a, b, w in schedule.cut(q, 0, n):
            sent[w, q] = sent.get((w, q), 0) + b - a
            for k in range(a, b):
                at[pos + k - a] = at.get(pos + k - a, 0) + 1
    assert sorted(at) == list(range(100_004)) and set(at.values()) == {1}
    for w in range(100):
        assert abs(sent[w, "a"] - 700) <= 2 and abs(sent[w, "b"] - 200) <= 2 and abs(sent[w, "c"] - 100) <= 2


def test_given_weights_hold_until_a_queue_is_dry():
    schedule = packing.Schedule({"a": 5000, "b": 5000, "z": 500}, {"a": 1, "b": 4}, window=1000)
    first = {q: sum(b - a for _, a, b, w in schedule.cut(q, 0, n) if w < 5) for q, n in {"a": 5000, "b": 5000, "z": 500}.items()}
    assert abs(first["b"] - 4 * first["a"]) <= 10 and first["z"] == 0


def test_sequences_put_the_ids_together(spark, library):
    docs = spark.createDataFrame([(1, "one two three", "s"), (2, "four", "t")], "doc_id long, text string, source string")
    (row,) = packing.sequences(packing.pack(docs, tokenizer())).collect()
    ids = np.frombuffer(bytes(row.ids), "<u4").tolist()
    assert ids == library.encode("one two three").ids + [0] + library.encode("four").ids + [0]


def test_placing_holds_no_ids():
    """A worker that has placed documents has nothing of them left, and each piece has its own ids."""
    rng = np.random.default_rng(5)
    n = rng.integers(1, 4000, 1200)
    queues = ["a" if k % 3 else "b" for k in range(len(n))]
    ats, sent = [], {"a": 0, "b": 0}
    for q, size in zip(queues, n.tolist(), strict=True):
        ats.append(sent[q])
        sent[q] += size
    docs = [rng.integers(1, 50_000, size, np.int32).tobytes() for size in n.tolist()]
    cols = {"doc_id": range(len(n)), "source": queues, "queue": queues, "n": n, "at": ats, "base": [0] * len(n), "ids": pa.array(docs, pa.binary())}
    whole = pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in cols.items()})
    run = packing._place(packing.Schedule(sent, window=1 << 14), 1024)
    parts = [whole.slice(0, 700), whole.slice(700)]  # of a longer buffer too
    got = [b""] * len(n)
    for p in (p for out in run(iter(parts)) for p in out.to_pylist()):
        assert len(p["ids"]) == 4 * p["length"] and len(got[p["doc_id"]]) == 4 * p["start"] and p["doc_tokens"] == n[p["doc_id"]]
        got[p["doc_id"]] += p["ids"]
    assert got == docs
    tracemalloc.start()
    try:
        for _ in run(iter(parts)):
            pass
        gc.collect()
        assert tracemalloc.get_traced_memory()[0] < sum(map(len, docs)) / 10
    finally:
        tracemalloc.stop()


def test_ids_equal_the_library(library):
    rng = np.random.default_rng(3)
    letters = list("ab 1.\n\t '’st  É \x1c  漢é ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    work = Encoder(tokenizer(), slots=256)
    for _ in range(2):
        ids, counts = work.encode(texts, 200)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
