import re
import zlib

import numpy as np

import corpus_pipeline
from tagwright.llm import quality
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard import brute as classes
from tests.llm.test_secrets import brute as spans

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    done = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        done[name] = {r.doc_id: r for r in docs.collect()}
    start = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels.where(quality.remainder("doc_id", 5) != 0))
    signal = model.sizer()
    scores = {i: model.score(np.array([signal(r.text.encode())]), np.array([len(r.text.encode())]))[0] for i, r in start.items()}
    assert set(done["quality"]) == {i for i, s in scores.items() if s >= 0.3}
    known = [(i, r.text) for i, r in done["quality"].items()]
    assert set(done["near_duplicates"]) == {c for _, c, _ in classes(known)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {d for d, *_ in leaks([(i, r.text) for i, r in done["near_duplicates"].items()], items)}
    assert set(done["benchmark_leaks"]) == set(done["near_duplicates"]) - found
    assert set(done["secrets"]) == set(done["benchmark_leaks"])
    for i, r in done["secrets"].items():
        before = done["benchmark_leaks"][i].text
        assert not spans(r.text) and r.n_chars == len(r.text)
        assert spans(before) or re.search(r"-----BEGIN|eyJ|://", before) or r.text == before


def test_run_packs_what_the_stages_leave(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    from tokenizers import Tokenizer

    from tagwright.llm.queries import tokenizer

    t = Tokenizer.from_file(tokenizer())
    t.encode_special_tokens = True
    want = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids + [0] for r in docs.collect()}
    assert {p.doc_id for p in pieces} == set(want)
    for p in pieces:
        assert zlib.crc32(np.array(want[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    assert sum(p.length for p in pieces) == sum(map(len, want.values()))


def test_stages_stand_odd_rows(spark):
    rows = [(1, None, "en", "s", None, "x"), (2, "", None, None, 0, "x"), (None, "abc def", "en", "s", 7, "x"), (3, "the of and to in is it that", "en", "s", 27, None), (3, "the of and to in is it that", "en", "s", 27, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sha string")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            some = stage(spark, some, SF)
            assert some.columns == docs.columns
            some.count()
        corpus_pipeline.STAGES[-1][1](spark, some, SF).count()
