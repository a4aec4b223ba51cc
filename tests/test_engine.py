"""The hand-written rows, and the engine against plain Python."""

import datetime
import itertools
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagwright.api import Api, respond
from tagwright.functions import columns as C
from tagwright.functions import patterns as P
from tagwright.operators import bitmaps, boolean, exclude, paging, sets, stats, validate, wildcard
from tagwright.plans.engine import Engine
from tagwright.plans.query import ALL, Sort, TagQuery
from tagwright.plans.shared import shared_dir
from tagwright.sources import tables

DAY = datetime.datetime(2015, 1, 1)
EDGE = [
    (1, "<c#><.net>", 10), (2, "<c#>", None), (3, "<c#>", -1), (4, "<c#>", -5), (5, "", 3), (6, "<php><cakephp>", 10),
    (7, "<phonegap-pushplugin>", 2), (8, "<a_b><axb>", 1), (9, " <c#>  <java> ", 7), (10, "<java><jquery>", 8), (11, None, 0),
]


def made(spark, rows):
    full = [(i, f"t{i}", tags, DAY, DAY, score, (i * 7) % 5, i % 3, None) for i, tags, score in rows]
    return Engine.from_posts(spark.createDataFrame(full, tables.POSTS).cache())


@pytest.fixture(scope="module")
def edge(spark):
    return made(spark, EDGE)


def ids(df):
    return [r.id for r in df.orderBy("pos").collect()]


def test_null_scores_sort_as_minus_one_and_ties_by_id(edge):
    assert ids(paging.tag_page(edge, TagQuery("c#", Sort.SCORE))) == [1, 9, 3, 2, 4]
    assert ids(paging.tag_page(edge, TagQuery("c#", Sort.SCORE, 2, 1))) == [9, 3]
    assert ids(paging.tag_page(edge, TagQuery("c#", Sort.SCORE, 2, -7))) == [1, 9]
    assert ids(paging.tag_page(edge, TagQuery("c#", Sort.SCORE, 5, 50))) == []
    assert len(ids(paging.tag_page(edge, TagQuery(ALL, Sort.SCORE)))) == 11


def test_unknown_tags_and_bad_parameters(edge):
    with pytest.raises(ValueError):
        paging.tag_page(edge, TagQuery("nosuch"))
    for bad in ({"tag": " "}, {"tag": "c#", "page_size": 0}, {"tag": "c#", "page_size": 251}, {"tag": "c#", "operator": "NOT"}, {"tag": "c#", "mode": "x"}, {"tag": "c#", "other_tag": ""}):
        with pytest.raises(ValueError):
            TagQuery(**bad)


def test_posts_without_tags_are_in_or_not_only(edge):
    q = TagQuery("java", Sort.SCORE, 50, 0, "c#", "OR-NOT")
    assert set(ids(boolean.run(edge, q))) == {5, 6, 7, 8, 9, 10, 11}
    assert ids(boolean.run(edge, TagQuery("c#", Sort.SCORE, 50, 0, "c#", "AND"))) == [1, 9, 3, 2, 4]
    assert ids(boolean.run(edge, TagQuery("c#", Sort.SCORE, 50, 0, "c#", "AND-NOT"))) == []


def test_wildcards(edge):
    tags = lambda ps, s="contains": sorted(r.tag for r in wildcard.expand(edge, ps, s).collect())
    assert tags(["*a_b*"]) == ["a_b"] and tags(["*php*"]) == ["cakephp", "php"] and tags(["php*"]) == ["php"]
    assert tags(["j*a"]) == [] and tags(["j*a"], "regex") == ["java"] and tags(["J*A"], "like") == ["java"] and tags(["*c#*"], "like") == []
    assert len(tags(["*"])) == 9 and tags(["java", "nosuch"]) == ["java"]
    assert tags(["*php"], "trie") == tags(["*php"])
    grams = lambda ps: sorted(r.tag for r in wildcard.expand_grams(edge, ps).collect())
    assert grams(["*php*"]) == ["cakephp", "php"] and grams(["*a*"]) == [] and grams(["ja*", "java", "x"]) == ["java"]
    assert sorted(r.tag for r in wildcard.gram_candidates(edge, "*php*").collect()) == ["cakephp", "phonegap-pushplugin", "php"]


def test_grams():
    assert P.search_grams("php") == ["ph", "hp"] and P.search_grams("a") == ["a"] and P.search_grams("") == []
    assert P.searches("php*") == ["ph", "hp", "^p"] and P.searches("*php") == ["ph", "hp", "p^"] and P.searches("p*p") == []


def test_hashes(spark):
    def wang(k):
        m = 0xFFFFFFFF
        k = (~k + (k << 15)) & m
        k ^= k >> 12
        k = (k + (k << 2)) & m
        k ^= k >> 4
        k = (k * 2057) & m
        return k ^ (k >> 16)

    def fnv(k):
        h = 2166136261
        for b in (k & 0xFFFFFFFF).to_bytes(4, "little"):
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    rows = spark.createDataFrame([(k,) for k in (0, 1, 77, 2**31 - 1, 123456789)], "k long")
    for r in rows.select("k", C.wang_hash(F.col("k")).alias("w"), C.fnv1a_hash(F.col("k")).alias("f")).collect():
        assert (r.w, r.f) == (wang(r.k), fnv(r.k))
    assert C.human_size(1536) == "1 KB" and C.human_size(12) == "12 B" and C.human_size(5 << 30) == "5 GB"


def test_statistics(edge):
    totals = {r.tag: r.n for r in stats.tag_totals(edge).collect()}
    assert totals["c#"] == 5 and totals[ALL] == 11
    assert [r.tag for r in stats.extreme_tags(edge, 2).collect()] == ["c#", "java"]
    assert [r.tag for r in stats.tags_over(edge, 2).collect()] == ["c#"]
    row = stats.extremes(edge).first()
    assert row.most_score == 1
    for n, want in ((7, 7), (10, 10), (11, 20), (99, 100), (100, 200), (12345, 20000), (999_999, 1_000_000), (1_000_000, 1_000_000)):
        assert edge.posts.sparkSession.range(1).select(stats.bucket(F.lit(n))).first()[0] == want


def test_exclusion_and_bloom(edge):
    all_ = edge.list_of(ALL)
    want = {r.id for r in exclude.without(edge, all_, ("java", "php")).collect()}
    assert want == {1, 2, 3, 4, 5, 7, 8, 11}
    assert {r.id for r in exclude.without_bloom(edge, all_, ("java", "php")).collect()} == want
    assert {r.id for r in exclude.without_bloom(edge, all_, ("java", "php"), bits=4).collect()} <= want
    row = exclude.coverage(edge, ("java", "php")).first()
    assert (row.n_posts, row.n_excluded, row.n_included, row.n_listed, row.n_remaining) == (11, 3, 8, 2, 7)
    assert tuple(validate.exclusion_errors(edge, ("java",)).first()) == (0, 0)


def test_ranks_and_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v")).repartition(6)
    got = {r.id: r.rank for r in paging.ranked(df, [F.col("v"), F.col("id").desc()]).collect()}
    want = sorted(range(1000), key=lambda i: (i % 7, -i))
    assert got == {i: k + 1 for k, i in enumerate(want)}
    assert sorted(r.id for r in paging.sample(df, [F.col("id")], 4).collect()) == [0, 250, 500, 750]
    assert paging.sample(df.limit(3), [F.col("id")], 10).count() == 3 and paging.sample(df.limit(0), [F.col("id")], 2).count() == 0


def test_bitmaps(spark, edge, tmp_path):
    index = bitmaps.build(edge, Sort.SCORE).save(f"file://{tmp_path}/bitmaps")
    assert bitmaps.mismatches(index.sizes, index.bits).count() == 0 and bitmaps.violations(edge, index, Sort.SCORE).count() == 0
    assert tuple(bitmaps.pair_counts(index, "c#", "java").first()) == (1, 4, 6, 10)
    for op, excluded, skip in itertools.product(("AND", "AND-NOT", "OR", "OR-NOT"), ((), ("php",), ("php", ".net")), (0, 2)):
        q = TagQuery("c#", Sort.SCORE, 4, skip, "java", op, excluded)
        assert ids(bitmaps.page(edge, index, q, Sort.SCORE)) == ids(boolean.run(edge, q)), q
    assert bitmaps.union(index.bits, ("c#", "java")).agg(F.sum(F.bitmap_count("bits"))).first()[0] == 6


def test_bitmaps_of_many_buckets(spark):
    rows = spark.range(100_000).select("id", F.when(F.col("id") % 3 == 0, "<a>").when(F.col("id") % 3 == 1, "<a><b>").otherwise("<b>").alias("raw_tags"), (F.col("id") % 1000).cast("int").alias("score"))
    engine = Engine.from_posts(rows.select("id", F.lit("t").alias("title"), "raw_tags", F.lit(DAY).alias("creation_date"), F.lit(DAY).alias("last_activity_date"), "score", "score", F.lit(1).alias("answer_count")).toDF("id", "title", "raw_tags", "creation_date", "last_activity_date", "score", "view_count", "answer_count"))
    index = bitmaps.build(engine, Sort.SCORE)
    assert index.bits.select("bucket").distinct().count() == 4
    q = TagQuery("a", Sort.SCORE, 50, 30_000, "b", "AND-NOT")
    assert ids(bitmaps.page(engine, index, q, Sort.SCORE)) == ids(boolean.run(engine, q))
    assert {r.id for r in bitmaps.positions(index, TagQuery("a", Sort.SCORE, 1, 0, "b", "OR-NOT")).collect()} == {k for k in range(100_000) if k % 3 < 2}


def test_damaged_bitmaps_are_refused(spark, edge, tmp_path):
    index = bitmaps.build(edge, Sort.SCORE)
    lost = bitmaps.populate(edge.post_tags.where("not (tag = 'c#' and id = 3)"), index.places)
    with pytest.raises(ValueError, match="c# has 4 bits of 5"):
        bitmaps.BitmapIndex(lost, index.places, index.sizes).save(f"file://{tmp_path}/lost")
    got = {(r.tag, r.problem) for r in bitmaps.violations(edge, bitmaps.BitmapIndex(lost, index.places, index.sizes), Sort.SCORE).collect()}
    assert got == {("c#", "unset"), ("c#", "count")}
    swapped = index.places.withColumn("rank", F.when(F.col("rank") == 1, 11).when(F.col("rank") == 11, 1).otherwise(F.col("rank")))
    assert "order" in {r.problem for r in bitmaps.violations(edge, bitmaps.BitmapIndex(bitmaps.populate(edge.post_tags, swapped), swapped, index.sizes), Sort.SCORE).collect()}


def test_damaged_tables_are_refused(edge):
    with pytest.raises(ValueError, match="posting lists"):
        Engine(edge.posts, edge.post_tags.where("id <> 3"), edge.tag_counts).verify()
    assert edge.verify() is edge


def test_order_is_checked_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(validate, "STRETCH", 4)
    rows = [(t, k, 100 - k) for t in "ab" for k in range(1, 20)] + [("c", k, 5 if k < 8 else 6 if k == 8 else 3) for k in range(1, 12)]
    lists = spark.createDataFrame(rows, "tag string, pos long, sort_value long")
    assert [(r.tag, r.pos) for r in validate.order_violations(lists, Sort.SCORE, "tag").collect()] == [("c", 8)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ranks_of_whole_posts(spark, adaptive):
    """Whole rows keep their ranks, whatever columns a plan asks for."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        posts = tables.order_posts(spark, "/root/testdata/sf0.1").cache()
        total = posts.count()
        wide = paging.ranked(posts, C.order(Sort.SCORE))
        for names in (("id", "title", "raw_tags", "rank"), ("id", "title", "rank"), ("id", "rank")):
            row = wide.select(*names).agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.count_distinct("id")).first()
            assert tuple(row) == (total, total, 1, total, total)
        assert validate.order_violations(wide.select(F.col("rank").alias("pos"), C.sort_key(Sort.SCORE).alias("sort_value")), Sort.SCORE).count() == 0
        some = paging.sample(posts, [F.col("id")], 1000)
        assert some.count() == len(some.collect()) == 1000
        posts.unpersist()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_long_lists_of_patterns(edge, monkeypatch):
    patterns = ["*php*", "php*", "*php", "java", "j*a", "*", "c#", "*e*y*", "*ush*", "a*", "nosuch"]
    want = {s: {(r.pattern, r.tag) for r in wildcard.matched(edge, patterns, s).collect()} for s in wildcard.STRATEGIES}
    monkeypatch.setattr(wildcard, "CHUNK", 3)
    for s in wildcard.STRATEGIES:
        assert {(r.pattern, r.tag) for r in wildcard.matched(edge, patterns, s).collect()} == want[s], s
    assert want["contains"] == want["trie"]
    assert {(r.pattern, r.tag) for r in wildcard.matched_grams(edge, patterns).collect()} == {x for x in want["contains"] if x[0] != "*"}
    assert {(r.pattern, r.strategies) for r in wildcard.disagreements(edge, ["j*a", "*c#*", "php*"]).collect()} == {("j*a", "like,regex"), ("*c#*", "contains,grams,regex,trie")}


def test_pattern_coverage(edge):
    assert tuple(exclude.pattern_coverage(edge, ("ja*", "php", "php", "nosuch")).first()) == (3, 1, 2, 11, 3, 8, 7)


def test_walks_of_any_depth(spark, monkeypatch):
    """A walk that widens its look, and one that ranks whole lists, give what the first look would."""
    rng = random.Random(5)
    rows = [(k, "".join(f"<{t}>" for t in "abcd" if rng.random() < 0.5), rng.randrange(9)) for k in range(80)]
    engine = made(spark, rows)
    queries = [TagQuery("a", Sort.SCORE, 6, skip, "b", op, ("c",), "interleave") for op, skip in (("OR", 12), ("OR-NOT", 0), ("OR-NOT", 60), ("AND", 12))]
    want = [(ids(boolean.run(engine, q)), tuple(boolean.counters(engine, q).first())) for q in queries]
    monkeypatch.setattr(boolean, "_lengths", lambda e, q: iter([(2, False), (9, False), (len(rows), True)]))
    assert [(ids(boolean.run(engine, q)), tuple(boolean.counters(engine, q).first())) for q in queries] == want
    monkeypatch.setattr(boolean, "LONGEST", 4)
    assert [(ids(boolean.run(engine, q)), tuple(boolean.counters(engine, q).first())) for q in queries[:2]] == want[:2]


def test_sets(spark):
    a, x = F.array(*map(F.lit, "aab")), F.lit("a")
    row = spark.range(1).select(sets.add(a, F.lit("c")).alias("added"), sets.remove(a, x).alias("removed"), sets.contains(a, x).alias("has"), sets.clear(a).alias("none"), sets.remove_where(a, lambda c: c == "b").alias("where")).first()
    assert (row.added, row.removed, row.has, row.none, row.where) == (["a", "b", "c"], ["b"], True, [], ["a"])


def test_responses(edge):
    api = Api(edge, ("php",))
    got = json.loads(respond(api.tag("java", {"type": "Score"})))
    assert [r["id"] for r in sorted(got["results"], key=lambda r: r["pos"])] == [10, 9] and got["statistics"]["total_questions_for_tag"] == 2
    info = json.loads(respond(api.info()))
    assert info["sample_urls"][0].startswith("/api/Tags/c%23?") and len(info["sample_urls"]) == 7 and isinstance(info["messages"], list)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://x:7077"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session)


def test_validators_find_what_is_wrong(edge):
    q = TagQuery("c#", Sort.SCORE, 50, 0, "java", "AND")
    everything = edge.list_of(ALL)
    assert {r.id for r in validate.invalid_results(edge, everything, q).collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 10, 11}
    assert {r.id: r.bad for r in validate.leaks(edge, everything, ("java", "php")).collect()} == {9: ["java"], 10: ["java"], 6: ["php"]}
    wrong = everything.sparkSession.createDataFrame([(1, 5), (2, 6), (3, 1)], "pos long, sort_value long")
    assert [r.pos for r in validate.order_violations(wrong, Sort.SCORE).collect()] == [2]


def test_differences(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "id long"), spark.createDataFrame([(1,), (3,)], "id long")
    assert sorted(map(tuple, sets.difference(a, b).collect())) == [(1, "a"), (2, "a"), (3, "b")]


def test_save_and_load(spark, edge, tmp_path):
    saved = edge.save(f"file://{tmp_path}/index")
    again = Engine.load(spark, f"file://{tmp_path}/index")
    for e in (saved, again):
        assert ids(paging.tag_page(e, TagQuery("c#", Sort.SCORE))) == [1, 9, 3, 2, 4]
        assert validate.list_violations(e, Sort.SCORE).count() == 0


def test_dump(spark, tmp_path):
    path = tmp_path / "posts.xml"
    path.write_text(
        '<posts><row Id="4" PostTypeId="1" AcceptedAnswerId="7" CreationDate="2008-07-31T21:42:52.667" Score="30" ViewCount="" LastActivityDate="2010-02-04T22:33:13.630" Title="A &lt;b&gt;" Tags="&lt;c#&gt;&lt;winforms&gt;" AnswerCount="12"/><row Id="5" PostTypeId="2" Score="1"/>\n<row Id="6" PostTypeId="1" Score="x" CreationDate="2008-07-31T21:42:52.667" LastActivityDate="2008-07-31T21:42:52.667" Tags=""/></posts>'
    )
    dump = tables.read_dump(spark, f"file://{path}")
    good = dump.where("id = 4").first()
    assert (good.id, good.score, good.view_count, good.title, good.accepted_answer_id) == (4, 30, None, "A <b>", 7)
    assert good.creation_date == datetime.datetime(2008, 7, 31, 21, 42, 52, 667000)
    assert {f.name: f.dataType for f in dump.schema} == {f.name: f.dataType for f in tables.POSTS}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        dump.collect()


def test_lists_and_sinks(spark, tmp_path):
    (tmp_path / "list.txt").write_text("b*\n\na\na\n")
    assert tables.read_patterns(spark, f"file://{tmp_path}/list.txt") == ["a", "b*"]
    tables.write_csv([{"q": 1, "s": 2.5}], str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_text().split() == ["q,s", "1,2.5"]
    tables.write_json(spark.range(2), f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 2


def test_api(edge):
    api = Api(edge, ("php", "ja*"))
    out = api.query("c#", {"othertag": "java", "OPERATOR": "OR", "type": "score", "counters": "", "debugMode": "true", "useDefaultExclusions": "true"})
    assert ids(out["results"]) == [1, 3, 2, 4] and out["statistics"]["total_questions_per_tag"] == {"c#": 5, "java": 2}
    assert out["debugging"]["invalid_results"].count() == 0 and out["debugging"]["should_be_excluded"].count() == 0
    assert ids(api.tag("java", {"type": "Score"})["results"]) == [10, 9] and api.question(3).first().id == 3 and api.question(99).count() == 0
    assert [tuple(r) for r in api.wildcards({"wildcards": "*php*,zz*"})["counts"].collect()] == [("*php*", 2), ("zz*", 0)]
    assert [r.tag for r in api.default_expanded().collect()] == ["java", "php"] and api.default_list()["wildcards"] == ["ja*"]
    assert api.info()["total_questions"] == 11 and api.wildcards({})["counts"] is None
    with pytest.raises(ValueError):
        api.query("c#", {})


def plain_walk(posts, q):
    """Both lists, entry by entry, until the page is full."""
    key = lambda p: (-(p[2] if p[2] is not None else -1), -p[0])
    tags = {p[0]: set((p[1] or "").replace("<", " ").replace(">", " ").split()) for p in posts}
    ranked = [p[0] for p in sorted(posts, key=key)]
    a, b = ([i for i in ranked if t in tags[i]] for t in (q.tag, q.other_tag))
    if q.operator.startswith("AND"):
        entries = [(i, (q.other_tag in tags[i]) == (q.operator == "AND")) for i in a]
    else:
        second = b if q.operator == "OR" else ranked
        entries = [(i, q.operator == "OR" or q.other_tag not in tags[i]) for pair in zip(a, second, strict=False) for i in pair]
    out, seen, skipped, excluded, at = [], set(), 0, 0, 0
    for i, member in entries:
        if len(out) == q.page_size:
            break
        at += 1
        if tags[i] & set(q.exclusions):
            excluded += 1
        elif member and i not in seen:
            seen.add(i)
            if skipped < q.offset:
                skipped += 1
            else:
                out.append(i)
    return out, (at if q.operator.startswith("AND") else (at + 1) // 2, skipped, excluded)


@pytest.mark.parametrize("seed", range(2))
def test_interleave_equals_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(k, "".join(f"<{t}>" for t in "abcd" if rng.random() < 0.4), rng.choice([None, *range(-3, 4)])) for k in range(60)]
    engine = made(spark, rows)
    for op, skip, excluded in itertools.product(("AND", "AND-NOT", "OR", "OR-NOT"), (0, 4), ((), ("c",))):
        q = TagQuery("a", Sort.SCORE, 6, skip, "b", op, excluded, "interleave")
        want, (base, skipped, bad) = plain_walk(rows, q)
        assert ids(boolean.run(engine, q)) == want, q
        row = boolean.counters(engine, q).first()
        assert (row.base_query, row.items_skipped, row.excluded) == (base, skipped, bad), q


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.data())
def test_set_mode_equals_plain_sets(spark, data):
    rows = data.draw(st.lists(st.tuples(st.sets(st.sampled_from("abc")), st.one_of(st.none(), st.integers(-3, 3))), min_size=3, max_size=12))
    posts = [(k, "".join(f"<{t}>" for t in sorted(tags)), score) for k, (tags, score) in enumerate(rows)] + [(100, "<a><b><c>", 0)]
    q = TagQuery("a", Sort.SCORE, data.draw(st.integers(1, 5)), data.draw(st.integers(-1, 4)), "b", data.draw(st.sampled_from(["AND", "AND-NOT", "OR", "OR-NOT"])), data.draw(st.sampled_from([(), ("c",)])))
    tags = {i: set(t.replace("<", " ").replace(">", " ").split()) for i, t, _ in posts}
    ok = {"AND": lambda t: "a" in t and "b" in t, "AND-NOT": lambda t: "a" in t and "b" not in t, "OR": lambda t: "a" in t or "b" in t, "OR-NOT": lambda t: "a" in t or "b" not in t}[q.operator]
    want = [i for i, _, s in sorted(posts, key=lambda p: (-(p[2] if p[2] is not None else -1), -p[0])) if ok(tags[i]) and not tags[i] & set(q.exclusions)]
    assert ids(boolean.run(made(spark, posts), q)) == want[q.offset : q.offset + q.page_size]
