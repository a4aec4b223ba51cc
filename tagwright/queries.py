"""The engine's registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright import api
from tagwright.functions import columns as C
from tagwright.operators import bitmaps, boolean, exclude, paging, sets, stats, validate, wildcard
from tagwright.plans.engine import Engine, engine_for
from tagwright.plans.query import ALL, Sort, TagQuery
from tagwright.sources.tables import tag_rows

BASE = """
WITH lp AS (SELECT l_orderkey AS id, p_name, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
post_tags AS (
  SELECT DISTINCT id, tag FROM (
    SELECT id, unnest(string_split(lower(p_name), ' ')) AS tag FROM lp
    UNION ALL SELECT id, lower(p_brand) FROM lp
    UNION ALL SELECT id, lower(p_type) FROM lp
    UNION ALL SELECT o_orderkey, lower(replace(o_orderpriority, ' ', '-')) FROM orders)),
sums AS (
  SELECT l_orderkey AS k, max(l_shipdate) AS shipped, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS INTEGER) AS score,
         CAST(count(*) AS INTEGER) AS answer_count, CAST(min(CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS INTEGER) AS accepted_answer_id
  FROM lineitem GROUP BY l_orderkey),
posts AS (
  SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, o_orderdate AS creation_date, coalesce(shipped, o_orderdate) AS last_activity_date,
         score, CAST(floor(o_totalprice) AS INTEGER) AS view_count, answer_count, accepted_answer_id
  FROM orders LEFT JOIN sums ON o_orderkey = k),
listed AS (SELECT id, string_agg(tag, ',' ORDER BY tag) AS tags FROM post_tags GROUP BY id),
tag_counts AS (SELECT tag, count(*) AS n FROM post_tags GROUP BY tag)
"""
KEYS = {Sort.LAST_ACTIVITY: "last_activity_date", Sort.CREATION: "creation_date", Sort.SCORE: "CAST(coalesce(score, -1) AS BIGINT)", Sort.VIEWS: "CAST(coalesce(view_count, -1) AS BIGINT)", Sort.ANSWERS: "CAST(coalesce(answer_count, -1) AS BIGINT)"}
EXCLUDED = ("brand#2", "hot", "4-not-specified")
PATTERNS = ("brand#1*", "*1", "*#2*", "*e*", "s*l", "nosuch*", "red", "nosuch")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Callable[[Engine], DataFrame], sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(engine_for(spark, sf_dir))

    QUERIES[name] = run
    if sql is not None:
        SQL[name] = BASE + sql


def members(q: TagQuery) -> str:
    a, b = (f"id IN (SELECT id FROM post_tags WHERE tag = '{t}')" for t in (q.tag, q.other_tag))
    return {"AND": f"{a} AND {b}", "AND-NOT": f"{a} AND NOT {b}", "OR": f"({a} OR {b})", "OR-NOT": f"({a} OR NOT {b})"}[q.operator]


def not_excluded(tags) -> str:
    return f" AND id NOT IN (SELECT id FROM post_tags WHERE tag IN ({', '.join(repr(t) for t in tags)}))" if tags else ""


def page_sql(sort: Sort, where: str, skip: int, size: int) -> str:
    key = KEYS[sort]
    return f"SELECT row_number() OVER (ORDER BY {key} DESC, id DESC) AS pos, id, {key} AS sort_value FROM posts WHERE {where} ORDER BY pos LIMIT {size} OFFSET {max(0, skip)}"


def tag_in(tag: str) -> str:
    return f"id IN (SELECT id FROM post_tags WHERE tag = '{tag}')"


def _register_pages() -> None:
    for name, sort, tag, skip in (("score", Sort.SCORE, "brand#1", 0), ("views", Sort.VIEWS, "small", 0), ("answers", Sort.ANSWERS, "hot", 40), ("created", Sort.CREATION, "red", 0), ("activity", Sort.LAST_ACTIVITY, "large", 10)):
        q = TagQuery(tag, sort, 50, skip)
        register(f"tag_page_{name}", lambda e, q=q: paging.tag_page(e, q), page_sql(sort, tag_in(tag), skip, 50))
    deep = TagQuery("small", Sort.SCORE, 25, 1000)
    register("tag_page_deep_skip", lambda e: paging.tag_page(e, deep), page_sql(deep.sort, tag_in("small"), 1000, 25))
    all_ = TagQuery(ALL, Sort.VIEWS, 25, 100)
    register("tag_page_all", lambda e: paging.tag_page(e, all_), page_sql(all_.sort, "true", 100, 25))
    past = TagQuery("red", Sort.SCORE, 25, 10_000_000)
    register("tag_page_past_end", lambda e: paging.tag_page(e, past), page_sql(past.sort, tag_in("red"), 10_000_000, 25))
    register("page_fetch", lambda e: paging.fetch(e, paging.tag_page(e, TagQuery("hot", Sort.SCORE, 50))).select("pos", "id", "title", "score", "view_count", "answer_count"), f"SELECT pos, id, title, score, view_count, answer_count FROM ({page_sql(Sort.SCORE, tag_in('hot'), 0, 50)}) JOIN posts USING (id)")
    register("top100_views", paging.top_views, "SELECT row_number() OVER (ORDER BY view_count DESC NULLS LAST, id DESC) AS pos, id, CAST(view_count AS BIGINT) AS view_count FROM posts ORDER BY pos LIMIT 100")
    register("point_lookup", lambda e: paging.lookup(e, 77).select("id", "title", "view_count"), "SELECT id, title, view_count FROM posts WHERE id = 77")
    register("tag_sample", lambda e: paging.sample(e.tag_counts, [F.desc("n"), F.col("tag")], 10), "SELECT tag, n FROM (SELECT tag, n, row_number() OVER (ORDER BY n DESC, tag) AS r, count(*) OVER () AS c FROM tag_counts) WHERE (r - 1) % greatest(1, c // 10) = 0 ORDER BY r LIMIT 10")
    wide = lambda e: paging.ranked(e.posts, C.order(Sort.SCORE)).select("id", "title", "view_count", "rank")
    register("global_rank_wide", wide, "SELECT id, title, view_count, row_number() OVER (ORDER BY coalesce(score, -1) DESC, id DESC) AS rank FROM posts")
    register("post_sample", lambda e: paging.sample(e.posts, C.order(Sort.VIEWS), 1000).drop("raw_tags"), "SELECT id, title, creation_date, last_activity_date, score, view_count, answer_count, accepted_answer_id FROM (SELECT *, row_number() OVER (ORDER BY coalesce(view_count, -1) DESC, id DESC) AS r, count(*) OVER () AS c FROM posts) WHERE (r - 1) % greatest(1, c // 1000) = 0 ORDER BY r LIMIT 1000")
    register("global_rank", lambda e: paging.ranked(e.posts, C.order(Sort.SCORE)).select("id", "rank"), "SELECT id, row_number() OVER (ORDER BY coalesce(score, -1) DESC, id DESC) AS rank FROM posts")


def _register_boolean() -> None:
    for op, name in (("AND", "and"), ("AND-NOT", "andnot"), ("OR", "or"), ("OR-NOT", "ornot")):
        for suffix, excluded, sort, pair, skip in (("", (), Sort.SCORE, ("hot", "red"), 0), ("_excl", EXCLUDED, Sort.VIEWS, ("small", "brand#1"), 25), ("_swapped", (), Sort.ANSWERS, ("brand#1", "small"), 100), ("_activity", (), Sort.LAST_ACTIVITY, ("red", "large"), 0), ("_created", ("red",), Sort.CREATION, ("small", "hot"), 5)):
            q = TagQuery(pair[0], sort, 25, skip, pair[1], op, excluded)
            register(f"bool_{name}{suffix}", lambda e, q=q: boolean.run(e, q), page_sql(sort, members(q) + not_excluded(excluded), skip, 25))
        q = TagQuery("hot", Sort.SCORE, 25, 0, "red", op)
        register(f"bool_{name}_count", lambda e, q=q: boolean.matching(e, q).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM posts WHERE {members(q)}")
        for suffix, excluded, skip in (("", (), 10), ("_excl", EXCLUDED, 40)):
            q = TagQuery("small", Sort.SCORE, 25, skip, "brand#1", op, excluded, "interleave")
            if op in ("OR", "OR-NOT"):
                register(f"{name}_interleave{suffix}", lambda e, q=q: boolean.run(e, q), interleave_sql(q))
            register(f"{name}_counters{suffix}", lambda e, q=q: boolean.counters(e, q), counters_sql(q))


def _register_grid() -> None:
    """The paging grid: every operator at every skip."""
    for op, name in (("AND", "and"), ("AND-NOT", "andnot"), ("OR", "or"), ("OR-NOT", "ornot")):
        for skip in (100, 500, 2000, 8000):
            q = TagQuery("hot", Sort.LAST_ACTIVITY, 25, skip, "red", op, ("brand#13",))
            register(f"grid_{name}_{skip}", lambda e, q=q: boolean.run(e, q), page_sql(q.sort, members(q) + not_excluded(q.exclusions), skip, 25))


def walk_sql(q: TagQuery) -> str:
    key = KEYS[q.sort]
    rank = lambda where: f"SELECT id, row_number() OVER (ORDER BY {key} DESC, id DESC) AS r FROM posts WHERE {where}"
    has = f"id IN (SELECT id FROM post_tags WHERE tag = '{q.other_tag}')"
    listed = ", ".join(repr(t) for t in q.exclusions) or "''"
    bad = f"id IN (SELECT id FROM post_tags WHERE tag IN ({listed}))"
    if q.operator in ("AND", "AND-NOT"):
        entries, end, member = "SELECT id, r AS pos FROM one", "n1", has if q.operator == "AND" else f"NOT {has}"
    else:
        entries = "SELECT id, 2 * r - 1 AS pos FROM one, sizes WHERE r <= m UNION ALL SELECT id, 2 * r AS pos FROM two, sizes WHERE r <= m"
        end, member = "2 * m", "true" if q.operator == "OR" else f"NOT {has}"
    second = "true" if q.operator == "OR-NOT" else has
    return f""",
one AS ({rank(tag_in(q.tag))}), two AS ({rank(second)}),
sizes AS (SELECT (SELECT count(*) FROM one) AS n1, (SELECT count(*) FROM post_tags WHERE tag = '{q.other_tag}') AS n2, least((SELECT count(*) FROM one), (SELECT count(*) FROM two)) AS m),
entries AS (SELECT id, pos, {bad} AS bad, {member} AS member FROM ({entries})),
firsts AS (SELECT id, bad, min(pos) AS pos FROM entries WHERE member GROUP BY id, bad),
good AS (SELECT id, pos, row_number() OVER (ORDER BY pos) AS k FROM firsts WHERE NOT bad),
ends AS (SELECT {end} AS end_ FROM sizes)
"""


def interleave_sql(q: TagQuery) -> str:
    return walk_sql(q) + f"SELECT k AS pos, id, {KEYS[q.sort]} AS sort_value FROM good JOIN posts USING (id) WHERE k > {q.offset} AND k <= {q.offset + q.page_size}"


def counters_sql(q: TagQuery) -> str:
    want = q.offset + q.page_size
    zipped, half = q.operator in ("OR", "OR-NOT"), "(last + 1) // 2"
    tag = half if zipped else "last"
    other = half if q.operator == "OR" else "n2"
    if q.operator == "OR":
        tag, other = f"CASE WHEN is_full THEN {half} ELSE least(n1, n2 + 1) END", f"CASE WHEN is_full THEN {half} ELSE least(n1, n2) END"
    elif q.operator == "OR-NOT":
        tag = f"CASE WHEN is_full THEN {half} ELSE n1 END"
    return (
        walk_sql(q)
        + f""", stop AS (SELECT (SELECT count(*) FROM good) >= {want} AS is_full, coalesce((SELECT pos FROM good WHERE k = {want}), end_) AS last, n1, n2 FROM sizes, ends)
SELECT CAST({half if zipped else "last"} AS BIGINT) AS base_query, CAST(least({q.offset}, (SELECT count(*) FROM good)) AS BIGINT) AS items_skipped, CAST({tag} AS BIGINT) AS tag, CAST({other} AS BIGINT) AS other_tag,
       (SELECT count(*) FROM entries WHERE bad AND pos <= last) AS excluded, (SELECT count(*) FROM firsts WHERE bad AND pos <= last) AS exclusion FROM stop"""
    )


def _register_exclusion() -> None:
    q = TagQuery("small", Sort.SCORE, 50, 0, exclusions=EXCLUDED)
    sql = page_sql(q.sort, tag_in("small") + not_excluded(EXCLUDED), 0, 50)
    register("excl_page", lambda e: paging.tag_page(e, q), sql)
    register("excl_page_bloom", lambda e: paging.page(exclude.without_bloom(e, e.list_of(q.tag), EXCLUDED), q.sort, 0, 50), sql)
    listed = ", ".join(repr(t) for t in EXCLUDED)
    register("excl_coverage", lambda e: exclude.coverage(e, EXCLUDED), f"SELECT n_posts, n_excluded, n_posts - n_excluded AS n_included, n_listed, n_tags - n_listed AS n_remaining FROM (SELECT (SELECT count(*) FROM posts) AS n_posts, (SELECT count(DISTINCT id) FROM post_tags WHERE tag IN ({listed})) AS n_excluded, (SELECT count(*) FROM tag_counts WHERE tag IN ({listed})) AS n_listed, (SELECT count(*) FROM tag_counts) AS n_tags)")
    for k in (1, 3, 6, 12, 25):
        tags = tuple(f"brand#{i}" for i in range(1, k + 1))
        register(f"excl_scaling_{k}", lambda e, tags=tags: paging.tag_page(e, TagQuery("hot", Sort.SCORE, 50, exclusions=tags)), page_sql(Sort.SCORE, tag_in("hot") + not_excluded(tags), 0, 50))
    for k in (50, 400, 1600, 6400):  # names that few posts or none have, as most of a long list
        tags = ("brand#13", "brand#24", "brand#31", *(f"made-up-{i}" for i in range(k - 3)))
        register(f"excl_scaling_{k}", lambda e, tags=tags: paging.tag_page(e, TagQuery("hot", Sort.SCORE, 50, exclusions=tags)), page_sql(Sort.SCORE, tag_in("hot") + not_excluded(tags), 0, 50))
    register("excl_pattern_coverage", lambda e: exclude.pattern_coverage(e, ("brand#1*", "*-specified", "hot", "nosuch")), """SELECT CAST(4 AS BIGINT) AS n_patterns, CAST(2 AS BIGINT) AS n_wildcards, n_expanded, n_posts, n_excluded, n_posts - n_excluded AS n_included, n_tags - n_expanded AS n_remaining FROM (
SELECT (SELECT count(*) FROM posts) AS n_posts, (SELECT count(*) FROM tag_counts) AS n_tags,
       (SELECT count(*) FROM tag_counts WHERE starts_with(tag, 'brand#1') OR suffix(tag, '-specified') OR tag = 'hot') AS n_expanded,
       (SELECT count(DISTINCT id) FROM post_tags WHERE starts_with(tag, 'brand#1') OR suffix(tag, '-specified') OR tag = 'hot') AS n_excluded)""")


def _pattern_sql(tests: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{p}' AS pattern, tag FROM tag_counts WHERE {t}" for p, t in tests.items())


def dictionary(n: int = 38_000):
    """A made dictionary of tags, as an engine without posts and as SQL."""

    def made(e: Engine) -> Engine:
        k = F.col("id")
        return Engine(e.posts, e.post_tags, e.posts.sparkSession.range(n).select(F.concat(F.lit("tag-"), F.lower(F.conv(k * 7919 % 1_000_003, 10, 36)), F.when(k % 3 == 0, "-api").when(k % 3 == 1, "").otherwise(".js")).alias("tag"), F.lit(1).cast("long").alias("n")))

    digits = "'0123456789abcdefghijklmnopqrstuvwxyz'"
    base = "ltrim(" + " || ".join(f"substr({digits}, CAST(v // {36**i} % 36 AS INTEGER) + 1, 1)" for i in (3, 2, 1, 0)) + ", '0')"
    return made, f"SELECT 'tag-' || CASE WHEN v = 0 THEN '0' ELSE {base} END || CASE k % 3 WHEN 0 THEN '-api' WHEN 1 THEN '' ELSE '.js' END AS tag FROM (SELECT range AS k, range * 7919 % 1000003 AS v FROM range({n}))"


def long_list(n: int = 2_500):
    """Made patterns, three of four with stars, as a list and as SQL."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    text = lambda k: digits[k * 31 % 36] + digits[k * 17 // 36 % 36] + digits[k % 36]
    listed = [(f"*{text(k)}*", f"tag-{text(k)}*", f"*{text(k)}.js", f"tag-{text(k)}")[k % 4] for k in range(n)]
    d = f"'{digits}'"
    x = " || ".join(f"substr({d}, CAST({at} % 36 AS INTEGER) + 1, 1)" for at in ("range * 31", "range * 17 // 36", "range"))
    sql = f"SELECT DISTINCT CASE k % 4 WHEN 0 THEN '*' || x || '*' WHEN 1 THEN 'tag-' || x || '*' WHEN 2 THEN '*' || x || '.js' ELSE 'tag-' || x END AS p FROM (SELECT range AS k, {x} AS x FROM range({n}))"
    return listed, sql


def _register_wildcards() -> None:
    contains = {"brand#1*": "starts_with(tag, 'brand#1')", "*1": "suffix(tag, '1')", "*#2*": "contains(tag, '#2')", "*e*": "contains(tag, 'e')", "s*l": "false", "nosuch*": "starts_with(tag, 'nosuch')", "red": "tag = 'red'", "nosuch": "tag = 'nosuch'"}
    inner = contains | {"s*l": "starts_with(tag, 's') AND suffix(tag, 'l') AND length(tag) >= 2"}
    like = inner | {"*#2*": "regexp_matches(tag, '[0-9]2')", "brand#1*": "regexp_matches(tag, '^brand[0-9]1')"}
    register("wild_contains", lambda e: wildcard.matched(e, PATTERNS), _pattern_sql(contains))
    register("wild_regex", lambda e: wildcard.matched(e, PATTERNS, "regex"), _pattern_sql(inner))
    register("wild_like", lambda e: wildcard.matched(e, PATTERNS, "like"), _pattern_sql(like))
    register("wild_trie", lambda e: wildcard.matched(e, PATTERNS, "trie"), _pattern_sql(contains))
    for name, p in (("prefix", "brand#1*"), ("suffix", "*1"), ("star", "*")):
        register(f"wild_{name}", lambda e, p=p: wildcard.expand(e, [p]), f"SELECT tag FROM tag_counts WHERE {contains.get(p, 'true')}")
    grams = ("brand#1*", "*1", "*#2*", "nosuch*", "red", "nosuch")
    register("wild_grams", lambda e: wildcard.expand_grams(e, grams), f"SELECT DISTINCT tag FROM ({_pattern_sql({p: contains[p] for p in grams})})")
    register("wild_counts", lambda e: wildcard.counts(e, PATTERNS), " UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) AS n FROM tag_counts WHERE {t}" for p, t in contains.items()))
    register("wild_lists", lambda e: wildcard.lists(e, PATTERNS).select("pattern", F.array_join("tags", ",").alias("tags")), f"SELECT pattern, string_agg(tag, ',' ORDER BY tag) AS tags FROM ({_pattern_sql(contains)}) GROUP BY pattern")
    excluded = ("brand#1*", "*-specified", "hot")
    register("wild_excl_page", lambda e: wildcard.excluded_page(e, TagQuery("small", Sort.SCORE, 50), excluded), page_sql(Sort.SCORE, f"{tag_in('small')} AND id NOT IN (SELECT id FROM post_tags WHERE starts_with(tag, 'brand#1') OR suffix(tag, '-specified') OR tag = 'hot')", 0, 50))
    anchored = "SELECT DISTINCT s[i:i+1] AS gram, tag FROM (SELECT tag, '^' || tag || '^' AS s, unnest(range(1, length(tag) + 2)) AS i FROM tag_counts)"
    register("ngram_index", wildcard.gram_index, anchored)
    register("ngram_totals", stats.gram_totals, f"SELECT count(DISTINCT gram) AS n_grams, count(*) AS n_postings FROM ({anchored})")
    register("ngram_candidates", lambda e: wildcard.gram_candidates(e, "*rand*"), f"SELECT tag FROM ({anchored}) WHERE gram IN ('ra', 'an', 'nd') GROUP BY tag HAVING count(*) = 3")
    made, many = dictionary(), long_list()
    test = "CASE WHEN p[1] = '*' AND p[-1] = '*' THEN contains(tag, x) WHEN p[-1] = '*' THEN starts_with(tag, x) WHEN p[1] = '*' THEN suffix(tag, x) ELSE tag = x END"
    many_sql = f"SELECT p AS pattern, tag FROM ({made[1]}) JOIN (SELECT p, replace(p, '*', '') AS x FROM ({many[1]})) ON {test}"
    for strategy in ("contains", "trie"):
        register(f"wild_long_{strategy}", lambda e, s=strategy: wildcard.matched(made[0](e), many[0], s), many_sql)
    register("wild_long_grams", lambda e: wildcard.matched_grams(made[0](e), many[0]), many_sql)
    register("wild_disagree", lambda e: wildcard.disagreements(e, ("*#2*", "s*l", "brand#1*", "*1", "red", "*e*")), """
SELECT '*#2*' AS pattern, tag, CASE WHEN contains(tag, '#2') THEN 'contains,grams,regex,trie' ELSE 'like' END AS strategies FROM tag_counts WHERE contains(tag, '#2') <> regexp_matches(tag, '[0-9]2')
UNION ALL SELECT 's*l', tag, 'like,regex' FROM tag_counts WHERE starts_with(tag, 's') AND suffix(tag, 'l') AND length(tag) >= 2
UNION ALL SELECT 'brand#1*', tag, CASE WHEN starts_with(tag, 'brand#1') THEN 'contains,grams,regex,trie' ELSE 'like' END FROM tag_counts WHERE starts_with(tag, 'brand#1') <> regexp_matches(tag, '^brand[0-9]1')
UNION ALL SELECT '*e*', tag, 'contains,like,regex,trie' FROM tag_counts WHERE contains(tag, 'e')""")
    register("wild_agree", lambda e: sets.difference(wildcard.expand(e, grams), wildcard.expand_grams(e, grams)), "SELECT tag, 'a' AS side FROM tag_counts WHERE false")


def _register_stats() -> None:
    register("tag_counts", stats.tag_totals, f"SELECT tag, n FROM tag_counts UNION ALL SELECT '{ALL}', count(*) FROM posts")
    register("tag_total", lambda e: stats.total(e, "hot"), "SELECT 'hot' AS tag, count(*) AS n FROM post_tags WHERE tag = 'hot'")
    register("tags_over_n", lambda e: stats.tags_over(e, 2000), "SELECT tag, n FROM tag_counts WHERE n > 2000")
    register("top_tags", lambda e: stats.extreme_tags(e, 20), "SELECT tag, n FROM tag_counts ORDER BY n DESC, tag LIMIT 20")
    register("bottom_tags", lambda e: stats.extreme_tags(e, 20, most=False), "SELECT tag, n FROM tag_counts ORDER BY n, tag LIMIT 20")
    bucket = "CASE WHEN n <= 10 THEN n " + " ".join(f"WHEN n < {10 ** (k + 1)} THEN n // {10**k} * {10**k} + {10**k}" for k in range(1, 6)) + " ELSE n END"
    register("tag_histogram", stats.histogram, f"SELECT bucket, n_tags, CAST(sum(n_tags) OVER (ORDER BY bucket) AS BIGINT) AS up_to, CAST(sum(n_tags) OVER (ORDER BY bucket DESC) AS BIGINT) AS from_on FROM (SELECT CAST({bucket} AS BIGINT) AS bucket, count(*) AS n_tags FROM tag_counts GROUP BY 1)")
    names = ("creation_date", "last_activity_date", "score", "view_count", "answer_count")
    register("post_stats", stats.summary, f"SELECT count(*) AS n_posts, {', '.join(f'min({c}) AS min_{c}, max({c}) AS max_{c}' for c in names)}, {', '.join(f'count(*) - count({c}) AS null_{c}' for c in names[2:])} FROM posts")
    register("argmax_posts", stats.extremes, "SELECT " + ", ".join(f"(SELECT id FROM posts WHERE {c} IS NOT NULL ORDER BY {c} DESC, id LIMIT 1) AS most_{c}" for c in ("view_count", "answer_count", "score")))
    register("remaining_tags", lambda e: stats.remaining_tags(e, wildcard.expand(e, ["brand#*"])), "SELECT tag FROM tag_counts WHERE NOT starts_with(tag, 'brand#')")
    register("tokenize_rawtags", lambda e: tag_rows(e.posts).select("id", "tag"), "SELECT id, tag FROM post_tags")
    register("display_fields", lambda e: e.posts.select("id", C.display(Sort.SCORE).alias("score"), C.display(Sort.VIEWS).alias("views"), C.display(Sort.CREATION).alias("created"), C.url(F.col("id")).alias("url")), "SELECT id, coalesce(format('{:,}', score), '<null>') AS score, format('{:,}', view_count) AS views, strftime(creation_date, '%Y-%m-%d %H:%M:%S') AS created, 'https://example.com/questions/' || id AS url FROM posts")
    def algebra(e: Engine) -> DataFrame:
        letters = F.array(*(F.lit(t) for t in ("hot", "red", "small", "large")))
        tags = F.filter(C.tokenize(F.col("raw_tags")), lambda t: ~F.startswith(t, F.lit("brand#")))
        flat = {k: F.array_join(F.array_sort(c), ",") if k in ("union", "intersect", "except", "symmetric") else c for k, c in sets.algebra(tags, letters).items()}
        return e.posts.select("id", *(c.alias(k) for k, c in flat.items()))

    register("tag_set_algebra", algebra, ALGEBRA_SQL)
    register("list_diff", lambda e: sets.difference(e.list_of("hot").select("id"), e.list_of("red").select("id")), f"SELECT id, 'a' AS side FROM posts WHERE {tag_in('hot')} AND NOT {tag_in('red')} UNION ALL SELECT id, 'b' FROM posts WHERE {tag_in('red')} AND NOT {tag_in('hot')}")
    register("reverse_popcount", lambda e: e.tag_counts.select("tag", C.reversed_text(F.col("tag")).alias("reversed"), C.popcount(F.col("n")).cast("long").alias("ones")), "SELECT tag, reverse(tag) AS reversed, CAST(bit_count(n) AS BIGINT) AS ones FROM tag_counts")


ALGEBRA_SQL = """
, a AS (SELECT p.id, list_sort(list_filter(coalesce(string_split(l.tags, ','), []), lambda x: NOT starts_with(x, 'brand#'))) AS t, ['hot', 'large', 'red', 'small'] AS s FROM posts p LEFT JOIN listed l ON p.id = l.id),
b AS (SELECT id, t, s, list_filter(t, lambda x: NOT list_contains(s, x)) AS l, list_filter(s, lambda x: NOT list_contains(t, x)) AS r, list_filter(t, lambda x: list_contains(s, x)) AS i FROM a)
SELECT id, array_to_string(list_sort(list_concat(t, r)), ',') AS "union", array_to_string(i, ',') AS "intersect", array_to_string(l, ',') AS "except", array_to_string(list_sort(list_concat(l, r)), ',') AS symmetric,
       len(l) = 0 AS subset, len(l) = 0 AND len(r) > 0 AS proper_subset, len(r) = 0 AS superset, len(r) = 0 AND len(l) > 0 AS proper_superset, len(i) > 0 AS overlaps, len(l) = 0 AND len(r) = 0 AS equal FROM b
"""


def spoilt(e: Engine, tag: str = "hot", every: int = 101) -> Engine:
    """An engine whose list of a tag lacks every so many posts and has wrong scores for others."""
    off = (F.col("tag") == tag) & (F.col("id") % every == 0)
    wrong = (F.col("tag") == tag) & (F.col("id") % every == 1)
    lists = e.post_tags.where(~off).withColumn("score", F.when(wrong, F.coalesce("score", F.lit(0)) + 1000).otherwise(F.col("score")))
    return Engine(e.posts, lists, e.tag_counts)


def _register_bitmaps_and_checks() -> None:
    register("bitmap_cardinality", lambda e: bitmaps.cardinalities(bitmaps.index_for(e, Sort.SCORE).bits), "SELECT tag, n FROM tag_counts")
    a, b = tag_in("hot"), tag_in("red")
    register("bitmap_pairs", lambda e: bitmaps.pair_counts(bitmaps.index_for(e, Sort.VIEWS), "hot", "red"), f"SELECT count(*) FILTER ({a} AND {b}) AS n_and, count(*) FILTER ({a} AND NOT {b}) AS n_and_not, count(*) FILTER ({a} OR {b}) AS n_or, count(*) FILTER ({a} OR NOT {b}) AS n_or_not FROM posts")
    for op, name in (("AND", "and"), ("AND-NOT", "andnot"), ("OR", "or"), ("OR-NOT", "ornot")):
        paged = TagQuery("small", Sort.SCORE, 25, 30, "brand#1", op, EXCLUDED)
        register(f"bitmap_page_{name}", lambda e, q=paged: bitmaps.page(e, bitmaps.index_for(e, Sort.SCORE), q, Sort.SCORE), page_sql(Sort.SCORE, members(paged) + not_excluded(EXCLUDED), 30, 25))
        whole = TagQuery("hot", Sort.SCORE, 25, 0, "red", op, ("brand#13",))
        register(f"bitmap_places_{name}", lambda e, q=whole: bitmaps.positions(bitmaps.index_for(e, Sort.SCORE), q), f"SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY coalesce(score, -1) DESC, id DESC) AS rank FROM posts) WHERE {members(whole)}{not_excluded(whole.exclusions)}")
    register("bitmap_exclusion", lambda e: bitmaps.union(bitmaps.index_for(e, Sort.SCORE).bits, EXCLUDED).agg(F.sum(F.bitmap_count("bits")).alias("n")), f"SELECT count(DISTINCT id) AS n FROM post_tags WHERE tag IN ({', '.join(repr(t) for t in EXCLUDED)})")
    register("bitmap_mismatches", lambda e: bitmaps.mismatches(spoilt(e).tag_counts, bitmaps.populate(spoilt(e).post_tags, bitmaps.index_for(e, Sort.SCORE).places)), f"SELECT 'hot' AS tag, count(*) AS n, count(*) FILTER (id % 101 <> 0) AS bits FROM posts WHERE {a}")
    register("bitmap_violations", lambda e: bitmaps.violations(e, bitmaps.BitmapIndex(bitmaps.populate(spoilt(e).post_tags, bitmaps.index_for(e, Sort.SCORE).places), bitmaps.index_for(e, Sort.SCORE).places, e.tag_counts), Sort.SCORE), f"SELECT 'hot' AS tag, rank, 'unset' AS problem FROM (SELECT id, row_number() OVER (ORDER BY coalesce(score, -1) DESC, id DESC) AS rank FROM posts) WHERE {a} AND id % 101 = 0 UNION ALL SELECT 'hot', NULL, 'count'")
    register("list_order", lambda e: validate.numbered(e, Sort.VIEWS), "SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY coalesce(view_count, -1) DESC, id DESC) AS pos, id, CAST(coalesce(view_count, -1) AS BIGINT) AS sort_value FROM post_tags JOIN posts USING (id)")
    swapped = lambda e: validate.numbered(e, Sort.VIEWS).withColumn("pos", F.when(F.col("pos") % 1000 == 7, F.col("pos") - 1).when(F.col("pos") % 1000 == 6, F.col("pos") + 1).otherwise(F.col("pos")))
    register("list_order_violations", lambda e: validate.order_violations(swapped(e), Sort.VIEWS, "tag").select("tag", "pos", "id"), """, l AS (SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY coalesce(view_count, -1) DESC, id DESC) AS p, id, coalesce(view_count, -1) AS v FROM post_tags JOIN posts USING (id)),
m AS (SELECT tag, CASE WHEN p % 1000 = 7 THEN p - 1 WHEN p % 1000 = 6 THEN p + 1 ELSE p END AS pos, id, v FROM l)
SELECT tag, pos, id FROM (SELECT *, lag(v) OVER (PARTITION BY tag ORDER BY pos) AS before FROM m) WHERE v > before""")
    q = TagQuery("hot", Sort.SCORE, 250, 0, "red", "OR-NOT", EXCLUDED)
    register("order_violations", lambda e: validate.order_violations(boolean.run(e, q), q.sort).select("pos", "id"), "SELECT id AS pos, id FROM posts WHERE false")
    register("list_violations", lambda e: validate.list_violations(spoilt(e), Sort.SCORE).select("id", "tag"), "SELECT id, tag FROM post_tags WHERE tag = 'hot' AND id % 101 = 1")
    other = TagQuery("hot", Sort.SCORE, 250, 0, "small", "AND")
    register("invalid_results", lambda e: validate.invalid_results(e, boolean.run(e, q), other).select("id"), f"SELECT id FROM ({page_sql(q.sort, members(q) + not_excluded(EXCLUDED), 0, 250)}) WHERE NOT ({members(other)})")
    unchecked = TagQuery("hot", Sort.SCORE, 250)
    register("excluded_leaks", lambda e: validate.leaks(e, paging.tag_page(e, unchecked), ("red", "small")).select("id", F.array_join("bad", ",").alias("bad")), f"SELECT p.id, string_agg(t.tag, ',' ORDER BY t.tag) AS bad FROM ({page_sql(Sort.SCORE, tag_in('hot'), 0, 250)}) p JOIN post_tags t ON p.id = t.id WHERE t.tag IN ('red', 'small') GROUP BY p.id")
    register("excl_soundness", lambda e: validate.exclusion_errors(e, EXCLUDED), "SELECT CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS BIGINT) AS n_missed")
    register("api_query", lambda e: api.Api(e, EXCLUDED).query("hot", {"otherTag": "red", "operator": "OR", "type": "Score", "useDefaultExclusions": "true"})["results"].select("pos", "id", "score"), f"SELECT pos, id, score FROM ({page_sql(Sort.SCORE, members(TagQuery('hot', other_tag='red', operator='OR')) + not_excluded(EXCLUDED), 0, 50)}) JOIN posts USING (id)")
    register("api_tag", lambda e: api.Api(e).tag("red", {"type": "AnswerCount", "pageSize": "20", "skip": "-5"})["results"].select("pos", "id", "answer_count"), f"SELECT pos, id, answer_count FROM ({page_sql(Sort.ANSWERS, tag_in('red'), 0, 20)}) JOIN posts USING (id)")


for _f in (_register_pages, _register_boolean, _register_grid, _register_exclusion, _register_wildcards, _register_stats, _register_bitmaps_and_checks):
    _f()

