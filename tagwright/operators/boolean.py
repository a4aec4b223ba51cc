"""Boolean queries of two tags, in set and in interleave mode, and their counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.functions.columns import order, sort_key
from tagwright.operators.exclude import without
from tagwright.operators.paging import page, ranked
from tagwright.plans.engine import Engine
from tagwright.plans.query import ALL, TagQuery
from tagwright.plans.shared import local_table


def matching(engine: Engine, q: TagQuery) -> DataFrame:
    """The posts that satisfy the expression, whatever their order and exclusions."""
    a, b = engine.list_of(q.tag), engine.list_of(q.other_tag)
    if q.operator == "AND":
        return a.join(b.select("id"), "id", "left_semi")
    if q.operator == "AND-NOT":
        return a.join(b.select("id"), "id", "left_anti")
    if q.operator == "OR":
        if ALL in (q.tag, q.other_tag):
            return engine.list_of(ALL)
        return engine.post_tags.where(F.col("tag").isin(q.tag, q.other_tag)).drop("tag").dropDuplicates(["id"])
    # OR-NOT: posts that lack the other tag, and those that have the first
    wrong = b.select("id").join(a.select("id"), "id", "left_anti")
    return engine.list_of(ALL).join(wrong, "id", "left_anti")


#: Entries of each list that a walk looks at first, and how many at most before it ranks the lists whole.
PREFIX, LONGEST = 1024, 1 << 16


def _first(engine: Engine, tag: str, q: TagQuery, k: int) -> DataFrame:
    """(id, rank) of a list's first k entries. Few enough to be numbered in one task, they go into the plan as they are."""
    if k > LONGEST:
        return ranked(engine.list_of(tag).select("id", q.sort.column), order(q.sort)).select("id", "rank").where(F.col("rank") <= k)
    some = engine.list_of(tag).orderBy(*order(q.sort)).limit(k).select("id").collect()
    return local_table(engine.posts.sparkSession, "id long, rank long", [(r["id"], n) for n, r in enumerate(some, 1)])


def walk(engine: Engine, q: TagQuery, k: int) -> tuple[DataFrame, int]:
    """The entries that are looked at in turn, as far as the first k of each list: (id, pos, bad, member), and the last pos.

    AND and AND-NOT walk the first tag's list; OR zips both lists, OR-NOT the first with all posts,
    and both end with the shorter list. bad: excluded; member: what the expression asks of it.
    """
    if q.operator in ("AND", "AND-NOT"):
        end = min(k, engine.size(q.tag))
        entries = _first(engine, q.tag, q, end).select("id", F.col("rank").alias("pos"))
    else:
        second = ALL if q.operator == "OR-NOT" else q.other_tag
        m = min(k, engine.size(q.tag), engine.size(second))
        zipped = [_first(engine, tag, q, m).select("id", (2 * F.col("rank") - 1 + n).alias("pos")) for n, tag in enumerate((q.tag, second))]
        entries, end = zipped[0].unionByName(zipped[1]), 2 * m
    # what each entry carries of the tags that matter, in one look at their lists
    own = entries.select("id").distinct()
    if k <= LONGEST:
        own = F.broadcast(own)  # 2 * LONGEST rows at most
    is_ = lambda tags: F.coalesce(F.max(F.col("tag").isin(list(tags))), F.lit(False))
    tagged = engine.post_tags.where(F.col("tag").isin([q.other_tag, *q.exclusions])).select("id", "tag").join(own, "id")
    flags = tagged.groupBy("id").agg(is_([q.other_tag]).alias("has"), is_(q.exclusions).alias("bad"))
    no = F.lit(False)
    told = entries.join(flags, "id", "left").select("id", "pos", F.coalesce("bad", no).alias("bad"), (F.lit(True) if q.other_tag == ALL else F.coalesce("has", no)).alias("has"))
    member = {"AND": F.col("has"), "OR": F.lit(True)}.get(q.operator, ~F.col("has"))
    return told.select("id", "pos", "bad", member.alias("member")), end


def _firsts(entries: DataFrame) -> DataFrame:
    return entries.where("member").groupBy("id", "bad").agg(F.min("pos").alias("pos"))


def _lengths(engine: Engine, q: TagQuery):
    """How much of the lists to look at: more and more, until a page is full or a list at its end."""
    longest = max(engine.size(t) for t in ((q.tag,) if q.operator in ("AND", "AND-NOT") else (q.tag, ALL if q.operator == "OR-NOT" else q.other_tag)))
    k = max(PREFIX, 4 * (q.offset + q.page_size))
    while k < longest:
        yield k, False
        k = k * 8 if k * 8 <= LONGEST else longest
    yield longest, True


def run(engine: Engine, q: TagQuery) -> DataFrame:
    """(pos, id, sort_value) of a page."""
    engine.check(q)
    if q.mode == "set" or q.operator in ("AND", "AND-NOT"):
        return page(without(engine, matching(engine, q), q.exclusions), q.sort, q.offset, q.page_size)
    for k, whole in _lengths(engine, q):
        some = _firsts(walk(engine, q, k)[0]).where(~F.col("bad")).orderBy("pos").offset(q.offset).limit(q.page_size).select("id").collect()
        if whole or len(some) == q.page_size:
            break
    placed = local_table(engine.posts.sparkSession, "id long, pos long", [(r["id"], q.offset + n) for n, r in enumerate(some, 1)])
    return engine.posts.join(F.broadcast(placed), "id").select("pos", "id", sort_key(q.sort).alias("sort_value"))  # 250 rows at most


def counters(engine: Engine, q: TagQuery) -> DataFrame:
    """One row: what a walk that stops when the page is full has looked at.

    base_query, items_skipped, excluded: of the plain walk; tag, other_tag, exclusion: of a walk over lazy lists.
    """
    engine.check(q)
    wanted = q.offset + q.page_size
    for k, whole in _lengths(engine, q):
        entries, end = walk(engine, q, k)
        good = _firsts(entries).where(~F.col("bad")).orderBy("pos").limit(wanted).agg(F.count("*").alias("n"), F.max("pos").alias("last"))
        # both numbers for every place where the walk could have stopped, told by its last entry
        stop = F.when(F.col("n") == wanted, F.col("last")).otherwise(F.lit(end))
        ends = F.broadcast(good.select("n", stop.alias("stop")))  # a row
        seen = entries.join(ends, F.col("pos") <= F.col("stop")).agg(F.max("n").alias("n"), F.max("stop").alias("stop"), F.count_if("bad").alias("excluded"), F.count_distinct(F.when(F.col("member") & F.col("bad"), F.col("id"))).alias("exclusion"))
        got = seen.first()
        n = got["n"] or 0
        if whole or n == wanted:
            break
    full = n == wanted
    last = got["stop"] if full else end
    n1, n2 = engine.size(q.tag), engine.size(q.other_tag)
    zipped = q.operator in ("OR", "OR-NOT")
    half = (last + 1) // 2
    if not zipped:
        tag, other = last, n2
    elif q.operator == "OR":
        tag, other = (half, half) if full else (min(n1, n2 + 1), min(n1, n2))
    else:
        tag, other = (half if full else n1), n2
    row = {"base_query": half if zipped else last, "items_skipped": min(q.offset, n), "tag": tag, "other_tag": other, "excluded": got["excluded"], "exclusion": got["exclusion"]}
    return local_table(engine.posts.sparkSession, ", ".join(f"{c} long" for c in row), [tuple(row.values())])
