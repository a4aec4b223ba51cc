"""Wildcard expansion: from patterns to the tags that match them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.functions import patterns as P
from tagwright.plans.engine import Engine
from tagwright.plans.shared import local_table

STRATEGIES = {"contains": P.matches, "regex": P.matches_regex, "like": P.matches_like, "trie": P.matches_trie}
#: So many predicates go into one expression; generated code has a limit.
CHUNK = 100


def matched(engine: Engine, patterns: Sequence[str], strategy: str = "contains") -> DataFrame:
    """(pattern, tag) of every match.

    A short list is tested in one scan of the tag dictionary. For a long one, contains and trie join the
    dictionary's substrings with the patterns' texts by equality; regex and like test it in parts of the list.
    """
    listed = list(dict.fromkeys(patterns))
    if len(listed) > CHUNK and strategy in ("contains", "trie"):
        return _matched_by_text(engine, listed, strategy)
    test = STRATEGIES[strategy]

    def some(part: list[str]) -> DataFrame:
        hits = F.array_compact(F.array(*(F.when(test(F.col("tag"), p), F.lit(p)) for p in part)).cast("array<string>"))
        return engine.tag_counts.select(F.explode(hits).alias("pattern"), "tag")

    return reduce(DataFrame.unionByName, [some(listed[k : k + CHUNK]) for k in range(0, max(1, len(listed)), CHUNK)])


def _matched_by_text(engine: Engine, patterns: list[str], strategy: str) -> DataFrame:
    """One equality join: a tag is laid out as its beginnings, ends and substrings of the lengths that the patterns have.

    In a trie the ends are beginnings of the reversed tag.
    """
    kinds = [(p, *P.kind(p)) for p in patterns]
    rows = [(p, k, t[::-1] if strategy == "trie" and k == "ends" else t, len(t)) for p, k, t in kinds if k != "none"]
    table = local_table(engine.tag_counts.sparkSession, "pattern string, kind string, text string, size int", rows)
    sizes = {k: sorted({r[3] for r in rows if r[1] == k}) for k in ("begins", "ends", "contains")}
    tag, size = F.col("tag"), F.length("tag")

    def cuts(kind: str, cut) -> Column:
        fits = F.filter(F.array(*map(F.lit, sizes[kind])).cast("array<int>"), lambda n: n <= size)
        return F.transform(fits, lambda n: F.struct(F.lit(kind).alias("kind"), cut(n).alias("text")))

    ends = (lambda n: F.substring(F.reverse(tag), F.lit(1), n)) if strategy == "trie" else (lambda n: F.substring(tag, size - n + 1, n))
    fits = F.filter(F.array(*map(F.lit, sizes["contains"])).cast("array<int>"), lambda n: n <= size)
    inside = F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.struct(F.lit("contains").alias("kind"), F.substring(tag, i, n).alias("text")))))
    same = F.array(F.struct(F.lit("equals").alias("kind"), tag.alias("text")))
    laid = engine.tag_counts.select("tag", F.explode(F.array_distinct(F.concat(same, cuts("begins", lambda n: F.substring(tag, F.lit(1), n)), cuts("ends", ends), inside))).alias("x"))
    return laid.select("tag", "x.*").join(F.broadcast(table), ["kind", "text"]).select("pattern", "tag")  # a list kept by hand


def expand(engine: Engine, patterns: Sequence[str], strategy: str = "contains") -> DataFrame:
    """The distinct tags that any pattern matches; names that no post has vanish."""
    return matched(engine, patterns, strategy).select("tag").distinct()


def gram_index(engine: Engine) -> DataFrame:
    """(gram, tag): the dictionary by two-letter grams."""
    return engine.tag_counts.select(F.explode(F.array_distinct(P.index_grams(F.col("tag")))).alias("gram"), "tag")


def candidates(engine: Engine, patterns: Sequence[str]) -> DataFrame:
    """(pattern, tag): tags that have every gram of a pattern which the index knows; grams it doesn't know are passed over.

    One join for all patterns: with the tags of each pattern's rarest gram, whose other grams are then looked for.
    """
    rows = [(p, g) for p in dict.fromkeys(patterns) for g in dict.fromkeys(P.searches(p))]
    wanted = local_table(engine.tag_counts.sparkSession, "pattern string, gram string", rows)
    index = gram_index(engine)
    known = index.groupBy("gram").agg(F.count("*").alias("n")).join(F.broadcast(wanted), "gram")  # a list kept by hand
    asked = known.groupBy("pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.collect_set("gram").alias("grams"))
    found = index.join(F.broadcast(asked), "gram")
    return found.where(F.size(F.array_except("grams", P.index_grams(F.col("tag")))) == 0).select("pattern", "tag")


def gram_candidates(engine: Engine, pattern: str) -> DataFrame:
    return candidates(engine, [pattern]).select("tag")


def matched_grams(engine: Engine, patterns: Sequence[str]) -> DataFrame:
    """As ``matched``, by gram candidates and a recheck. A pattern of one letter between stars finds nothing, as its gram isn't in the index."""
    kinds = [(p, *P.kind(p)) for p in dict.fromkeys(patterns)]
    table = local_table(engine.tag_counts.sparkSession, "pattern string, kind string, text string", kinds)
    text, tag = F.col("text"), F.col("tag")
    ok = F.when(F.col("kind") == "contains", F.contains(tag, text)).when(F.col("kind") == "begins", F.startswith(tag, text)).when(F.col("kind") == "ends", F.endswith(tag, text)).otherwise(False)
    some = candidates(engine, [p for p, k, _ in kinds if k not in ("equals", "none")]).join(F.broadcast(table), "pattern").where(ok).select("pattern", "tag")
    plain = engine.tag_counts.select("tag").join(F.broadcast(table.where("kind = 'equals'").select("pattern", F.col("text").alias("tag"))), "tag").select("pattern", "tag")
    return some.unionByName(plain)


def expand_grams(engine: Engine, patterns: Sequence[str]) -> DataFrame:
    return matched_grams(engine, patterns).select("tag").distinct()


def disagreements(engine: Engine, patterns: Sequence[str]) -> DataFrame:
    """(pattern, tag, strategies): matches that some strategies find and others don't, with the names of those that do."""
    every = [matched(engine, patterns, s).withColumn("strategy", F.lit(s)) for s in STRATEGIES] + [matched_grams(engine, patterns).withColumn("strategy", F.lit("grams"))]
    found = reduce(DataFrame.unionByName, every).groupBy("pattern", "tag").agg(F.array_sort(F.collect_set("strategy")).alias("strategies"))
    return found.where(F.size("strategies") < len(every)).select("pattern", "tag", F.array_join("strategies", ",").alias("strategies"))


def counts(engine: Engine, patterns: Sequence[str]) -> DataFrame:
    """(pattern, n) by falling n, then pattern; patterns without a match have 0."""
    listed = F.explode(F.array(*(F.lit(p) for p in dict.fromkeys(patterns)))).alias("pattern")
    every = engine.tag_counts.sparkSession.range(1).select(listed)
    n = matched(engine, patterns).groupBy("pattern").agg(F.count("*").alias("n"))
    return every.join(n, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy(F.desc("n"), "pattern")


def lists(engine: Engine, patterns: Sequence[str]) -> DataFrame:
    """(pattern, tags): each pattern's tags, sorted."""
    return matched(engine, patterns).groupBy("pattern").agg(F.array_sort(F.collect_set("tag")).alias("tags")).orderBy("pattern")


def excluded_page(engine: Engine, query, patterns: Sequence[str]) -> DataFrame:
    """A page without the posts that carry a tag which any pattern matches: tags, their posts and the page in one plan."""
    from tagwright.operators.paging import page

    bad = engine.post_tags.join(expand(engine, patterns), "tag", "left_semi").select("id").distinct()
    return page(engine.list_of(query.tag).join(bad, "id", "left_anti"), query.sort, query.offset, query.page_size)
