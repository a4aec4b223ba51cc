"""URL filters: rules on hosts and paths, and link-graph propagation where no rule fits.

Trust starts at hosts in proportion to the share of their pages that a rule allows, and follows links;
distrust starts at the share that a rule blocks, and follows links backwards, from a blocked host
to those that link to it. Both are personalised PageRanks over host edges: a host passes on
DAMPING of what it has, over its links by their number, and restarts make up the rest.

Both sums depend on how many link to a host or share what it passes back, so verdicts don't compare them.
They compare shares of 0 to 1: trust as a share of what the host would have if all hosts were trusted seeds, and
blame, which a host has by its own pages and its own links alone, each link counting the blame of the host it goes to, as
a share of what it would be if all hosts were blocked. A host whose share of blame reaches LEAST and exceeds
its share of trust by RATIO is blocked where no rule decides.

DataFrame functions only. A round is one join with the edges and one sum for all scores; ranks are
written to the shared folder. Cases: a url that is null or has no "://" has an empty host and
path, fits no rule and is allowed; hosts without links or seeds are allowed; links of a
host to itself don't count; null html has no links; repeated pages count each time they
come; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.llm.storage import materialise, release

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING = 0.85
#: Rounds between two looks at the largest change, and the change, as a share of a score and a seed's restart, at which to stop.
STEP = 5
TOLERANCE = 1e-3
#: More rounds than any graph needs: changes fall by DAMPING a round, whatever the number of hosts.
MOST_ROUNDS = 1000
#: The least share of blame of a blocked host.
LEAST = 0.05
RATIO = 2.0

LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: up to / ? # after the first ://, and from there up to ? or #."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.length(F.substring_index(url, "://", 1)) + 4, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null. A list kept by hand: it goes into the plan."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    if not order:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    known = F.array(*(F.struct(F.lit(h).alias("host"), F.lit("." + h).alias("sub"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in order))
    fit = F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, r["sub"])) & F.startswith(path, r["path"]))
    return F.get(fit, F.lit(0))


def edges(pages: DataFrame) -> DataFrame:
    """(source, target, n): links between different hosts of ``pages(host, html)``."""
    linked = F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
    found = pages.where("html is not null and host <> ''").select("host", linked.alias("to"))
    target, _ = split_url(F.concat(F.lit("http://"), F.regexp_replace("to", r"^(?i:https?:)?//", "")))
    both = found.select(F.col("host").alias("source"), target.alias("target"))
    return both.where("target <> '' and source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


#: Scores, the factor of a link for each, and the seed: t along links, d against them by what the target shares out, b by the source's own links.
SCORES = (("trust", "t", "trust"), ("distrust", "d", "distrust"), ("all_trust", "t", None), ("blame", "b", "distrust"), ("all_blame", "b", None))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust, all_trust, blame, all_blame) from ``seeds(host, trust, distrust)`` and ``links(source, target, n)``."""
    given = links.join(links.groupBy("source").agg(F.sum("n").alias("out")), "source").join(links.groupBy("target").agg(F.sum("n").alias("in")), "target")
    none = F.lit(0.0)
    ahead = given.select(F.col("source").alias("host"), F.col("target").alias("to"), (F.col("n") / F.col("out")).alias("t"), none.alias("d"), none.alias("b"))
    back = given.select(F.col("target").alias("host"), F.col("source").alias("to"), none.alias("t"), (F.col("n") / F.col("in")).alias("d"), (F.col("n") / F.col("out")).alias("b"))
    ways = materialise(ahead.unionByName(back), "ways")
    hosts = seeds.select("host").unionByName(ways.select("host")).distinct()
    start = lambda seed: (1 - damping) * (F.coalesce(seed, F.lit(0.0)) if seed else F.lit(1.0))
    base = materialise(hosts.join(seeds, "host", "left").select("host", *(start(seed).alias(f"s_{c}") for c, _, seed in SCORES)), "seeds")
    ranks = materialise(base.select("host", *(F.col(f"s_{c}").alias(c) for c, *_ in SCORES)), "ranks")
    if ways.isEmpty():
        return ranks
    for k in range(1, MOST_ROUNDS + 1):
        got = ways.join(ranks, "host").groupBy(F.col("to").alias("host")).agg(*(F.sum(F.col(way) * F.col(c)).alias(f"g_{c}") for c, way, _ in SCORES))
        new = base.join(got, "host", "left").select("host", *((F.col(f"s_{c}") + damping * F.coalesce(f"g_{c}", F.lit(0.0))).alias(c) for c, *_ in SCORES))
        before, ranks = ranks, materialise(new, "ranks")
        change = F.greatest(*(F.abs(F.col(c) - F.col(f"0_{c}")) / (F.col(c) + (1 - damping)) for c, *_ in SCORES))
        done = k % STEP == 0 and (ranks.join(before.toDF("host", *(f"0_{c}" for c, *_ in SCORES)), "host").agg(F.max(change)).first()[0] or 0) < tolerance
        release(before)
        if done:
            return ranks
    raise RuntimeError(f"ranks didn't settle in {MOST_ROUNDS} rounds")


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, least: float = LEAST, ratio: float = RATIO) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of ``pages(page_id, url, html)``."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    ruled = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "best.rule", "best.verdict")
    share = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0))
    seeds = materialise(ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "hosts")
    links = materialise(edges(rows), "links")
    ranks = propagate(seeds, links, damping)
    blame = F.col("blame") / F.col("all_blame")
    bad = (blame >= least) & (blame > ratio * F.col("trust") / F.col("all_trust"))
    joined = ruled.join(ranks, "host", "left")
    verdict = F.coalesce("verdict", F.when(bad, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
