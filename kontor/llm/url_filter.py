"""URL filter: rules first, then trust and distrust propagated over the host link graph.

Built-in functions only. Trust is a PageRank personalised on trusted hosts, following links; distrust is one personalised
on blocked hosts, following links backwards (who links to a blocked host is suspect). A host is blocked where its distrust
passes the threshold and its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import fold_ascii, fresh, scratch_table

LINK = "(?is)<a\\s[^>]*?href\\s*=\\s*[\"']?([^\"'\\s>]+)"


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return fold_ascii(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(host: Column, path: Column, rule: str) -> Column:
    """Whether ``rule`` (host, then a path from ``/``) fits: its host or a subdomain of it, and a path that begins with its path."""
    h, _, p = rule.partition("/")
    return ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        test = rule_fits(host, path, rule)
        out = F.when(test, F.lit(rule)) if out is None else out.when(test, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def rule_verdict(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts; links without ``://`` stay within their host and make no edge."""
    links = pages.select(url_host(F.col(url)).alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), 1), url_host))).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-6, steps: int = 8) -> DataFrame:
    """(host, rank) for the hosts that the seeds reach: walks that start at every seed and end with probability ``1 - damping`` a step.

    ``edges``: (src, dst, n); ``seeds``: (host), one row each. Every seed has mass 1, whatever their number: a host's rank
    is how much of it ends there, at least ``1 - damping`` for a seed, and depends only on the seeds that reach the host. What
    reaches hosts without links and does not end there is lost. Rounds go on until all walks together have less than ``tolerance`` left;
    each is one join on the source host and one aggregate, and every ``steps`` of them are written to the shared scratch folder.
    """
    seeds = seeds.select("host").distinct()
    rank = seeds.withColumn("rank", F.lit(1 - damping)).withColumn("new", F.col("rank"))
    if edges.isEmpty():
        return rank.drop("new")
    totals = edges.groupBy("src").agg(F.sum("n").alias("total"))
    flow = edges.join(totals, "src").select("src", "dst", (damping * F.col("n") / F.col("total")).alias("w"))
    hosts = edges.select("src").union(edges.select("dst")).union(seeds).distinct()
    flow = scratch_table(flow.unionByName(hosts.select("src", F.col("src").alias("dst"), F.lit(None).cast("double").alias("w"))), "host-flow")  # null: what the host has, it keeps
    left = None
    while left is None or left * damping / (1 - damping) >= tolerance:
        for _ in range(steps):
            gets = F.col("new") * F.col("w")
            moved = rank.join(flow, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), F.coalesce(gets, F.col("rank")).alias("rank"), F.coalesce(gets, F.lit(0.0)).alias("new"))
            rank = moved.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("new").alias("new"))
        rank = scratch_table(rank, "host-rank")
        left = rank.agg(F.coalesce(F.sum("new"), F.lit(0.0))).first()[0]
    return rank.drop("new")


def judge_pages(pages: DataFrame, rules: dict[str, str], *, url: str = "url", html: str = "html", damping: float = 0.85, threshold: float = 1e-4) -> DataFrame:
    """All rows and columns of ``pages`` plus ``host``, ``path``, ``rule``, ``trust``, ``distrust`` and ``verdict``.

    ``rules``: rule to ``allow`` or ``block``; a few literals that become one expression. Seeds are the hosts of pages that
    a rule allows or blocks; a host with both counts as a seed of both. Where no rule fits, a host is blocked if its
    distrust is above ``threshold`` (of the mass of one seed) and above its trust, else allowed; hosts that no walk reaches
    have 0 for both. Neither depends on the number of seeds, so that a host's verdict is that of its surroundings in a crawl of any size.

    Edge cases: a null url, one without ``://`` or an empty host has empty host and path (rules need a host, so none fits)
    and is allowed; null html has no links; repeated rows are judged alike; an empty table gives no rows; existing columns
    of the six names are replaced.
    """
    rules = {k: rules[k] for k in sorted(rules)}
    pages = pages.drop("host", "path", "rule", "trust", "distrust", "verdict")
    out = pages.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url))).withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    seeds = scratch_table(out.where("rule is not null").groupBy("host").agg(F.max(rule_verdict(F.col("rule"), rules) == "allow").alias("good"), F.max(rule_verdict(F.col("rule"), rules) == "block").alias("bad")), "url-seeds")
    edges = scratch_table(host_edges(pages, url, html), "url-edges")
    trust = personalised_rank(edges, seeds.where("good"), damping=damping).select("host", F.col("rank").alias("trust"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_rank(back, seeds.where("bad"), damping=damping).select("host", F.col("rank").alias("distrust"))
    hosts = scratch_table(trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"]), "url-scores")
    scored = out.join(hosts, "host", "left").na.fill(0.0, ["trust", "distrust"])
    by_method = F.when((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce(rule_verdict(F.col("rule"), rules), by_method))
