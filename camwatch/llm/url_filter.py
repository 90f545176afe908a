"""URL filters: explicit rules, then trust and distrust spread over the link graph.

Host edges are counted from absolute links in the pages' html and from the
subdomain relation (a host and its parent domains refer to each other, so that
sibling hosts are joined by a parent, with pages or without). Trust is a personalised
PageRank that starts from allowed seeds and follows the edges; distrust starts from
blocked seeds and follows them backwards: who links to blocked hosts earns distrust.
Both are shares of the rank that a host has if every host is a seed of 1. A host is
blocked if its distrust is over a threshold and over its trust.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from camwatch.llm.common import ascii_lower, drop, table

#: (verdict, host, path)
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, ascii_lower(host)).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Ties in length go to the alphabetically first rule.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, html_col: str) -> DataFrame:
    """src, dst, weight between different hosts; ``pages`` has host and the html column.

    Links and mentions are counted per pair before they are shuffled. Edges to
    hosts without pages stay: they carry trust on to nobody, as in the web at large.
    Each host and its parent domains are a chain of edges in both directions, up to
    the parent of two labels: a top-level domain would join strangers. Public
    suffixes of more labels are not known here. Addresses in digits have no parents.
    """
    links = (
        pages.filter("host <> ''")
        .select("host", F.explode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))).alias("link"))
        .select(F.col("host").alias("src"), split_url(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")))[0].alias("dst"))
        .filter("dst <> '' and dst <> src")
        .groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    )
    hosts = pages.filter("host <> ''").select("host").distinct()
    label = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(label) - 1), lambda i: F.struct(F.array_join(F.slice(label, i, F.size(label)), ".").alias("src"), F.array_join(F.slice(label, i + 1, F.size(label)), ".").alias("dst")))
    named = hosts.filter(F.col("host").rlike(r"^[^.:]+(\.[^.:]+){2,}(:[0-9]*)?$") & ~F.col("host").rlike(r"\.[0-9]+(:[0-9]*)?$"))
    up = named.select(F.explode(chain).alias("e")).select("e.*").filter(F.col("dst").contains(".")).distinct()
    family = up.union(up.select(F.col("dst"), F.col("src"))).withColumn("w", F.lit(1.0))
    return links.unionByName(family).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """Personalised PageRank: host, rank.

    ``edges``: src, dst, w. ``seeds``: host, seed (non-negative; scaled to sum 1).
    Every round each host keeps ``1 - damping`` of its seed and gets ``damping``
    times what its sources pass on in proportion to the edges' weights. Mass at
    hosts without out-edges is not passed on. No seeds: an empty result.
    """
    total = seeds.agg(F.sum("seed")).first()[0] or 1.0
    seeds = table(seeds.select("host", (F.col("seed") / total).alias("seed")), "seeds")
    out = edges.groupBy("src").agg(F.sum("w").alias("all"))
    share = table(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("all")).alias("p")), "share")
    rank = seeds.select("host", F.col("seed").alias("rank"))
    written = None
    for k in range(rounds):
        passed = share.join(rank, share.src == rank.host).select(F.col("dst").alias("host"), (F.lit(damping) * F.col("p") * F.col("rank")).alias("rank"))
        kept = seeds.select("host", (F.lit(1 - damping) * F.col("seed")).alias("rank"))
        rank = passed.union(kept).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % 3 == 2 or k == rounds - 1:  # keeps each plan short
            new = table(rank, "rank")
            if written is not None:
                drop(written)
            rank = written = new
    return rank


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES,
    threshold: float = 0.3,
    damping: float = 0.85,
    rounds: int = 12,
) -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict, trust, distrust, method_verdict.

    Seeds are the hosts with pages that a rule allows (trust) or blocks (distrust),
    weighted by the share of such pages among the host's. Ranks are divided by those
    of a run with a seed of 1 at every host, so trust and distrust are means, from 0
    to 1, of the shares of the host and of those it is reached from, the near ones
    counting most: a host without edges has its own shares. ``threshold``, 0.3, is the least
    distrust above which a host's pages without a rule are blocked (if trust is less).

    A null url or one without ``://`` has an empty host and path, no rule and the
    method's verdict for an unknown host: allow. Null html has no links. Repeated
    rows are judged alike and counted each. An empty table gives an empty result.
    Other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "by_rule": verdict})
    per_host = table(
        base.filter("host <> ''").groupBy("host").agg(
            F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")
        ),
        "hosts",
    )
    edges = table(host_edges(base, "html"), "edges")
    # one run over four copies of the graph, told apart by a letter before the host: seeds of shares and of 1, along the edges and back
    tagged = lambda tag, c: F.concat(F.lit(tag), c)
    graph = [edges.select(tagged(tag, a).alias("src"), tagged(tag, b).alias("dst"), "w") for tag, a, b in (("a", "src", "dst"), ("A", "src", "dst"), ("b", "dst", "src"), ("B", "dst", "src"))]
    seeds = [per_host.select(tagged(tag, "host").alias("host"), x.alias("seed")) for tag, x in (("a", F.col("allowed") / F.col("n")), ("A", F.lit(1.0)), ("b", F.col("blocked") / F.col("n")), ("B", F.lit(1.0)))]
    ranks = pagerank(functools.reduce(DataFrame.union, graph), functools.reduce(DataFrame.union, seeds).filter("seed > 0"), damping, rounds)
    of = lambda tag: F.coalesce(F.sum(F.when(F.col("host").startswith(tag), F.col("rank"))), F.lit(0.0))
    ranks = ranks.groupBy(F.expr("substr(host, 2)").alias("key")).agg((of("a") / F.nullif(of("A"), F.lit(0.0))).alias("trust"), (of("b") / F.nullif(of("B"), F.lit(0.0))).alias("distrust"))
    scores = per_host.join(ranks.withColumnRenamed("key", "host"), "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    scores = table(scores, "scores")  # the planner sees its size: it is broadcast only if small
    method = F.when((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return base.select("page_id", "host", "path", "rule", "by_rule").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
        method.alias("method_verdict"),
    )
