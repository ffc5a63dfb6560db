"""URL filter: rules by host and path, and link-graph propagation for everything without a rule.

Trust flows from allowed seeds along host edges (personalised PageRank), distrust from blocked seeds
against them. A host whose distrust exceeds its trust by a factor is blocked. Edges are the links of the
pages, and between a host and its parent domain (both ways), so that hosts without links are reached too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Verdict and rule (host/path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MASS = 10**15  # rank is whole units, so sums do not depend on the order of rows
DAMPING = 0.85
LEFT = 1e-3  # share of the mass that may still be on its way at the end
ROUNDS = math.ceil(math.log(LEFT) / math.log(DAMPING))
MIN_LABELS = 2  # parents with fewer labels (top-level domains) are no nodes
ADDRESS = r"^[0-9.]+(:|$)|^\["  # hosts that are addresses have no parent domain
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty for NULL or without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(domain, prefix, rule, verdict) of a rule list."""
    rows = [F.struct(F.lit(r.partition("/")[0]).alias("domain"), F.lit("/" + r.partition("/")[2]).alias("prefix"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for v, r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules that fit a host, the longest first; an equi-join on the domain."""
    fitting = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("domain")).join(rules, "domain")
    one = F.struct((-F.length("rule")).alias("o"), "rule", "prefix", "verdict")
    return fitting.groupBy("host").agg(F.sort_array(F.collect_set(one)).alias("rules"))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts, and host to parent domain and back."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1)))).alias("url"))
    # //host/path takes the scheme of its page
    links = links.withColumn("url", F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("http:"), "url")).otherwise(F.col("url")))
    links = links.filter(F.col("url").contains("://")).select(F.col("host").alias("src"), host_of(F.col("url")).alias("dst"))
    links = links.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    known = hosts.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    chain = F.filter(suffixes(F.col("host")), lambda d: F.size(F.split(d, r"\.")) >= MIN_LABELS)
    pair = F.transform(F.filter(F.sequence(F.lit(0), F.size("c") - 2), lambda i: i >= 0), lambda i: F.struct(F.get("c", i).alias("src"), F.get("c", i + 1).alias("dst")))
    up = known.filter(~F.col("host").rlike(ADDRESS)).select(chain.alias("c")).filter(F.size("c") > 1).select(F.inline(pair)).distinct()
    tree = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(1).cast("bigint"))
    return links.unionByName(tree).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, trust, distrust): two walks over one edge table.

    ``seeds``: (node, trust, distrust) counts. Both walks run in the same joins: each edge carries trust
    forward and distrust backward. A round is a join on the sending node and a sum; ranks are written out
    every few rounds, so plans stay short. Each round moves ``DAMPING`` of what the one before moved, so after
    ``ROUNDS`` at most ``LEFT`` of the mass is still on its way, whatever the graph; a node farther from every
    seed than that has no rank.
    """
    trust_out = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("out"))
    back_out = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("out"))
    forward = edges.join(trust_out, edges["src"] == trust_out["node"]).select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("w") / F.col("out")).alias("t"), F.lit(0.0).alias("d"))
    backward = edges.join(back_out, edges["dst"] == back_out["node"]).select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("t"), (F.col("w") / F.col("out")).alias("d"))
    share = stored(forward.unionByName(backward).groupBy("a", "b").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "link-shares")
    total = seeds.agg(F.sum("trust"), F.sum("distrust")).first()
    part = lambda c, n: F.floor(F.lit(float(MASS)) * F.col(c) / F.lit(float(max(n or 0, 1)))).cast("bigint")
    start = stored(seeds.select("node", part("trust", total[0]).alias("t0"), part("distrust", total[1]).alias("d0")).filter("t0 > 0 OR d0 > 0"), "link-seeds")
    rank = start.select("node", F.col("t0").alias("t"), F.col("d0").alias("d"))
    jump = lambda c: F.floor(F.col(c) * (1 - DAMPING)).cast("bigint")
    move = lambda r, s: F.floor(F.col(r) * DAMPING * F.col(s)).cast("bigint")
    base = start.select("node", jump("t0").alias("t"), jump("d0").alias("d"))
    for i in range(rounds):
        r = rank.select(F.col("node").alias("a"), F.col("t").alias("rt"), F.col("d").alias("rd"))
        sent = share.join(r, "a").select(F.col("b").alias("node"), move("rt", "t").alias("t"), move("rd", "d").alias("d"))
        rank = base.unionByName(sent).groupBy("node").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        if i % 4 == 3:
            rank = stored(rank, "link-ranks")
    return rank.select("node", F.col("t").alias("trust"), F.col("d").alias("distrust"))


def judge(pages: DataFrame, rules: DataFrame, factor: float = 1.0, floor: int = 1) -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust (whole units of ``MASS``).

    The longest fitting rule decides. Else the host is blocked if its distrust is at least ``floor`` and
    above ``factor`` times its trust; hosts that no seed reaches are allowed. Seeds weigh as many pages
    as their rules allow or block. NULL urls have an empty host and path and are allowed; columns of
    ``pages`` named like an added one are replaced; repeated rows are judged alike.
    """
    added = ["host", "path", "rule", "verdict", "trust", "distrust"]
    keep = [c for c in pages.columns if c not in added]
    rows = pages.select(F.struct(*keep).alias("page"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    fit = stored(hosts.join(rules_by_host(hosts, rules), "host", "left"), "url-rules")
    best = F.get(F.filter("rules", lambda x: F.startswith(F.col("path"), x["prefix"])), 0)
    ruled = rows.join(fit.select("host", "rules"), "host", "left").withColumn("_best", best)
    counts = ruled.groupBy(F.col("host").alias("node")).agg(
        F.sum((F.col("_best.verdict") == "allow").cast("bigint")).alias("trust"), F.sum((F.col("_best.verdict") == "block").cast("bigint")).alias("distrust")
    )
    edges = stored(host_edges(pages.select(host_of(F.col("url")).alias("host"), "html"), fit.filter("host <> ''")), "link-edges")
    ranks = stored(propagate(edges, counts.na.fill(0)), "link-result")
    scored = ruled.join(ranks.select(F.col("node").alias("host"), "trust", "distrust"), "host", "left").na.fill(0, ["trust", "distrust"])
    bad = (F.col("distrust") >= floor) & (F.col("distrust") > factor * F.col("trust"))
    verdict = F.coalesce(F.col("_best.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page.*", "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
