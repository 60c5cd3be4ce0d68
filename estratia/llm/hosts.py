"""URL filters: rules for hosts and paths, and trust that flows over links between hosts.

A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule
wins. Hosts of pages that rules allow or block are the seeds of two personalised PageRanks: trust
flows along host edges, distrust against them. Where no rule fits, a host is blocked if its distrust
exceeds ``MAX_RATIO`` times its trust.

Host edges are the absolute links of the pages, and the ties of a host with its parent domain, both
ways. Rank is mass in whole units, so sums do not depend on their order and reruns agree. The rounds
are as many as any graph needs for all but ``TOLERANCE`` of the mass to have settled; hosts farther
than that from every seed have rank 0.

Defined results: a url that is null or without ``://`` has an empty host and path, fits no rule, and
its pages make one host without edges; null or empty html has no links; repeated pages count each;
without seeds every rank is 0 and all hosts are allowed; an empty table gives no rows. Very long html
is read in full by one pattern. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estratia.llm.common import cut, drop_cut, whole

# Verdict, host and path of the rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 85
#: Mass of each kind in whole units. An edge's floor loses less than one unit a round, in all less than
#: 1 / (1 - 0.85) units an edge: below the tolerance for hosts of up to 150,000 edges.
MASS = 10**15
#: A round moves at most 0.85 of the mass that the round before moved, in any graph. After so many
#: rounds no more than this share of all mass is still to move.
TOLERANCE = 1e-9
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING / 100))
CUT_ROUNDS = 8
#: Edges up to which a round runs in one task, against ranks that are broadcast: no shuffle a round.
ONE_TASK_EDGES = 500_000
MAX_RATIO = 1.0
LINK = r"""(?i)href\s{0,9}=\s{0,9}["']?([a-z][a-z0-9+.-]{0,19}://[^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and rule_verdict (null where none fits)."""
    df = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, weight: links between different hosts, and ties of hosts with their parent domains."""
    rows = pages.select(host_of(F.col(url)).alias("src"), F.regexp_extract_all(whole(html), F.lit(LINK), F.lit(1)).alias("l_"))
    links = rows.select("src", F.explode("l_").alias("l_")).select("src", host_of(F.col("l_")).alias("dst"))
    links = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    hosts = rows.select(F.col("src").alias("sub")).where("sub <> ''").distinct()
    ups = hosts.select("sub", F.regexp_extract("sub", r"^[^.]+\.([^.]+\..+)$", 1).alias("up")).where("up <> ''")
    ties = ups.select(F.col("sub").alias("src"), F.col("up").alias("dst")).union(ups.select(F.col("up").alias("src"), F.col("sub").alias("dst")))
    both = links.union(ties.distinct().select("src", "dst", F.lit(1).cast("long").alias("weight")))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, host, mass after ``rounds`` steps of personalised PageRank.

    ``edges`` (src, dst, weight) carry kind ``allow`` forward and kind ``block`` backward; ``seeds``
    (kind, host, n) share ``MASS`` of their kind in proportion to n.
    """
    ways = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight")
    ways = ways.union(edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = ways.groupBy("kind", "src").agg(F.sum("weight").alias("all_"))
    share = F.col("weight").cast("double") / F.col("all_").cast("double")
    ways = cut(ways.join(out, ["kind", "src"]).select("kind", "src", "dst", share.alias("share")))
    # Ranks are at most one row a kind and end of an edge or seed
    small = ways.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES and seeds.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES
    together = (lambda df: df.coalesce(1)) if small else (lambda df: df)
    near = F.broadcast if small else (lambda df: df)
    ways = cut(ways.coalesce(1)) if small else ways
    sums = seeds.groupBy("kind").agg(F.sum("n").alias("s"))
    start = F.floor(F.col("n").cast("double") / F.col("s").cast("double") * MASS).cast("long")
    seeds = cut(together(seeds.join(sums, "kind").select("kind", "host", start.alias("mass"))))
    now, own = seeds, seeds.select("kind", "host", (F.col("mass") * (100 - DAMPING)).alias("part"))
    held = None
    for step in range(rounds):
        sent = ways.join(near(now.select("kind", F.col("host").alias("src"), "mass")), ["kind", "src"])
        amount = F.floor(F.col("mass").cast("double") * F.col("share")).cast("long") * DAMPING
        flow = sent.select("kind", F.col("dst").alias("host"), amount.alias("part"))
        now = together(flow.union(own)).groupBy("kind", "host").agg(F.expr("sum(part) div 100").alias("mass"))
        if step % CUT_ROUNDS == CUT_ROUNDS - 1 or step == rounds - 1:
            last, now = held, cut(now)
            held = now
            if last is not None:
                drop_cut(last)
    return now


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", rounds: int = ROUNDS) -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust, which replace columns of these names; all others stay."""
    packed = pages.select(F.struct(*(F.col(c).alias(f"u{i}") for i, c in enumerate(pages.columns))).alias("row_"), F.col(url).alias("url"), F.col(html).alias("html"))
    df = ruled(packed.drop("html"), rules)
    pages, url, html, names = packed, "url", "html", pages.columns
    seeds = df.where("rule_verdict is not null").groupBy(F.col("rule_verdict").alias("kind"), "host").agg(F.count("*").alias("n"))
    ranks = propagate(host_edges(pages, url, html), seeds, rounds)
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0))
    hosts = ranks.groupBy(F.col("host").alias("h_")).agg(part("allow").alias("trust"), part("block").alias("distrust"))
    df = df.join(hosts, F.col("host") == F.col("h_"), "left").drop("h_")
    zero = F.lit(0).cast("long")
    df = df.withColumn("trust", F.coalesce("trust", zero)).withColumn("distrust", F.coalesce("distrust", zero))
    method = F.when(F.col("distrust") > F.col("trust") * MAX_RATIO, "block").otherwise("allow")
    made = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "verdict": F.coalesce("rule_verdict", method), "trust": F.col("trust"), "distrust": F.col("distrust")}
    own = [F.col(f"row_.u{i}").alias(c) for i, c in enumerate(names) if c not in made]
    return df.select(*own, *(c.alias(n) for n, c in made.items()))
