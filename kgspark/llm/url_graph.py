"""URL filter: rules first, then trust and distrust that spread over the links between hosts. DataFrame functions only.

``verdicts`` gives each url the longest rule that fits its host and path. Hosts of allowed urls seed a personalised
PageRank along the links, hosts of blocked urls seed one against them (a host that links to blocked hosts is suspect).
A host's seed is the share of its urls that rules allow or block. A url without a rule is blocked when its host's
distrust exceeds its trust by more than ``threshold``, in units of a full seed.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed unless its
(empty) host ranks as blocked; repeated rows give repeated results; relative links stay on their host and links to
the same host are no edges; null html has no links; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
LINK = r"""(?i)\s(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""
DAMPING, ROUNDS, THRESHOLD = 0.85, 12, 0.5
# Rounds between written tables, so that no plan grows with the number of rounds.
ROUNDS_PER_PLAN = 4


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls; of equal rules the blocking one. Rules are a short list."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, share): distinct links from host to host, weighted by their share of the source's links."""
    links = pages.select(host_of(F.col("url")).alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    edges = links.select("source", host_of(full).alias("target")).where("source <> target AND source <> '' AND target <> ''")
    edges = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    return edges.join(edges.groupBy("source").agg(F.sum("n").alias("out")), "source").select("source", "target", "n", (F.col("n") / F.col("out")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank of several kinds at once: (kind, host, seed) and (kind, source, target, share) to
    (kind, host, score), scores in units of a full seed."""
    start = seeds.where("seed > 0").select("kind", "host", F.col("seed").alias("score"))
    if not edges.head(1):
        return start
    score = start
    for n in range(1, rounds + 1):
        given = edges.join(score.withColumnRenamed("host", "source"), ["kind", "source"])
        given = given.select("kind", F.col("target").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        score = start.unionByName(given).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if n % ROUNDS_PER_PLAN == 0 and n < rounds:
            score = stage(score, "url_rank")
    return score


def host_ranks(pages: DataFrame, rules: list[tuple[str, str]] = RULES, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host that has any of either."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(host.alias("host"), longest_rule(host, path, rules)[1].alias("verdict"))
    shares = judged.groupBy("host").agg(*[(F.count(F.when(F.col("verdict") == v, 1)) / F.count(F.lit(1))).alias(v) for v in ("allow", "block")])
    seeds = stage(
        shares.select("host", F.explode(F.array(
            F.struct(F.lit("trust").alias("kind"), F.col("allow").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("block").alias("seed"))
        )).alias("s")).select("s.kind", "host", "s.seed"), "url_seeds",
    )
    links = host_links(pages)
    into = links.groupBy("target").agg(F.sum("n").alias("in"))
    # Distrust flows from a host to those that link to it, split over them.
    ways = F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("source"), F.col("target"), F.col("share")),
        F.struct(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), (F.col("n") / F.col("in")).alias("share")),
    )
    edges = stage(links.join(into, "target").select(F.explode(ways).alias("e")).select("e.*"), "url_edges")
    score = propagate(seeds, edges, damping, rounds)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return score.groupBy("host").agg(of("trust"), of("distrust"))


def verdicts(
    pages: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row."""
    pages = pages.select("page_id", "url", "html")
    ranks = stage(host_ranks(pages, rules, damping, rounds), "url_ranks")  # its real size decides how it is joined
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .join(ranks, "host", "left").na.fill(0.0, ["trust", "distrust"])
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "trust", "distrust")
    )
