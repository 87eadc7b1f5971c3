"""Louvain clusters per tenant as joins and aggregations, and the read models over a given assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import modularity_gain
from ..schema import GAIN_EPSILON, MAX_LEVELS
from ..session import cut
from .provenance import with_both_ends
from .skew import ranked

# A tenant leaves a level when the moves that its nodes still want are worth less modularity than this together, or than this share
# of what they wanted at first.
TOLERANCE, SHARE = 1e-4, 0.02
# Passes of one level at most; every pass raises modularity, and the levels above move on from where a level stops.
LEVEL_PASSES = 30


def undirected_weights(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Weight 1 per typed edge on the unordered pair; self and dangling edges are skipped."""
    return (
        with_both_ends(edges.where("source_concept_id <> target_concept_id"), concepts)
        .groupBy(
            "user_id",
            F.least("source_concept_id", "target_concept_id").alias("a"),
            F.greatest("source_concept_id", "target_concept_id").alias("b"),
        )
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def degrees(weights: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Weighted degree per node, a self-loop counting twice. With ``nodes(user_id, node)`` isolated ones get 0."""
    ends = weights.select("user_id", F.explode(F.array("a", "b")).alias("node"), "weight")
    summed = ends.groupBy("user_id", "node").agg(F.sum("weight").alias("degree"))
    if nodes is None:
        return summed
    return nodes.join(summed, ["user_id", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))


def total_weights(weights: DataFrame) -> DataFrame:
    return weights.groupBy("user_id").agg(F.sum("weight").alias("total"))


def modularity(weights: DataFrame, assignment: DataFrame) -> DataFrame:
    """Modularity of ``assignment(user_id, node, community)`` per tenant."""
    comm = lambda c: assignment.select("user_id", F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    inside = (
        weights.join(comm("a"), ["user_id", "a"]).join(comm("b"), ["user_id", "b"])
        .groupBy("user_id").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    )
    outside = (
        degrees(weights).join(assignment, ["user_id", "node"]).groupBy("user_id", "community").agg(F.sum("degree").alias("d"))
        .groupBy("user_id").agg(F.sum(F.col("d") * F.col("d")).alias("squares"))
    )
    return total_weights(weights).join(inside, "user_id").join(outside, "user_id").select(
        "user_id",
        (F.col("inside") / F.col("total") - F.col("squares") / (4.0 * F.col("total") * F.col("total"))).alias("modularity"),
    )


def aggregate_level(weights: DataFrame, assignment: DataFrame) -> DataFrame:
    """Communities become nodes: weights between them add up, weights inside become self-loops."""
    comm = lambda c: assignment.select("user_id", F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    return (
        weights.join(comm("a"), ["user_id", "a"]).join(comm("b"), ["user_id", "b"])
        .groupBy("user_id", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        .agg(F.sum("weight").alias("weight"))
    )


def _wanted(adjacent: DataFrame, state: DataFrame, active: DataFrame | None) -> DataFrame:
    """``user_id, node, own, degree, total, pass, gained, target, step``: the active nodes that would gain by moving.

    ``gained`` is the best gain anywhere; ``target`` and its gain ``step`` are set if the node may move in this pass, in which one random
    half of the communities gives nodes away and the other half takes them. A node weighs its own community like any other,
    without itself.
    """
    active = state.select("user_id", "node") if active is None else active
    gain = modularity_gain(F.col("weight_into"), F.expr("sigma - if(community = own, degree, 0D)"), F.col("degree"), F.col("total"))
    scored = state.sparkSession.sql(
        """WITH movers AS (SELECT user_id, node, community AS own, degree, total, pass FROM {state} LEFT SEMI JOIN {active} USING (user_id, node)),
        links AS (
          SELECT n.user_id, n.node, s.community, n.weight FROM (SELECT * FROM {adjacent} LEFT SEMI JOIN {active} USING (user_id, node)) n
          JOIN {state} s ON s.user_id = n.user_id AND s.node = n.other
          UNION ALL SELECT user_id, node, own, 0D FROM movers),
        into AS (SELECT user_id, node, community, sum(weight) AS weight_into FROM links GROUP BY user_id, node, community),
        sigma AS (SELECT user_id, community, sum(degree) AS sigma FROM {state} GROUP BY user_id, community)
        SELECT * FROM into JOIN movers USING (user_id, node) JOIN sigma USING (user_id, community)""",
        state=state, active=active, adjacent=adjacent,
    ).withColumn("gain", gain)
    return state.sparkSession.sql(
        """SELECT user_id, node, own, degree, total, pass, best - stay AS gained, if(now.gain > stay + {epsilon}, now.community, NULL) AS target,
          if(now.gain > stay + {epsilon}, now.gain - stay, NULL) AS step
        FROM (
          SELECT user_id, node, own, degree, total, pass, max(gain) FILTER (WHERE community <> own) AS best, max(gain) FILTER (WHERE community = own) AS stay,
            max(struct(gain, community)) FILTER (WHERE community <> own AND pmod(xxhash64(user_id, community, pass), 2) = 1 AND pmod(xxhash64(user_id, own, pass), 2) = 0) AS now
          FROM {scored} GROUP BY user_id, node, own, degree, total, pass)
        WHERE best > stay + {epsilon}""",
        scored=scored, epsilon=GAIN_EPSILON,
    )


def _accepted(wanted: DataFrame) -> DataFrame:
    """``user_id, node, target``: moves that together gain at least what each is counted for.

    Moves stand in steps of halving gain and, inside a step, in random classes of doubling size. A move counts the degrees that
    enter its target and leave its community in the classes before and in its own; whatever else happens at once (companions that come
    along) only adds to modularity. Communities carry one number for each class, so none is gathered.
    """
    return wanted.sparkSession.sql(
        """WITH drawn AS (SELECT *, xxhash64(user_id, node, pass) AS draw FROM {wanted} WHERE target IS NOT NULL),
        moves AS (SELECT *, -(floor(log2(step)) * 64 + least(bit_count((draw & -draw) - 1), 63)) AS rank FROM drawn),
        flows AS (
          SELECT user_id, community, rank, sum(sum(degree)) OVER (PARTITION BY user_id, community ORDER BY rank) AS flow
          FROM (SELECT user_id, explode(array(own, target)) AS community, rank, degree FROM moves) GROUP BY user_id, community, rank)
        SELECT m.user_id, m.node, m.target FROM moves m
        JOIN flows s ON s.user_id = m.user_id AND s.community = m.own AND s.rank = m.rank
        JOIN flows t ON t.user_id = m.user_id AND t.community = m.target AND t.rank = m.rank
        WHERE m.step > (s.flow + t.flow - 2 * m.degree) * m.degree / (2 * m.total * m.total)""",
        wanted=wanted,
    )


def local_moving(weights: DataFrame, max_passes: int = LEVEL_PASSES, tolerance: float = TOLERANCE, share: float = SHARE) -> DataFrame:
    """Communities after local moving over all nodes of ``weights``: ``user_id, node, community``.

    A pass makes many moves at once, none of which spoils another, so modularity rises with every pass. Only nodes on the
    worklist are scored: those next to a node that moved, and those that still want to move. A tenant leaves when its
    worklist is empty, when what its nodes want is worth less than ``tolerance`` or than ``share`` of what they wanted first, or after
    ``max_passes``, whatever other tenants do.
    """
    adjacent = cut(
        weights.where("a <> b").select(
            "user_id", F.inline(F.array(
                F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "weight"),
                F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "weight"),
            ))
        ),
        "adjacent",
    )
    state = cut(
        degrees(weights).join(total_weights(weights), "user_id").select(
            "user_id", "node", F.col("node").alias("community"), "degree", "total", F.lit(False).alias("moved"), F.lit(0).alias("pass")
        ),
        "louvain_state",
    )
    node, active, first = ["user_id", "node"], None, None
    for _ in range(max_passes):
        wanted = cut(_wanted(adjacent, state, active), "louvain_wanted")
        going = wanted.groupBy("user_id").agg(F.sum("gained").alias("gained")).where(F.col("gained") >= tolerance)
        if first is not None:
            going = going.join(first, "user_id").where(F.col("gained") >= share * F.col("first"))
        going = cut(going.select("user_id", "gained"), "louvain_going")
        first = going.withColumnRenamed("gained", "first") if first is None else first
        if not going.head(1):
            break
        wanted = wanted.join(going, "user_id", "left_semi")
        state = cut(
            # The number of the pass is data, so that all passes run the same generated code.
            state.join(_accepted(wanted), node, "left").select(
                *node, F.coalesce("target", "community").alias("community"), "degree", "total", F.col("target").isNotNull().alias("moved"), (F.col("pass") + 1).alias("pass")
            ),
            "louvain_state",
        )
        moved = state.where("moved").select("user_id", F.col("node").alias("other"))
        beside = adjacent.join(moved, ["user_id", "other"], "left_semi").select(*node)
        active = beside.unionByName(wanted.select(*node)).distinct()
    return state.select("user_id", "node", "community")


def level_quality(level: DataFrame) -> DataFrame:
    """``user_id, q``: modularity of the communities that are the nodes of an aggregated level."""
    inside = level.groupBy("user_id").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    squares = degrees(level).groupBy("user_id").agg(F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    total = F.col("total")
    return inside.join(squares, "user_id").select("user_id", (F.col("inside") / total - F.col("squares") / (4.0 * total * total)).alias("q"))


def connected(weights: DataFrame, assignment: DataFrame) -> DataFrame:
    """``assignment`` with every community split into its connected parts, each named by its smallest node.

    Inside weight stays and squared degrees shrink, so modularity never falls. Labels spread to neighbours and jump to the
    label of their label; each round is written.
    """
    comm = lambda c: assignment.select("user_id", F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    inner = weights.where("a <> b").join(comm("a"), ["user_id", "a"]).join(comm("b"), ["user_id", "b"]).where("ca = cb")
    links = cut(inner.select("user_id", F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))
    ))), "inner_links")
    # Each node starts with its smallest neighbour or itself; nodes without inner links are parts of their own.
    label = cut(links.groupBy("user_id", "node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "part_labels")
    while True:
        there = label.select("user_id", F.col("node").alias("other"), F.col("label").alias("theirs"))
        spread = links.join(there, ["user_id", "other"]).groupBy("user_id", "node").agg(F.min("theirs").alias("theirs"))
        low = label.join(spread, ["user_id", "node"]).select("user_id", "node", F.col("label").alias("was"), F.least("label", "theirs").alias("low"))
        jump = label.select("user_id", F.col("node").alias("low"), F.col("label").alias("label"))
        after = cut(low.join(jump, ["user_id", "low"]).select("user_id", "node", "was", F.least("low", "label").alias("label")), "part_labels")
        label = after.drop("was")
        if not after.where("was <> label").head(1):
            break
    return assignment.join(label, ["user_id", "node"], "left").select("user_id", "node", F.coalesce("label", "node").alias("community"))


def louvain(edges: DataFrame, concepts: DataFrame, max_levels: int = MAX_LEVELS, max_passes: int = LEVEL_PASSES,
            tolerance: float = TOLERANCE, share: float = SHARE) -> DataFrame:
    """Community per concept: ``user_id, concept_id, community``. Concepts without edges stay alone.

    Levels of local moving and aggregation, the same joins and aggregations for a tenant of any size. A tenant keeps a level only
    if it raised its modularity, so the outcome for a tenant depends on its own graph alone. Communities are connected.
    """
    weights = cut(undirected_weights(edges, concepts), "louvain_weights")
    nodes = weights.select("user_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    placed = nodes.withColumn("community", F.col("node"))
    level, quality = weights, None
    for _ in range(max_levels):
        found = local_moving(level, max_passes, tolerance, share)
        above = cut(aggregate_level(level, found), "louvain_weights")
        after = level_quality(above)
        before = level_quality(level) if quality is None else quality
        rose = cut(
            after.join(before.withColumnRenamed("q", "was"), "user_id").where(F.col("q") > F.col("was") + GAIN_EPSILON).select("user_id", "q"),
            "louvain_quality",
        )
        if not rose.head(1):
            break
        up = found.join(rose, "user_id", "left_semi").select("user_id", F.col("node").alias("community"), F.col("community").alias("parent"))
        placed = cut(_lift(placed, up), "louvain_placed")
        level, quality = above.join(rose, "user_id", "left_semi"), rose
    whole = connected(weights, placed).withColumnRenamed("node", "concept_id")
    return concepts.select("user_id", "concept_id").join(whole, ["user_id", "concept_id"], "left").select(
        "user_id", "concept_id", F.coalesce("community", "concept_id").alias("community")
    )


def _lift(placed: DataFrame, up: DataFrame) -> DataFrame:
    return placed.join(up, ["user_id", "community"], "left").select(
        "user_id", "node", F.coalesce("parent", "community").alias("community")
    )


# --- read models over a given assignment ----------------------------------------------------------
def session_ranks(assignment: DataFrame) -> DataFrame:
    """``user_id, community, size, first_member, partition_id, label``: largest cluster first."""
    sizes = assignment.groupBy("user_id", "community").agg(
        F.count(F.lit(1)).alias("size"), F.min("concept_id").alias("first_member")
    )
    numbered = ranked(sizes, ["user_id"], [F.desc("size"), F.asc("first_member")])
    return numbered.select(
        "user_id", "community", "size", "first_member", (F.col("rank") - 1).cast("int").alias("partition_id"),
        F.concat(F.lit("Group "), F.col("rank"), F.lit(" for this session")).alias("label"),
    )


def partition_ids(assignment: DataFrame) -> DataFrame:
    return assignment.join(session_ranks(assignment), ["user_id", "community"]).select(
        "user_id", "concept_id", "partition_id"
    )


def partition_summary(assignment: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row per cluster with its label and size, and the tenant's concept count."""
    counts = concepts.groupBy("user_id").agg(F.count(F.lit(1)).alias("concept_count"))
    return session_ranks(assignment).join(counts, "user_id").select(
        "user_id", "partition_id", "label", "size", "first_member", "concept_count"
    )


def partition_members(assignment: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row per cluster member with its label; a cluster of any size stays spread out."""
    ranks = session_ranks(assignment).select("user_id", "community", "partition_id", F.col("label").alias("cluster_label"))
    return (
        assignment.join(concepts.select("user_id", "concept_id", "label"), ["user_id", "concept_id"])
        .join(ranks, ["user_id", "community"])
        .select("user_id", "partition_id", "cluster_label", "concept_id", "label")
    )
