"""Edge types: seed, proposals, approval, retagging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import type_text
from ..functions.vectors import text_vector
from ..schema import DEFAULT_DIM, ONTOLOGY_SEED, TYPE_MERGE_THRESHOLD
from . import queues
from .history import append_types, edges_wearing
from .knn import nearest
from .lookups import endpoints_and_type
from .skew import ranked

SYSTEM_PROMPT = "Choose the one type that fits the edge best and answer with its slug only."


def seed_ontology(users: DataFrame, existing: DataFrame | None = None, at: int = 0) -> DataFrame:
    """The starting types for every tenant that has none yet."""
    new = users.select("user_id").distinct()
    if existing is not None:
        new = new.join(existing.select("user_id"), "user_id", "left_anti")
    rows = F.array(
        *[F.struct(F.lit(s).alias("slug"), F.lit(l).alias("label"), F.lit(d).alias("description")) for s, l, d in ONTOLOGY_SEED]
    )
    return new.select("user_id", F.posexplode(rows).alias("i", "t")).select(
        "user_id", (F.col("i") + 1).cast("bigint").alias("ontology_id"), "t.slug", "t.label", "t.description",
        F.lit(at).cast("bigint").alias("created_at"),
    )


def slugs_in_order(ontology: DataFrame) -> DataFrame:
    """One row per tenant with its slugs in id order (the vocabulary is small by nature)."""
    return ontology.groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ontology_id", "slug"))), lambda s: s["slug"]).alias("slugs")
    )


def missing_vectors(ontology: DataFrame, type_embeddings: DataFrame) -> DataFrame:
    return ontology.join(type_embeddings, ["user_id", "ontology_id"], "left_anti")


def type_vectors(ontology: DataFrame, embed: Callable[[Column], Column] | None = None, dim: int = DEFAULT_DIM) -> DataFrame:
    embed = embed or (lambda t: text_vector(t, dim))
    return ontology.select(
        "user_id", "ontology_id", embed(type_text(F.col("slug"), F.col("label"), F.col("description"))).alias("embedding")
    )


def fill_vectors(ontology: DataFrame, type_embeddings: DataFrame, **kw) -> DataFrame:
    """Type vectors with the missing ones embedded and added; stored ones stay as they are."""
    return type_embeddings.unionByName(type_vectors(missing_vectors(ontology, type_embeddings), **kw))


def propose_types(
    requests: DataFrame, ontology: DataFrame, type_embeddings: DataFrame, at: int,
    embed: Callable[[Column], Column] | None = None, threshold: float = TYPE_MERGE_THRESHOLD, dim: int = DEFAULT_DIM,
) -> DataFrame:
    """Validated proposals: ``status`` is ``pending``, ``auto_merged`` or null with a ``reason``.

    ``requests(user_id, proposal_id, slug, label, description, merge_of)``. The near match is recorded either way.
    """
    embed = embed or (lambda t: text_vector(t, dim))
    known = ontology.select("user_id", "slug").distinct()
    clean = requests.select(
        "user_id", "proposal_id", *[F.trim(c).alias(c) for c in ("slug", "label", "description", "merge_of")]
    )
    checked = (
        clean.join(known.withColumn("taken", F.lit(True)), ["user_id", "slug"], "left")
        .join(
            known.select("user_id", F.col("slug").alias("merge_of"), F.lit(True).alias("merges_known")),
            ["user_id", "merge_of"], "left",
        )
        .withColumn(
            "reason",
            F.when((F.col("slug") == "") | (F.col("label") == "") | (F.col("description") == ""), F.lit("blank_field"))
            .when(F.col("taken"), F.lit("slug_exists"))
            .when(F.col("merge_of").isNotNull() & F.col("merges_known").isNull(), F.lit("unknown_merge_of")),
        )
        .drop("taken", "merges_known")
    )
    vectors = checked.where("reason IS NULL").select(
        "user_id", F.col("proposal_id").alias("query_id"),
        embed(type_text(F.col("slug"), F.col("label"), F.col("description"))).alias("embedding"),
    )
    near = (
        nearest(vectors, type_embeddings, "ontology_id", 1, strategy="lookup")
        .join(ontology.select("user_id", "ontology_id", F.col("slug").alias("near_match_slug")), ["user_id", "ontology_id"])
        .select("user_id", F.col("query_id").alias("proposal_id"), "near_match_slug", F.col("similarity").alias("near_match_similarity"))
    )
    return checked.join(near, ["user_id", "proposal_id"], "left").withColumn(
        "status",
        F.when(F.col("reason").isNotNull(), F.lit(None)).when(
            F.col("near_match_similarity") >= threshold, F.lit("auto_merged")
        ).otherwise(F.lit("pending")),
    ).select(
        "user_id", "proposal_id", "slug", "label", "description", "merge_of", "status", "near_match_slug",
        "near_match_similarity", F.lit(at).cast("bigint").alias("created_at"), F.lit(None).cast("bigint").alias("resolved_at"),
        "reason",
    )


def approve_types(
    proposals: DataFrame, requests: DataFrame, ontology: DataFrame, at: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queue after, ontology rows added, outcome per request). Ids continue each tenant's own numbering.

    Two approved proposals of one slug add it once: the lower id adds it, the other conflicts.
    """
    decided = queues.decide(requests.withColumn("action", F.lit("approved")), proposals, "proposal_id")
    key = ["user_id", "proposal_id"]
    won = decided.where("outcome = 'approved'").select(*key).join(proposals.drop("status"), key)
    first = won.groupBy("user_id", "slug").agg(F.min("proposal_id").alias("proposal_id"))
    fresh = first.join(ontology.select("user_id", "slug"), ["user_id", "slug"], "left_anti").select(*key)
    decided = decided.join(fresh.withColumn("fresh", F.lit(True)), key, "left").withColumn(
        "outcome",
        F.when((F.col("outcome") == "approved") & F.col("fresh").isNull(), F.lit("conflict")).otherwise(F.col("outcome")),
    ).drop("fresh")
    added = won.join(fresh, key, "left_semi")
    top = ontology.groupBy("user_id").agg(F.max("ontology_id").alias("top"))
    numbered = ranked(added, ["user_id"], [F.col("proposal_id")]).join(top, "user_id", "left")
    rows = numbered.select(
        "user_id", (F.coalesce("top", F.lit(0)) + F.col("rank")).cast("bigint").alias("ontology_id"),
        "slug", "label", "description", F.lit(at).cast("bigint").alias("created_at"),
    )
    return queues.resolve(proposals, decided, "proposal_id", at), rows, decided.drop("action")


def retag_prompts(
    proposals: DataFrame, edges: DataFrame, history: DataFrame, concepts: DataFrame, ontology: DataFrame
) -> DataFrame:
    """One prompt per edge whose current type is a proposal's ``merge_of``."""
    merging = proposals.where("merge_of IS NOT NULL").select(
        "user_id", "proposal_id", F.col("slug").alias("new_slug"), F.col("label").alias("new_label"),
        F.col("description").alias("new_description"), F.col("merge_of").alias("current_type"),
    )
    worn = endpoints_and_type(edges, history, concepts).join(merging, ["user_id", "current_type"])
    prompt = F.concat(
        F.lit("Edge: "), "source_label", F.lit(" -["), "current_type", F.lit("]→ "), "target_label",
        F.lit("\nMerged into: "), "new_slug", F.lit(" ("), "new_label", F.lit(": "), "new_description",
        F.lit(")\nTypes: "), F.array_join("slugs", ", "),
    )
    return worn.join(slugs_in_order(ontology), "user_id").select(
        "user_id", "proposal_id", "edge_id", "new_slug", "slugs", F.lit(SYSTEM_PROMPT).alias("system"), prompt.alias("prompt")
    )


def retag_edges(
    proposals: DataFrame, edges: DataFrame, history: DataFrame, concepts: DataFrame, ontology: DataFrame, at: int,
    classify: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """History rows appended for approved merges.

    ``classify`` adds an ``answer`` column to the prompts; an answer outside the vocabulary means the new type.
    """
    answered = classify(retag_prompts(proposals, edges, history, concepts, ontology))
    slug = F.trim("answer")
    chosen = answered.select(
        "user_id", "edge_id", F.when(F.array_contains("slugs", slug), slug).otherwise(F.col("new_slug")).alias("type_slug")
    )
    return append_types(chosen, history, at)


__all__ = [
    "approve_types", "edges_wearing", "fill_vectors", "missing_vectors", "propose_types", "retag_edges", "retag_prompts",
    "seed_ontology", "slugs_in_order", "type_vectors",
]
