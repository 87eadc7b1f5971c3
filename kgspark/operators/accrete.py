"""Edges of extracted notes onto the graph, and what each note contributed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import edge_key
from ..session import cut, settings
from .history import first_history

NOTE = ["user_id", "braindump_id"]
KEY = ["user_id", "source_concept_id", "type", "target_concept_id"]


def first_labels(concepts: DataFrame) -> DataFrame:
    """First position of each label within a note."""
    return concepts.groupBy(*NOTE, "label").agg(F.min("pos").alias("pos"))


def first_edges(edges: DataFrame) -> DataFrame:
    """First position of each (source, type, target) of labels within a note."""
    return edges.groupBy(*NOTE, "source", "type", "target").agg(F.min("pos").alias("pos"))


def resolve_ends(edges: DataFrame, label_ids: DataFrame) -> DataFrame:
    """Concept ids for both labels of each edge; null where the label was not extracted from the note.

    Both sides are sorted by a hash of all three keys first: names of tenants and ids of notes repeat, one integer mostly decides.
    """
    out, at = edges, "_at"
    for end in ("source", "target"):
        ids = label_ids.select(
            F.xxhash64(*NOTE, "label").alias(at), *NOTE, F.col("label").alias(end), F.col("concept_id").alias(f"{end}_concept_id")
        )
        out = out.withColumn(at, F.xxhash64(*NOTE, end)).join(ids, [at, *NOTE, end], "left").drop(at)
    return out


# Positions in a note are below this.
_POSITIONS = 1 << 31


def _key_id() -> Column:
    return edge_key(F.col("source_concept_id"), F.col("type"), F.col("target_concept_id")).alias("key_id")


@dataclass
class Accretion:
    """``judged`` has one row per distinct extracted edge; the rest are rows to add. Keys are folded only for results that need them."""

    resolved: DataFrame
    held: DataFrame
    at: int
    write: Callable[[DataFrame, str], DataFrame]
    # Set if ``resolved`` marks the first edge of a note between the same concepts, so that assertions are distinct as they are.
    marked: bool = False

    @cached_property
    def _valid(self) -> DataFrame:
        return self.resolved.where("reason IS NULL")

    @cached_property
    def _new(self) -> DataFrame:
        # A decimal holds note and position in order; unlike a struct it is aggregated without sorting the edges.
        first = F.col("braindump_id").cast("decimal(20,0)") * F.lit(_POSITIONS).cast("decimal(11,0)") + F.col("pos")
        pos = F.pmod("first", F.lit(_POSITIONS).cast("decimal(11,0)"))
        asserted = self._valid.groupBy(*KEY).agg(F.min(first).alias("first")).select(
            *KEY, _key_id(), F.struct(
                F.expr(f"(first - pmod(first, {_POSITIONS}BD)) div {_POSITIONS}BD").alias("braindump_id"), pos.cast("int").alias("pos")).alias("first"),
        ).join(self.held, KEY, "left")
        return self.write(asserted, "asserted_edges").where("held_id IS NULL")

    @cached_property
    def judged(self) -> DataFrame:
        creators = self._new.select(
            "user_id", "key_id", F.col("first.braindump_id").alias("braindump_id"), F.col("first.pos").alias("pos"),
            F.lit(True).alias("creates"),
        )
        return self.resolved.join(creators, ["user_id", "key_id", "braindump_id", "pos"], "left").withColumn(
            "outcome",
            F.when(F.col("reason").isNotNull(), F.lit("rejected")).when(F.col("creates"), F.lit("created")).otherwise(F.lit("accreted")),
        ).drop("creates")

    @cached_property
    def new_edges(self) -> DataFrame:
        return self._new.select(
            "user_id", F.col("key_id").alias("edge_id"), "source_concept_id", "target_concept_id",
            F.col("type").alias("original_type"), F.lit(self.at).cast("bigint").alias("created_at"),
        )

    @cached_property
    def history(self) -> DataFrame:
        return first_history(self.new_edges)

    @cached_property
    def provenance(self) -> DataFrame:
        """Only edges held before have another id than their key, so assertions meet those, not all keys."""
        asserted = self._valid.where("first") if self.marked else self._valid
        found = asserted.join(self.held, KEY, "left").select(
            "user_id", F.coalesce("held_id", "key_id").alias("edge_id"), "braindump_id"
        )
        return found if self.marked else found.distinct()

    @cached_property
    def note_counts(self) -> DataFrame:
        """``edges_created, edges_accreted, edges_rejected`` per note: what a note's edges come to less those it created."""
        of_note = self.resolved.groupBy(*NOTE).agg(
            F.count(F.when(F.col("reason").isNull(), 1)).alias("edges_accreted"), F.count("reason").alias("edges_rejected"))
        created = self._new.groupBy("user_id", F.col("first.braindump_id").alias("braindump_id")).agg(F.count(F.lit(1)).alias("edges_created"))
        sums = of_note.select(*NOTE, F.lit(0).cast("bigint").alias("edges_created"), "edges_accreted", "edges_rejected").unionByName(
            created.select(*NOTE, "edges_created", (-F.col("edges_created")).alias("edges_accreted"), F.lit(0).cast("bigint").alias("edges_rejected")))
        return sums.groupBy(*NOTE).agg(*[F.sum(c).alias(c) for c in ("edges_created", "edges_accreted", "edges_rejected")])


def accrete_edges(
    edges: DataFrame, label_ids: DataFrame, ontology: DataFrame, existing: DataFrame, at: int, materialize: bool = False,
    parts: int = 0,
) -> Accretion:
    """Judge extracted edges in note order: unknown end, then unsanctioned type, else create or accrete.

    The creator of a new edge is the earliest (note, position) asserting its key; the earliest is found by a
    combined minimum, so an edge asserted by very many notes is never gathered. ``materialize`` writes the judged
    edges and their keys once, for callers that use more than one result; ``parts`` says in how many partitions edges lie by note.
    """
    types = ontology.select("user_id", F.col("slug").alias("type"), F.lit(True).alias("sanctioned")).distinct()
    if materialize:
        # Few types have very many edges each: the real size of the types decides that these are not shuffled by type.
        types = cut(types, "types")
        # Labels and edges of a note meet in one place: labels are shuffled once, by note; parsed edges lie by note already.
        label_ids = label_ids.select(*NOTE, "label", "concept_id")
        label_ids = label_ids.repartition(parts, *NOTE) if parts else label_ids.repartition(*NOTE)
    judged = _judged(resolve_ends(first_edges(edges), label_ids), types)
    if materialize:
        with settings(existing.sparkSession, spark__sql__requireAllClusterKeysForCoPartition="false"):
            judged = cut(judged, "judged_edges")
    return Accretion(judged, _held(existing), at, cut if materialize else lambda df, name: df)


def accrete_placed(edges: DataFrame, ontology: DataFrame, existing: DataFrame, at: int, marked: bool = False) -> Accretion:
    """The same for ``edges(user_id, braindump_id, pos, type, source_concept_id, target_concept_id, ..)``, the distinct edges of notes with
    their ends resolved (else null). They are read again for each result; only the few new edges are written.
    """
    types = cut(ontology.select("user_id", F.col("slug").alias("type"), F.lit(True).alias("sanctioned")).distinct(), "types")
    return Accretion(_judged(edges, types), _held(existing), at, cut, marked)


def _judged(resolved: DataFrame, types: DataFrame) -> DataFrame:
    return resolved.join(types, ["user_id", "type"], "left").withColumn(
        "reason",
        F.when(F.col("source_concept_id").isNull(), F.lit("unknown_source"))
        .when(F.col("target_concept_id").isNull(), F.lit("unknown_target"))
        .when(F.col("sanctioned").isNull(), F.lit("unknown_type")),
    ).withColumn("key_id", _key_id()).drop("sanctioned")


def _held(existing: DataFrame) -> DataFrame:
    return existing.select(
        "user_id", "source_concept_id", F.col("original_type").alias("type"), "target_concept_id",
        F.col("edge_id").alias("held_id"),
    )


def outcome_counts(concept_outcomes: DataFrame, judged_edges: DataFrame) -> DataFrame:
    """Counters per note: concepts created, accreted, suggestions; edges created, accreted, rejected."""
    concepts = concept_outcomes.select(
        *NOTE, F.concat(F.lit("concepts_"), F.when(F.col("outcome") == "accreted", "accreted").otherwise("created")).alias("what"),
        (F.col("outcome") == "suggested").cast("int").alias("suggested"),
    )
    edges = judged_edges.select(*NOTE, F.concat(F.lit("edges_"), "outcome").alias("what"), F.lit(0).alias("suggested"))
    return concepts.unionByName(edges).groupBy(*NOTE).agg(
        *[
            F.count_if(F.col("what") == what).alias(what)
            for what in ("concepts_created", "concepts_accreted")
        ],
        F.sum("suggested").cast("bigint").alias("merge_suggestions"),
        *[F.count_if(F.col("what") == what).alias(what) for what in ("edges_created", "edges_accreted", "edges_rejected")],
    )
