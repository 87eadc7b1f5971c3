"""Concept identity: which extracted labels are known concepts, which become new ones.

In arrival order a label joins its nearest earlier concept at or above the accretion similarity, else it becomes a
concept itself, with a merge suggestion when its nearest earlier concept is at least at the suggestion floor. Concept
vectors never move, so a label leads exactly when no earlier leader is near enough: the leaders are the first
independent set in arrival order, found here in rounds. Nothing emits the pairs of a dense group:

* exact copies of a vector are reduced to their first occurrence before any comparison (only it can lead);
* where a vector is a function of its label, each distinct label gets one, and occurrences travel without it;
* a round keeps one fact per label, whether an earlier undecided label or leader is near.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ACCRETION_SIMILARITY, SIMILARITY_DECIMALS, SUGGESTION_FLOOR_SIMILARITY
from ..session import cut
from .knn import CELL_ROWS, _id_order, _unit_rows, meet, row_tiles

# Stored concepts come before every new label.
BEFORE_ALL = -1


@dataclass
class Identity:
    """``occurrences`` carry ``concept_id``, ``outcome``; ``leaders`` are the new concepts; ``suggestions`` their near ones."""

    occurrences: DataFrame
    leaders: DataFrame
    suggestions: DataFrame


def _order(table: pa.Table, at: str, pos: str) -> tuple[np.ndarray, np.ndarray]:
    return (
        table[at].to_numpy().astype(np.int64),
        table[pos].to_numpy().astype(np.int64),
    )


def _earlier(right: pa.Table, left: pa.Table, rows: slice) -> np.ndarray:
    """Matrix: right column arrived before left row."""
    la, lp = (x[rows] for x in _order(left, "at", "pos"))
    ra, rp = _order(right, "at", "pos")
    return (ra[None, :] < la[:, None]) | ((ra[None, :] == la[:, None]) & (rp[None, :] < lp[:, None]))


def _tiles(left: pa.Table, right: pa.Table):
    """(rows, similarities, whether the right one arrived before) of the left rows in tiles of bounded size."""
    one, two = _unit_rows(left["embedding"]), _unit_rows(right["embedding"])
    for rows in row_tiles(left.num_rows, right.num_rows):
        yield rows, np.round(one[rows] @ two.T, SIMILARITY_DECIMALS), _earlier(right, left, rows)


def _meet_any(threshold: float):
    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        hit = np.zeros(left.num_rows, dtype=bool)
        if left.num_rows and right.num_rows:
            for rows, sims, earlier in _tiles(left, right):
                hit[rows] = ((sims >= threshold) & earlier).any(axis=1)
        rows = pa.array(np.flatnonzero(hit))
        return pa.table({c: left[c].combine_chunks().take(rows) for c in ("user_id", "vector_id")})

    return near


def _meet_nearest():
    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = {"user_id": pa.string(), "vector_id": pa.string(), "leader_id": pa.string(), "leader_at": pa.int64(),
                  "leader_pos": pa.int64(), "similarity": pa.float64()}
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({k: pa.array([], t) for k, t in schema.items()})
        ra, rp = _order(right, "at", "pos")
        rank = np.empty(len(ra), dtype=np.int64)
        rank[np.lexsort((_id_order(right["concept_id"]), rp, ra))] = np.arange(len(ra))
        top, best = np.full(left.num_rows, -np.inf), np.zeros(left.num_rows, np.int64)
        for rows, sims, earlier in _tiles(left, right):
            sims = np.where(earlier, sims, -np.inf)
            top[rows] = sims.max(axis=1)
            best[rows] = np.where(sims == top[rows, None], rank[None, :], len(ra)).argmin(axis=1)
        rows = np.flatnonzero(np.isfinite(top))
        pick = pa.array(best[rows])
        return pa.table(
            {
                "user_id": left["user_id"].combine_chunks().take(pa.array(rows)),
                "vector_id": left["vector_id"].combine_chunks().take(pa.array(rows)),
                "leader_id": right["concept_id"].combine_chunks().take(pick),
                "leader_at": pa.array(ra[best[rows]]),
                "leader_pos": pa.array(rp[best[rows]]),
                "similarity": pa.array(top[rows]),
            }
        )

    return near


_VECTOR = ["user_id", "vector_id", "at", "pos", "embedding"]
_KEY = ["user_id", "vector_id"]


def _near(left: DataFrame, right: DataFrame, threshold: float, cell_rows: int) -> DataFrame:
    """Keys of left vectors with an earlier right vector at or above the threshold."""
    return meet(
        left.select(*_VECTOR), "vector_id", right.select(*_VECTOR), "vector_id", _meet_any(threshold),
        "user_id string, vector_id string", cell_rows, threshold,
    ).distinct()


def nearest_earlier(left: DataFrame, leaders: DataFrame, cell_rows: int = CELL_ROWS, min_similarity: float | None = None) -> DataFrame:
    """The nearest earlier leader per left row (ties: the earliest leader); leaders below ``min_similarity`` may be left out."""
    partial = meet(
        left.select(*_VECTOR), "vector_id", leaders.select(*_VECTOR, "concept_id"), "vector_id", _meet_nearest(),
        "user_id string, vector_id string, leader_id string, leader_at bigint, leader_pos bigint, similarity double", cell_rows, min_similarity,
    )
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "leader_at", "leader_pos", "leader_id"))
    return partial.groupBy(*_KEY).agg(best.alias("b")).select(*_KEY, "b.leader_id", (-F.col("b.s")).alias("similarity"))


def elect(vectors: DataFrame, accrete: float, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """First independent set over distinct non-zero vectors: (leaders, followers)."""
    columns = [*_VECTOR, "concept_id", "copy_a", "copy_b"]
    leaders = followers = None
    open_ = vectors
    # Stored concepts already lead; everything near one of them follows.
    stored = vectors.where(F.col("at") == BEFORE_ALL)
    winners = stored if stored.limit(1).count() else None
    while True:
        if winners is None:
            blocked = _near(open_, open_, accrete, cell_rows)
            winners = cut(open_.join(blocked, _KEY, "left_anti"), "winners")
        rest = open_.join(winners, _KEY, "left_anti")
        near = _near(rest, winners, accrete, cell_rows).withColumn("follows", F.lit(True))
        judged = cut(rest.join(near, _KEY, "left").select(*columns, F.coalesce("follows", F.lit(False)).alias("follows")), "judged")
        led, followed = winners.select(*columns), judged.where("follows").select(*columns)
        leaders = led if leaders is None else leaders.unionByName(led)
        followers = followed if followers is None else followers.unionByName(followed)
        open_, winners = judged.where("NOT follows").select(*columns), None
        if not open_.limit(1).count():
            return leaders, followers


def resolve_identity(
    labels: DataFrame,
    stored: DataFrame | None = None,
    accrete: float = ACCRETION_SIMILARITY,
    floor: float = SUGGESTION_FLOOR_SIMILARITY,
    cell_rows: int = CELL_ROWS,
    embed: Callable[[Column], Column] | None = None,
    every: Callable[[DataFrame], DataFrame] | None = None,
) -> Identity:
    """Resolve ``labels(user_id, braindump_id, pos, label, embedding)``, one row per label and note.

    With ``embed`` the vector of a label is ``embed(label)``, ``labels`` need no embedding, and each distinct label is embedded once.
    ``stored(user_id, concept_id, embedding)`` are the tenant's concepts. New ids are ``k:<note>:<pos>``. Further columns of
    ``labels`` travel on to the occurrences.

    With ``every``, ``labels`` are entries that each stand for the occurrences of a label in some notes, at the first of them, and
    ``every`` spells out the rows ``(.., at, pos)`` of entries. Only labels without a concept of their own vector need that; the others
    have one concept in all their notes. ``each`` tells which occurrences speak for one note alone.
    """
    carry = [c for c in labels.columns if c not in ("user_id", "braindump_id", "pos", "label", "embedding")]
    # 128 bits stand for the vector wherever only equality matters, so occurrences travel without it.
    codes = {
        "zero": F.forall("embedding", lambda x: x == 0),
        "copy_a": F.xxhash64("embedding"), "copy_b": F.xxhash64(F.lit(1), "embedding"),
    }
    arrived = labels.withColumnsRenamed({"braindump_id": "at"}).withColumns(
        {"at": F.col("at").cast("bigint"), "pos": F.col("pos").cast("bigint")})
    if embed is None:
        arrived = arrived.select("user_id", "at", "pos", "label", *carry, "embedding").withColumns(codes)
        with_vector = lambda df: df.withColumn("embedding", F.col("carried"))
        carried = F.col("embedding")
    else:
        words = cut(labels.select("label").distinct().withColumn("embedding", embed(F.col("label"))).withColumns(codes), "words")
        arrived = cut(arrived.select("user_id", "at", "pos", "label", *carry).join(words.drop("embedding"), "label"), "arrived", "zstd")
        vectors_of = words.select(F.col("label").alias("carried"), "embedding")
        with_vector = lambda df: df.join(vectors_of, "carried")
        carried = F.col("label")
    copy = ["user_id", "copy_a", "copy_b"]
    # Copies of one vector share the fate of their first occurrence, combined before the shuffle.
    first = F.struct("at", "pos")
    copies = with_vector(arrived.where("NOT zero").groupBy(*copy).agg(F.min(first).alias("f"), F.min_by(carried, first).alias("carried")))
    new = copies.select(
        "user_id", F.concat_ws(":", F.lit("k"), "f.at", "f.pos").alias("vector_id"), "f.at", "f.pos", "embedding",
        F.concat_ws(":", F.lit("k"), "f.at", "f.pos").alias("concept_id"), "copy_a", "copy_b",
    )
    if stored is not None:
        # Stored ids rank by id, so a tie between stored concepts goes to the lowest.
        old = stored.select("user_id", "concept_id", "embedding").where(F.exists("embedding", lambda x: x != 0))
        old = old.select(
            "user_id", F.concat(F.lit("stored:"), "concept_id").alias("vector_id"),
            F.lit(BEFORE_ALL).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("pos"), "embedding", "concept_id",
            F.lit(None).cast("bigint").alias("copy_a"), F.lit(None).cast("bigint").alias("copy_b"),
        )
        new = old.unionByName(new)
    vectors = cut(new, "vectors")
    leaders, followers = elect(vectors, accrete, cell_rows)
    decided = leaders.withColumn("leads", F.lit(True)).unionByName(followers.withColumn("leads", F.lit(False)))

    # Copies whose first occurrence leads belong to it: nothing else can be nearer than an equal vector.
    # Copies of a follower look up the nearest leader that was there when each of them arrived.
    mine = decided.where(F.col("at") != BEFORE_ALL).select(
        *copy, "leads", F.col("at").alias("first_at"), F.col("pos").alias("first_pos"), F.col("concept_id").alias("own_id")
    )
    seen = arrived.where("NOT zero").select(*copy, "at", "pos", "label", *carry).join(mine, copy)
    each, place = F.lit(every is not None).alias("each"), ["user_id", "at", "pos", "label", *carry]
    of_leader = seen.where("leads").select(
        *place, F.lit(False).alias("each"), F.col("own_id").alias("concept_id"), F.lit(1.0).alias("similarity"),
        ((F.col("at") == F.col("first_at")) & (F.col("pos") == F.col("first_pos"))).alias("is_first"),
    )
    following, zero, of_copy = arrived.where("NOT zero").join(followers.select(*copy), copy, "left_semi"), arrived.where("zero"), None
    if every is not None:
        # Nothing that comes later is nearer than an equal direction, and ties go to the earliest: such copies have one concept everywhere.
        equal = cut(
            nearest_earlier(followers, leaders, cell_rows, accrete).where("similarity >= 1").join(followers.select(*_KEY, "copy_a", "copy_b"), _KEY)
            .select(*copy, "leader_id"), "equal",
        )
        of_copy = arrived.where("NOT zero").join(equal, copy).select(
            *place, F.lit(False).alias("each"), F.col("leader_id").alias("concept_id"), F.lit(1.0).alias("similarity"), F.lit(False).alias("is_first"))
        # Mostly none is left, and the notes need not be read for them.
        alone = cut(following.join(equal, copy, "left_anti").unionByName(zero), "alone")
        alone = cut(every(alone), "alone_each") if alone.head(1) else alone
        following, zero = alone.where("NOT zero"), alone.where("zero")
    late = with_vector(following.withColumn("carried", carried)).select(
        "user_id", F.concat_ws(":", F.lit("k"), "at", "pos").alias("vector_id"), "at", "pos", "label", *carry, "embedding"
    )
    near_late = nearest_earlier(late, leaders, cell_rows, accrete)
    of_follower = late.join(near_late, _KEY).select(
        *place, each, F.col("leader_id").alias("concept_id"), "similarity", F.lit(False).alias("is_first")
    )
    of_zero = zero.select(
        *place, each, F.concat_ws(":", F.lit("k"), "at", "pos").alias("concept_id"),
        F.lit(0.0).alias("similarity"), F.lit(True).alias("is_first"),
    )
    fresh = leaders.where(F.col("at") != BEFORE_ALL)
    near_leaders = cut(
        nearest_earlier(fresh, leaders, cell_rows, floor).where(F.col("similarity") >= floor)
        .join(fresh.select(*_KEY, "at", "pos", "concept_id"), _KEY), "near_leaders",
    )
    placed = of_leader.unionByName(of_follower).unionByName(of_zero)
    placed = placed if of_copy is None else placed.unionByName(of_copy)
    suggested = near_leaders.select("user_id", "concept_id", F.lit(True).alias("suggests"))
    occurrences = placed.join(suggested, ["user_id", "concept_id"], "left").select(
        "user_id", F.col("at").alias("braindump_id"), "pos", "label", "concept_id", *carry, *(["each"] if carry else []),
        F.when(~F.col("is_first"), F.lit("accreted")).when(F.col("suggests"), F.lit("suggested"))
        .otherwise(F.lit("created")).alias("outcome"),
    )
    # New leaders have the size of their files, so few of them do not make all arrivals travel; zero labels are concepts themselves.
    led = arrived.join(fresh.select("user_id", "at", "pos", "concept_id"), ["user_id", "at", "pos"]).select(*place, "concept_id", carried.alias("carried"))
    alone = zero.select(*place, F.concat_ws(":", F.lit("k"), "at", "pos").alias("concept_id"), carried.alias("carried"))
    created = with_vector(led.unionByName(alone)).select("user_id", "concept_id", F.col("at").alias("braindump_id"), "pos", "label", "embedding")
    created = created if every is None else created.dropDuplicates(["user_id", "concept_id", "label"])
    suggestions = near_leaders.select(
        "user_id", F.concat(F.lit("m:"), F.col("concept_id")).alias("suggestion_id"), F.col("at").alias("braindump_id"),
        F.col("concept_id").alias("new_concept_id"), F.col("leader_id").alias("existing_concept_id"), "similarity",
    )
    return Identity(occurrences, created, suggestions)
