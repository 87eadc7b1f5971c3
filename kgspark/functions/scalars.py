"""Small scalar columns shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HOP, SNIPPET_CHARS

# Fixed value: the latest and earliest date of the client's calendar, in seconds from 1970.
SHOWN_SECONDS = 8_640_000_000_000

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def hop_score(hops: Column) -> Column:
    return 1.0 / (1.0 + hops.cast("double"))


def similarity_from_distance(distance: Column) -> Column:
    return 1.0 - distance


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def snippet(text: Column, length: int = SNIPPET_CHARS) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, length)


def month_year(epoch: Column) -> Column:
    """``Month YYYY`` in UTC; empty for a missing epoch or one beyond the dates that can be shown."""
    usable = epoch.isNotNull() & (F.abs(epoch) <= F.lit(SHOWN_SECONDS))
    stamp = F.when(usable, F.timestamp_add("SECOND", epoch, F.expr(_EPOCH)))
    return F.coalesce(F.date_format(stamp, "MMMM y"), F.lit(""))


def epoch(stamp: Column) -> Column:
    """Whole seconds of a zone-less timestamp, read as UTC whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.expr(_EPOCH), stamp).cast("bigint")


def now_seconds(at: int | None = None) -> Column:
    return F.lit(at).cast("bigint") if at is not None else F.unix_timestamp().cast("bigint")


def id_list(text: Column) -> Column:
    """Ids stored as a JSON array in a text; empty for anything that is not such an array."""
    ids = F.from_json(text, "array<bigint>")
    whole = F.startswith(F.ltrim(text), F.lit("[")) & ~F.exists(ids, lambda x: x.isNull())
    return F.when(whole, ids).otherwise(F.array().cast("array<bigint>"))


def hop_list(text: Column) -> Column:
    """An evidence path stored as a JSON array of hops; empty for anything else or a hop with a missing field."""
    hops = F.from_json(text, f"array<{HOP}>")
    torn = F.exists(hops, lambda h: h.isNull() | h["source_concept_id"].isNull() | h["edge_type"].isNull() | h["target_concept_id"].isNull())
    whole = F.startswith(F.ltrim(text), F.lit("[")) & ~torn
    return F.when(whole, hops).otherwise(F.array().cast(f"array<{HOP}>"))


def undirected_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def modularity_gain(weight_into: Column, community_degree: Column, degree: Column, total: Column) -> Column:
    """Gain of moving an isolated node of ``degree`` into a community."""
    return weight_into / total - (community_degree * degree) / (2.0 * total * total)


def edge_key(source: Column, type_slug: Column, target: Column) -> Column:
    """Edge id = its identity key, so writers need no shared counter and replays are idempotent.

    A bar inside a part is escaped, so different parts never make the same key.
    """
    part = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.concat_ws("|", part(source), part(type_slug), part(target))
