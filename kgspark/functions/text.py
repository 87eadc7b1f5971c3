"""Tokens, FNV-1a, type text, citation markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLUSTER_CITATION

# --- fixed values: FNV-1a 32 bit, citation markers ----------------------------------------------
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK_32 = 4294967295
NOTE_MARKER = r"\[bd:(\d+)\]"
EDGE_MARKER = r" ?\[edge:[^\]]*\]"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, _UPPER, _UPPER.lower())


def tokens(text: Column) -> Column:
    """Runs of letters and digits (Unicode), ASCII letters lower-cased, in order."""
    parts = F.split(ascii_lower(text), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.array_remove(parts, "")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes, as bigint."""
    octets = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    hashed = F.aggregate(
        F.split(octets, ""),
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(
            F.lit(MASK_32).cast("bigint")
        ),
    )
    return F.when(F.octet_length(text) > 0, hashed).otherwise(F.lit(FNV_OFFSET).cast("bigint"))


def bucket(token: Column, dim: int) -> Column:
    return F.pmod(fnv1a(token), F.lit(dim)).cast("int")


def buckets(text: Column, dim: int) -> Column:
    """One bucket per token, in token order."""
    return F.transform(tokens(text), lambda t: bucket(t, dim))


def type_text(slug: Column, label: Column, description: Column) -> Column:
    return F.concat_ws(" ", slug, label, description)


def cites_cluster(answer: Column) -> Column:
    return F.contains(ascii_lower(answer), F.lit(CLUSTER_CITATION))


def cited_notes(answer: Column) -> Column:
    """Note ids in the order they are cited, repeats kept."""
    return F.transform(
        F.regexp_extract_all(answer, F.lit(NOTE_MARKER), F.lit(1)), lambda d: d.cast("bigint")
    )


def citation_order(answer: Column) -> Column:
    """Distinct cited ids by first appearance; a citation's number is its 1-based place here."""
    return F.array_distinct(cited_notes(answer))


def strip_edge_markers(answer: Column) -> Column:
    """Drop edge markers from the prose between note markers."""
    return F.array_join(
        F.transform(_prose(answer), lambda part: F.regexp_replace(part, EDGE_MARKER, "")), ""
    )


def _prose(answer: Column) -> Column:
    return F.split(answer, NOTE_MARKER, -1)


def answer_segments(answer: Column) -> Column:
    """Ordered segments: text pieces (never empty) and numbered citations."""
    cites = cited_notes(answer)
    order = citation_order(answer)
    kind = "struct<kind:string,text:string,index:int,braindump_id:bigint>"

    def text_segment(part):
        return F.struct(
            F.lit("text").alias("kind"),
            F.regexp_replace(part, EDGE_MARKER, "").alias("text"),
            F.lit(None).cast("int").alias("index"),
            F.lit(None).cast("bigint").alias("braindump_id"),
        ).cast(kind)

    def cite_segment(note):
        return F.struct(
            F.lit("citation").alias("kind"),
            F.lit(None).cast("string").alias("text"),
            F.array_position(order, note).cast("int").alias("index"),
            note.alias("braindump_id"),
        ).cast(kind)

    # Prose i sits before citation i; zip_with pads the missing last citation with null.
    pairs = F.zip_with(
        _prose(answer),
        cites,
        lambda part, note: F.when(note.isNull(), F.array(text_segment(part))).otherwise(
            F.array(text_segment(part), cite_segment(note))
        ),
    )
    return F.filter(F.flatten(pairs), lambda s: (s["kind"] == "citation") | (F.length(s["text"]) > 0))


def clipboard_text(answer: Column) -> Column:
    """Answer with ``[bd:id]`` as ``[n]`` and without edge markers."""
    return F.array_join(
        F.transform(
            answer_segments(answer),
            lambda s: F.when(s["kind"] == "text", s["text"]).otherwise(
                F.concat(F.lit("["), s["index"].cast("string"), F.lit("]"))
            ),
        ),
        "",
    )
