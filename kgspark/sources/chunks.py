"""Whole notes taken apart inside the tasks that read them, so that neither labels nor edges are shuffled by note.

A task deals its notes into chunks of bounded size. Inside a chunk a label of a tenant is a number, so only the distinct
labels of a chunk (its entries) are shuffled by label, and only numbers travel when the concepts found for them come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, settings
from .extraction import NOTE, read_payloads

# Labels in a chunk; a chunk is one group in one task when its concepts come back.
CHUNK_LABELS = 1 << 20
# Notes on their way to Python at once.
BATCH_NOTES = 1000
# Chunks of a task, and the first task number of notes that arrived in several rows.
TASK_CHUNKS, MERGED_TASKS = 1 << 24, 1 << 30


@dataclass
class Lists:
    """Values of a column of lists one after the other, the row of each and its place in its row."""

    values: pa.Array
    rows: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, lists: pa.Array) -> Lists:
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(lists), dtype=np.int64), lengths)
        return cls(lists.flatten(), rows, np.arange(len(rows), dtype=np.int64) - (np.cumsum(lengths) - lengths)[rows])


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.cast(pa.string()).dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _joint(*keys: np.ndarray) -> np.ndarray:
    """One number for each combination of the keys."""
    out = np.unique(keys[0], return_inverse=True)[1].astype(np.int64)
    for key in keys[1:]:
        distinct, inverse = np.unique(key, return_inverse=True)
        out = np.unique(out * max(1, len(distinct)) + inverse, return_inverse=True)[1].astype(np.int64)
    return out


def _firsts(key: np.ndarray) -> np.ndarray:
    """Places of the first occurrence of each key, in order."""
    return np.sort(np.unique(key, return_index=True)[1])


def _offsets(rows: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)


def _lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


class Apart:
    """The distinct labels and distinct edges of the notes of a batch, each where it stands first."""

    def __init__(self, batch: pa.RecordBatch):
        self.n = batch.num_rows
        labels, sources, targets, types = (Lists.of(batch[c]) for c in ("labels", "sources", "targets", "types"))
        code, self.names = _codes(pa.concat_arrays([x.values.cast(pa.string()) for x in (labels, sources, targets)]))
        label, source, target = np.split(code, [len(labels.rows), len(labels.rows) + len(sources.rows)])
        size = max(1, len(self.names))
        kind, self.types = _codes(types.values)
        # A note that arrived in several rows brings the places of its labels and edges along, in ascending order.
        place = lambda lists, given: np.where(
            np.repeat(~given.is_null().to_numpy(zero_copy_only=False), np.bincount(lists.rows, minlength=self.n)), _given(lists, given), lists.places)
        label_at, edge_at = place(labels, batch["label_at"]), place(sources, batch["edge_at"])

        keys = labels.rows * size + label
        known, first = np.unique(keys, return_index=True)
        order = np.argsort(first)
        kept = first[order]
        standing = np.empty(len(known), np.int64)
        standing[order] = np.arange(len(known))
        self.label_row, self.label, self.label_at = labels.rows[kept], label[kept], label_at[kept]
        self.label_offsets = _offsets(self.label_row, self.n)

        once = _firsts(_joint(sources.rows * size + source, kind * size + target))
        self.edge_row, self.kind, self.edge_at = sources.rows[once], kind[once], edge_at[once]
        self.edge_offsets = _offsets(self.edge_row, self.n)
        self.source, self.target = source[once], target[once]

        def label_of(end: np.ndarray) -> np.ndarray:
            """Number of the end among the labels of its note, -1 if it is none of them."""
            if not len(known):
                return np.full(len(end), -1, np.int64)
            key = self.edge_row * size + end
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            return np.where(known[at] == key, standing[at] - self.label_offsets[self.edge_row], -1)

        self.source_label, self.target_label = label_of(self.source), label_of(self.target)

    def text(self, codes: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(codes))

    def edge_types(self) -> pa.Array:
        return self.types.take(pa.array(self.kind))

    def local_types(self) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Numbers of the types of edges among those of their note, and the types of each note."""
        size = max(1, len(self.types))
        pairs, inverse = np.unique(self.edge_row * size + self.kind, return_inverse=True)
        offsets = _offsets(pairs // size, self.n)
        return inverse - offsets[self.edge_row], self.edge_offsets, self.types.take(pa.array(pairs % size)), offsets


def _given(lists: Lists, given: pa.Array) -> np.ndarray:
    flat = given.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(lists.rows):
        return flat
    out, there = np.zeros(len(lists.rows), np.int64), ~given.is_null().to_numpy(zero_copy_only=False)
    out[there[lists.rows]] = flat
    return out


def _arrays(raw: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Payloads as arrays of trimmed texts; a refused note has none."""
    of = lambda array, field: F.when(F.col("reason").isNull(), F.transform(array, lambda x: F.trim(x[field])))
    return read_payloads(raw, keep).select(
        *NOTE, *keep, "reason", of("concepts", "label").alias("labels"), of("edges", "source").alias("sources"),
        of("edges", "type").alias("types"), of("edges", "target").alias("targets"),
        F.lit(None).cast("array<int>").alias("label_at"), F.lit(None).cast("array<int>").alias("edge_at"),
    )


def _merged(arrays: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Rows of one note as one row: a label or an edge stands at its lowest place in any of them."""
    label = F.transform("labels", lambda x, i: F.struct(i.alias("at"), x.alias("x")))
    edge = F.transform(F.arrays_zip("sources", "types", "targets"), lambda e, i: F.struct(
        i.alias("at"), e["sources"].alias("s"), e["types"].alias("t"), e["targets"].alias("o")))
    flat = lambda c: F.sort_array(F.flatten(F.collect_list(c)))
    rows = arrays.groupBy(*NOTE).agg(flat(label).alias("l"), flat(edge).alias("e"), F.max("reason").alias("reason"), *[F.min(c).alias(c) for c in keep])
    return rows.select(
        *NOTE, *keep, "reason", F.col("l.x").alias("labels"), F.col("e.s").alias("sources"), F.col("e.t").alias("types"),
        F.col("e.o").alias("targets"), F.col("l.at").alias("label_at"), F.col("e.at").alias("edge_at"),
    )


def _apart(raw: DataFrame, keep: tuple[str, ...], name: str, write: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``write(arrays, first task)`` of all notes; the few notes that arrived in several rows are gathered row by row first."""
    spark = raw.sparkSession
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_NOTES)):
        table = cut(write(_arrays(raw, keep), 0), name, "zstd")
        # Whether a note arrived twice is seen in what was written, whose ids are read alone.
        twice = cut(table.where("reason IS NULL").groupBy(*NOTE).agg(F.count(F.when(F.col("is_note"), 1)).alias("n")).where("n > 1").select(*NOTE), "twice")
        if twice.head(1):
            again = _arrays(raw, keep).where("reason IS NULL").join(F.broadcast(twice), NOTE, "left_semi")
            merged = cut(write(_merged(again, keep), MERGED_TASKS), name, "zstd")
            table = table.join(F.broadcast(twice.withColumn("_", F.lit(1))), NOTE, "left_anti").unionByName(merged)
    return table


EDGE = "struct<source:string,type:string,target:string,pos:int,source_known:boolean,target_known:boolean>"


def plain_notes(raw: DataFrame) -> DataFrame:
    """``user_id, braindump_id, reason, labels, edges`` per note: its distinct labels and edges with their first places.

    ``source_known`` and ``target_known`` tell whether an end is among the labels of the note.
    """

    def write(arrays: DataFrame, _: int) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a = Apart(batch)
                labels = pa.StructArray.from_arrays([a.text(a.label), pa.array(a.label_at, pa.int32())], ["label", "pos"])
                edges = pa.StructArray.from_arrays(
                    [a.text(a.source), a.edge_types(), a.text(a.target), pa.array(a.edge_at, pa.int32()),
                     pa.array(a.source_label >= 0), pa.array(a.target_label >= 0)],
                    ["source", "type", "target", "pos", "source_known", "target_known"])
                yield pa.RecordBatch.from_arrays(
                    [batch["user_id"], batch["braindump_id"], batch["reason"], _lists(labels, a.label_offsets), _lists(edges, a.edge_offsets),
                     pa.array(np.ones(a.n, bool))],
                    ["user_id", "braindump_id", "reason", "labels", "edges", "is_note"])

        return arrays.mapInArrow(work, f"user_id string, braindump_id bigint, reason string, labels array<struct<label:string,pos:int>>, edges array<{EDGE}>, is_note boolean")

    return _apart(raw, (), "plain_notes", write).drop("is_note")


@dataclass
class Chunks:
    """``notes`` hold numbers for their labels; ``entries`` (one per tenant and label of a chunk) tell what these stand for.

    An entry carries the first place (``braindump_id``, ``pos``) of its label among the notes of the chunk.
    """

    notes: DataFrame
    entries: DataFrame

    def every(self, entries: DataFrame) -> DataFrame:
        """``entries(chunk, word, at, pos, ..)`` once for every note that holds them, at its place there."""
        held = self.notes.where("reason IS NULL").select("chunk", F.col("braindump_id").alias("at"), F.inline(F.arrays_zip("words", "label_at")))
        held = held.select("chunk", F.col("words").alias("word"), "at", F.col("label_at").cast("bigint").alias("pos"))
        return entries.drop("at", "pos").join(held, ["chunk", "word"])


def chunked_notes(raw: DataFrame, keep: tuple[str, ...] = ()) -> Chunks:
    """Notes with numbers for labels and for the ends of edges, written once with the columns in ``keep``."""
    notes = {"user_id": pa.string(), "braindump_id": pa.int64(), "chunk": pa.int64(), "reason": pa.string()}
    ints = pa.list_(pa.int32())
    found = {"words": ints, "label_at": ints, "source": ints, "target": ints, "type": ints, "types": pa.list_(pa.string()), "edge_at": ints}
    entry = {"word": pa.int32(), "label": pa.string(), "at": pa.int64(), "pos": pa.int32(), "is_note": pa.bool_()}
    kept = {f.name: f.dataType.simpleString() for f in raw.schema if f.name in keep}
    ddl = ", ".join([
        "user_id string, braindump_id bigint, chunk bigint, reason string", *[f"{c} {t}" for c, t in kept.items()],
        "words array<int>, label_at array<int>, source array<int>, target array<int>, type array<int>, types array<string>, edge_at array<int>",
        "word int, label string, at bigint, pos int, is_note boolean"])
    names = [c.strip().split(" ")[0] for c in ddl.split(", ")]
    limit = CHUNK_LABELS

    def write(arrays: DataFrame, first_task: int) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = (first_task + TaskContext.get().partitionId()) * TASK_CHUNKS
            numbers: dict[tuple[str, str], int] = {}
            at, pos, seen = np.empty(0, np.int64), np.empty(0, np.int64), 0

            def batch_of(columns: dict, kinds: dict, rows: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, kinds[c]) for c in names], names)

            def entries(kinds: dict) -> pa.RecordBatch:
                n = len(numbers)
                return batch_of({
                    "user_id": pa.array([u for u, _ in numbers], pa.string()), "label": pa.array([w for _, w in numbers], pa.string()),
                    "chunk": pa.array(np.full(n, chunk)), "word": pa.array(np.arange(n), pa.int32()), "at": pa.array(at[:n]),
                    "pos": pa.array(pos[:n], pa.int32()), "is_note": pa.array(np.zeros(n, bool)),
                }, kinds, n)

            kinds = None
            for batch in batches:
                kinds = {**notes, **found, **entry, **{c: batch.schema.field(c).type for c in kept}}
                a = Apart(batch)
                user, users = _codes(batch["user_id"])
                note = batch["braindump_id"].to_numpy(zero_copy_only=False).astype(np.int64)
                size = max(1, len(a.names))
                pairs, inverse = np.unique(user[a.label_row] * size + a.label, return_inverse=True)
                mine = np.fromiter((
                    numbers.setdefault(pair, len(numbers)) for pair in
                    zip(users.take(pa.array(pairs // size)).to_pylist(), a.names.take(pa.array(pairs % size)).to_pylist())), np.int64, len(pairs))
                # The first place of each label, in this batch and in the chunk.
                order = np.lexsort((a.label_at, note[a.label_row], inverse))
                lead = order[np.unique(inverse[order], return_index=True)[1]]
                grown = max(len(numbers), 2 * len(at)) if len(numbers) > len(at) else len(at)
                far = np.full(grown - len(at), np.iinfo(np.int64).max)
                at, pos = np.concatenate([at, far]), np.concatenate([pos, far])
                here_at, here_pos = note[a.label_row][lead], a.label_at[lead]
                sooner = (here_at < at[mine]) | ((here_at == at[mine]) & (here_pos < pos[mine]))
                at[mine[sooner]], pos[mine[sooner]] = here_at[sooner], here_pos[sooner]
                part = lambda values, offsets: _lists(pa.array(values, pa.int32()), offsets)
                yield batch_of({
                    "user_id": batch["user_id"], "braindump_id": batch["braindump_id"], "reason": batch["reason"], **{c: batch[c] for c in kept},
                    "chunk": pa.array(np.full(a.n, chunk)), "words": part(mine[inverse], a.label_offsets), "label_at": part(a.label_at, a.label_offsets),
                    "source": part(a.source_label, a.edge_offsets), "target": part(a.target_label, a.edge_offsets),
                    "type": part(*a.local_types()[:2]), "types": _lists(*a.local_types()[2:]), "edge_at": part(a.edge_at, a.edge_offsets), "is_note": pa.array(np.ones(a.n, bool)),
                }, kinds, a.n)
                seen += len(a.label)
                if seen >= limit:
                    yield entries(kinds)
                    chunk, numbers, seen = chunk + 1, {}, 0
                    at, pos = np.empty(0, np.int64), np.empty(0, np.int64)
            if numbers:
                yield entries(kinds)

        return arrays.mapInArrow(work, ddl)

    table = _apart(raw, keep, "chunked_notes", write)
    return Chunks(
        table.where("is_note").select(*NOTE, "chunk", "reason", *keep, *found),
        table.where("NOT is_note").select("user_id", "chunk", "word", "label", F.col("at").alias("braindump_id"), "pos"),
    )


PLACED = "struct<source_concept_id:string,type:string,target_concept_id:string,pos:int,first:boolean>"


def place(chunks: Chunks, found: DataFrame) -> DataFrame:
    """``user_id, braindump_id, concepts, edges`` per note: its distinct concepts, and its edges between concepts.

    ``found(chunk, word, at, concept_id)`` names the concept of a number; with ``at`` for that note alone. ``first`` marks the
    first edge of a note between the same concepts.
    """

    def work(notes: pa.Table, found: pa.Table) -> pa.Table:
        notes, found = notes.combine_chunks(), found.combine_chunks()
        column = lambda t, c: t[c].chunk(0) if t[c].num_chunks else pa.array([], t.schema.field(c).type)
        words, sources, targets, types, places, kinds = (Lists.of(column(notes, c)) for c in ("words", "source", "target", "types", "edge_at", "type"))
        word = words.values.to_numpy(zero_copy_only=False).astype(np.int64)
        n = notes.num_rows
        code, names = _codes(column(found, "concept_id"))
        key, alone = column(found, "word").to_numpy(zero_copy_only=False).astype(np.int64), column(found, "at").is_valid().to_numpy(zero_copy_only=False)
        concept_of = np.full(max(word.max(initial=-1), key.max(initial=-1)) + 1, -1, np.int64)
        concept_of[key[~alone]] = code[~alone]
        concept = concept_of[word]
        if alone.any():
            at = column(notes, "braindump_id").to_numpy(zero_copy_only=False).astype(np.int64)[words.rows]
            there = pc.fill_null(column(found, "at"), 0).to_numpy(zero_copy_only=False).astype(np.int64)[alone]
            joint = _joint(np.concatenate([word, key[alone]]), np.concatenate([at, there]))
            given = np.full(joint.max() + 1, -1, np.int64)
            given[joint[len(word):]] = code[alone]
            concept = np.where(given[joint[: len(word)]] >= 0, given[joint[: len(word)]], concept)
        offsets = _offsets(words.rows, n)
        ends = []
        for lists in (sources, targets):
            end = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(offsets[lists.rows] + np.maximum(end, 0), max(0, len(concept) - 1))
            ends.append(np.where(end >= 0, concept[at] if len(concept) else -1, -1))
        type_code, type_names = _codes(types.values)
        kind = type_code[_offsets(types.rows, n)[kinds.rows] + kinds.values.to_numpy(zero_copy_only=False).astype(np.int64)]
        first = np.zeros(len(kind), bool)
        first[_firsts(_joint(sources.rows, ends[0], kind, ends[1]))] = True
        named = lambda codes: names.take(pa.array(codes, mask=codes < 0))
        edges = pa.StructArray.from_arrays(
            [named(ends[0]), type_names.take(pa.array(kind)), named(ends[1]), places.values.cast(pa.int32()), pa.array(first)],
            ["source_concept_id", "type", "target_concept_id", "pos", "first"])
        once = _firsts(_joint(words.rows, concept))
        once = once[concept[once] >= 0]
        return pa.table({
            "user_id": notes["user_id"], "braindump_id": notes["braindump_id"],
            "concepts": _lists(names.take(pa.array(concept[once])), _offsets(words.rows[once], n)),
            "edges": _lists(edges, _offsets(sources.rows, n)),
        })

    notes = chunks.notes.where("reason IS NULL").select("chunk", *NOTE, "words", "source", "target", "type", "types", "edge_at")
    both = notes.groupBy("chunk").cogroup(found.select("chunk", "word", F.col("at").cast("bigint").alias("at"), "concept_id").groupBy("chunk"))
    return cut(both.applyInArrow(work, f"user_id string, braindump_id bigint, concepts array<string>, edges array<{PLACED}>"), "placed_notes", "zstd")
