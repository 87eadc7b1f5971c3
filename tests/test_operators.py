"""Literal cases and properties of the operators."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from yardstick import sequential_communities

from kgspark.checks.stream_queries import stream_versions
from kgspark.functions import text as X
from kgspark.operators import cluster as K
from kgspark.operators import knn, retract
from kgspark.operators.accrete import first_edges
from kgspark.operators.identity import resolve_identity
from kgspark.operators.inference import endorse, path_fault
from kgspark.operators.merge import merge_concepts
from kgspark.operators.skew import ranked
from kgspark.plans.retrieve import retrieve
from kgspark.plans.snapshot import Delta, Snapshot, apply_delta, delta_since_version, net_changes
from kgspark.schema import TABLES, empty
from kgspark.sources.changes import CHANGE, ChangeLog
from kgspark.sources.extraction import parse_extractions
from kgspark.sources.store import GraphStore
from kgspark.streaming import snapshot as streaming_snapshot
from kgspark.streaming.alerts import FRESH, step
from kgspark.streaming.snapshot import HeldSnapshot, start_snapshot


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- identity -------------------------------------------------------------------------------------
def sequential(stream, stored, accrete, floor):
    """One by one: nearest earlier concept at or above ``accrete``, else a new concept."""
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    concepts = {u: [(c, unit(np.array(v, float))) for c, v in rows] for u, rows in stored.items()}
    out = []
    for user, at, pos, vec in stream:
        v = unit(np.array(vec, np.float32).astype(float))
        held = concepts.setdefault(user, [])
        sims = [round(float(c @ v), 10) for _, c in held]
        best = max(range(len(sims)), key=lambda i: (sims[i], -i)) if sims else None
        if best is not None and sims[best] >= accrete:
            out.append((user, at, held[best][0], "accreted"))
            continue
        name = f"k:{at}:{pos}"
        near = best is not None and sims[best] >= floor
        out.append((user, at, name, "suggested" if near else "created"))
        held.append((name, v))
    return sorted(out)


@pytest.mark.parametrize("bound", [4096, 0])
@pytest.mark.parametrize("with_stored", [False, True])
def test_identity_equals_the_sequential_rule(spark, monkeypatch, bound, with_stored):
    monkeypatch.setattr(knn, "BROADCAST_ROWS", bound)
    rng = np.random.default_rng(7 + with_stored)
    base = rng.normal(size=(12, 6)).astype(np.float32)
    stream = []
    for at in range(60):
        kind = rng.integers(0, 10)
        v = base[rng.integers(0, 12)]
        if kind == 0:
            v = np.zeros(6, np.float32)
        elif kind < 5:
            v = (v + rng.normal(scale=0.35, size=6)).astype(np.float32)
        stream.append((["u", "w"][int(rng.integers(0, 2))], at, 0, [float(x) for x in v]))
    stored = {"u": [("old1", base[0].tolist()), ("old2", base[3].tolist())]} if with_stored else {}
    labels = frame(spark, [(u, a, p, f"l{a}", v) for u, a, p, v in stream],
                   "user_id string, braindump_id bigint, pos int, label string, embedding array<float>")
    held = frame(spark, [(u, c, v) for u, rows in stored.items() for c, v in rows],
                 "user_id string, concept_id string, embedding array<float>") if with_stored else None
    got = resolve_identity(labels, held, 0.9, 0.6, cell_rows=7)
    want = sequential(stream, stored, 0.9, 0.6)
    assert pairs(got.occurrences, "user_id", "braindump_id", "concept_id", "outcome") == want
    assert got.leaders.count() == sum(o != "accreted" for *_, o in want)
    assert got.suggestions.count() == sum(o == "suggested" for *_, o in want)


def test_hot_copies_become_one_concept(spark):
    labels = spark.range(3000).select(
        F.lit("u").alias("user_id"), F.col("id").alias("braindump_id"), F.lit(0).alias("pos"), F.lit("same").alias("label"),
        F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    got = resolve_identity(labels).occurrences
    assert pairs(got.groupBy("concept_id", "outcome").count(), "concept_id", "outcome", "count") == [
        ("k:0:0", "accreted", 2999), ("k:0:0", "created", 1)]


# --- nearest neighbours ---------------------------------------------------------------------------
def test_cells_too_far_apart_never_meet(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    vectors = np.repeat(centres, 40, axis=0) + rng.normal(scale=0.12, size=(1200, 16))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    pivots = unit[::20]
    sims = unit @ pivots.T
    cell, radius = sims.argmax(axis=1), {}
    for c, s in zip(cell.tolist(), np.arccos(np.clip(sims.max(axis=1), -1, 1)).tolist()):
        radius[c] = max(radius.get(c, 0.0), s)
    kept = set(knn.near_cells(pivots, radius, radius, 0.9))
    a, b = np.nonzero(unit @ unit.T >= 0.9)
    assert {(cell[i], cell[j]) for i, j in zip(a, b)} <= kept and len(kept) < 0.2 * len(radius) ** 2


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.99])
def test_near_grid_finds_every_pair_above_the_threshold(spark, monkeypatch, threshold):
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(6)
    vectors = np.repeat(rng.normal(size=(9, 6)), 12, axis=0) + rng.normal(scale=0.3, size=(108, 6))
    vectors[5], vectors[40:60] = 0, vectors[40]  # a zero vector, and a heap of copies
    rows = [(["u", "w"][i % 2], i, [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))]
    left = frame(spark, rows, "user_id string, one bigint, embedding array<float>")
    right = left.withColumnRenamed("one", "two")

    def found(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({"one": pa.array([], pa.int64()), "two": pa.array([], pa.int64())})
        at = np.nonzero(np.round(knn._unit_rows(a["embedding"]) @ knn._unit_rows(b["embedding"]).T, 10) >= threshold)
        return pa.table({"one": a["one"].combine_chunks().take(pa.array(at[0])), "two": b["two"].combine_chunks().take(pa.array(at[1]))})

    got = pairs(knn.meet(left, "one", right, "two", found, "one bigint, two bigint", 10, threshold), "one", "two")
    unit = knn._unit_rows(pa.array([v for *_, v in rows]))
    sims = np.round(unit @ unit.T, 10)
    assert got == sorted((i, j) for i in range(108) for j in range(108) if i % 2 == j % 2 and sims[i, j] >= threshold)


def test_blocks_are_compared_in_tiles(monkeypatch):
    monkeypatch.setattr(knn, "TILE_VALUES", 40)
    assert [(t.start, t.stop) for t in knn.row_tiles(10, 9)] == [(0, 4), (4, 8), (8, 10)] and len(list(knn.row_tiles(3, 1000))) == 3
    # At the default cell size a tile and its copies stay far below the two whole matrices of 2 GB.
    assert max(t.stop - t.start for t in knn.row_tiles(knn.CELL_ROWS, knn.CELL_ROWS, 1 << 22)) * knn.CELL_ROWS <= 1 << 22
    rng = np.random.default_rng(7)
    one, two = rng.normal(size=(23, 5)), rng.normal(size=(31, 5))
    tiled = knn.block_best(one, two, np.arange(31), 4, None)
    monkeypatch.setattr(knn, "TILE_VALUES", 10**6)
    assert all((x == y).all() for x, y in zip(tiled, knn.block_best(one, two, np.arange(31), 4, None)))


@pytest.mark.parametrize("strategy", ["broadcast", "grid", "lookup"])
def test_nearest_keeps_tenants_apart_and_breaks_ties_by_id(spark, strategy):
    ddl = "user_id string, {} bigint, embedding array<float>"
    queries = frame(spark, [("u", 1, [1.0, 0.0]), ("w", 2, [0.0, 1.0]), ("u", 3, [0.0, 0.0])], ddl.format("query_id"))
    notes = frame(spark, [("u", i, [1.0, 0.1 * (i // 2)]) for i in range(8)] + [("w", 99, [1.0, 0.0])], ddl.format("note"))
    got = knn.nearest(queries, notes, "note", 3, strategy=strategy, cell_rows=3)
    assert pairs(got, "query_id", "rank", "note") == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 99), (3, 1, 0), (3, 2, 1), (3, 3, 2)]


def test_each_label_is_embedded_once(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def embed(label):
        asked.add(1)
        return [float(ord(label) - 96), 1.0, 0.0] if label != "z" else [0.0, 0.0, 0.0]

    labels = frame(spark, [("u", n, i, w) for n in range(30) for i, w in enumerate("abcdz")], "user_id string, braindump_id bigint, pos int, label string")
    got = resolve_identity(labels, None, 0.999, 0.9, embed=embed)
    columns = ("user_id", "braindump_id", "pos", "label", "concept_id", "outcome")
    rows = pairs(got.occurrences, *columns)
    assert asked.value == 5 and len(rows) == 150
    given = resolve_identity(labels.withColumn("embedding", embed("label")), None, 0.999, 0.9)
    assert rows == pairs(given.occurrences, *columns)
    assert pairs(got.leaders, "concept_id", "label", "embedding") == pairs(given.leaders, "concept_id", "label", "embedding")


def test_copies_of_a_vector_enter_the_grid_once(spark):
    rng = np.random.default_rng(3)
    kinds = rng.normal(size=(6, 4)).astype(np.float32).tolist()
    notes = frame(spark, [("u", i, kinds[i % 6]) for i in range(900)], "user_id string, note bigint, embedding array<float>")
    queries = frame(spark, [("u", i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)], "user_id string, query_id bigint, embedding array<float>")
    held = knn.distinct_vectors(notes, "note", 3)
    assert pairs(held, "ids") == [([i, i + 6, i + 12],) for i in range(6)]
    # A side is copied to few cells, however many rows it meets.
    _, sizes = knn.with_cells(notes, "note", "cell", 3)
    assert pairs(sizes, "user_id", "cell_count") == [("u", knn.CELLS)]
    got = knn.nearest(queries, notes, "note", 200, strategy="grid", cell_rows=3)
    assert pairs(got, "query_id", "rank", "note", "similarity") == pairs(
        knn.nearest(queries, notes, "note", 200, strategy="broadcast"), "query_id", "rank", "note", "similarity")


def test_blocks_are_filtered_in_single_precision_without_loss():
    rng = np.random.default_rng(5)
    one, two = knn._unit_rows(pa.array(rng.normal(size=(40, 6)).tolist())), knn._unit_rows(pa.array((rng.normal(size=(5000, 6)).round(1)).tolist()))
    sims, order = np.round(one @ two.T, 10), rng.permutation(5000)
    for floor in (None, 0.9):
        want = [(i, j) for i in range(40) for j in np.lexsort((order, -sims[i]))[:7] if floor is None or sims[i, j] >= floor]
        rows, columns, values = knn.block_best(one, two, order, 7, floor)
        assert list(zip(rows.tolist(), columns.tolist())) == want and np.allclose(values, [sims[p] for p in want], atol=1e-9)


def test_ranked_equals_a_window(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise("cold").alias("k"), (F.col("id") * 37 % 500).alias("v"))
    got = pairs(ranked(rows, ["k"], [F.desc("v")], parts=6), "k", "v", "rank")
    want = []
    for k in ("cold", "hot"):
        vs = sorted((r["v"] for r in rows.where(F.col("k") == k).collect()), reverse=True)
        want += [(k, v, i + 1) for i, v in enumerate(vs)]
    assert got == sorted(want)


# --- retrieval ------------------------------------------------------------------------------------
def test_note_is_found_through_the_graph(spark):
    t = lambda rows, name: frame(spark, rows, TABLES[name])
    got = retrieve(
        frame(spark, [(1, "u", [1.0, 0.0])], "query_id bigint, user_id string, embedding array<float>"),
        t([("u", "maria", "Maria", 1), ("u", "q3", "Q3 launch", 1)], "concepts"),
        t([("u", "e", "maria", "q3", "endangers", 1)], "edges"),
        t([("u", "e", 0, "endangers", 1)], "edge_type_history"),
        t([("u", "maria", 7)], "concept_provenance"),
        frame(spark, [("u", 7), ("u", 8), ("w", 9)], "user_id string, braindump_id bigint"),
        t([("u", "q3", [1.0, 0.0]), ("u", "maria", [0.0, 1.0])], "concept_embeddings"),
        t([("u", 7, [0.0, 1.0]), ("u", 8, [0.9, 0.1]), ("w", 9, [1.0, 0.0])], "braindump_embeddings"),
    )
    assert pairs(got.notes, "braindump_id", "source") == [(7, "subgraph"), (8, "backfill")]
    assert pairs(got.paths, "source_label", "edge_type", "target_label") == [("Maria", "endangers", "Q3 launch")]
    assert got.notes.where("braindump_id = 7").head()["score"] == 0.5


# --- retraction, merges, endorsement --------------------------------------------------------------
def graph(spark, concepts, edges, cp, ep, inferred=(), suggestions=()):
    t = lambda rows, name: frame(spark, rows, TABLES[name]) if rows else empty(spark, name)
    return {
        "concepts": t([("u", c, c, 1) for c in concepts], "concepts"),
        "edges": t([("u", f"{s}|{k}|{o}", s, o, k, 1) for s, k, o in edges], "edges"),
        "edge_type_history": t([("u", f"{s}|{k}|{o}", 0, k, 1) for s, k, o in edges], "edge_type_history"),
        "concept_provenance": t([("u", c, n) for c, n in cp], "concept_provenance"),
        "edge_provenance": t([("u", e, n) for e, n in ep], "edge_provenance"),
        "edge_inference_provenance": t([("u", e, i, "structural_inference", None, 1) for e, i in inferred], "edge_inference_provenance"),
        "merge_suggestions": t([("u", s, 1, f, f, k, 0.9, "pending", 1) for s, f, k in suggestions], "merge_suggestions"),
        "graph_tombstones": empty(spark, "graph_tombstones"),
    }


def test_edge_goes_with_its_endpoint_and_inference_keeps_an_edge(spark):
    tables = graph(
        spark, ["a", "b", "c"], [("a", "helps", "b"), ("b", "helps", "c")],
        [("a", 1), ("b", 2), ("c", 2)], [("a|helps|b", 2), ("b|helps|c", 1)], inferred=[("b|helps|c", 5)])
    out = retract.retract(tables, frame(spark, [("u", 1)], "user_id string, braindump_id bigint"), 9)
    assert pairs(out["concepts"], "concept_id") == [("b",), ("c",)]
    assert pairs(out["edges"], "edge_id") == [("b|helps|c",)]
    assert pairs(out["graph_tombstones"], "kind", "entity_id") == [("concept", "a")]


def test_orphan_edges_are_taken_out_of_the_cascade_once(spark):
    edge = "user_id string, edge_id string, source_concept_id string, target_concept_id string, original_type string, created_at bigint"
    tables = {
        "concepts": frame(spark, [("u", c, c, 0) for c in "abc"], "user_id string, concept_id string, label string, created_at bigint"),
        "edges": frame(spark, [("u", "e", "a", "b", "t", 0), ("u", "f", "b", "c", "t", 0), ("u", "g", "b", "b", "t", 0), ("u", "h", "c", "a", "t", 0)], edge),
        "concept_provenance": frame(spark, [("u", "a", 1), ("u", "b", 2), ("u", "c", 2)], "user_id string, concept_id string, braindump_id bigint"),
        "edge_provenance": frame(spark, [("u", "e", 1), ("u", "f", 2), ("u", "g", 2), ("u", "h", 2)], "user_id string, edge_id string, braindump_id bigint"),
        "edge_inference_provenance": empty(spark, "edge_inference_provenance"),
    }
    gone = retract.find_gone(tables, frame(spark, [("u", 1)], "user_id string, braindump_id bigint"))
    assert [pairs(gone.edges, "edge_id"), pairs(gone.concepts, "concept_id"), pairs(gone.cascaded, "edge_id")] == [[("e",)], [("a",)], [("h",)]]
    plan = gone.cascaded._jdf.queryExecution().optimizedPlan().toString()
    # Orphan edges once (3 anti-joins), lost concepts for each end (2 each).
    assert plan.count("LeftAnti") <= 7


def test_merge_collapses_and_unites_provenance(spark):
    tables = graph(
        spark, ["maria", "beta", "q3"], [("maria", "helps", "q3"), ("beta", "helps", "q3"), ("beta", "helps", "maria")],
        [("maria", 1), ("beta", 2), ("q3", 1)], [("maria|helps|q3", 1), ("beta|helps|q3", 2), ("beta|helps|maria", 2)],
        suggestions=[("s1", "beta", "maria"), ("s2", "q3", "beta")])
    asked = frame(spark, [("u", 1, "s1"), ("u", 2, "s2"), ("u", 3, "s9")], "user_id string, ord bigint, suggestion_id string")
    out, outcome = merge_concepts(tables, asked)
    assert pairs(outcome, "suggestion_id", "outcome") == [("s1", "approved"), ("s2", "not_found"), ("s9", "not_found")]
    assert pairs(out["edges"], "source_concept_id", "target_concept_id") == [("maria", "maria"), ("maria", "q3")]
    assert pairs(out["edge_provenance"], "edge_id", "braindump_id") == [
        ("beta|helps|maria", 2), ("maria|helps|q3", 1), ("maria|helps|q3", 2)]
    assert pairs(out["concept_provenance"], "concept_id", "braindump_id") == [("maria", 1), ("maria", 2), ("q3", 1)]
    assert out["merge_suggestions"].count() == 0


def test_endorsing_twice_adds_one_edge(spark):
    tables = graph(spark, ["a", "b"], [], [("a", 1), ("b", 1)], [])
    rows = [("u", i, "structural_inference", "a", "b", "helps", [], None, None, "pending", 1, None) for i in (1, 2)]
    tables["chat_inference_proposals"] = frame(spark, rows, TABLES["chat_inference_proposals"])
    asked = frame(spark, [("u", 1, 1), ("u", 2, 2), ("u", 1, 3)], "user_id string, proposal_id bigint, ord bigint")
    out, outcome = endorse(tables, asked, 5)
    assert pairs(out["edges"], "edge_id") == [("a|helps|b",)]
    assert pairs(out["edge_inference_provenance"], "chat_inference_id") == [(1,), (2,)]
    assert pairs(outcome, "ord", "outcome") == [(1, "endorsed"), (2, "endorsed"), (3, "conflict")]


def test_path_faults(spark):
    ddl = "source string, target string, path array<struct<source_concept_id:string,edge_type:string,target_concept_id:string>>"
    rows = [("a", "c", [("a", "x", "b"), ("b", "x", "c")]), ("a", "c", [("a", "x", "b"), ("d", "x", "c")]), ("a", "c", []),
            ("b", "c", [("a", "x", "c")])]
    got = frame(spark, rows, ddl).select(path_fault(F.col("path"), F.col("source"), F.col("target")).alias("f")).collect()
    assert [r["f"] for r in got] == [None, "not_connected", "empty_path", "wrong_start"]


def test_edges_meet_only_the_ends_that_are_no_concepts(spark, tmp_path):
    """Edges are not joined with all concepts: those are read before, to find the few lost ends."""
    from kgspark.operators.provenance import with_both_ends

    frame(spark, [("u", n, n, 1) for n in "abc"] + [("w", "d", "d", 1)], TABLES["concepts"]).write.parquet(f"{tmp_path}/concepts")
    rows = [("u", "1", "a", "b"), ("u", "2", "a", "d"), ("u", "3", "d", "a"), ("u", "4", "c", "c"), ("u", "5", None, "a"), ("w", "6", "d", "d"), ("x", "7", "a", "b")]
    edges = frame(spark, [(*r, "t", 1) for r in rows], TABLES["edges"])
    got = with_both_ends(edges, spark.read.schema(TABLES["concepts"]).parquet(f"{tmp_path}/concepts"))
    assert sorted(r["edge_id"] for r in got.collect()) == ["1", "4", "6"] and got.columns[0] == "user_id"
    assert not [f for f in got.inputFiles() if str(tmp_path) in f]


def test_types_are_looked_up_for_touched_edges_alone(spark):
    from kgspark.plans.retrieve import paths_of

    concepts = frame(spark, [("u", n, n.upper(), 1) for n in "abcd"], TABLES["concepts"])
    edges = frame(spark, [("u", "1", "a", "b", "t", 1), ("u", "2", "b", "c", "t", 1), ("u", "3", "c", "d", "t", 1)], TABLES["edges"])
    history = frame(spark, [("u", "1", 0, "t", 1), ("u", "1", 1, "x", 2), ("u", "3", 0, "t", 1)], TABLES["edge_type_history"])
    hops = frame(spark, [(q, "u", n, 0) for q, names in ((1, "abc"), (2, "bcd")) for n in names], "query_id bigint, user_id string, concept_id string, hops int")
    got = paths_of(hops.where("query_id = 1"), edges, history, concepts)
    assert sorted((r["edge_id"], r["target_label"], r["edge_type"]) for r in got.collect()) == [("1", "B", "x"), ("2", "C", "")]
    assert any("touched" in f for f in got.inputFiles())
    both = paths_of(hops, edges, history, concepts).collect()
    assert sorted((r["query_id"], r["edge_id"]) for r in both) == [(1, "1"), (1, "2"), (2, "2"), (2, "3")]


# --- clusters -------------------------------------------------------------------------------------
def communities(spark, nodes, edges):
    concepts = frame(spark, [("u", n, n, 1) for n in nodes], TABLES["concepts"])
    rows = [("u", f"{i}", s, o, "t", 1) for i, (s, o) in enumerate(edges)]
    links = frame(spark, rows, TABLES["edges"]) if rows else empty(spark, "edges")
    got = K.louvain(links, concepts).groupBy("community").agg(F.sort_array(F.collect_list("concept_id")).alias("m"))
    return sorted(r["m"] for r in got.collect())


def test_louvain_properties(spark):
    cliques = [("0", "1"), ("1", "2"), ("0", "2"), ("3", "4"), ("4", "5"), ("3", "5"), ("2", "3")]
    assert communities(spark, "0123459", cliques) == [["0", "1", "2"], ["3", "4", "5"], ["9"]]
    assert communities(spark, "ab", [("a", "b")]) == [["a", "b"]]
    assert communities(spark, "ab", []) == [["a"], ["b"]]


def test_louvain_beats_single_nodes(spark):
    from kgspark.checks.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    weights = K.undirected_weights(v.b_edges, v.b_concepts)
    found = K.louvain(v.b_edges, v.b_concepts)
    assert found.count() == v.b_concepts.count() == found.select("user_id", "concept_id").distinct().count()
    single = v.b_concepts.select("user_id", F.col("concept_id").alias("node"), F.col("concept_id").alias("community"))
    q = {r["user_id"]: r["modularity"] for r in K.modularity(weights, found.withColumnRenamed("concept_id", "node")).collect()}
    base = {r["user_id"]: r["modularity"] for r in K.modularity(weights, single).collect()}
    assert all(q[u] > base[u] for u in base)


def test_louvain_of_a_tenant_does_not_depend_on_its_neighbours(spark):
    rng = random.Random(8)
    rows, nodes = [], []
    for user, size in (("u", 30), ("v", 40), ("w", 5)):
        nodes += [(user, f"{user}{i}", f"{user}{i}", 1) for i in range(size)]
        rows += [(user, f"{user}|{i}", f"{user}{rng.randrange(size)}", f"{user}{rng.randrange(size)}", "t", 1) for i in range(2 * size)]

    def solve(users):
        concepts = frame(spark, [n for n in nodes if n[0] in users], TABLES["concepts"])
        found = K.louvain(frame(spark, [r for r in rows if r[0] in users], TABLES["edges"]), concepts, max_passes=4)
        return {u: sorted((r["concept_id"], r["community"]) for r in found.where(F.col("user_id") == u).collect()) for u in users}

    together = solve("uvw")
    assert solve("u")["u"] == together["u"] and [len(together[u]) for u in "uvw"] == [30, 40, 5]


def quality(ends, home):
    total = sum(w for *_, w in ends)
    degree, sums = {}, {}
    for a, b, w in ends:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
    for n, d in degree.items():
        sums[home[n]] = sums.get(home[n], 0) + d
    return sum(w for a, b, w in ends if home[a] == home[b]) / total - sum(d * d for d in sums.values()) / (4 * total * total)


def test_the_yardstick_is_near_the_best_on_small_graphs():
    rng = random.Random(2)
    for _ in range(40):
        pairs = {tuple(sorted(rng.sample("abcdefgh", 2))) for _ in range(rng.randint(2, 14))}
        ends = [(a, b, float(rng.randint(1, 3))) for a, b in sorted(pairs)]
        home = sequential_communities(ends, 64, 100)
        assert all(home[c] == c for c in set(home.values()))
        q = quality(ends, home)
        # No node gains by moving to a neighbouring community after the first level, nor by standing alone at the start.
        assert q >= quality(ends, {n: n for n in home}) - 1e-12
        brute = max(quality(ends, dict(zip(home, cut, strict=True))) for cut in itertools.islice(itertools.product(range(3), repeat=len(home)), 7000))
        assert q >= 0.6 * brute - 1e-9


def planted(rng, groups, size, inner, outer):
    """Pairs of a graph of equal groups: each node has about so many links inside its group and outside it."""
    nodes = groups * size
    pairs = set()
    for n in range(nodes):
        g = n // size
        pairs |= {tuple(sorted((n, g * size + rng.randrange(size)))) for _ in range(inner)}
        pairs |= {tuple(sorted((n, rng.randrange(nodes)))) for _ in range(outer)}
    return sorted((a, b) for a, b in pairs if a != b)


def test_louvain_is_as_good_as_node_by_node_and_connected(spark):
    rng = random.Random(12)
    graphs = {
        "clear": planted(rng, 12, 25, 6, 1), "blurred": planted(rng, 20, 40, 5, 3), "random": planted(rng, 1, 300, 0, 5),
        "ring": [(n, (n + 1) % 200) for n in range(200)], "star": [(0, n) for n in range(1, 120)],
    }
    named = {user: [(f"{a:04d}", f"{b:04d}") if a < b else (f"{b:04d}", f"{a:04d}") for a, b in pairs] for user, pairs in graphs.items()}
    nodes = {user: sorted({n for pair in pairs for n in pair}) for user, pairs in named.items()}
    concepts = frame(spark, [(u, n, n, 1) for u in named for n in nodes[u]], TABLES["concepts"])
    edges = frame(spark, [(u, f"{u}|{i}", a, b, "t", 1) for u in named for i, (a, b) in enumerate(named[u])], TABLES["edges"])
    found = {}
    for r in K.louvain(edges, concepts).collect():
        found.setdefault(r["user_id"], {})[r["concept_id"]] = r["community"]
    for user, pairs in named.items():
        home = found[user]
        assert sorted(home) == nodes[user]
        assert all(c == min(n for n in home if home[n] == c) for c in set(home.values()))
        ends = [(a, b, 1.0) for a, b in pairs]
        # A graph without groups has many cuts of nearly the same worth.
        assert quality(ends, home) >= (0.94 if user == "random" else 0.98) * quality(ends, sequential_communities(ends, 64, 100)), user
        # Each community holds together by its own links.
        root = {n: n for n in home}

        def lead(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in pairs:
            if home[a] == home[b]:
                root[lead(a)] = lead(b)
        assert len({lead(n) for n in home}) == len(set(home.values()))


def test_louvain_scores_only_what_changed(spark):
    """Passes behind the first read the neighbourhoods of moved nodes alone."""
    weights = frame(spark, [("u", f"{n:03d}", f"{n + 1:03d}", 1.0) for n in range(50)], "user_id string, a string, b string, weight double")
    both = weights.select("user_id", F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "weight"),
                                                      F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))))
    state = K.degrees(weights).join(K.total_weights(weights), "user_id").select("user_id", "node", F.col("node").alias("community"), "degree", "total", F.lit(0).alias("pass"))
    active = frame(spark, [("u", "010"), ("u", "030")], "user_id string, node string")
    assert [r["node"] for r in K._wanted(both, state, active).orderBy("node").collect()] == ["010", "030"]
    assert K._wanted(both, state, None).count() > 40


def test_a_disconnected_community_is_split(spark):
    weights = frame(spark, [("u", f"{n:02d}", f"{n + 1:02d}", 1.0) for n in range(40) if n != 20], "user_id string, a string, b string, weight double")
    all_ = frame(spark, [("u", f"{n:02d}", "00") for n in range(42)], "user_id string, node string, community string")
    got = {r["node"]: r["community"] for r in K.connected(weights, all_).collect()}
    assert got == {f"{n:02d}": "00" if n <= 20 else "21" if n <= 40 else "41" for n in range(42)}


# --- change feed ----------------------------------------------------------------------------------
def changes(spark, rows):
    """Rows of (change, id, version[, current_type[, created_at]])."""
    full = [("u", c, i, i.upper(), "s", "t", "x", (more or ("x",))[0], (more or ("x", 5))[1] if len(more) > 1 else 5, v) for c, i, v, *more in rows]
    return frame(spark, full, CHANGE)


def named(delta):
    return sorted((r["change"], r["id"], r["payload"]) for r in delta.rows().collect())


def test_a_log_read_from_version_to_version_loses_and_repeats_nothing(spark, tmp_path):
    log = ChangeLog(spark, f"{tmp_path}/log")
    assert log.head() == 0 and named(delta_since_version(log, 0)) == []
    log.append(changes(spark, [("add_concept", "a", 0), ("add_edge", "e", 0)]))
    first = delta_since_version(log, 0)
    # Another commit in the second of the cursor: a cursor of seconds would pass it by.
    log.append(changes(spark, [("add_concept", "b", 0)]))
    second = delta_since_version(log, first.cursor)
    assert (named(first), first.cursor) == ([("add_concept", "a", "A"), ("add_edge", "e", "x")], 1)
    assert (named(second), second.cursor) == ([("add_concept", "b", "B")], 2)
    assert named(delta_since_version(log, 0, epoch=5)) == [] and len(named(delta_since_version(log, 0, epoch=4))) == 3
    # A batch that is committed again changes nothing.
    assert log.append(changes(spark, [("add_concept", "z", 0)]), version=2) == 2 and log.versions() == [1, 2]
    # Only folders behind the cursor are read.
    assert {f.split("version=")[1].split("/")[0] for f in log.rows(since=1).inputFiles()} == {"2"}
    assert delta_since_version(log, 2).cursor == 2 and named(delta_since_version(log, 2)) == []


def test_the_last_word_about_an_entity_counts(spark):
    rows = [("add_edge", "e", 1), ("retag_edge", "e", 2, "y"), ("add_edge", "f", 1), ("delete_edge", "f", 2), ("delete_concept", "c", 1), ("add_concept", "c", 2),
            ("retag_edge", "g", 1, "y", 9), ("retag_edge", "g", 2, "z", 3), ("retag_edge", "h", 1, "y"), ("delete_edge", "h", 1), ("add_concept", "e", 1)]
    assert named(net_changes(changes(spark, rows), 2)) == [
        ("add_concept", "c", "C"), ("add_concept", "e", "E"), ("add_edge", "e", "y"), ("delete_edge", "f", ""), ("delete_edge", "h", ""), ("retag_edge", "g", "z")]


def test_changes_are_folded_once_for_all_lists(spark):
    delta = net_changes(changes(spark, [("add_edge", "e", 1), ("delete_concept", "c", 1)]), 1)
    lists = (delta.added_concepts, delta.added_edges, delta.deleted_concepts, delta.deleted_edges, delta.retagged)
    files = [f for found in lists for f in found.inputFiles()]
    assert files and all("net_changes" in f for f in files)


def test_a_held_snapshot_survives_a_lost_driver(spark, tmp_path, monkeypatch):
    concept, edge = "user_id string, concept_id string, label string, created_at bigint", "user_id string, edge_id string, source_concept_id string, target_concept_id string, original_type string, current_type string, created_at bigint"
    start = Snapshot(frame(spark, [("u", "a", "A", 1)], concept), frame(spark, [], edge), frame(spark, [], "user_id string, concept_id string, partition_id int"))
    drops = [[("add_concept", "b", 1)], [("delete_concept", "a", 2), ("add_concept", "c", 2)], [("add_concept", "a", 3), ("delete_concept", "b", 3)]]
    for drop in drops:
        changes(spark, drop).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")

    def run(check):
        held = HeldSnapshot(spark, start, root=f"{tmp_path}/held")
        stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/changes")
        query = start_snapshot(stream, held, check)
        query.awaitTermination()
        return held

    kept, calls = streaming_snapshot.write_pointer, []

    def dies(spark_, path, state):
        calls.append(state)
        if len(calls) == 2:  # the second batch is written, its pointer is not
            raise RuntimeError("lost")
        kept(spark_, path, state)

    monkeypatch.setattr(streaming_snapshot, "write_pointer", dies)
    with pytest.raises(Exception, match="lost"):
        run(f"{tmp_path}/checkpoint")
    monkeypatch.setattr(streaming_snapshot, "write_pointer", kept)
    assert pairs(HeldSnapshot(spark, start, root=f"{tmp_path}/held").current.concepts, "concept_id") == [("a",), ("b",)]
    held = run(f"{tmp_path}/checkpoint")
    want = apply_delta(start, net_changes(spark.read.schema(CHANGE).parquet(f"{tmp_path}/changes"), 3))
    assert pairs(held.current.concepts, "concept_id", "label") == pairs(want.concepts, "concept_id", "label") and held.cursor == 3
    # Without its checkpoint the stream brings every change again; the cursor passes them over.
    assert pairs(run(f"{tmp_path}/other").current.concepts, "concept_id") == [("a",), ("c",)] and len(held.paths) == 2


def test_a_version_in_many_files_is_one_batch(spark, tmp_path):
    concept, edge = "user_id string, concept_id string, label string, created_at bigint", "user_id string, edge_id string, source_concept_id string, target_concept_id string, original_type string, current_type string, created_at bigint"
    start = Snapshot(frame(spark, [], concept), frame(spark, [], edge), frame(spark, [], "user_id string, concept_id string, partition_id int"))
    rows = changes(spark, [("add_concept", f"c{i}", 1) for i in range(40)] + [("delete_concept", f"c{i}", 2) for i in range(0, 40, 2)])
    stream_versions(rows.repartition(4), (1, 2), start, f"{tmp_path}/changes")
    held = HeldSnapshot(spark, start, root=f"{tmp_path}/changes-held")
    assert pairs(held.current.concepts, "concept_id") == sorted((f"c{i}",) for i in range(1, 40, 2)) and held.cursor == 2
    assert len(spark.read.parquet(f"{tmp_path}/changes").inputFiles()) == 8


def test_applying_a_delta_twice_changes_nothing_more(spark):
    edge = "user_id string, edge_id string, source_concept_id string, target_concept_id string, original_type string, current_type string, created_at bigint"
    concept = "user_id string, concept_id string, label string, created_at bigint"
    held = Snapshot(
        frame(spark, [("u", "a", "A", 1), ("u", "b", "B", 1), ("u", "c", "C", 1)], concept),
        frame(spark, [("u", "e1", "a", "b", "t", "t", 1), ("u", "e2", "b", "c", "t", "t", 1)], edge),
        frame(spark, [("u", "a", 0), ("u", "c", 0)], "user_id string, concept_id string, partition_id int"))
    delta = Delta(
        frame(spark, [("u", "d", "D", 2), ("u", "a", "other", 2)], concept),
        frame(spark, [("u", "e3", "a", "d", "t", "t", 2)], edge),
        frame(spark, [("u", "c")], "user_id string, concept_id string"), frame(spark, [("u", "zz")], "user_id string, edge_id string"),
        frame(spark, [("u", "e1", "new")], "user_id string, edge_id string, current_type string"), 2)
    once = apply_delta(held, delta)
    twice = apply_delta(once, delta)
    for s in (once, twice):
        assert pairs(s.concepts, "concept_id", "label") == [("a", "A"), ("b", "B"), ("d", "D")]
        assert pairs(s.edges, "edge_id", "current_type") == [("e1", "new"), ("e3", "t")]
        assert pairs(s.partitions, "concept_id") == [("a",)]


# --- store, extraction, text, alerts --------------------------------------------------------------
def test_store_moves_its_pointer_last(spark, tmp_path):
    store = GraphStore(spark, f"file:{tmp_path}/g")
    rows = lambda n: frame(spark, [("u", f"c{i}", "x", 1) for i in range(n)], TABLES["concepts"])
    store.commit({"concepts": rows(2)}, 0)
    broken = rows(3).withColumn("label", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception):
        store.commit({"concepts": broken}, 1)
    assert store.read("concepts").count() == 2 and store.state()["batch"] == 0
    store.commit({"concepts": rows(3)}, 1)
    assert store.read("concepts").count() == 3 and store.state()["version"] == 2
    assert store.point_read("concepts", "u", "concept_id", "c1").count() == 1


def test_extraction_rejects(spark):
    payloads = ['{"concepts":[{"label":" A "}]}', '{"edges":[{"source":"a","type":"","target":"b"}]}', "nonsense", "{}",
                '{"concepts":[{"name":"x"}]}']
    raw = frame(spark, [("u", i, p) for i, p in enumerate(payloads)], "user_id string, braindump_id bigint, payload string")
    got = parse_extractions(raw)
    assert pairs(got.concepts, "braindump_id", "label") == [(0, "A")]
    assert pairs(got.rejects, "braindump_id", "reason") == [(1, "edge_field"), (2, "not_json"), (4, "concept_label")]


def test_notes_are_parsed_once_and_stay_together(spark):
    raw = spark.createDataFrame([("u", n % 7, '{"concepts":[{"label":"a"}],"edges":[{"source":"a","type":"t","target":"b"},{"source":" a","type":"t","target":"b"}]}')
                                 for n in range(20)], "user_id string, braindump_id bigint, payload string")
    found = first_edges(parse_extractions(raw).edges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1
    # One shuffle, of whole notes, below the step that takes them apart.
    assert plan.count("Exchange") == 1 and plan.index("posexplode") < plan.index("Exchange")
    assert sorted(map(tuple, found.collect())) == [("u", n, "a", "t", "b", 0) for n in range(7)]


def test_citations(spark):
    said = "See [bd:5] and [edge:a -b→ c] also [bd:9][bd:5]."
    df = frame(spark, [(said,)], "a string")
    row = df.select(X.clipboard_text(F.col("a")).alias("c"), X.answer_segments(F.col("a")).alias("s"), X.strip_edge_markers(F.col("a")).alias("p")).head()
    assert row["c"] == "See [1] and also [2][1]."
    assert [(s["kind"], s["index"], s["braindump_id"]) for s in row["s"] if s["kind"] == "citation"] == [
        ("citation", 1, 5), ("citation", 2, 9), ("citation", 1, 5)]
    assert row["p"] == "See  and also ."


def test_alert_cases():
    cases = [((True, 0, 20), []), ((False, 0, 20), ["down"]), ((False, 0, 20), []), ((True, 5, 20), []), ((True, 9, 20), ["growth"]),
             ((True, 0, 95), ["level"]), ((True, 0, 95), [])]
    state = FRESH
    for t, ((up, count, pct), want) in enumerate(cases):
        state, got = step(state, 1_000_000 + t, up, count, pct, 3600, 85)
        assert [kind for kind, *_ in got] == want


def test_keys_and_requests_are_unambiguous(spark):
    from kgspark.functions.scalars import edge_key, month_year
    from kgspark.operators.queues import decide

    parts = [("a|b", "c", "d"), ("a", "b|c", "d"), ("a\\", "b", "c|d"), ("a\\|b", "c", "d"), ("a", "b", "c")]
    keys = [r[0] for r in frame(spark, parts, "s string, t string, o string").select(edge_key(F.col("s"), F.col("t"), F.col("o"))).collect()]
    assert len(set(keys)) == len(parts) and keys[-1] == "a|b|c"
    queue = frame(spark, [("u", 1, "pending"), ("u", 2, "pending")], "user_id string, item bigint, status string")
    asked = frame(spark, [("u", 1, 5, "reject"), ("u", 1, 5, "approve"), ("u", 2, 1, "approve"), ("u", 2, 1, "approve")], "user_id string, item bigint, ord bigint, action string")
    assert pairs(decide(asked, queue, "item"), "item", "action", "outcome") == [(1, "approve", "approve"), (1, "reject", "conflict"), (2, "approve", "approve"), (2, "approve", "conflict")]
    shown = frame(spark, [(0,), (253_402_300_800,), (8_640_000_000_000,), (8_640_000_000_001,), (None,)], "e bigint").select(month_year(F.col("e"))).collect()
    assert [r[0] for r in shown] == ["January 1970", "January 10000", "September 275760", "", ""]


def test_retry_timer_runs_out(spark, tmp_path):
    import time

    from kgspark.streaming.retry import retry_states

    ddl = "user_id string, braindump_id bigint, attempt int, outcome string, attempted_at bigint"
    frame(spark, [("u", 1, 1, "transient", 10), ("u", 2, 1, "complete", 10)], ddl).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []

    def keep(batch, _):
        seen.extend(tuple(r) for r in batch.select("braindump_id", "ingest_status", "retry_due").collect())

    states = retry_states(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"), interval=1)
    q = states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while (1, "pending", True) not in seen and time.time() < end and q.exception() is None:
            time.sleep(0.5)
    finally:
        q.stop()
    assert (1, "pending", False) in seen and (2, "complete", False) in seen
    assert (1, "pending", True) in seen and (2, "complete", True) not in seen


def test_a_streamed_note_is_stored_and_can_be_edited(spark, tmp_path):
    from kgspark.plans.ingest import batch_ingest, edit_notes

    tables = {n: empty(spark, n) for n in TABLES}
    tables["ontology"] = frame(spark, [("u", 1, "helps", "Helps", "", 1)], TABLES["ontology"])
    ddl = "user_id string, braindump_id bigint, verbatim string, payload string"
    rows = [("u", 1, "one", '{"concepts":[{"label":"A"},{"label":"B"}],"edges":[{"source":"A","type":"helps","target":"B"}]}'), ("u", 2, "two", "broken")]
    after, _, _ = batch_ingest(tables, frame(spark, rows, ddl), 7)
    assert pairs(after["braindumps"], "braindump_id", "verbatim", "ingest_status", "ingest_attempts", "created_at") == [(1, "one", "complete", 1, 7), (2, "two", "failed", 1, 7)]
    assert pairs(after["ingest_rejects"], "braindump_id", "reason", "rejected_at") == [(2, "not_json", 7)]
    edit = frame(spark, [("u", 2, "new", "new", '{"concepts":[{"label":"A"}],"edges":[]}')], "user_id string, braindump_id bigint, verbatim string, cleaned string, payload string")
    again, _, _ = edit_notes(after, edit, 9)
    assert pairs(again["braindumps"], "braindump_id", "verbatim", "ingest_status", "ingest_attempts", "last_attempt_at") == [(1, "one", "complete", 1, 7), (2, "new", "complete", 2, 9)]
    assert again["ingest_rejects"].count() == 0
    assert pairs(again["concept_provenance"], "braindump_id") == [(1,), (1,), (2,)]


def test_json_lists_and_the_clock(spark):
    import time

    from kgspark.functions.scalars import hop_list, id_list, now_seconds

    texts = [("[1, 2]",), ("[]",), ("[1,",), ("{}",), ("[1, null]",), ('["x"]',), ("7",), (None,), ("",)]
    assert [r[0] for r in frame(spark, texts, "t string").select(id_list(F.col("t"))).collect()] == [[1, 2], *[[]] * 8]
    hop = '{"source_concept_id":"a","edge_type":"x","target_concept_id":"b"}'
    got = frame(spark, [(f"[{hop}]",), ('[{"source_concept_id":"a"}]',), ("oops",), (None,)], "t string").select(hop_list(F.col("t"))).collect()
    assert [[tuple(h) for h in r[0]] for r in got] == [[("a", "x", "b")], [], [], []]
    at, now = frame(spark, [(1,)], "x int").select(now_seconds(5), now_seconds()).head()
    assert at == 5 and abs(now - time.time()) < 600


def test_silent_answers_carry_no_citations_and_notes_are_ranked(spark):
    from kgspark.plans.chat import citations, gate
    from kgspark.plans.retrieve import ranked as presented

    key = "query_id bigint, user_id string"
    answers = frame(spark, [(1, "u", "See [bd:4]."), (2, "u", "No notes behind this."), (3, "u", None), (4, "u", "By [cluster:1].")], f"{key}, answer string")
    notes = frame(spark, [(1, "u", 4, 0.5), (1, "u", 3, 0.5), (1, "u", 9, 0.7), (3, "u", 4, 0.5), (4, "u", 4, 0.5)], f"{key}, braindump_id bigint, score double")
    gated = gate(answers, notes)
    assert pairs(gated, "query_id", "silent") == [(1, False), (2, True), (3, True), (4, True)]
    assert pairs(citations(gated, notes), "query_id", "braindump_id") == [(1, 3), (1, 4), (1, 9)]
    assert [r["braindump_id"] for r in presented(notes).where("query_id = 1").collect()] == [9, 3, 4]


# --- growth ---------------------------------------------------------------------------------------
def test_provenance_does_not_fold_keys(spark):
    from kgspark.operators.accrete import accrete_edges

    edges = frame(spark, [("u", n, 0, "a", "t", "b") for n in (1, 2)] + [("u", 2, 1, "b", "t", "a")], "user_id string, braindump_id bigint, pos int, source string, type string, target string")
    labels = frame(spark, [("u", n, c, c) for n in (1, 2) for c in "ab"], "user_id string, braindump_id bigint, label string, concept_id string")
    ontology = frame(spark, [("u", "t")], "user_id string, slug string")
    held = frame(spark, [("u", "old", "b", "a", "t", 1)], TABLES["edges"])
    found = accrete_edges(edges, labels, ontology, held, 1)
    assert sorted(tuple(r) for r in found.provenance.collect()) == [("u", "a|t|b", 1), ("u", "a|t|b", 2), ("u", "old", 2)]
    assert "first" not in found.provenance._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["braindump_id"], r["pos"], r["outcome"]) for r in found.judged.collect()) == [(1, 0, "created"), (2, 0, "accreted"), (2, 1, "accreted")]


def test_notes_are_taken_apart_in_tasks_of_few_bytes(spark, tmp_path, monkeypatch):
    from kgspark.sources import extraction

    notes = frame(spark, [("u", n, '{"concepts":[{"label":"a%d"}],"edges":[]}' % n) for n in range(2000)], "user_id string, braindump_id bigint, payload string")
    notes.write.parquet(str(tmp_path / "notes"))
    raw = spark.read.parquet(str(tmp_path / "notes"))
    monkeypatch.setattr(extraction, "TASK_BYTES", extraction.estimated_bytes(raw) // 50)
    for materialize in (False, True):
        parsed = extraction.parse_extractions(raw, materialize)
        assert parsed.parts >= 20 and parsed.concepts.rdd.getNumPartitions() == parsed.parts and parsed.concepts.count() == 2000


def test_large_drops_are_several_files_and_arrive_drop_by_drop(spark, monkeypatch):
    from types import SimpleNamespace

    from kgspark.checks import stream_queries as Q

    path = Q.scratch_path(spark, "many")
    monkeypatch.setattr(Q, "DROP_BYTES", 8 << 10)
    monkeypatch.setattr(Q, "scratch_path", lambda spark, name: path)
    stream = Q.arriving(SimpleNamespace(spark=spark), spark.range(8000).withColumn("x", F.col("id") * 7), "many", 2)
    seen = []
    Q.finish(stream.writeStream.foreachBatch(lambda df, _: seen.append(df.agg(F.min("id"), F.max("id"), F.count("id")).head()))
             .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start())
    assert len(seen) == 2 and seen[0][0] == 0 and seen[1][1] == 7999 and seen[0][1] < seen[1][0] and sum(r[2] for r in seen) == 8000
    drops = [len(spark.read.parquet(f"{path}/drop={i}").inputFiles()) for i in range(2)]
    assert drops[0] == drops[1] > 1


def by_hand(notes):
    """Labels and edges of ``(user, note, labels, edges)`` at their lowest places: per note, over all rows of it."""
    labels, edges = {}, {}
    for user, note, names, links in notes:
        for at, name in enumerate(names):
            labels[user, note, name] = min(at, labels.get((user, note, name), at))
        for at, link in enumerate(links):
            edges[(user, note, *link)] = min(at, edges.get((user, note, *link), at))
    return labels, edges


def noted(spark, notes):
    import json

    rows = [(u, n, f"text {n}", json.dumps({"concepts": [{"label": x} for x in names], "edges": [dict(zip(("source", "type", "target"), e, strict=True)) for e in links]}))
            for u, n, names, links in notes]
    return frame(spark, rows, "user_id string, braindump_id bigint, verbatim string, payload string")


def some_notes(rng, count, ids):
    pick = lambda: rng.choice("abcdefgh")
    return [(rng.choice("uw"), rng.randrange(ids), [pick() for _ in range(rng.randrange(6))],
             [(pick(), rng.choice("st"), pick()) for _ in range(rng.randrange(6))]) for _ in range(count)]


@pytest.mark.parametrize("ids", [10**9, 20])
def test_notes_are_taken_apart_without_a_shuffle(spark, ids):
    """Also notes that arrive in several rows have each label and edge once, at its lowest place."""
    from kgspark.sources.chunks import plain_notes

    notes = some_notes(random.Random(ids), 60, ids)
    labels, edges = by_hand(notes)
    got = plain_notes(noted(spark, notes))
    assert got.count() == len({n[:2] for n in notes})
    assert {(r[0], r[1], r[2]): r[3] for r in got.select("user_id", "braindump_id", F.inline("labels")).collect()} == labels
    found = got.select("user_id", "braindump_id", F.inline("edges")).collect()
    assert {(r["user_id"], r["braindump_id"], r["source"], r["type"], r["target"]): r["pos"] for r in found} == edges
    assert all(r["source_known"] == ((r["user_id"], r["braindump_id"], r["source"]) in labels) for r in found)
    assert all(r["target_known"] == ((r["user_id"], r["braindump_id"], r["target"]) in labels) for r in found)


@pytest.mark.parametrize(("limit", "held"), [(3, False), (1 << 20, False), (3, True)])
def test_ingest_in_chunks_equals_identity_of_every_occurrence(spark, monkeypatch, limit, held):
    """Labels with vectors of their own, near ones, zero ones and equal directions: as if each occurrence were resolved alone."""
    from kgspark.plans.ingest import batch_ingest
    from kgspark.sources import chunks

    monkeypatch.setattr(chunks, "CHUNK_LABELS", limit)
    monkeypatch.setattr(chunks, "BATCH_NOTES", 4)
    angle = {"a": 0.0, "b": 0.1, "c": 0.2, "d": 0.3, "e": 0.4, "f": 1.5, "g": 3.0}

    @F.udf("array<float>")
    def embed(label):
        if label not in angle:
            return [0.0, 0.0]
        return [float(np.cos(angle[label])), float(np.sin(angle[label]))]

    notes = some_notes(random.Random(limit), 40, 10**9)
    tables = {n: empty(spark, n) for n in TABLES}
    tables["ontology"] = frame(spark, [(u, i, "s", "S", "", 1) for i, u in enumerate("uw")], TABLES["ontology"])
    if held:
        tables["concept_embeddings"] = frame(spark, [("u", "old", [1.0, 0.0]), ("u", "old2", [1.0, 0.0])], TABLES["concept_embeddings"])
    labels, edges = by_hand(notes)
    rows = frame(spark, [(u, n, p, w) for (u, n, w), p in labels.items()], "user_id string, braindump_id bigint, pos int, label string")
    want = resolve_identity(rows, tables["concept_embeddings"], 0.99, 0.8, embed=embed)
    concept = {(r["user_id"], r["braindump_id"], r["label"]): (r["concept_id"], r["outcome"]) for r in want.occurrences.collect()}
    after, outcome, _ = batch_ingest(tables, noted(spark, notes), 7, embed=embed, accrete=0.99, floor=0.8)
    assert pairs(after["concept_provenance"], "user_id", "concept_id", "braindump_id") == sorted({(u, concept[u, n, w][0], n) for u, n, w in labels})
    assert pairs(after["concepts"], "user_id", "concept_id", "label") == pairs(want.leaders, "user_id", "concept_id", "label")
    assert pairs(after["merge_suggestions"], "suggestion_id", "existing_concept_id") == pairs(want.suggestions, "suggestion_id", "existing_concept_id")
    valid = sorted((n, p, u, concept[u, n, s][0], concept[u, n, o][0]) for (u, n, s, t, o), p in edges.items() if t == "s" and (u, n, s) in labels and (u, n, o) in labels)
    assert pairs(after["edges"], "user_id", "source_concept_id", "target_concept_id") == sorted({(u, s, o) for _, _, u, s, o in valid})
    assert pairs(after["edge_provenance"], "user_id", "edge_id", "braindump_id") == sorted({(u, f"{s}|s|{o}", n) for n, _, u, s, o in valid})
    made, counts = {}, {}
    for n, p, u, s, o in valid:
        made.setdefault((u, s, o), (u, n))
    for u, n, w in labels:
        kind = 1 if concept[u, n, w][1] == "accreted" else 0
        counts.setdefault((u, n), [0] * 6)[kind] += 1
        counts[u, n][2] += concept[u, n, w][1] == "suggested"
    for u, n in made.values():
        counts[u, n][3] += 1
    for u, n, *_ in edges:
        counts.setdefault((u, n), [0] * 6)
    for u, n in counts:
        mine = sum(1 for v in valid if (v[2], v[0]) == (u, n))
        counts[u, n][4:] = [mine - counts[u, n][3], sum(1 for e in edges if e[:2] == (u, n)) - mine]
    got = {(r["user_id"], r["braindump_id"]): list(r)[2:] for r in outcome.collect()}
    assert got == {(u, n): counts.get((u, n), [0] * 6) for u, n, *_ in notes}


def test_an_ingest_shuffles_no_edge_by_note_and_a_commit_adds_parts(spark, tmp_path, monkeypatch):
    """A second batch writes its own rows beside the first one's; edges meet the labels of their note without a join on texts."""
    from kgspark.plans import ingest
    from kgspark.streaming.ingest import start_ingest

    seen = []
    monkeypatch.setattr(ingest, "place", lambda chunks, found, place=ingest.place: seen.append(chunks) or place(chunks, found))
    store = GraphStore(spark, str(tmp_path / "graph"))
    store.commit({"ontology": frame(spark, [("u", 1, "s", "S", "", 1), ("w", 2, "s", "S", "", 1)], TABLES["ontology"])})
    first, second = some_notes(random.Random(1), 30, 10**9), some_notes(random.Random(2), 30, 10**9)
    for i, notes in enumerate((first, second)):
        noted(spark, notes).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        stream = spark.readStream.schema("user_id string, braindump_id bigint, verbatim string, payload string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        start_ingest(stream, store, str(tmp_path / "check"), lambda batch: 7).awaitTermination()
    tables = {n: empty(spark, n) for n in TABLES} | {"ontology": store.read("ontology")}
    whole, _, _ = ingest.batch_ingest(ingest.batch_ingest(tables, noted(spark, first), 7)[0], noted(spark, second), 7)
    for name in ("concepts", "concept_provenance", "edges", "edge_provenance", "edge_type_history", "braindumps", "braindump_embeddings"):
        assert len(store.state()["tables"][name]) == 2
        assert pairs(store.read(name), *whole[name].columns) == pairs(whole[name], *whole[name].columns), name
    assert all("label" not in c.notes.columns for c in seen)
