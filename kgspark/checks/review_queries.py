"""Deletes, merges, queues, types and proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.models import constant_answer
from ..operators import inference as I
from ..operators import lookups as L
from ..operators import merge as M
from ..operators import ontology as O
from ..operators import retract as R
from ..schema import empty
from .graph_queries import INFERRED, inferred
from .oracle import twin
from .registry import query
from .views import NOW


def b_tables(v, with_inference: bool = True) -> dict:
    return {
        "concepts": v.b_concepts, "edges": v.b_edges, "concept_provenance": v.b_concept_provenance,
        "edge_provenance": v.b_edge_provenance, "edge_type_history": v.b_history,
        "edge_inference_provenance": inferred(v).where("mode = 'structural_inference'") if with_inference
        else empty(v.spark, "edge_inference_provenance"),
        "merge_suggestions": v.b_suggestions, "graph_tombstones": empty(v.spark, "graph_tombstones"),
        "braindumps": v.b_note_ids,
    }


_GONE = {
    **INFERRED,
    "kept_ep": """SELECT p.* FROM b_edge_provenance p ANTI JOIN b_deletes d USING (user_id, braindump_id)""",
    "kept_cp": """SELECT p.* FROM b_concept_provenance p ANTI JOIN b_deletes d USING (user_id, braindump_id)""",
    "gone_e": """SELECT user_id, edge_id FROM b_edges e WHERE NOT EXISTS (SELECT 1 FROM kept_ep k WHERE k.user_id = e.user_id AND k.edge_id = e.edge_id)
        AND NOT EXISTS (SELECT 1 FROM b_inferred i WHERE i.mode = 'structural_inference' AND i.user_id = e.user_id AND i.edge_id = e.edge_id)""",
    "gone_c": "SELECT user_id, concept_id FROM b_concepts ANTI JOIN kept_cp USING (user_id, concept_id)",
    "rest_e": "SELECT * FROM b_edges ANTI JOIN gone_e USING (user_id, edge_id)",
    "casc_e": """SELECT user_id, edge_id FROM rest_e e WHERE EXISTS (SELECT 1 FROM gone_c c WHERE c.user_id = e.user_id
        AND (c.concept_id = e.source_concept_id OR c.concept_id = e.target_concept_id))""",
}


@query("orphans_after_delete", twin(
    """SELECT user_id, 'edge' AS kind, edge_id AS entity_id FROM gone_e UNION ALL SELECT user_id, 'concept', concept_id FROM gone_c""", **_GONE))
def orphans_after_delete(v):
    gone = R.find_gone(b_tables(v), v.b_deletes)
    return gone.edges.select("user_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("entity_id")).unionByName(
        gone.concepts.select("user_id", F.lit("concept").alias("kind"), F.col("concept_id").alias("entity_id")))


@query("tombstones_after_delete", twin(
    f"""SELECT user_id, 'edge' AS kind, edge_id AS entity_id, CAST({NOW} AS BIGINT) AS created_at FROM gone_e
        UNION ALL SELECT user_id, 'concept', concept_id, {NOW} FROM gone_c""", **_GONE))
def tombstones_after_delete(v):
    return R.retract(b_tables(v), v.b_deletes, NOW)["graph_tombstones"]


@query("cascade_after_delete", twin("SELECT user_id, edge_id FROM casc_e", **_GONE))
def cascade_after_delete(v):
    return R.find_gone(b_tables(v), v.b_deletes).cascaded


@query("delete_notes", twin(
    """SELECT user_id, edge_id, source_concept_id, target_concept_id, original_type, created_at FROM rest_e
       ANTI JOIN casc_e USING (user_id, edge_id)""", **_GONE))
def delete_notes(v):
    """Edges left after the withdrawn notes are deleted."""
    return R.delete_notes(b_tables(v), v.b_deletes, NOW)[0]["edges"]


@query("delete_outcome", twin(
    """SELECT n.user_id, n.braindump_id, d.user_id IS NOT NULL AS deleted FROM (SELECT user_id, braindump_id FROM b_deletes
       UNION ALL SELECT user_id, -braindump_id - 1 FROM b_deletes) n LEFT JOIN b_note_ids d USING (user_id, braindump_id)"""))
def delete_outcome(v):
    asked = v.b_deletes.unionByName(v.b_deletes.withColumn("braindump_id", -F.col("braindump_id") - 1))
    return R.delete_notes(b_tables(v), asked, NOW)[1]


# --- merges ---------------------------------------------------------------------------------------
_WALK = {
    "req": """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (suggestion_id * 7919) % 10007 * 4294967296 + suggestion_id) AS n FROM b_suggestions""",
    "walk": """SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS folded FROM b_users UNION ALL
        SELECT w.user_id, r.n, CASE WHEN list_contains(w.folded, r.new_concept_id) OR list_contains(w.folded, r.existing_concept_id)
            THEN w.folded ELSE list_append(w.folded, r.new_concept_id) END
        FROM walk w JOIN req r ON r.user_id = w.user_id AND r.n = w.n + 1""",
    "folded_c": "SELECT user_id, unnest(f) AS fold FROM (SELECT user_id, arg_max(folded, n) AS f FROM walk GROUP BY 1) q",
    "links": """SELECT r.user_id, r.new_concept_id AS fold, r.existing_concept_id AS keep, r.n FROM req r
        JOIN folded_c f ON f.user_id = r.user_id AND f.fold = r.new_concept_id""",
    "chain": """SELECT user_id, fold, keep, n, 1 AS depth FROM links UNION ALL
        SELECT c.user_id, c.fold, l.keep, c.n, c.depth + 1 FROM chain c JOIN links l ON l.user_id = c.user_id AND l.fold = c.keep""",
    "roots": "SELECT user_id, fold, arg_max(keep, depth) AS root, max(depth) AS depth, any_value(n) AS n FROM chain GROUP BY 1, 2",
    "moved": """SELECT e.*, coalesce(s.root, e.source_concept_id) AS ns, coalesce(t.root, e.target_concept_id) AS nt,
        coalesce(s.depth, 0) + coalesce(t.depth, 0) AS depth, coalesce(least(s.n, t.n), -1) AS moved_at
        FROM b_edges e LEFT JOIN roots s ON s.user_id = e.user_id AND s.fold = e.source_concept_id
        LEFT JOIN roots t ON t.user_id = e.user_id AND t.fold = e.target_concept_id""",
    "keepers": """SELECT user_id, ns, original_type, nt, first(edge_id ORDER BY depth, moved_at, edge_id) AS keeper,
        first(created_at ORDER BY depth, moved_at, edge_id) AS created_at FROM moved GROUP BY 1, 2, 3, 4""",
}


def _requests(v):
    """Requests in a shuffled order, so that some merges follow and some precede those they depend on."""
    order = (F.col("suggestion_id") * 7919) % 10007 * 4294967296 + F.col("suggestion_id")
    return v.b_suggestions.select("user_id", order.alias("ord"), "suggestion_id")


@query("merge_outcomes", twin(
    """SELECT r.user_id, r.suggestion_id, CASE WHEN f.fold IS NULL THEN 'not_found' ELSE 'approved' END AS outcome
       FROM req r LEFT JOIN folded_c f ON f.user_id = r.user_id AND f.fold = r.new_concept_id""", recursive=True, **_WALK))
def merge_outcomes(v):
    return M.decide_merges(_requests(v), v.b_suggestions).select("user_id", "suggestion_id", F.col("state").alias("outcome"))


@query("merge_concepts_edges", twin(
    """SELECT user_id, keeper AS edge_id, ns AS source_concept_id, nt AS target_concept_id, original_type, created_at FROM keepers""",
    recursive=True, **_WALK))
def merge_concepts_edges(v):
    return M.merge_concepts(b_tables(v), _requests(v))[0]["edges"]


@query("merge_concepts_provenance", twin(
    """SELECT DISTINCT k.user_id, k.keeper AS edge_id, p.braindump_id FROM keepers k
       JOIN moved m ON m.user_id = k.user_id AND m.ns = k.ns AND m.nt = k.nt AND m.original_type = k.original_type
       JOIN b_edge_provenance p ON p.user_id = m.user_id AND p.edge_id = m.edge_id""", recursive=True, **_WALK))
def merge_concepts_provenance(v):
    return M.merge_concepts(b_tables(v), _requests(v))[0]["edge_provenance"]


@query("merge_extractors", twin(
    """SELECT DISTINCT p.user_id, coalesce(r.root, p.concept_id) AS concept_id, p.braindump_id FROM b_concept_provenance p
       LEFT JOIN roots r ON r.user_id = p.user_id AND r.fold = p.concept_id""", recursive=True, **_WALK))
def merge_extractors(v):
    return M.merge_concepts(b_tables(v), _requests(v))[0]["concept_provenance"]


@query("merge_view_edges", twin(
    """SELECT user_id, edge_id, ns AS source_concept_id, nt AS target_concept_id, original_type, created_at FROM moved
       WHERE ns <> nt OR user_id NOT IN (SELECT user_id FROM roots)""", recursive=True, **_WALK))
def merge_view_edges(v):
    folds = M.fold_map(M.decide_merges(_requests(v), v.b_suggestions))
    partitions = v.assignment.select("user_id", "concept_id", F.col("community").alias("partition_id"))
    return M.merge_in_view(v.b_concepts, v.b_edges, partitions, folds)[1]


@query("type_merge_view", twin(
    """SELECT user_id, edge_id, CASE WHEN original_type = 'contradicts' THEN 'relates_to' ELSE original_type END AS current_type FROM b_edges"""))
def type_merge_view(v):
    typed = v.b_edges.withColumn("current_type", F.col("original_type"))
    return M.retype_in_view(typed, "contradicts", "relates_to").select("user_id", "edge_id", "current_type")


@query("reject_suggestions", twin(
    """SELECT s.user_id, s.suggestion_id FROM b_suggestions s WHERE s.braindump_id NOT IN
       (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') OR s.braindump_id IS NULL"""))
def reject_suggestions(v):
    """Suggestions raised by a withdrawn order are rejected."""
    gone = v.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("braindump_id"))
    asked = v.b_suggestions.join(gone, "braindump_id", "left_semi").select("user_id", "suggestion_id")
    return M.reject_suggestions(v.b_suggestions, asked)[0].select("user_id", "suggestion_id")


def _suggesting_notes(v):
    """The notes that made suggestions, with their texts."""
    docs = v.table("documents").select("doc_id", "text")
    return v.b_suggestions.select("user_id", "braindump_id").distinct().withColumn(
        "doc_id", F.col("braindump_id") % v._count("documents")
    ).join(docs, "doc_id").select("user_id", "braindump_id", F.col("text").alias("verbatim"))


@query("suggestion_details", twin(
    """SELECT s.user_id, s.suggestion_id, s.existing_concept_id AS existing_concept_label,
       md5(substr(d.text, 1, 300)) AS snippet_hash, length(substr(d.text, 1, 300)) AS snippet_chars
       FROM b_suggestions s JOIN documents d ON d.doc_id = s.braindump_id % (SELECT count(*) FROM documents)"""))
def suggestion_details(v):
    return L.suggestion_details(v.b_suggestions, v.b_concepts, _suggesting_notes(v)).select(
        "user_id", "suggestion_id", "existing_concept_label", F.md5("braindump_snippet").alias("snippet_hash"),
        F.char_length("braindump_snippet").cast("bigint").alias("snippet_chars"))


# --- types ----------------------------------------------------------------------------------------
_FNV = """list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(octet_length(encode(w))),
    lambda i: CAST(CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS BIGINT))),
    lambda h, b: (xor(h, b) * 16777619) & 4294967295)"""
TOKENS = r"""list_filter(regexp_split_to_array(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '')"""


def vectors_of(rows: str, key: str, text: str) -> dict[str, str]:
    """CTEs ending in ``<rows>_vec(key..., v)``: the 64-bucket unit vector of each text."""
    return {
        f"{rows}_tok": f"SELECT {key}, unnest({TOKENS.format(t=text)}) AS w FROM {rows}",
        f"{rows}_fnv": f"SELECT w, {_FNV} % 64 AS bucket FROM (SELECT DISTINCT w FROM {rows}_tok) q",
        f"{rows}_cnt": f"SELECT {key}, bucket, count(*) AS n FROM {rows}_tok JOIN {rows}_fnv USING (w) GROUP BY ALL",
        f"{rows}_vec": f"SELECT {key}, sqrt(sum(n * n)) AS norm FROM {rows}_cnt GROUP BY ALL",
        # Stored vectors are single precision; similarities are taken over the stored values.
        f"{rows}_x": f"SELECT {key}, bucket, CAST(CAST(n / norm AS FLOAT) AS DOUBLE) AS x FROM {rows}_cnt JOIN {rows}_vec USING ({key})",
        f"{rows}_len": f"SELECT {key}, sqrt(sum(x * x)) AS len FROM {rows}_x GROUP BY ALL",
    }


_PROPOSED = {
    "clean_p": """SELECT user_id, proposal_id, trim(slug) AS slug, trim(label) AS label, trim(description) AS description,
        trim(merge_of) AS merge_of FROM proposed_types""",
    "judged_p": """SELECT p.*, CASE WHEN p.slug = '' OR p.label = '' OR p.description = '' THEN 'blank_field'
        WHEN p.slug IN (SELECT slug FROM seed_types) THEN 'slug_exists'
        WHEN p.merge_of IS NOT NULL AND p.merge_of NOT IN (SELECT slug FROM seed_types) THEN 'unknown_merge_of' END AS reason FROM clean_p p""",
    "good_p": "SELECT user_id, proposal_id, slug || ' ' || label || ' ' || description AS text FROM judged_p WHERE reason IS NULL",
    "seed_text": "SELECT i, slug, slug || ' ' || label || ' ' || description AS text FROM seed_types",
    **vectors_of("good_p", "user_id, proposal_id", "text"),
    **vectors_of("seed_text", "i", "text"),
    "near_p": """SELECT user_id, proposal_id, i, sim FROM (SELECT *, row_number() OVER (PARTITION BY user_id, proposal_id ORDER BY sim DESC, i) AS rn FROM (
        SELECT a.user_id, a.proposal_id, b.i, round(coalesce(d.dot, 0) / (a.len * b.len), 10) AS sim
        FROM good_p_len a, seed_text_len b LEFT JOIN (
            SELECT x.user_id, x.proposal_id, y.i, sum(x.x * y.x) AS dot FROM good_p_x x JOIN seed_text_x y USING (bucket) GROUP BY 1, 2, 3) d
        ON d.user_id = a.user_id AND d.proposal_id = a.proposal_id AND d.i = b.i) q) q WHERE rn = 1""",
    "proposals_p": f"""SELECT j.*, CASE WHEN reason IS NOT NULL THEN NULL WHEN sim >= 0.995 THEN 'auto_merged' ELSE 'pending' END AS status,
        s.slug AS near_match_slug, sim AS near_match_similarity FROM judged_p j
        LEFT JOIN near_p n USING (user_id, proposal_id) LEFT JOIN seed_types s ON s.i = n.i""",
}


def _proposals(v):
    return O.propose_types(v.proposed_types, v.b_ontology, O.type_vectors(v.b_ontology), NOW)


@query("nearest_type", twin(
    "SELECT user_id, proposal_id, CAST(i + 1 AS BIGINT) AS ontology_id, round(sim, 4) AS similarity FROM near_p", **_PROPOSED))
def nearest_type(v):
    p = _proposals(v).where("reason IS NULL")
    return p.join(v.b_ontology.select("user_id", "ontology_id", F.col("slug").alias("near_match_slug")), ["user_id", "near_match_slug"]).select(
        "user_id", "proposal_id", "ontology_id", F.round("near_match_similarity", 4).alias("similarity"))


@query("propose_types", twin(
    """SELECT user_id, proposal_id, slug, label, merge_of, status, near_match_slug, round(near_match_similarity, 4) AS near_match_similarity,
       reason FROM proposals_p""", **_PROPOSED))
def propose_types(v):
    return _proposals(v).select("user_id", "proposal_id", "slug", "label", "merge_of", "status", "near_match_slug",
                                F.round("near_match_similarity", 4).alias("near_match_similarity"), "reason")


def _queue(v):
    return _proposals(v).where("reason IS NULL").drop("reason")


def _type_requests(v):
    """Two requests for each proposal of a large part, one for each part that made none."""
    part = v.table("part").select((F.col("p_partkey") % 5).cast("string").alias("user_id"), F.col("p_partkey").alias("proposal_id"), "p_size")
    return part.where("p_size > 20").select("user_id", "proposal_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"))


_APPROVED = {
    **_PROPOSED,
    "queue_p": "SELECT * FROM proposals_p WHERE reason IS NULL",
    "ask_p": "SELECT CAST(p_partkey % 5 AS VARCHAR) AS user_id, p_partkey AS proposal_id, ord FROM part, (VALUES (1), (2)) t(ord) WHERE p_size > 20",
    "first_p": """SELECT user_id, proposal_id, slug, label, description, row_number() OVER (PARTITION BY user_id, slug ORDER BY proposal_id) AS rn
        FROM queue_p JOIN (SELECT DISTINCT user_id, proposal_id FROM ask_p) a USING (user_id, proposal_id) WHERE status = 'pending'""",
    "added_p": "SELECT * FROM first_p WHERE rn = 1",
}


@query("approve_types", twin(
    """SELECT user_id, CAST(13 + row_number() OVER (PARTITION BY user_id ORDER BY proposal_id) AS BIGINT) AS ontology_id, slug, label
       FROM added_p""", **_APPROVED))
def approve_types(v):
    return O.approve_types(_queue(v), _type_requests(v), v.b_ontology, NOW)[1].select("user_id", "ontology_id", "slug", "label")


@query("approve_outcomes", twin(
    """SELECT a.user_id, a.proposal_id, a.ord, CASE WHEN q.slug IS NULL THEN 'not_found' WHEN d.slug IS NOT NULL AND a.ord = 1 THEN 'approved'
       ELSE 'conflict' END AS outcome FROM ask_p a LEFT JOIN queue_p q USING (user_id, proposal_id)
       LEFT JOIN added_p d ON d.user_id = a.user_id AND d.proposal_id = a.proposal_id""", **_APPROVED))
def approve_outcomes(v):
    return O.approve_types(_queue(v), _type_requests(v), v.b_ontology, NOW)[2].select("user_id", "proposal_id", "ord", "outcome")


@query("ontology_slugs", twin(
    "SELECT user_id, ontology_id, slug, label FROM b_ontology"))
def ontology_slugs(v):
    """Seeding tenants, with one tenant already seeded, adds the types of the others only."""
    have = v.b_ontology.where("user_id = '0'")
    return have.unionByName(O.seed_ontology(v.b_users, have, NOW)).select("user_id", "ontology_id", "slug", "label")


@query("slug_exists", twin(
    """SELECT DISTINCT user_id, type AS slug FROM b_assert SEMI JOIN b_ontology o ON o.user_id = b_assert.user_id AND o.slug = b_assert.type"""))
def slug_exists(v):
    return L.slug_exists(v.b_edges.select("user_id", F.col("original_type").alias("slug")).distinct(), v.b_ontology)


@query("type_vector_fill", twin(
    """SELECT o.user_id, o.ontology_id, CAST(count(*) AS BIGINT) AS buckets FROM b_ontology o JOIN seed_text t ON t.slug = o.slug
       JOIN (SELECT DISTINCT i, bucket FROM seed_text_cnt) c ON c.i = t.i GROUP BY 1, 2""", **_PROPOSED))
def type_vector_fill(v):
    """Vectors of the types that lack one (all but the first of each tenant here) are embedded and added."""
    some = O.type_vectors(v.b_ontology.where("ontology_id = 1"))
    return O.fill_vectors(v.b_ontology, some).select(
        "user_id", "ontology_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("buckets"))


def _retag_proposals(v):
    return v.b_users.select(
        "user_id", F.lit(1).cast("bigint").alias("proposal_id"), F.lit("opposes").alias("slug"), F.lit("Opposes").alias("label"),
        F.lit("A works against B.").alias("description"), F.lit("contradicts").alias("merge_of"))


@query("retag_edges", twin(
    f"""SELECT user_id, edge_id, CAST(1 AS BIGINT) AS seq_index, 'opposes' AS type_slug, CAST({NOW} AS BIGINT) AS created_at
        FROM b_edges WHERE original_type = 'contradicts'"""))
def retag_edges(v):
    """Edges of a merged type; the classifier names no known type, so the new one is appended."""
    return O.retag_edges(
        _retag_proposals(v), v.b_edges, v.b_history, v.b_concepts, v.b_ontology, NOW, lambda p: constant_answer(p, " unheard_of "))


@query("retag_prompts", twin(
    """SELECT user_id, edge_id, md5('Edge: ' || source_concept_id || ' -[contradicts]→ ' || target_concept_id ||
       chr(10) || 'Merged into: opposes (Opposes: A works against B.)' || chr(10) || 'Types: ' ||
       (SELECT string_agg(slug, ', ' ORDER BY i) FROM seed_types)) AS prompt_hash FROM b_edges WHERE original_type = 'contradicts'"""))
def retag_prompts(v):
    return O.retag_prompts(_retag_proposals(v), v.b_edges, v.b_history, v.b_concepts, v.b_ontology).select(
        "user_id", "edge_id", F.md5("prompt").alias("prompt_hash"))


# --- proposed edges -------------------------------------------------------------------------------
_FAULTS = {
    "judged_s": """SELECT p.*, CASE WHEN trim(proposed_type) = '' THEN 'blank_type'
        WHEN hop_target <> target_concept_id THEN 'wrong_end'
        WHEN trim(proposed_type) NOT IN (SELECT slug FROM seed_types) THEN 'unknown_type'
        WHEN NOT EXISTS (SELECT 1 FROM b_edges e WHERE e.user_id = p.user_id AND e.source_concept_id = hop_source
            AND e.target_concept_id = hop_target AND e.original_type = hop_type) THEN 'not_traversable' END AS reason FROM b_proposals p""",
}


@query("validate_paths", twin(
    """SELECT user_id, proposal_id, CASE WHEN hop_target <> target_concept_id THEN 'wrong_end' END AS fault FROM b_proposals"""))
def validate_paths(v):
    return v.b_proposals.select("user_id", "proposal_id", I.path_fault(
        F.col("evidence_path"), F.col("source_concept_id"), F.col("target_concept_id")).alias("fault"))


def _structural(v):
    return I.propose_structural(v.b_proposals, v.b_ontology, v.b_edges, v.b_history, NOW)


@query("propose_structural", twin(
    """SELECT user_id, proposal_id, trim(proposed_type) AS proposed_type, CASE WHEN reason IS NULL THEN 'pending' END AS status, reason
       FROM judged_s""", **_FAULTS))
def propose_structural(v):
    return _structural(v).select("user_id", "proposal_id", "proposed_type", "status", "reason")


def _clusters(v):
    """One thematic proposal per (tenant, community): its first and last supplier, over all its members."""
    return v.assignment.groupBy("user_id", "community").agg(
        F.min(F.when(F.startswith("concept_id", F.lit("s:")), F.col("concept_id"))).alias("a"),
        F.max(F.when(F.startswith("concept_id", F.lit("s:")), F.col("concept_id"))).alias("b"),
        F.collect_list("concept_id").alias("ids"),
    ).where("a IS NOT NULL").select(
        "user_id", F.col("community").alias("proposal_id"), F.col("a").alias("source_concept_id"), F.col("b").alias("target_concept_id"),
        F.when(F.col("community") == 7, F.lit("unheard_of")).otherwise(F.lit(" relates_to ")).alias("proposed_type"),
        F.when(F.col("community") == 6, F.concat("ids", F.array(F.lit("s:none")))).when(
            F.col("community") == 5, F.array("a")).when(F.col("community") == 4, F.array("a", "b", "a")).otherwise(F.col("ids")).alias("cluster_concept_ids"),
        F.lit(" near ").alias("rationale"),
    )


_THEMES = {
    "themes": """SELECT user_id, community AS proposal_id, min(concept_id) FILTER (WHERE concept_id LIKE 's:%') AS a,
        max(concept_id) FILTER (WHERE concept_id LIKE 's:%') AS b FROM assignment GROUP BY 1, 2""",
    "evidence": """SELECT DISTINCT e.user_id, s.community AS proposal_id, p.braindump_id FROM b_edges e
        JOIN assignment s ON s.user_id = e.user_id AND s.concept_id = e.source_concept_id
        JOIN assignment t ON t.user_id = e.user_id AND t.concept_id = e.target_concept_id AND s.community = t.community
        JOIN b_edge_provenance p ON p.user_id = e.user_id AND p.edge_id = e.edge_id""",
    "judged_t": """SELECT t.*, CASE WHEN a = b THEN 'same_ends' WHEN proposal_id = 5 THEN 'end_outside_cluster'
        WHEN proposal_id = 7 THEN 'unknown_type' WHEN proposal_id = 6 THEN 'unknown_member'
        WHEN proposal_id = 4 OR NOT EXISTS (SELECT 1 FROM evidence e WHERE e.user_id = t.user_id AND e.proposal_id = t.proposal_id)
        THEN 'no_evidence' END AS reason FROM themes t WHERE a IS NOT NULL""",
}


def _thematic(v):
    return I.propose_thematic(_clusters(v), v.b_ontology, v.b_concepts, v.b_edges, v.b_edge_provenance, NOW)


@query("propose_thematic", twin(
    """SELECT user_id, proposal_id, a AS source_concept_id, b AS target_concept_id, CASE WHEN reason IS NULL THEN 'pending' END AS status,
       reason FROM judged_t""", **_THEMES))
def propose_thematic(v):
    return _thematic(v)[0].select("user_id", "proposal_id", "source_concept_id", "target_concept_id", "status", "reason")


@query("frozen_snapshots", twin(
    """SELECT j.user_id, 't:' || j.proposal_id AS snapshot_id, 'note' AS kind, CAST(e.braindump_id AS VARCHAR) AS member FROM judged_t j
       JOIN evidence e ON e.user_id = j.user_id AND e.proposal_id = j.proposal_id WHERE reason IS NULL
       UNION ALL SELECT j.user_id, 't:' || j.proposal_id, 'concept', s.concept_id FROM judged_t j
       JOIN assignment s ON s.user_id = j.user_id AND s.community = j.proposal_id WHERE reason IS NULL""", **_THEMES))
def frozen_snapshots(v):
    """Every member of every frozen snapshot."""
    frozen = _thematic(v)[1]
    of = lambda kind, ids: frozen.select("user_id", "snapshot_id", F.lit(kind).alias("kind"), F.explode(F.col(ids).cast("array<string>")).alias("member"))
    return of("note", "braindump_ids").unionByName(of("concept", "concept_ids"))


@query("proposal_snapshots", twin(
    """SELECT j.user_id, j.proposal_id, e.braindump_id FROM judged_t j
       LEFT JOIN evidence e ON e.user_id = j.user_id AND e.proposal_id = j.proposal_id AND j.reason IS NULL""", **_THEMES))
def proposal_snapshots(v):
    """The notes behind every proposal; a null note where nothing was frozen."""
    proposals, snapshots = _thematic(v)
    return L.proposals_with_snapshot(proposals, snapshots).select("user_id", "proposal_id", F.explode_outer("braindump_ids").alias("braindump_id"))


def _endorse(v):
    proposals = _structural(v).where("reason IS NULL").drop("reason")
    asked = v.b_proposals.select("user_id", "proposal_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"))
    tables = {**b_tables(v), "chat_inference_proposals": proposals}
    return I.endorse(tables, asked, NOW)


@query("endorse_edges", twin(
    f"""SELECT user_id, edge_id, source_concept_id, target_concept_id, original_type, created_at FROM b_edges
        UNION ALL SELECT user_id, source_concept_id || '|' || proposed_type || '|' || target_concept_id, source_concept_id, target_concept_id,
        proposed_type, {NOW} FROM judged_s WHERE reason IS NULL""", **_FAULTS))
def endorse_edges(v):
    return _endorse(v)[0]["edges"]


@query("queue_transitions", twin(
    """SELECT p.user_id, p.proposal_id, o.ord, CASE WHEN reason IS NOT NULL THEN 'not_found' WHEN ord = 1 THEN 'endorsed' ELSE 'conflict' END
       AS outcome FROM judged_s p, (VALUES (1), (2)) o(ord)""", **_FAULTS))
def queue_transitions(v):
    return _endorse(v)[1].select("user_id", "proposal_id", "ord", "outcome")


@query("queue_after", twin(
    f"""SELECT user_id, proposal_id, 'endorsed' AS status, CAST({NOW} AS BIGINT) AS resolved_at FROM judged_s WHERE reason IS NULL""", **_FAULTS))
def queue_after(v):
    return _endorse(v)[0]["chat_inference_proposals"].select("user_id", "proposal_id", "status", "resolved_at")


@query("pending_proposals", twin("SELECT user_id, proposal_id FROM judged_s WHERE reason IS NULL", **_FAULTS))
def pending_proposals(v):
    return L.pending(_structural(v)).select("user_id", "proposal_id").orderBy("proposal_id")


@query("endorsed_view", twin(
    """SELECT user_id, source_concept_id, target_concept_id, original_type AS label FROM b_edges
       UNION ALL SELECT user_id, source_concept_id, target_concept_id, proposed_type FROM judged_s WHERE reason IS NULL""", **_FAULTS))
def endorsed_view(v):
    links = v.b_edges.select("user_id", "source_concept_id", "target_concept_id", F.col("original_type").alias("label"))
    return I.endorsed_in_view(links, v.b_concepts, _structural(v).where("reason IS NULL"))


@query("housekeeping_queue", twin(
    """SELECT s.user_id, CAST(suggestion_id AS VARCHAR) AS item_id, 'concept' AS kind, new_concept_label AS left_label,
       existing_concept_id AS right_label, 0.9::DOUBLE AS similarity, md5(substr(d.text, 1, 300)) AS snippet_hash
       FROM b_suggestions s JOIN documents d ON d.doc_id = s.braindump_id % (SELECT count(*) FROM documents)
       UNION ALL SELECT p.user_id, CAST(p.proposal_id AS VARCHAR), 'type', p.label, coalesce(s.label, p.near_match_slug),
       round(p.near_match_similarity, 4), NULL FROM proposals_p p JOIN seed_types s ON s.slug = p.near_match_slug WHERE p.reason IS NULL""", **_PROPOSED))
def housekeeping_queue(v):
    details = L.suggestion_details(v.b_suggestions, v.b_concepts, _suggesting_notes(v))
    return L.housekeeping_queue(details, _queue(v), v.b_ontology).select(
        "user_id", "item_id", "kind", "left_label", "right_label", F.round("similarity", 4).alias("similarity"), F.md5("braindump_snippet").alias("snippet_hash"))
