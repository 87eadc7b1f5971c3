"""Scans, history, provenance, snapshot and change-feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hop_list, id_list, month_year, now_seconds
from ..operators import history as H
from ..operators import lookups as L
from ..operators import provenance as P
from ..plans import snapshot as S
from ..session import scratch_path
from ..sources import embeddings as E
from ..sources.changes import ChangeLog
from .oracle import twin
from .registry import query
from .views import NOW, SINCE

_LATEST = "SELECT user_id, edge_id, arg_max(type_slug, seq_index) AS current_type FROM a_type_history GROUP BY 1, 2"


# --- history --------------------------------------------------------------------------------------
@query("edges_current_type", twin("SELECT user_id, edge_id, original_type, current_type FROM a_typed"))
def edges_current_type(v):
    return H.with_current_type(v.a_edges, v.a_type_history).select("user_id", "edge_id", "original_type", "current_type")


@query("edges_wearing_type", twin("SELECT user_id, edge_id FROM a_typed WHERE current_type = 'retag_F'"))
def edges_wearing_type(v):
    return H.edges_wearing(v.a_edges, v.a_type_history, "retag_F").select("user_id", "edge_id")


@query("latest_history_window", twin(
    """SELECT user_id, edge_id, seq_index, type_slug, created_at FROM (SELECT *, row_number() OVER
       (PARTITION BY user_id, edge_id ORDER BY seq_index DESC) AS rn FROM a_type_history) q WHERE rn = 1"""))
def latest_history_window(v):
    return H.latest_rows(v.a_type_history)


@query("next_seq", twin(
    """SELECT e.user_id, e.edge_id, CAST(coalesce(max(h.seq_index), -1) + 1 AS BIGINT) AS next_seq FROM a_edges e
       LEFT JOIN a_type_history h USING (user_id, edge_id) GROUP BY 1, 2"""))
def next_seq(v):
    return H.next_seq(v.a_edges, v.a_type_history)


@query("retagged_since", twin(
    f"""SELECT user_id, edge_id, source_concept_id, target_concept_id, original_type, current_type FROM a_typed e
        WHERE created_at <= {SINCE} AND EXISTS (SELECT 1 FROM a_type_history h WHERE h.user_id = e.user_id AND
        h.edge_id = e.edge_id AND h.seq_index > 0 AND h.created_at > {SINCE})"""))
def retagged_since(v):
    return H.retagged_since(v.a_edges, v.a_type_history, SINCE).drop("created_at")


# --- provenance -----------------------------------------------------------------------------------
@query("edge_asserters", twin(
    """SELECT user_id, edge_id, string_agg(CAST(braindump_id AS VARCHAR), ',' ORDER BY braindump_id) AS notes
       FROM a_edge_provenance JOIN a_edges USING (user_id, edge_id) GROUP BY 1, 2"""))
def edge_asserters(v):
    rows = P.of_known_parents(v.a_edge_provenance, v.a_edges, "edge_id")
    return P.packed(rows, "edge_id").select("user_id", "edge_id", F.array_join("braindump_ids", ",").alias("notes"))


@query("concept_extractors", twin(
    "SELECT user_id, concept_id, braindump_id FROM a_concept_provenance JOIN a_concepts USING (user_id, concept_id)"))
def concept_extractors(v):
    return P.of_known_parents(v.a_concept_provenance, v.a_concepts, "concept_id")


def inferred(v):
    """Every contradiction of graph B counts as endorsed structurally, every generic relation thematically."""
    return v.b_edges.where("original_type <> 'affects'").select(
        "user_id", "edge_id", F.substr("target_concept_id", F.lit(3)).cast("bigint").alias("chat_inference_id"),
        F.expr("CASE original_type WHEN 'contradicts' THEN 'structural_inference' ELSE 'thematic_inference' END").alias("mode"),
        F.lit(None).cast("string").alias("snapshot_id"), "created_at",
    )


INFERRED = {"b_inferred": """SELECT user_id, edge_id, CAST(substr(target_concept_id, 3) AS BIGINT) AS chat_inference_id,
    CASE original_type WHEN 'contradicts' THEN 'structural_inference' ELSE 'thematic_inference' END AS mode, created_at
    FROM b_edges WHERE original_type <> 'affects'"""}


@query("origin_rollup", twin(
    """SELECT user_id, edge_id, 'braindump' AS origin, count(*) AS asserters FROM b_edge_provenance GROUP BY 1, 2
       UNION ALL SELECT user_id, edge_id, mode, count(*) FROM b_inferred GROUP BY 1, 2, 3""", **INFERRED))
def origin_rollup(v):
    return P.origin_rollup(v.b_edge_provenance, inferred(v))


@query("cluster_evidence", twin(
    """SELECT DISTINCT e.user_id, s.community AS cluster_id, p.braindump_id FROM b_edges e
       JOIN assignment s ON s.user_id = e.user_id AND s.concept_id = e.source_concept_id
       JOIN assignment t ON t.user_id = e.user_id AND t.concept_id = e.target_concept_id AND s.community = t.community
       JOIN b_edge_provenance p ON p.user_id = e.user_id AND p.edge_id = e.edge_id
       WHERE e.source_concept_id <> e.target_concept_id"""))
def cluster_evidence(v):
    return P.cluster_evidence(v.assignment.withColumnRenamed("community", "cluster_id"), v.b_edges, v.b_edge_provenance)


# --- point reads and listings ---------------------------------------------------------------------
@query("concept_lookup", twin("SELECT user_id, label, min(concept_id) AS concept_id FROM a_concepts GROUP BY 1, 2"))
def concept_lookup(v):
    return L.concept_ids_by_label(v.a_concepts)


@query("concept_listing", twin("SELECT user_id, concept_id, label, created_at FROM a_concepts WHERE user_id = 'BUILDING'"))
def concept_listing(v):
    return L.of_tenant(v.a_concepts, "BUILDING").orderBy("concept_id")


@query("concepts_exist", twin(
    """SELECT DISTINCT user_id, concept_id FROM (SELECT c_mktsegment AS user_id, 'c:' || c_custkey AS concept_id FROM customer) q
       SEMI JOIN a_concepts USING (user_id, concept_id)"""))
def concepts_exist(v):
    """Which customers are concepts of their tenant."""
    ids = v.table("customer").select(F.col("c_mktsegment").alias("user_id"), F.concat(F.lit("c:"), "c_custkey").alias("concept_id"))
    return L.known_concepts(ids, v.a_concepts)


@query("edge_lookup", twin(
    """SELECT edge_id, user_id, source_concept_id, target_concept_id, original_type, created_at FROM b_edges
       SEMI JOIN (SELECT user_id, source_concept_id, target_concept_id, 'contradicts' AS original_type FROM b_edges
                  WHERE original_type = 'affects') k USING (user_id, source_concept_id, target_concept_id, original_type)"""))
def edge_lookup(v):
    """Contradictions that stand beside an 'affects' edge of the same pair."""
    keys = v.b_edges.where("original_type = 'affects'").withColumn("original_type", F.lit("contradicts"))
    return L.find_edges(keys, v.b_edges)


@query("edge_endpoints", twin("SELECT user_id, source_concept_id, target_concept_id FROM b_edges"))
def edge_endpoints(v):
    return L.edge_endpoints(v.b_edges)


@query("edge_with_labels", twin(
    """SELECT user_id, edge_id, source_concept_id AS source_label, target_concept_id AS target_label, current_type FROM a_typed"""))
def edge_with_labels(v):
    return L.endpoints_and_type(v.a_edges, v.a_type_history, v.a_concepts)


@query("traversable_hops", twin(
    """SELECT DISTINCT user_id, source_concept_id, original_type AS edge_type, target_concept_id FROM a_edges e
       WHERE (user_id, source_concept_id, original_type, target_concept_id) IN
       (SELECT (user_id, source_concept_id, current_type, target_concept_id) FROM a_typed)"""))
def traversable_hops(v):
    """Edges still traversable under the type they were first given."""
    hops = v.a_edges.select("user_id", "source_concept_id", F.col("original_type").alias("edge_type"), "target_concept_id")
    return L.traversable(hops, v.a_edges, v.a_type_history)


@query("tenant_scope", twin(
    "SELECT user_id, count(*) AS edges, count(DISTINCT source_concept_id) AS sources FROM a_edges WHERE user_id = 'MACHINERY' GROUP BY 1"))
def tenant_scope(v):
    return L.of_tenant(v.a_edges, "MACHINERY").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("edges"), F.count_distinct("source_concept_id").alias("sources"))


# --- snapshot and delta ---------------------------------------------------------------------------
def _topology(v):
    return S.topology(v.a_concepts, v.a_edges, v.a_type_history)


@query("topology_snapshot", twin(
    """SELECT user_id, edge_id, source_concept_id, target_concept_id, original_type, current_type, created_at FROM a_typed"""))
def topology_snapshot(v):
    return _topology(v).edges


@query("snapshot_sink_roundtrip", twin(
    """SELECT user_id, edge_id, source_concept_id, target_concept_id, original_type, current_type, created_at FROM a_typed"""))
def snapshot_sink_roundtrip(v):
    """The snapshot written as gzip JSON and read back."""
    path = scratch_path(v.spark, "snapshot")
    S.write_snapshot(_topology(v), path)
    return S.read_snapshot(v.spark, path).edges


@query("view_graph_edges", twin(
    """SELECT user_id, edge_id, source_concept_id, target_concept_id, current_type AS label FROM a_typed
       WHERE source_concept_id <> target_concept_id"""))
def view_graph_edges(v):
    return S.view_edges(_topology(v))


_RANKED = {"ranks": """SELECT user_id, community, size, first_member, CAST(rn - 1 AS INTEGER) AS partition_id,
    'Group ' || rn || ' for this session' AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY size DESC, first_member) AS rn FROM (
        SELECT user_id, community, count(*) AS size, min(concept_id) AS first_member FROM assignment GROUP BY 1, 2) q) q"""}


@query("view_graph_nodes", twin(
    """SELECT c.user_id, c.concept_id, c.label, coalesce(r.partition_id, -1) AS cluster_group FROM b_concepts c
       LEFT JOIN assignment a ON a.user_id = c.user_id AND a.concept_id = c.concept_id AND c.concept_id LIKE 's:%'
       LEFT JOIN ranks r ON r.user_id = a.user_id AND r.community = a.community""",
    ranks=_RANKED["ranks"].replace("FROM assignment", "FROM assignment WHERE concept_id LIKE 's:%'")))
def view_graph_nodes(v):
    """Only suppliers are clustered here, so parts show the group of unclustered nodes."""
    some = v.assignment.where("concept_id LIKE 's:%'")
    return S.view_nodes(S.topology(v.b_concepts, v.b_edges, v.b_history, some)).withColumnRenamed("group", "cluster_group")


def _delta(v):
    return S.delta_since(v.a_concepts, v.a_edges, v.a_type_history, v.tombstones, SINCE, NOW)


_FEED = {
    "feed": f"""SELECT user_id, 'add_concept' AS change, concept_id AS id, label AS payload FROM a_concepts WHERE created_at > {SINCE}
        UNION ALL SELECT user_id, 'add_edge', edge_id, current_type FROM a_typed WHERE created_at > {SINCE}
        UNION ALL SELECT user_id, 'delete_' || kind, entity_id, '' FROM tombstones WHERE created_at > {SINCE}
        UNION ALL SELECT user_id, 'retag_edge', edge_id, current_type FROM a_typed e WHERE created_at <= {SINCE} AND EXISTS (
            SELECT 1 FROM a_type_history h WHERE h.user_id = e.user_id AND h.edge_id = e.edge_id AND h.seq_index > 0 AND h.created_at > {SINCE})""",
}


@query("delta_since", twin("SELECT user_id, change, id, payload FROM feed", **_FEED))
def delta_since(v):
    return _delta(v).rows()


# Five commits: additions with ids of even length, of odd length (so rows of one second lie in both), retags, deleted edges, deleted concepts.
_LOG = {
    "commits": f"""SELECT user_id, 'add_concept' AS change, concept_id AS id, label AS payload, created_at, 1 + length(concept_id) % 2 AS version FROM a_concepts WHERE created_at > {SINCE}
        UNION ALL SELECT user_id, 'add_edge', edge_id, original_type, created_at, 1 + length(edge_id) % 2 FROM a_edges WHERE created_at > {SINCE}
        UNION ALL SELECT user_id, 'retag_edge', edge_id, type_slug, created_at, 3 FROM a_type_history WHERE seq_index > 0 AND created_at > {SINCE}
        UNION ALL SELECT user_id, 'delete_' || kind, entity_id, '', created_at, CASE kind WHEN 'edge' THEN 4 ELSE 5 END FROM tombstones WHERE created_at > {SINCE}""",
    "readings": "SELECT 0 AS low, 1 AS high UNION ALL SELECT 1, 3 UNION ALL SELECT 3, 5",
    "told": """SELECT r.low, c.*, bool_or(starts_with(change, 'add_')) OVER w AS adds, bool_or(starts_with(change, 'delete_')) OVER w AS deletes,
        max(CASE WHEN change = 'retag_edge' THEN {'t': created_at, 'p': payload} END) OVER w AS retag FROM readings r JOIN commits c ON c.version > r.low AND c.version <= r.high
        WINDOW w AS (PARTITION BY r.low, c.user_id, split_part(c.change, '_', 2), c.id)""",
}


@query("delta_since_version", twin(
    """SELECT DISTINCT CAST(low AS INTEGER) AS from_version, user_id, change, id, CASE WHEN change IN ('add_edge', 'retag_edge') THEN coalesce(retag.p, payload) ELSE payload END AS payload
       FROM told WHERE CASE WHEN starts_with(change, 'delete_') THEN TRUE WHEN deletes THEN FALSE WHEN change = 'retag_edge' THEN NOT adds ELSE TRUE END""", **_LOG))
def delta_since_version(v):
    """Three readings of a log of five commits, each from the cursor of the one before: rows of one second that lie in two commits come once each."""
    log = ChangeLog(v.spark, scratch_path(v.spark, "log"))
    late = lambda df: df.where(F.col("created_at") > SINCE)
    concepts = late(v.a_concepts).select("user_id", F.lit("add_concept").alias("change"), F.col("concept_id").alias("id"), "label", "created_at")
    edges = late(v.a_edges).select("user_id", F.lit("add_edge").alias("change"), F.col("edge_id").alias("id"), "source_concept_id", "target_concept_id",
                                   "original_type", F.col("original_type").alias("current_type"), "created_at")
    added = concepts.unionByName(edges, allowMissingColumns=True)
    gone = late(v.tombstones).select("user_id", F.concat(F.lit("delete_"), "kind").alias("change"), F.col("entity_id").alias("id"), "created_at")
    retags = late(v.a_type_history).where("seq_index > 0").select("user_id", F.lit("retag_edge").alias("change"), F.col("edge_id").alias("id"),
                                                                 F.col("type_slug").alias("current_type"), "created_at")
    commits = [added.where(F.length("id") % 2 == 0), added.where(F.length("id") % 2 == 1), retags, gone.where("change = 'delete_edge'"), gone.where("change = 'delete_concept'")]
    found, cursor = [], 0
    for upto, batch in ((1, commits[:1]), (3, commits[1:3]), (5, commits[3:])):
        for rows in batch:
            log.append(rows)
        delta = S.delta_since_version(log, cursor)
        found.append(delta.rows().select(F.lit(cursor).alias("from_version"), "user_id", "change", "id", "payload"))
        cursor = delta.cursor
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("apply_delta", twin(
    f"""SELECT user_id, edge_id, source_concept_id, target_concept_id, original_type,
        CASE WHEN created_at <= {SINCE} AND NOT late THEN old_type ELSE current_type END AS current_type, created_at FROM (
        SELECT e.*, h.late, h.old_type FROM a_typed e JOIN (
            SELECT user_id, edge_id, bool_or(seq_index > 0 AND created_at > {SINCE}) AS late,
            arg_max(type_slug, seq_index) FILTER (WHERE created_at <= {SINCE} OR seq_index = 0) AS old_type
            FROM a_type_history GROUP BY 1, 2) h USING (user_id, edge_id)) e
        WHERE NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.user_id = e.user_id AND t.created_at > {SINCE} AND
            ((t.kind = 'edge' AND t.entity_id = e.edge_id) OR
             (t.kind = 'concept' AND t.entity_id = e.source_concept_id) OR (t.kind = 'concept' AND t.entity_id = e.target_concept_id)))"""))
def apply_delta(v):
    """The snapshot held at the cursor, brought up to date by the delta."""
    old = v.a_type_history.where((F.col("created_at") <= SINCE) | (F.col("seq_index") == 0))
    held = S.topology(
        v.a_concepts.where(F.col("created_at") <= SINCE), v.a_edges.where(F.col("created_at") <= SINCE), old
    )
    return S.apply_delta(held, _delta(v)).edges


@query("apply_delta_concepts", twin(
    f"""SELECT user_id, concept_id, label, created_at FROM a_concepts c WHERE NOT EXISTS (SELECT 1 FROM tombstones t
        WHERE t.user_id = c.user_id AND t.kind = 'concept' AND t.entity_id = c.concept_id AND t.created_at > {SINCE})"""))
def apply_delta_concepts(v):
    held = S.topology(v.a_concepts.where(F.col("created_at") <= SINCE), v.a_edges, v.a_type_history)
    return S.apply_delta(held, _delta(v)).concepts


# --- embeddings -----------------------------------------------------------------------------------
@query("embedding_exists", twin(
    """SELECT user_id, braindump_id, CAST(braindump_id % (SELECT count(*) FROM embeddings) IN (SELECT vec_id FROM embeddings) AS BOOLEAN)
       AS present FROM a_note_ids"""))
def embedding_exists(v):
    has = E.with_vector(v.a_note_ids, v.a_braindump_embeddings, "braindump_id").withColumn("present", F.lit(True))
    lacks = E.without_vector(v.a_note_ids, v.a_braindump_embeddings, "braindump_id").withColumn("present", F.lit(False))
    return has.unionByName(lacks).select("user_id", "braindump_id", "present")


@query("embedding_upkeep", twin(
    """SELECT user_id, concept_id, len(embedding) AS dim FROM a_concept_embeddings c WHERE NOT EXISTS (
       SELECT 1 FROM tombstones t WHERE t.user_id = c.user_id AND t.kind = 'concept' AND t.entity_id = c.concept_id)"""))
def embedding_upkeep(v):
    """Vectors of tombstoned concepts deleted, then every vector inserted-or-ignored again on the rest."""
    gone = v.tombstones.where("kind = 'concept'").select("user_id", F.col("entity_id").alias("concept_id")).distinct()
    kept = E.delete_vectors(v.a_concept_embeddings, gone, "concept_id")
    return E.insert_vectors(kept, kept, "concept_id", 64).select("user_id", "concept_id", F.size("embedding").cast("bigint").alias("dim"))


@query("month_year", twin(
    """SELECT user_id, braindump_id, strftime(make_timestamp(created_at * 1000000), '%B %Y') AS shown FROM a_note_ids"""))
def month_year_query(v):
    return v.a_note_ids.select("user_id", "braindump_id", month_year(F.col("created_at")).alias("shown"))


@query("json_id_lists", twin(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderkey || ',' || o_custkey END AS ids FROM orders"""))
def json_id_lists(v):
    """Id lists kept as JSON text: of two ids, of one, or broken off, which reads as empty."""
    key, other = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("["), key, F.lit(","))).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("["), other, F.lit("]")))
        .otherwise(F.concat(F.lit(" ["), key, F.lit(", "), other, F.lit("]")))
    )
    return v.table("orders").select("o_orderkey", F.array_join(id_list(text).cast("array<string>"), ",").alias("ids"))


@query("hop_lists", twin(
    """SELECT user_id, edge_id, CASE length(edge_id) % 4 WHEN 0 THEN source_concept_id || ' ' || original_type || ' ' || target_concept_id
         WHEN 1 THEN source_concept_id || ' ' || original_type || ' ' || target_concept_id || ';' || target_concept_id || ' ' || original_type || ' ' || source_concept_id ELSE '' END AS hops FROM a_edges"""))
def hop_lists(v):
    """Evidence paths kept as JSON text: of one hop, of two, with a hop that lacks its target, or broken off; the last two read as empty."""
    hop = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, ("source_concept_id", "edge_type", "target_concept_id"))])
    one, back = hop("source_concept_id", "original_type", "target_concept_id"), hop("target_concept_id", "original_type", "source_concept_id")
    kind = F.length("edge_id") % 4
    text = (
        F.when(kind == 0, F.to_json(F.array(one))).when(kind == 1, F.to_json(F.array(one, back)))
        .when(kind == 2, F.to_json(F.array(hop("source_concept_id", "original_type")))).otherwise(F.expr("concat('[', to_json(struct(source_concept_id)))"))
    )
    told = F.transform(hop_list(text), lambda h: F.concat_ws(" ", h["source_concept_id"], h["edge_type"], h["target_concept_id"]))
    return v.a_edges.select("user_id", "edge_id", F.array_join(told, ";").alias("hops"))


@query("note_ages", twin(f"SELECT user_id, braindump_id, {NOW} - created_at AS age FROM a_note_ids"))
def note_ages(v):
    """Seconds since each note by a clock that the caller sets."""
    return v.a_note_ids.select("user_id", "braindump_id", (now_seconds(NOW) - F.col("created_at")).alias("age"))
