"""The views of ``views.py`` as DuckDB common table expressions."""

from __future__ import annotations

import re

from ..schema import ONTOLOGY_SEED, SILENCE_TEXT
from .views import NOW, SINCE


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SEED_ROWS = ", ".join(
    f"({i}, {_quote(s)}, {_quote(l)}, {_quote(d)})" for i, (s, l, d) in enumerate(ONTOLOGY_SEED)
)

CTES: dict[str, str] = {
    "a_notes": """SELECT o.*, c.c_mktsegment AS user_id FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "a_assert": """SELECT *, source || '|' || type || '|' || target AS edge_id FROM (
        SELECT n.user_id, 'c:' || n.o_custkey AS source,
               lower(replace(substr(n.o_orderpriority, 3), ' ', '_')) AS type,
               'p:' || l.l_partkey AS target, n.o_orderkey AS note,
               CAST(floor(epoch(n.o_orderdate)) AS BIGINT) AS asserted_at,
               l.l_returnflag, l.l_linestatus, CAST(floor(epoch(l.l_shipdate)) AS BIGINT) AS shipped_at
        FROM lineitem l JOIN a_notes n ON l.l_orderkey = n.o_orderkey) q""",
    "a_edges": """SELECT user_id, edge_id, any_value(source) AS source_concept_id, any_value(target) AS target_concept_id,
        any_value(type) AS original_type, min(asserted_at) AS created_at FROM a_assert GROUP BY 1, 2""",
    "a_edge_provenance": "SELECT DISTINCT user_id, edge_id, note AS braindump_id FROM a_assert",
    "a_ends": """SELECT user_id, source AS concept_id, note, asserted_at FROM a_assert
        UNION ALL SELECT user_id, target, note, asserted_at FROM a_assert""",
    "a_concepts": """SELECT user_id, concept_id, concept_id AS label, min(asserted_at) AS created_at
        FROM a_ends GROUP BY 1, 2""",
    "a_concept_provenance": "SELECT DISTINCT user_id, concept_id, note AS braindump_id FROM a_ends",
    "a_type_history": """SELECT user_id, edge_id, CAST(0 AS BIGINT) AS seq_index, original_type AS type_slug, created_at FROM a_edges
        UNION ALL
        SELECT user_id, edge_id, row_number() OVER (PARTITION BY user_id, edge_id ORDER BY shipped_at, note, l_linestatus),
               'retag_' || l_linestatus, shipped_at FROM a_assert WHERE l_returnflag = 'R'""",
    "a_typed": """SELECT e.*, coalesce(h.current_type, '') AS current_type FROM a_edges e LEFT JOIN (
        SELECT user_id, edge_id, arg_max(type_slug, seq_index) AS current_type FROM a_type_history GROUP BY 1, 2) h
        USING (user_id, edge_id)""",
    "a_braindumps": """SELECT n.user_id, n.o_orderkey AS braindump_id, d.text AS verbatim, trim(d.text, ' ') AS cleaned,
        CAST(floor(epoch(n.o_orderdate)) AS BIGINT) AS created_at,
        CASE n.o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'pending' ELSE 'failed' END AS ingest_status
        FROM a_notes n JOIN documents d ON d.doc_id = n.o_orderkey % (SELECT count(*) FROM documents)""",
    "a_note_ids": """SELECT user_id, o_orderkey AS braindump_id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_at FROM a_notes""",
    "a_concept_embeddings": """SELECT c.user_id, c.concept_id, e.embedding FROM a_concepts c JOIN embeddings e
        ON e.vec_id = CAST(substr(c.concept_id, 3) AS BIGINT) % (SELECT count(*) FROM embeddings)""",
    "a_braindump_embeddings": """SELECT n.user_id, n.o_orderkey AS braindump_id, e.embedding FROM a_notes n JOIN embeddings e
        ON e.vec_id = n.o_orderkey % (SELECT count(*) FROM embeddings)""",
    "users": "SELECT DISTINCT c_mktsegment AS user_id FROM customer",
    "a_queries": """SELECT CAST(label AS BIGINT) AS query_id, user_id, embedding FROM (
        SELECT label, list(x ORDER BY i) AS embedding FROM (
            SELECT label, i, CAST(avg(x) AS FLOAT) AS x FROM (
                SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) q
            GROUP BY 1, 2) q GROUP BY 1) q, users""",
    "vector_queries": """SELECT vec_id AS query_id,
        (SELECT list(user_id ORDER BY user_id) FROM users)[CAST(vec_id % (SELECT count(*) FROM users) AS INTEGER) + 1] AS user_id,
        embedding FROM embeddings""",
    "b_suppliers": """SELECT s_suppkey, s_nationkey, CAST(n_regionkey AS VARCHAR) AS user_id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "b_users": "SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS user_id FROM nation",
    "b_assert": """SELECT *, source || '|' || type || '|' || target AS edge_id FROM (
        SELECT s.user_id, 's:' || l_suppkey AS source,
            CASE l_returnflag WHEN 'A' THEN 'affects' WHEN 'N' THEN 'relates_to' ELSE 'contradicts' END AS type,
            'p:' || l_partkey AS target, l_orderkey AS note, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS asserted_at
        FROM lineitem JOIN b_suppliers s ON l_suppkey = s_suppkey) q""",
    "b_edges": """SELECT user_id, edge_id, any_value(source) AS source_concept_id, any_value(target) AS target_concept_id,
        any_value(type) AS original_type, min(asserted_at) AS created_at FROM b_assert GROUP BY 1, 2""",
    "b_edge_provenance": "SELECT DISTINCT user_id, edge_id, note AS braindump_id FROM b_assert",
    "b_ends": """SELECT user_id, source AS concept_id, note, asserted_at FROM b_assert
        UNION ALL SELECT user_id, target, note, asserted_at FROM b_assert""",
    "b_concepts": """SELECT user_id, concept_id, concept_id AS label, min(asserted_at) AS created_at FROM b_ends GROUP BY 1, 2""",
    "b_concept_provenance": "SELECT DISTINCT user_id, concept_id, note AS braindump_id FROM b_ends",
    "seed_types": f"SELECT * FROM (VALUES {_SEED_ROWS}) AS t(i, slug, label, description)",
    "b_ontology": """SELECT user_id, CAST(i + 1 AS BIGINT) AS ontology_id, slug, label, description FROM b_users, seed_types""",
    "b_suggestions": f"""SELECT s.user_id, s.s_suppkey AS suggestion_id, n.braindump_id,
        's:' || s.s_suppkey AS new_concept_label, 's:' || s.s_suppkey AS new_concept_id, 's:' || s.before AS existing_concept_id,
        0.9::DOUBLE AS similarity, 'pending' AS status, CAST({NOW} AS BIGINT) AS created_at
        FROM (SELECT a.*, b.s_suppkey AS before FROM b_places a JOIN b_places b ON a.s_nationkey = b.s_nationkey AND a.place // 2 = b.place) s
        LEFT JOIN (SELECT l_suppkey, min(l_orderkey) AS braindump_id FROM lineitem GROUP BY 1) n ON n.l_suppkey = s.s_suppkey
        """,
    "b_places": "SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM b_suppliers",
    "b_deletes": """SELECT DISTINCT a.user_id, a.note AS braindump_id FROM b_assert a JOIN orders o ON o.o_orderkey = a.note
        WHERE o.o_orderstatus = 'P'""",
    "b_note_ids": "SELECT DISTINCT user_id, note AS braindump_id FROM b_assert",
    "assignment": """SELECT user_id, concept_id, CAST(substr(concept_id, 3) AS BIGINT) % 8 AS community FROM b_concepts""",
    "b_proposals": """SELECT user_id, number AS proposal_id, a.source_concept_id AS source_concept_id, target_concept_id,
        CASE WHEN a.original_type = b.original_type THEN 'depends_on'
             WHEN a.source_concept_id = b.source_concept_id THEN ' ' ELSE 'invents' END AS proposed_type,
        a.source_concept_id AS hop_source,
        CASE WHEN number % 3 = 0 THEN 'helps' ELSE a.original_type END AS hop_type,
        CASE WHEN number % 5 = 0 THEN b.source_concept_id ELSE target_concept_id END AS hop_target
        FROM (SELECT user_id, target_concept_id, CAST(substr(target_concept_id, 3) AS BIGINT) AS number,
            arg_min({'source_concept_id': source_concept_id, 'original_type': original_type}, edge_id) AS a,
            arg_max({'source_concept_id': source_concept_id, 'original_type': original_type}, edge_id) AS b
            FROM b_edges GROUP BY 1, 2) q""",
    "tombstones": f"""SELECT c.c_mktsegment AS user_id, 'concept' AS kind, 'c:' || c.c_custkey AS entity_id,
            CAST({SINCE - 50} AS BIGINT) + event_id % 100 AS created_at
        FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE event_type = 'error'
        UNION ALL
        SELECT p.user_id, 'edge', p.edge_id, CAST({SINCE - 50} AS BIGINT) + event_id % 100
        FROM events e JOIN a_edge_provenance p ON e.event_id = p.braindump_id WHERE event_type = 'signup'""",
    "attempts": """SELECT user_id AS braindump_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS attempt,
        CASE event_type WHEN 'error' THEN 'transient' WHEN 'signup' THEN 'failed' ELSE 'complete' END AS outcome,
        CAST(floor(epoch(ts)) AS BIGINT) AS attempted_at FROM events""",
    "logs": """SELECT event_id AS log_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
        'user::' || user_id AS target, event_type AS message, props AS fields FROM events""",
    "doc_lists": r"""SELECT source AS user_id, doc_id AS braindump_id,
        list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\p{L}\p{M}\p{N}]+'), lambda t: t <> '') AS toks FROM documents""",
    "doc_tokens": """SELECT user_id, braindump_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM doc_lists""",
    "long_lists": "SELECT user_id, braindump_id, list_filter(toks, lambda t: length(t) >= 5) AS t FROM doc_lists",
    "x_labels": """SELECT user_id, braindump_id, label, min(pos) AS pos FROM (
        SELECT user_id, braindump_id, unnest(t) AS label, generate_subscripts(t, 1) AS pos FROM long_lists) q GROUP BY 1, 2, 3""",
    "x_edges": """SELECT user_id, braindump_id, source, type, target, min(pos) AS pos FROM (
        SELECT user_id, braindump_id, pos, source, target,
            CASE WHEN h = 13 THEN 'invented_type' ELSE s.slug END AS type FROM (
            SELECT *, (length(source) * 7 + length(target)) % 14 AS h FROM (
                SELECT user_id, braindump_id, unnest(t[:-2]) AS source, unnest(t[2:]) AS target,
                    generate_subscripts(t[2:], 1) AS pos FROM long_lists WHERE len(t) > 1) q) q
            LEFT JOIN seed_types s ON s.i = h) q GROUP BY 1, 2, 3, 4, 5""",
    "answers": f"""SELECT conv_id * 100 + turn AS query_id,
        CASE WHEN (conv_id * 100 + turn) % 11 = 0 THEN {_quote(SILENCE_TEXT + ' ')}
             WHEN (conv_id * 100 + turn) % 7 = 0 THEN marked || ' [Cluster:1]' ELSE marked END AS answer
        FROM (SELECT *, text || ' [bd:' || conv_id || '] x [edge:a -y→ b] [bd:' || turn || '] y [bd:' || conv_id || ']' AS marked
              FROM conversations WHERE role = 'assistant') q""",
    "proposed_types": """SELECT CAST(p_partkey % 5 AS VARCHAR) AS user_id, p_partkey AS proposal_id,
        CASE WHEN p_brand = 'Brand#7' THEN s.slug || '!' WHEN p_size = 13 THEN 'helps'
             ELSE ' ' || replace(p_name, ' ', '_') END AS slug,
        CASE WHEN p_brand = 'Brand#7' THEN s.label ELSE p_name END AS label,
        CASE WHEN p_brand = 'Brand#7' THEN s.description WHEN p_size = 1 THEN '  '
             ELSE p_type || ' ' || p_brand || ' ' || p_name END AS description,
        CASE WHEN p_size = 50 THEN 'nowhere' WHEN p_size > 25 THEN s.slug END AS merge_of
        FROM part JOIN seed_types s ON s.i = p_size % 13""",
}



def twin(body: str, recursive: bool = False, **extra: str) -> str:
    """``body`` behind the views it uses (and ``extra`` named ones), in dependency order."""
    known = {**CTES, **extra}
    names = re.compile(r"\b(" + "|".join(sorted(known, key=len, reverse=True)) + r")\b")
    order: list[str] = []
    open_: set[str] = set()

    def visit(sql: str) -> None:
        for name in names.findall(sql):
            if name in order or name in open_:
                continue
            open_.add(name)
            visit(known[name])
            open_.remove(name)
            order.append(name)

    visit(body)
    if not order:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + body
