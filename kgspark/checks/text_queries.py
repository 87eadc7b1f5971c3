"""Text, citations, logs, notes and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as X
from ..functions.vectors import text_vector
from ..plans import chat as C
from ..schema import SILENCE_TEXT
from ..sources import logs as G
from ..sources import notes as N
from ..sources.extraction import parse_extractions
from .oracle import twin
from .registry import query
from .retrieval_queries import CHAIN, paths, retrieval
from .review_queries import _FNV, vectors_of
from .views import NOW

_SILENT = SILENCE_TEXT.replace("'", "''")


# --- tokens and vectors ---------------------------------------------------------------------------
@query("fnv_tokens", twin(
    f"SELECT w AS token, count(*) AS uses, any_value(h) AS hash FROM (SELECT w, {_FNV} AS h FROM (SELECT DISTINCT w FROM tok) d) f JOIN tok USING (w) GROUP BY 1",
    tok="SELECT token AS w FROM doc_tokens"))
def fnv_tokens(v):
    """Every distinct token of the documents with its count and hash."""
    return v.doc_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses")).select(
        "token", "uses", X.fnv1a(F.col("token")).alias("hash"))


_DOCS = {"docs": "SELECT doc_id, text FROM documents", **vectors_of("docs", "doc_id", "text")}


@query("token_buckets", twin("SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, n FROM docs_cnt", **_DOCS))
def token_buckets(v):
    rows = v.table("documents").select("doc_id", F.explode(X.buckets(F.col("text"), 64)).alias("bucket"))
    return rows.groupBy("doc_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("text_vectors", twin(
    """SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(CAST(n / norm AS FLOAT)::DOUBLE, 4) AS x FROM docs_cnt JOIN docs_vec USING (doc_id)""", **_DOCS))
def text_vectors(v):
    """Token-bucket vectors of whole documents, as their non-zero entries."""
    rows = v.table("documents").select("doc_id", F.posexplode(text_vector(F.col("text"))).alias("bucket", "x"))
    return rows.where("x > 0").select("doc_id", "bucket", F.round(F.col("x").cast("double"), 4).alias("x"))


@query("udf_clean", twin(
    "SELECT doc_id, md5(trim(text, ' ')) AS cleaned_hash FROM documents"))
def udf_clean(v):
    return v.table("documents").select("doc_id", F.md5(models.clean(F.col("text"))).alias("cleaned_hash"))


@query("udf_embed", twin(
    """SELECT conv_id, turn, round(CAST(n / norm AS FLOAT)::DOUBLE, 4) AS x, CAST(bucket AS INTEGER) AS bucket FROM said_cnt JOIN said_vec USING (conv_id, turn)""",
    said="SELECT conv_id, turn, text FROM conversations", **vectors_of("said", "conv_id, turn", "text")))
def udf_embed(v):
    """Query embeddings of all conversation turns through the model seam (a plugged-in callable per batch)."""

    def model(batch: list[str]) -> list[list[float]]:
        import re
        from collections import Counter

        out = []
        for said in batch:
            counts: Counter = Counter()
            for word in re.findall(r"[^\W_]+", said.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
                h = 2166136261
                for byte in word.encode():
                    h = ((h ^ byte) * 16777619) & 0xFFFFFFFF
                counts[h % 64] += 1
            norm = sum(n * n for n in counts.values()) ** 0.5
            out.append([counts[i] / norm if norm else 0.0 for i in range(64)])
        return out

    rows = v.table("conversations").select("conv_id", "turn", F.posexplode(models.embed(F.col("text"), 64, model)).alias("bucket", "x"))
    return rows.where("x > 0").select("conv_id", "turn", F.round(F.col("x").cast("double"), 4).alias("x"), "bucket")


# --- citations and chat ---------------------------------------------------------------------------
@query("citation_numbers", twin(
    """SELECT query_id, id AS braindump_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS number, uses FROM (
       SELECT query_id, id, min(pos) AS pos, count(*) AS uses FROM (
           SELECT query_id, CAST(unnest(ids) AS BIGINT) AS id, generate_subscripts(ids, 1) AS pos FROM (
               SELECT query_id, regexp_extract_all(answer, '\\[bd:(\\d+)\\]', 1) AS ids FROM answers) q) q GROUP BY 1, 2) q""".replace("\\\\", "\\")))
def citation_numbers(v):
    cited = v.answers.select("query_id", X.citation_order(F.col("answer")).alias("o"), X.cited_notes(F.col("answer")).alias("all"))
    return cited.select("query_id", F.posexplode("o").alias("i", "braindump_id"), "all").select(
        "query_id", "braindump_id", (F.col("i") + 1).alias("number"),
        F.size(F.filter("all", lambda x: x == F.col("braindump_id"))).cast("bigint").alias("uses"))


# The built-up answers have a known shape: text [bd:c] x [edge] [bd:t] y [bd:c] with an optional cluster marker.
@query("clipboard_answers", twin(
    r"""SELECT query_id, md5(regexp_replace(replace(replace(answer, '[bd:' || c || ']', '[1]'), '[bd:' || t || ']', CASE WHEN c = t THEN '[1]' ELSE '[2]' END),
        ' ?\[edge:[^\]]*\]', '', 'g')) AS shown_hash FROM (SELECT query_id, answer, query_id // 100 AS c, query_id % 100 AS t FROM answers) q"""))
def clipboard_answers(v):
    return v.answers.select("query_id", F.md5(X.clipboard_text(F.col("answer"))).alias("shown_hash"))


@query("answer_segments", twin(
    r"""SELECT query_id, CAST(len(regexp_extract_all(answer, '\[bd:\d+\]')) AS BIGINT) AS citations,
        CAST(length(regexp_replace(regexp_replace(answer, '\[bd:\d+\]', '', 'g'), ' ?\[edge:[^\]]*\]', '', 'g')) AS BIGINT) AS prose_chars FROM answers"""))
def answer_segments(v):
    seg = v.answers.select("query_id", X.answer_segments(F.col("answer")).alias("s"))
    return seg.select(
        "query_id", F.size(F.filter("s", lambda s: s["kind"] == "citation")).cast("bigint").alias("citations"),
        F.char_length(F.array_join(F.transform(F.filter("s", lambda s: s["kind"] == "text"), lambda s: s["text"]), "")).cast("bigint").alias("prose_chars"))


_GATED = f"""SELECT query_id, CASE WHEN silent THEN '{_SILENT}' ELSE md5(answer) END AS shown, silent FROM (SELECT *,
    trim(answer, ' ') = '{_SILENT}' OR contains(lower(answer), '[cluster:') OR query_id // 100 NOT IN (SELECT doc_id FROM labels) AS silent FROM answers) q"""


def _gated(v):
    noted = v.spark.read.parquet(f"{v.dir}/labels.parquet").select("doc_id")
    return C.gate(v.answers.withColumn("doc_id", F.floor(F.col("query_id") / 100)), noted, ["doc_id"])


@query("answer_gate", twin(_GATED))
def answer_gate(v):
    """Answers about conversations whose number is no labelled document count as having no notes."""
    return _gated(v).select(
        "query_id", F.when(F.col("silent"), F.col("answer")).otherwise(F.md5("answer")).alias("shown"), "silent")


_CLUSTERS = {
    "a_place": "SELECT user_id, concept_id, CAST(substr(concept_id, 3) AS BIGINT) % 3 AS partition_id FROM a_concepts",
    "a_lines": """SELECT user_id, string_agg('[Group ' || partition_id || '] ' || members || chr(10), '' ORDER BY partition_id) AS clusters FROM (
        SELECT user_id, partition_id, string_agg(concept_id, ', ' ORDER BY concept_id) AS members FROM a_place GROUP BY 1, 2) q GROUP BY 1""",
    **CHAIN,
    "n_lines": """SELECT h.query_id, h.user_id, string_agg('[bd:' || h.braindump_id || '] ' || b.cleaned || chr(10), '' ORDER BY h.similarity DESC, h.braindump_id) AS notes
        FROM hits h JOIN a_braindumps b ON b.user_id = h.user_id AND b.braindump_id = h.braindump_id GROUP BY 1, 2""",
    "p_lines": """SELECT query_id, user_id, string_agg(source_label || ' -' || edge_type || '→ ' || target_label || chr(10), '' ORDER BY edge_id) AS paths
        FROM paths GROUP BY 1, 2""",
}


@query("grounded_context", twin(
    """SELECT q.query_id, q.user_id, md5('Clusters:' || chr(10) || c.clusters || chr(10) || 'Notes:' || chr(10) || coalesce(n.notes, '(none)' || chr(10)) ||
       chr(10) || 'Edges:' || chr(10) || coalesce(p.paths, '(none)' || chr(10))) AS context_hash
       FROM a_queries q JOIN a_lines c USING (user_id) LEFT JOIN n_lines n ON n.query_id = q.query_id AND n.user_id = q.user_id
       LEFT JOIN p_lines p ON p.query_id = q.query_id AND p.user_id = q.user_id""", **_CLUSTERS))
def grounded_context(v):
    """Prompts from the nearest notes, the seeds' edge paths and a given clustering."""
    place = v.a_concepts.select(
        "user_id", (F.substr("concept_id", F.lit(3)).cast("bigint") % 3).alias("partition_id"), "concept_id", "label"
    ).withColumn("cluster_label", F.concat(F.lit("Group "), "partition_id"))
    return C.grounded_context(
        v.a_queries, retrieval(v, floor=1.5).notes, paths(v), v.a_braindumps, place
    ).select("query_id", "user_id", F.md5("context").alias("context_hash"))


@query("udf_synthesize", twin(
    "SELECT query_id, user_id, 'notes: ' || count(*) AS answer FROM hits GROUP BY 1, 2", **CHAIN))
def udf_synthesize(v):
    """A synthesizer run over the grounded prompts; this one reports how many notes it was given."""
    none = v.a_concepts.where("false").select(
        "user_id", F.lit(0).alias("partition_id"), F.lit("").alias("cluster_label"), "concept_id", "label")
    plain = retrieval(v, floor=1.5)
    context = C.grounded_context(v.a_queries, plain.notes, plain.paths, v.a_braindumps, none)
    prompts = context.select("query_id", "user_id", F.col("context").alias("system"), F.lit("?").alias("prompt"))

    def model(systems: list[str], questions: list[str]) -> list[str]:
        return [f"notes: {s.count('[bd:')}" for s in systems]

    return models.answer(prompts, model).select("query_id", "user_id", "answer")


# --- logs -----------------------------------------------------------------------------------------
@query("log_tail", twin(
    "SELECT log_id, timestamp, level, target, message, fields FROM logs ORDER BY timestamp DESC, log_id DESC LIMIT 200"))
def log_tail(v):
    return G.tail(v.logs)


@query("log_search", twin(
    """SELECT log_id, level FROM logs WHERE level = 'ERROR' AND contains(lower(message || ' ' || target || ' ' || fields), '"k": 1')"""))
def log_search(v):
    return G.search(v.logs, "ERROR", ' "K": 1 ').select("log_id", "level")


@query("log_levels", twin("SELECT DISTINCT level FROM logs"))
def log_levels(v):
    return G.levels(v.logs)


# --- notes ----------------------------------------------------------------------------------------
@query("insert_notes", twin(
    f"""SELECT CAST(20000000 + row_number() OVER (ORDER BY conv_id, turn) AS BIGINT) AS braindump_id, conv_id || '' AS user_id, md5(text) AS text_hash,
        'pending' AS ingest_status FROM conversations WHERE length(trim(text, ' ')) > 0 AND role <> 'system'"""))
def insert_notes(v):
    """Conversation turns arrive as notes; system turns arrive blank and are refused."""
    arrivals = v.table("conversations").select(
        F.col("conv_id").cast("string").alias("user_id"), "conv_id", "turn",
        F.when(F.col("role") == "system", F.lit("  ")).otherwise(F.col("text")).alias("verbatim"))
    existing = v.table("orders").select(F.lit(20000000).cast("bigint").alias("braindump_id"))
    return N.insert_notes(arrivals, existing, NOW, ["conv_id", "turn"]).select(
        "braindump_id", "user_id", F.md5("verbatim").alias("text_hash"), "ingest_status")


@query("notes_point_read", twin(
    "SELECT braindump_id, created_at, md5(verbatim) AS text_hash FROM a_braindumps WHERE user_id = 'FURNITURE' AND ingest_status = 'complete'"))
def notes_point_read(v):
    return v.a_braindumps.where("user_id = 'FURNITURE' AND ingest_status = 'complete'").select(
        "braindump_id", "created_at", F.md5("verbatim").alias("text_hash"))


@query("pending_notes", twin("SELECT user_id, braindump_id FROM a_braindumps WHERE ingest_status = 'pending'"))
def pending_notes(v):
    return N.pending_notes(v.a_braindumps).orderBy("braindump_id")


@query("attempt_fold", twin(
    """SELECT braindump_id, coalesce(f.outcome, 'pending') AS ingest_status, coalesce(f.attempt, l.attempt) AS ingest_attempts,
       coalesce(f.attempted_at, l.attempted_at) AS last_attempt_at FROM
       (SELECT braindump_id, max(attempt) AS attempt, arg_max(attempted_at, attempt) AS attempted_at FROM attempts GROUP BY 1) l
       LEFT JOIN (SELECT braindump_id, min(attempt) AS attempt, arg_min(outcome, attempt) AS outcome, arg_min(attempted_at, attempt) AS attempted_at
           FROM attempts WHERE outcome <> 'transient' GROUP BY 1) f USING (braindump_id)"""))
def attempt_fold(v):
    return N.fold_attempts(v.attempts)


@query("corrected_notes", twin(
    """SELECT b.user_id, b.braindump_id, b.created_at, md5(coalesce(c.verbatim, b.verbatim)) AS text_hash FROM a_braindumps b LEFT JOIN (
       SELECT l_orderkey AS braindump_id, arg_max('corrected ' || l_linenumber || ' ' || l_partkey,
       {'t': l_shipdate, 'v': 'corrected ' || l_linenumber || ' ' || l_partkey}) AS verbatim FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) c
       USING (braindump_id)"""))
def corrected_notes(v):
    """Every returned line corrects the note of its order; the newest correction holds."""
    text = F.concat_ws(" ", F.lit("corrected"), "l_linenumber", "l_partkey")
    fixes = v.table("lineitem").where("l_returnflag = 'R'").join(
        v.a_notes.select(F.col("o_orderkey").alias("l_orderkey"), "user_id"), "l_orderkey"
    ).select("user_id", F.col("l_orderkey").alias("braindump_id"), text.alias("verbatim"), text.alias("cleaned"),
             F.col("l_shipdate").alias("corrected_at"))
    return N.correct_notes(v.a_braindumps, fixes).select("user_id", "braindump_id", "created_at", F.md5("verbatim").alias("text_hash"))


@query("schema_backfill", twin(
    """SELECT o_orderkey AS braindump_id, CASE WHEN o_orderstatus = 'P' THEN 'admin' ELSE c_mktsegment END AS user_id,
       'complete' AS ingest_status, CAST(0 AS INTEGER) AS ingest_attempts FROM orders JOIN customer ON o_custkey = c_custkey"""))
def schema_backfill(v):
    """Rows of an older layout: no status columns, and no tenant on some."""
    old = v.a_notes.select(
        F.col("o_orderkey").alias("braindump_id"), F.when(F.col("o_orderstatus") != "P", F.col("user_id")).alias("user_id"))
    return N.upgrade(old, "braindumps", "admin").select("braindump_id", "user_id", "ingest_status", "ingest_attempts")


# --- extraction -----------------------------------------------------------------------------------
def payloads(v):
    """Extractions of all documents; those of labelled toxic documents are damaged in one of two ways."""
    toxic = v.spark.read.parquet(f"{v.dir}/labels.parquet").where("toxic = 1").select(
        F.col("doc_id").alias("braindump_id"), F.col("quality").alias("q"))
    return v.extractions.join(toxic, "braindump_id", "left").select(
        "user_id", "braindump_id",
        F.when(F.col("q") == 1, F.lit("not json")).when(F.col("q") == 0, F.lit('{"concepts":[{"label":" "}]}')).otherwise(F.col("payload")).alias("payload"))


_GOOD = "(SELECT doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) t USING (doc_id))"


@query("parse_extraction", twin(
    f"""SELECT user_id, braindump_id, unnest(t) AS label, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos FROM long_lists
        WHERE braindump_id IN {_GOOD}"""))
def parse_extraction(v):
    return parse_extractions(payloads(v)).concepts.select("user_id", "braindump_id", "label", "pos")


@query("parse_rejects", twin(
    "SELECT d.source AS user_id, doc_id AS braindump_id, CASE WHEN quality = 1 THEN 'not_json' ELSE 'concept_label' END AS reason FROM labels JOIN documents d USING (doc_id) WHERE toxic = 1"))
def parse_rejects(v):
    return parse_extractions(payloads(v)).rejects


@query("udf_extract", twin(
    """SELECT user_id, braindump_id, len(list_filter(toks, lambda t: true)) AS labels FROM doc_lists WHERE len(toks) > 0
       UNION ALL SELECT user_id, braindump_id, 0 FROM doc_lists WHERE len(toks) = 0"""))
def udf_extract(v):
    """An extractor run over whole documents: every word becomes a concept."""
    import json
    import re

    def model(texts: list[str], vocabularies: list[list[str]]) -> list[str]:
        return [json.dumps({"concepts": [{"label": w} for w in re.findall(r"[^\W_]+", t)]}) for t in texts]

    notes = v.table("documents").select(F.col("source").alias("user_id"), F.col("doc_id").alias("braindump_id"), F.col("text").alias("verbatim"))
    slugs = notes.select("user_id").distinct().withColumn("slugs", F.array(F.lit("relates_to")))
    parsed = parse_extractions(models.extract(notes, slugs, model))
    counted = parsed.concepts.groupBy("user_id", "braindump_id").agg(F.count(F.lit(1)).alias("labels"))
    return notes.select("user_id", "braindump_id").join(counted, ["user_id", "braindump_id"], "left").na.fill(0)
