"""Table schemas (as DDL) and the constants that define the semantics."""

# --- fixed values: thresholds, limits and texts ------------------------------------------------
ACCRETION_SIMILARITY = 0.95
SUGGESTION_FLOOR_SIMILARITY = 0.80
TYPE_MERGE_THRESHOLD = 0.995
SEED_SIMILARITY_FLOOR = 0.2
SEED_TOP_K = 5
EXPAND_DEPTH = 2
BRAINDUMP_TOP_K = 10
MAX_LEVELS = 64
MAX_PASSES = 100
GAIN_EPSILON = 1e-12
SNIPPET_CHARS = 300
RETRY_INTERVAL_SECONDS = 180
LOG_TAIL_LIMIT = 200
LOG_TAIL_CAPACITY = 1000
DEFAULT_DIM = 64
NO_PARTITION = -1
SILENCE_TEXT = "you haven't told me about that"
CLUSTER_CITATION = "[cluster:"

STRUCTURAL = "structural_inference"
THEMATIC = "thematic_inference"
BRAINDUMP = "braindump"

# --- fixed values: the edge types every tenant starts with, in id order -------------------------
ONTOLOGY_SEED = [
    ("relates_to", "Relates to", "Generic association between two concepts; the fallback when no more specific type fits."),
    ("causes", "Causes", "A brings about B; B would not have occurred without A."),
    ("affects", "Affects", "A influences or has an effect on B, without strictly causing it."),
    ("endangers", "Endangers", "A puts B at risk or under threat."),
    ("helps", "Helps", "A benefits, aids, or contributes positively to B."),
    ("part_of", "Part of", "A is a component or member of the larger whole B."),
    ("depends_on", "Depends on", "A requires or relies on B to exist or function."),
    ("supports", "Supports", "A backs, justifies, or lends weight to B."),
    ("contradicts", "Contradicts", "A is in tension with or opposes B."),
    ("precedes", "Precedes", "A comes before B in time or sequence."),
    ("enables", "Enables", "A makes B possible or allows it to happen."),
    ("produces", "Produces", "A generates, creates, or yields B."),
    ("derived_from", "Derived from", "A originates from or is abstracted out of B."),
]

# --- similarities are compared at this many decimals, so the shape of a block never decides a tie
SIMILARITY_DECIMALS = 10


HOP = "struct<source_concept_id:string,edge_type:string,target_concept_id:string>"

TABLES = {
    "braindumps": (
        "user_id string, braindump_id bigint, verbatim string, cleaned string, created_at bigint, "
        "ingest_status string, ingest_attempts int, last_attempt_at bigint"
    ),
    "ingest_rejects": ("user_id string, braindump_id bigint, reason string, rejected_at bigint"),
    "ontology": (
        "user_id string, ontology_id bigint, slug string, label string, description string, created_at bigint"
    ),
    "concepts": ("user_id string, concept_id string, label string, created_at bigint"),
    "concept_provenance": ("user_id string, concept_id string, braindump_id bigint"),
    "edges": (
        "user_id string, edge_id string, source_concept_id string, target_concept_id string, "
        "original_type string, created_at bigint"
    ),
    "edge_provenance": ("user_id string, edge_id string, braindump_id bigint"),
    "edge_type_history": (
        "user_id string, edge_id string, seq_index bigint, type_slug string, created_at bigint"
    ),
    "merge_suggestions": (
        "user_id string, suggestion_id string, braindump_id bigint, new_concept_label string, "
        "new_concept_id string, existing_concept_id string, similarity double, status string, created_at bigint"
    ),
    "type_proposals": (
        "user_id string, proposal_id bigint, slug string, label string, description string, merge_of string, "
        "status string, near_match_slug string, near_match_similarity double, created_at bigint, resolved_at bigint"
    ),
    "graph_tombstones": ("user_id string, kind string, entity_id string, created_at bigint"),
    "thematic_snapshots": (
        "user_id string, snapshot_id string, braindump_ids array<bigint>, concept_ids array<string>, captured_at bigint"
    ),
    "chat_inference_proposals": (
        "user_id string, proposal_id bigint, mode string, source_concept_id string, target_concept_id string, "
        f"proposed_type string, evidence_path array<{HOP}>, rationale string, snapshot_id string, status string, "
        "created_at bigint, resolved_at bigint"
    ),
    "edge_inference_provenance": (
        "user_id string, edge_id string, chat_inference_id bigint, mode string, snapshot_id string, created_at bigint"
    ),
    "concept_embeddings": ("user_id string, concept_id string, embedding array<float>"),
    "braindump_embeddings": ("user_id string, braindump_id bigint, embedding array<float>"),
    "type_embeddings": ("user_id string, ontology_id bigint, embedding array<float>"),
}


def empty(spark, name: str):
    """An empty table the optimizer recognises as such."""
    from pyspark.sql.types import StructType

    columns = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in StructType.fromDDL(TABLES[name]))
    return spark.sql(f"SELECT {columns} WHERE false")


EXTRACTION = (
    "concepts array<struct<label:string>>, edges array<struct<source:string,type:string,target:string>>"
)
