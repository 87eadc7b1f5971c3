"""Graph-shaped views over the test tables, as Spark DataFrames.

Graph A: customers and parts linked by order priority, one tenant per market segment.
Graph B: suppliers and parts linked by return flag, one tenant per supplier region.
Every view covers its whole source table. ``oracle.py`` holds the same views as DuckDB SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scalars import edge_key, epoch
from ..schema import ONTOLOGY_SEED, SILENCE_TEXT
from ..session import scratch_path, spread

# Cut-off for change feeds and the clock of the writing operators (epoch seconds).
SINCE = 891_000_000
NOW = 1_000_000_000


TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Graph tables already written by this application: (application, folder, view) -> path.
_STORED: dict[tuple[str, str, str], str] = {}


def stored(build):
    """A graph table, written once per application and folder and then read by every query that needs it."""

    def read(self: Views) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, build.__name__)
        if key not in _STORED:
            df = build(self)
            path = scratch_path(self.spark, build.__name__)
            df.write.parquet(path)
            _STORED[key] = (path, df.schema)
        path, schema = _STORED[key]
        return self.spark.read.schema(schema).parquet(path)

    read.__name__, read.__doc__ = build.__name__, build.__doc__
    return cached_property(read)


def extraction_json(text: Column) -> Column:
    """JSON of a document: long tokens are concepts, neighbours are edges, a hash picks the type."""
    slugs = F.array(*[F.lit(s) for s, _, _ in ONTOLOGY_SEED], F.lit("invented_type"))
    edge = lambda a, b: F.struct(
        a.alias("source"),
        F.element_at(slugs, (F.pmod(F.char_length(a) * 7 + F.char_length(b), F.lit(14)) + 1).cast("int")).alias("type"),
        b.alias("target"),
    )

    def folded(t: Column) -> Column:
        size = F.size(t)
        return F.to_json(
            F.struct(
                F.transform(t, lambda x: F.struct(x.alias("label"))).alias("concepts"),
                F.when(
                    size > 1,
                    F.zip_with(F.slice(t, 1, size - 1), F.slice(t, 2, F.greatest(size - 1, F.lit(0))), edge),
                ).alias("edges"),
            )
        )

    # The tokens are computed once for all uses: a one-element array stands for a variable.
    long = F.filter(X.tokens(text), lambda t: F.char_length(t) >= 5)
    return F.element_at(F.transform(F.array(long), folded), 1)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.schema(TABLES[name]).parquet(f"{self.dir}/{name}.parquet")
        # Texts cost much per row: a file too small to split is spread over the cores.
        return spread(df) if name in ("documents", "conversations") else df

    def _count(self, name: str):
        return self.table(name).agg(F.count(F.lit(1))).scalar()

    # --- Graph A --------------------------------------------------------------------------------
    @cached_property
    def a_notes(self) -> DataFrame:
        """Orders with their tenant."""
        return self.table("orders").join(
            self.table("customer").select("c_custkey", F.col("c_mktsegment").alias("user_id")),
            F.col("o_custkey") == F.col("c_custkey"),
        )

    @cached_property
    def _a_orders(self) -> DataFrame:
        return self.a_notes.withColumn("type", F.lower(F.replace(F.substr("o_orderpriority", F.lit(3)), F.lit(" "), F.lit("_"))))

    @stored
    def _a_lines(self) -> DataFrame:
        """Lines with their order and tenant, joined once for edges and history; ids are built behind the shuffles."""
        orders = self._a_orders.select("user_id", "o_custkey", "o_orderkey", "type", epoch(F.col("o_orderdate")).alias("asserted_at"))
        # Only returned lines tell more than their edge.
        returned = F.col("l_returnflag") == "R"
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", returned.alias("returned"), F.when(returned, F.col("l_linestatus")).alias("returned_status"),
            F.when(returned, epoch(F.col("l_shipdate"))).alias("shipped_at"),
        )
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "user_id", "o_custkey", "type", "l_partkey", F.col("o_orderkey").alias("note"), "asserted_at", "returned", "returned_status", "shipped_at"
        )

    @staticmethod
    def _a_ids(lines: DataFrame) -> DataFrame:
        return lines.withColumns({
            "source": F.concat(F.lit("c:"), F.col("o_custkey")), "target": F.concat(F.lit("p:"), F.col("l_partkey")),
        }).withColumn("edge_id", edge_key(F.col("source"), F.col("type"), F.col("target")))

    @cached_property
    def _a_by_note(self) -> DataFrame:
        """The parts of each note with its customer. Lines are shuffled once, by note: distinct rows with their note need no further shuffle."""
        parts = self.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").repartition("o_orderkey")
        return self._a_ids(parts.join(self._a_orders.select("user_id", "o_custkey", "o_orderkey", "type"), "o_orderkey").distinct())

    @stored
    def a_edges(self) -> DataFrame:
        # Few lines share an edge, so they are not combined before the shuffle. The edges of a part come to lie in few files, in order.
        key = ["user_id", "o_custkey", "type", "l_partkey"]
        lines = self._a_lines.select(*key, "asserted_at", F.pmod("o_custkey", F.lit(4)).alias("share")).repartition("l_partkey", "share")
        found = lines.groupBy(*key, "share").agg(F.min("asserted_at").alias("created_at"))
        return self._a_ids(found.sortWithinPartitions("l_partkey", "o_custkey")).select(
            "user_id", "edge_id", F.col("source").alias("source_concept_id"), F.col("target").alias("target_concept_id"),
            F.col("type").alias("original_type"), "created_at",
        )

    @stored
    def a_edge_provenance(self) -> DataFrame:
        return self._a_by_note.select("user_id", "edge_id", F.col("o_orderkey").alias("braindump_id")).distinct()

    @stored
    def a_concepts(self) -> DataFrame:
        # Lines lie by order and edges by part: each gives one end, of which most rows are combined before the shuffle.
        ends = self._a_lines.select("user_id", F.concat(F.lit("c:"), "o_custkey").alias("concept_id"), F.col("asserted_at").alias("created_at")).unionByName(
            self.a_edges.select("user_id", F.col("target_concept_id").alias("concept_id"), "created_at"))
        return ends.groupBy("user_id", "concept_id").agg(F.min("created_at").alias("created_at")).select(
            "user_id", "concept_id", F.col("concept_id").alias("label"), "created_at"
        )

    @stored
    def a_concept_provenance(self) -> DataFrame:
        ends = self._a_by_note.select("user_id", F.explode(F.array("source", "target")).alias("concept_id"), "o_orderkey")
        return ends.distinct().select("user_id", "concept_id", F.col("o_orderkey").alias("braindump_id"))

    @stored
    def a_type_history(self) -> DataFrame:
        first = self.a_edges.select(
            "user_id", "edge_id", F.lit(0).cast("bigint").alias("seq_index"),
            F.col("original_type").alias("type_slug"), "created_at",
        )
        w = Window.partitionBy("user_id", "o_custkey", "type", "l_partkey").orderBy("shipped_at", "note", "returned_status")
        lines = self._a_lines.where("returned").drop("returned", "asserted_at").repartition("o_custkey", "l_partkey")
        later = self._a_ids(lines.withColumn("seq_index", F.row_number().over(w).cast("bigint"))).select(
            "user_id", "edge_id", "seq_index", F.concat(F.lit("retag_"), F.col("returned_status")).alias("type_slug"),
            F.col("shipped_at").alias("created_at"),
        )
        return first.unionByName(later)

    @cached_property
    def a_braindumps(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "text")
        return (
            self.a_notes.withColumn("doc_id", F.col("o_orderkey") % self._count("documents"))
            .join(docs, "doc_id")
            .select(
                "user_id", F.col("o_orderkey").alias("braindump_id"), F.col("text").alias("verbatim"),
                F.trim("text").alias("cleaned"), epoch(F.col("o_orderdate")).alias("created_at"),
                F.expr("CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'pending' ELSE 'failed' END").alias(
                    "ingest_status"
                ),
            )
        )

    @cached_property
    def a_note_ids(self) -> DataFrame:
        return self.a_notes.select(
            "user_id", F.col("o_orderkey").alias("braindump_id"), epoch(F.col("o_orderdate")).alias("created_at")
        )

    def _vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding")

    @stored
    def a_concept_embeddings(self) -> DataFrame:
        number = F.substr("concept_id", F.lit(3)).cast("bigint")
        return (
            self.a_concepts.select("user_id", "concept_id", (number % self._count("embeddings")).alias("vec_id"))
            .join(self._vectors(), "vec_id")
            .select("user_id", "concept_id", "embedding")
        )

    @stored
    def a_braindump_embeddings(self) -> DataFrame:
        return (
            self.a_notes.select(
                "user_id", F.col("o_orderkey").alias("braindump_id"),
                (F.col("o_orderkey") % self._count("embeddings")).alias("vec_id"),
            )
            .join(self._vectors(), "vec_id")
            .select("user_id", "braindump_id", "embedding")
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_mktsegment").alias("user_id")).distinct()

    @stored
    def a_queries(self) -> DataFrame:
        """One question per tenant and embedding label: the mean vector of the label."""
        means = (
            self.table("embeddings")
            .select("label", F.posexplode("embedding").alias("i", "x"))
            .groupBy("label", "i").agg(F.avg("x").cast("float").alias("x"))
            .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
            .select(F.col("label").cast("bigint").alias("query_id"), F.col("v.x").alias("embedding"))
        )
        # One row per (label, tenant): both sides are bounded by their number of distinct values.
        tenants = self.users.agg(F.sort_array(F.collect_set("user_id"))).scalar()
        return means.select("query_id", F.explode(tenants).alias("user_id"), "embedding")

    @stored
    def vector_queries(self) -> DataFrame:
        """Every embedding asks one tenant, dealt out in turn."""
        tenants = self.users.agg(F.sort_array(F.collect_set("user_id"))).scalar()
        return self.table("embeddings").withColumn("tenants", tenants).select(
            F.col("vec_id").alias("query_id"),
            F.element_at("tenants", (F.col("vec_id") % F.size("tenants") + 1).cast("int")).alias("user_id"),
            "embedding",
        )

    # --- Graph B --------------------------------------------------------------------------------
    @cached_property
    def _b_lines(self) -> DataFrame:
        """Lines with their tenant; numbers only, since what is shuffled should be small. Ids are built behind the shuffle."""
        sup = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            "s_suppkey", F.col("n_regionkey").cast("string").alias("user_id")
        )
        return self.table("lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(
            "user_id", "l_suppkey", "l_partkey", "l_returnflag", F.col("l_orderkey").alias("note"), epoch(F.col("l_shipdate")).alias("asserted_at")
        )

    @staticmethod
    def _b_ids(lines: DataFrame) -> DataFrame:
        return lines.withColumns({
            "source": F.concat(F.lit("s:"), F.col("l_suppkey")),
            "type": F.expr("CASE l_returnflag WHEN 'A' THEN 'affects' WHEN 'N' THEN 'relates_to' ELSE 'contradicts' END"),
            "target": F.concat(F.lit("p:"), F.col("l_partkey")),
        }).withColumn("edge_id", edge_key(F.col("source"), F.col("type"), F.col("target")))

    @cached_property
    def b_assert(self) -> DataFrame:
        return self._b_ids(self._b_lines).select("user_id", "source", "type", "target", "note", "asserted_at", "edge_id")

    @cached_property
    def _b_by_note(self) -> DataFrame:
        """``b_assert`` shuffled once, by note: distinct rows with their note need no further shuffle."""
        return self._b_ids(self._b_lines.select("user_id", "l_suppkey", "l_partkey", "l_returnflag", "note").repartition("note"))

    @stored
    def b_edges(self) -> DataFrame:
        return self.b_assert.groupBy("user_id", "edge_id").agg(
            F.first("source").alias("source_concept_id"), F.first("target").alias("target_concept_id"),
            F.first("type").alias("original_type"), F.min("asserted_at").alias("created_at"),
        )

    @stored
    def b_edge_provenance(self) -> DataFrame:
        return self._b_by_note.select("user_id", "edge_id", F.col("note").alias("braindump_id")).distinct()

    @cached_property
    def _b_ends(self) -> DataFrame:
        return self.b_assert.select(
            "user_id", F.explode(F.array("source", "target")).alias("concept_id"), "note", "asserted_at"
        )

    @stored
    def b_concepts(self) -> DataFrame:
        return self._b_ends.groupBy("user_id", "concept_id").agg(F.min("asserted_at").alias("created_at")).select(
            "user_id", "concept_id", F.col("concept_id").alias("label"), "created_at"
        )

    @stored
    def b_concept_provenance(self) -> DataFrame:
        return self._b_by_note.select("user_id", F.explode(F.array("source", "target")).alias("concept_id"), F.col("note").alias("braindump_id")).distinct()

    @cached_property
    def b_history(self) -> DataFrame:
        return self.b_edges.select(
            "user_id", "edge_id", F.lit(0).cast("bigint").alias("seq_index"),
            F.col("original_type").alias("type_slug"), "created_at",
        )

    @cached_property
    def b_ontology(self) -> DataFrame:
        from ..operators.ontology import seed_ontology

        return seed_ontology(self.b_users, at=NOW)

    @cached_property
    def b_users(self) -> DataFrame:
        return self.table("nation").select(F.col("n_regionkey").cast("string").alias("user_id")).distinct()

    @cached_property
    def b_suppliers(self) -> DataFrame:
        return self.table("supplier").join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        ).select("s_suppkey", "s_nationkey", F.col("n_regionkey").cast("string").alias("user_id"))

    @stored
    def b_suggestions(self) -> DataFrame:
        """Each supplier is suggested to fold into the one at half its place in its nation."""
        w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
        placed = self.b_suppliers.withColumn("place", F.row_number().over(w))
        before = placed.select("s_nationkey", F.col("place").alias("half"), F.col("s_suppkey").alias("before"))
        first_note = self.table("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
            F.min("l_orderkey").alias("braindump_id")
        )
        return (
            placed.withColumn("half", F.floor(F.col("place") / 2).cast("int")).join(before, ["s_nationkey", "half"])
            .join(first_note, "s_suppkey", "left")
            .select(
                "user_id", F.col("s_suppkey").alias("suggestion_id"), "braindump_id",
                F.concat(F.lit("s:"), F.col("s_suppkey")).alias("new_concept_label"),
                F.concat(F.lit("s:"), F.col("s_suppkey")).alias("new_concept_id"),
                F.concat(F.lit("s:"), F.col("before")).alias("existing_concept_id"),
                F.lit(0.9).alias("similarity"), F.lit("pending").alias("status"),
                F.lit(NOW).cast("bigint").alias("created_at"),
            )
        )

    @stored
    def b_deletes(self) -> DataFrame:
        """Notes of orders with status P are withdrawn, in every tenant that has them."""
        gone = self.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("note"))
        return self.b_assert.select("user_id", "note").distinct().join(gone, "note").select(
            "user_id", F.col("note").alias("braindump_id")
        )

    @stored
    def b_note_ids(self) -> DataFrame:
        return self._b_by_note.select("user_id", F.col("note").alias("braindump_id")).distinct()

    @cached_property
    def assignment(self) -> DataFrame:
        return self.b_concepts.select(
            "user_id", "concept_id", F.pmod(F.substr("concept_id", F.lit(3)).cast("bigint"), F.lit(8)).alias("community")
        )

    @cached_property
    def b_proposals(self) -> DataFrame:
        """One structural proposal per line: supplier -> part -> supplier paths through a shared part."""
        e = self.b_edges
        left = e.groupBy("user_id", "target_concept_id").agg(
            F.min(F.struct("edge_id", "source_concept_id", "original_type")).alias("a"),
            F.max(F.struct("edge_id", "source_concept_id", "original_type")).alias("b"),
        )
        number = F.substr("target_concept_id", F.lit(3)).cast("bigint")
        return left.select(
            "user_id", number.alias("proposal_id"),
            F.col("a.source_concept_id").alias("source_concept_id"),
            F.col("target_concept_id"),
            F.expr("CASE WHEN a.original_type = b.original_type THEN 'depends_on' "
                   "WHEN a.source_concept_id = b.source_concept_id THEN ' ' ELSE 'invents' END").alias("proposed_type"),
            F.array(
                F.struct(
                    F.col("a.source_concept_id").alias("source_concept_id"),
                    F.when(number % 3 == 0, F.lit("helps")).otherwise(F.col("a.original_type")).alias("edge_type"),
                    F.when(number % 5 == 0, F.col("b.source_concept_id")).otherwise(F.col("target_concept_id")).alias("target_concept_id"),
                )
            ).alias("evidence_path"),
            F.lit("  ").alias("rationale"),
        )

    # --- change feed ----------------------------------------------------------------------------
    @stored
    def tombstones(self) -> DataFrame:
        """Error events tombstone the customer concept, signup events every edge of the order with their id."""
        ev = self.table("events").select("event_id", "user_id", "event_type")
        at = F.lit(SINCE - 50).cast("bigint") + (F.col("event_id") % 100)
        concepts = (
            ev.where("event_type = 'error'").withColumnRenamed("user_id", "c_custkey")
            .join(self.table("customer").select("c_custkey", F.col("c_mktsegment").alias("user_id")), "c_custkey")
            .select("user_id", F.lit("concept").alias("kind"),
                    F.concat(F.lit("c:"), F.col("c_custkey")).alias("entity_id"), at.alias("created_at"))
        )
        edges = (
            ev.where("event_type = 'signup'").select(F.col("event_id").alias("braindump_id"), at.alias("created_at"))
            .join(self.a_edge_provenance, "braindump_id")
            .select("user_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("entity_id"), "created_at")
        )
        return concepts.unionByName(edges)

    # --- attempts, logs, counters ---------------------------------------------------------------
    @cached_property
    def attempts(self) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(
            F.col("user_id").alias("braindump_id"), F.row_number().over(w).cast("int").alias("attempt"),
            F.expr("CASE event_type WHEN 'error' THEN 'transient' WHEN 'signup' THEN 'failed' ELSE 'complete' END").alias("outcome"),
            epoch(F.col("ts")).alias("attempted_at"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("log_id"), epoch(F.col("ts")).alias("timestamp"),
            F.expr("CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END").alias("level"),
            F.concat(F.lit("user::"), F.col("user_id")).alias("target"),
            F.col("event_type").alias("message"), F.col("props").alias("fields"),
        )

    # --- texts ----------------------------------------------------------------------------------
    @cached_property
    def doc_tokens(self) -> DataFrame:
        """Tokens of whole documents, in order."""
        return self.table("documents").select(
            F.col("source").alias("user_id"), F.col("doc_id").alias("braindump_id"),
            F.posexplode(X.tokens(F.col("text"))).alias("pos", "token"),
        )

    @stored
    def extractions(self) -> DataFrame:
        """JSON per document, see ``extraction_json``."""
        return self.table("documents").select(
            F.col("source").alias("user_id"), F.col("doc_id").alias("braindump_id"), extraction_json(F.col("text")).alias("payload")
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Assistant turns with citation markers appended; some cite a cluster, some are the silence text."""
        marked = F.concat(
            F.col("text"), F.lit(" [bd:"), F.col("conv_id"), F.lit("] x [edge:a -y→ b] [bd:"), F.col("turn"), F.lit("] y [bd:"),
            F.col("conv_id"), F.lit("]"),
        )
        n = F.col("conv_id") * 100 + F.col("turn")
        return self.table("conversations").where("role = 'assistant'").select(
            n.alias("query_id"),
            F.when(n % 11 == 0, F.lit(SILENCE_TEXT + " ")).when(
                n % 7 == 0, F.concat(marked, F.lit(" [Cluster:1]"))
            ).otherwise(marked).alias("answer"),
        )

    # --- type proposals -------------------------------------------------------------------------
    @cached_property
    def proposed_types(self) -> DataFrame:
        """One proposal per part; brand 7 restates a seeded type, size 50 names an unknown merge target."""
        seeds = F.array(*[F.struct(F.lit(s).alias("slug"), F.lit(l).alias("label"), F.lit(d).alias("description"))
                          for s, l, d in ONTOLOGY_SEED])
        seed = F.element_at(seeds, (F.col("p_size") % 13 + 1).cast("int"))
        copy = F.col("p_brand") == "Brand#7"
        return self.table("part").select(
            (F.col("p_partkey") % 5).cast("string").alias("user_id"),
            F.col("p_partkey").alias("proposal_id"),
            F.when(copy, F.concat(seed["slug"], F.lit("!"))).when(F.col("p_size") == 13, F.lit("helps"))
            .otherwise(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("_")))).alias("slug"),
            F.when(copy, seed["label"]).otherwise(F.col("p_name")).alias("label"),
            F.when(copy, seed["description"]).when(F.col("p_size") == 1, F.lit("  "))
            .otherwise(F.concat_ws(" ", "p_type", "p_brand", "p_name")).alias("description"),
            F.when(F.col("p_size") == 50, F.lit("nowhere")).when(F.col("p_size") > 25, seed["slug"]).alias("merge_of"),
        )
