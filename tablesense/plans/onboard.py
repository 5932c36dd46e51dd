"""From a raw table to everything known about it."""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tablesense.operators import (
    answerrows, ask, factsearch, findings, profile as profiles, structure)
from tablesense.operators.roles import (
    TableRoles, capability_flags, partner_columns, profile_roles, read_roles, semantic_roles,
    visual_roles,
)
from tablesense.plans.blocks import aggregation_blocks
from tablesense.sources.export import DOCUMENT_VERSION, document_to_json
from tablesense.sources.normalise import normalise


@dataclass
class Onboarded:
    """A normalised table, its roles in the three vocabularies, and lazy findings."""

    source_id: str
    source_name: str
    table: DataFrame
    profile: DataFrame
    roles: TableRoles
    visual: TableRoles
    semantic: TableRoles
    order_by: tuple
    grain: str | None = None

    @cached_property
    def kpis(self) -> DataFrame:
        """KPI signals, at most eight rows."""
        return _settled(findings.kpi_signals(self.table, self.semantic, self.order_by))

    @cached_property
    def temporal(self) -> DataFrame | None:
        """Temporal patterns, at most eight rows; None without time or measures."""
        if not self.semantic.times or not self.semantic.measures:
            return None
        return _settled(findings.temporal_patterns(self.table, self.semantic, self.grain))

    @cached_property
    def anomalies(self) -> DataFrame:
        """Anomaly signals, at most twelve rows."""
        return _settled(findings.anomaly_signals(
            self.table, self.semantic, self.profile, self.kpis, self.grain))

    @cached_property
    def narrative(self) -> DataFrame:
        """The one-row plain-language summary."""
        temporal = self.temporal
        if temporal is None:
            temporal = self.table.sparkSession.createDataFrame([], findings.TEMPORAL_SCHEMA)
        return _settled(findings.narrative(self.source_name, self.semantic, self.kpis,
                                           temporal, self.anomalies))

    def facts(self):
        return factsearch.fact_documents(self.table, self.semantic, self.order_by, self.grain)

    def blocks(self):
        return aggregation_blocks(self.table, self.visual)

    def answer(self, questions: DataFrame) -> DataFrame:
        """Answer rows for (question_id, question) rows."""
        keyed = questions.withColumn("source_id", F.lit(self.source_id))
        resolved = ask.resolve_questions(keyed, profile_roles(self.profile))
        return ask.answer_questions(self.table, self.roles, resolved)

    def answer_rows(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(asked, rows): the rows behind breach, status, outlier and variance questions."""
        keyed = questions.withColumn("source_id", F.lit(self.source_id))
        resolved = ask.resolve_questions(keyed, profile_roles(self.profile))
        return answerrows.answer_rows(self.table, self.roles, resolved, self.order_by)

    def route(self, questions: DataFrame, k=6) -> DataFrame:
        """Computed answer, fact search or fallback per question."""
        facts = self.facts()
        hits = factsearch.search(factsearch.build_index(facts), questions, k)
        return ask.route(ask.replies(self.answer(questions)), hits, facts)


def onboard(df: DataFrame, source_id: str, source_name=None, order_by=None, grain=None,
            mode="strict", exact=True, normalised=False) -> Onboarded:
    """Normalise, profile and classify a table.

    Row order defaults to the first time column, then the id columns.  The profile rows
    (one per column) are the only data collected.
    """
    table = df if normalised else normalise(df, order_by or ())
    profile = profiles.profile_columns(table, source_id, exact)
    described = read_roles(partner_columns(profile_roles(profile, mode)))
    spark = table.sparkSession
    # reuse the collected rows: classification again costs no scan
    fields = [f for f in profile.schema.fields]
    rows = [tuple(r[f.name] for f in fields) for r in described.rows]
    small = spark.createDataFrame(rows, profile.schema)
    if order_by is None:
        order_by = described.times[:1] + described.names("id")
    return Onboarded(
        source_id, source_name or source_id, table, small, described,
        read_roles(visual_roles(small, mode)), read_roles(semantic_roles(small, mode)),
        tuple(order_by), grain)


def _settled(found: DataFrame) -> DataFrame:
    """Compute a finding table once; its few rows then serve every reader."""
    return found.sparkSession.createDataFrame(found.collect(), found.schema)


def _gathered(df, *order):
    """A bounded finding table as one array value."""
    if df is None:
        return F.lit(None)
    columns = F.struct(*df.columns)
    key = F.struct(*order) if order else F.lit(0)
    return df.agg(F.transform(
        F.sort_array(F.collect_list(F.struct(key.alias("k"), columns.alias("v")))),
        lambda x: x["v"])).scalar()


def portable_document(o: Onboarded, max_questions=10) -> DataFrame:
    """The profile document of a source as JSON: roles, findings, blocks, questions."""
    flags = capability_flags(visual_roles(o.profile)).collect()[0]
    shapes = structure.chart_shapes(visual_roles(o.profile))
    kind = structure.dashboard_type(o.profile)
    kpis, temporal, anomalies = o.kpis, o.temporal, o.anomalies
    blocks = o.blocks()
    offered = ask.generate_questions(
        ask.question_context(profile_roles(o.profile), kinds=kind), max_questions)
    text = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    rels = findings.relationships(o.table, o.semantic)
    row = o.table.sparkSession.range(1).select(
        F.lit(DOCUMENT_VERSION).alias("schema_version"), F.lit(o.source_id).alias("source_id"),
        F.lit(o.source_name).alias("source_name"), F.lit("").alias("view_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("extracted_at"),
        F.lit("table").alias("extraction_strategy"),
        F.lit(o.roles.n_rows).cast("long").alias("total_rows"),
        F.lit(len(o.table.columns)).alias("total_cols"),
        text(o.table.columns).alias("all_columns"),
        kind.select("dashboard_type").scalar().alias("dashboard_type"),
        shapes.where(F.col("rank") == 1).select("shape").scalar().alias("primary_vtype"),
        shapes.where(F.col("rank") > 1).agg(
            F.sort_array(F.collect_list(F.struct("rank", "shape")))["shape"]
        ).scalar().alias("alt_vtypes"),
        F.struct(F.lit(flags["has_time"]).alias("time_series"),
                 F.lit(flags["has_geo"]).alias("geographic"),
                 F.lit(flags["has_status"]).alias("rag_status"),
                 F.lit(flags["has_threshold"]).alias("thresholds"),
                 F.lit(flags["has_multi_measure"]).alias("multi_measure")).alias("capabilities"),
        profiles.fingerprint(o.table).select("fingerprint").scalar().alias("fingerprint"),
        o.narrative.scalar().alias("narrative"),
        text(o.roles.dimensions).alias("dimensions"), text(o.roles.measures).alias("measures"),
        text(o.roles.times).alias("time_cols"), text(o.roles.statuses).alias("status_cols"),
        structure.schema_text(visual_roles(o.profile)).select("schema_text").scalar()
        .alias("schema_text"),
        _gathered(kpis, "name").alias("kpis"),
        _gathered(anomalies, "severity", "signal_type", "column").alias("anomalies"),
        _gathered(temporal, "time_col", "measure_col").alias("temporal"),
        (_gathered(findings.entities(o.table, o.semantic.dimensions), "name")
         if o.semantic.dimensions else F.lit(None)).alias("entities"),
        _gathered(rels, "rel_type", "col_a", "col_b").alias("relationships"),
        F.lit(len(blocks)).alias("agg_count"),
        F.array(*[F.struct(F.lit(b.agg_id).alias("agg_id"), F.lit(b.agg_type).alias("agg_type"),
                           F.lit(b.title).alias("title")) for b in blocks]).alias("agg_blocks"),
        offered.agg(F.sort_array(F.collect_list(F.struct("rank", "question")))["question"])
        .scalar().alias("questions"))
    return document_to_json(row)
