"""Exports: JSON-safe records, CSV previews, the portable profile document."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from tablesense.functions.numbers import finite

PREVIEW_ROWS = 80  # fixed value: rows of a preview text


def _first(df: DataFrame, order_by, n) -> DataFrame:
    """All rows in order, or the first n."""
    rows = df.orderBy(*order_by)
    return rows if n is None else rows.limit(n)


def json_records(df: DataFrame, order_by, n=None) -> DataFrame:
    """The rows in order, or the first n, as JSON objects, NaN and infinities as null."""
    safe = [
        (finite(F.col(f"`{f.name}`")) if isinstance(f.dataType, (DoubleType, FloatType))
         else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields]
    return _first(df, order_by, n).select(
        *order_by,
        F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("record"))


def csv_preview(df: DataFrame, order_by, n=None) -> DataFrame:
    """The rows, or the first n, as CSV lines in order."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return _first(df, order_by, n).select(
        *order_by, F.to_csv(F.struct(*columns)).alias("line"))


def preview_text(df: DataFrame, order_by, n=PREVIEW_ROWS) -> DataFrame:
    """One text: banner, columns, row count, and the preview lines."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    lines = csv_preview(df, order_by, n).agg(
        F.sort_array(F.collect_list(F.struct(*order_by, "line"))).line.alias("lines"))
    return lines.select(F.concat_ws(
        "\n", F.lit("=== LIVE DATA (CSV) ==="), F.lit("Columns: " + ", ".join(df.columns)),
        F.concat(F.lit("Rows: "), total.cast("string")), F.lit(""), F.array_join("lines", "\n"),
        F.lit("=== END LIVE DATA ===")).alias("preview"))


# fixed values: list lengths in the portable document
DOCUMENT_LIMITS = {"alt_vtypes": 3, "entities": 15, "relationships": 10, "agg_blocks": 8}
DOCUMENT_VERSION = "2.0"

_KPI = ("array<struct<name:string,current_val:double,prev_val:double,threshold:double,"
        "direction:string,status:string,trend:string,pct_change:double,percentile:double>>")
_ANOMALY = ("array<struct<signal_type:string,severity:string,description:string,"
            "column:string,affected_rows:bigint,value:double,context:string>>")
_TEMPORAL = ("array<struct<time_col:string,measure_col:string,trend_dir:string,"
             "trend_slope:double,min_period:string,max_period:string,n_periods:bigint,"
             "latest_val:double,baseline_val:double,pct_change:double,is_seasonal:boolean>>")
DOCUMENT_SCHEMA = (
    "schema_version string, source_id string, source_name string, view_id string, "
    "extracted_at string, extraction_strategy string, total_rows bigint, total_cols int, "
    "all_columns array<string>, dashboard_type string, primary_vtype string, "
    "alt_vtypes array<string>, "
    "capabilities struct<time_series:boolean,geographic:boolean,rag_status:boolean,"
    "thresholds:boolean,multi_measure:boolean>, "
    "fingerprint string, narrative string, dimensions array<string>, measures array<string>, "
    "time_cols array<string>, status_cols array<string>, schema_text string, "
    f"kpis {_KPI}, anomalies {_ANOMALY}, temporal {_TEMPORAL}, "
    "entities array<struct<name:string,entity_type:string,sample_values:array<string>,"
    "frequency:bigint,importance:double>>, "
    "relationships array<struct<col_a:string,col_b:string,rel_type:string,"
    "strength:double,note:string>>, "
    "agg_count int, agg_blocks array<struct<agg_id:string,agg_type:string,title:string>>, "
    "questions array<string>"
)


def document_to_json(profile: DataFrame) -> DataFrame:
    """One JSON document per profile row, with its long lists cut."""
    fields = []
    for name in profile.columns:
        c = F.col(name)
        if name in DOCUMENT_LIMITS:
            c = F.slice(c, 1, DOCUMENT_LIMITS[name])
        fields.append(c.alias(name))
    return profile.select("source_id", F.to_json(F.struct(*fields)).alias("document"))


def document_from_json(documents: DataFrame, column="document") -> DataFrame:
    """Profile rows back from their JSON documents."""
    return documents.select(F.from_json(F.col(column), DOCUMENT_SCHEMA).alias("d")).select("d.*")


