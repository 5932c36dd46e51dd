"""Findings over one table: entities, KPI signals, relationships, anomalies, insights."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tablesense.functions import words
from tablesense.functions.text import format_fact, has_any
from tablesense.operators import aggregate, ordered, select, structure
from tablesense.operators.roles import TableRoles


def _union(parts) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def entities(df: DataFrame, dims) -> DataFrame:
    """Per dimension: what kind of thing it names, its five most frequent values, how
    many rows name one, and an importance between 0 and 1."""
    dims = list(dims)
    cells = [F.struct(F.lit(d).alias("name"), F.col(f"`{d}`").cast("string").alias("value"))
             for d in dims]
    counts = df.select(F.inline(F.array(*cells))).groupBy("name", "value").agg(
        F.count(F.lit(1)).alias("n"))
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    present = counts.where(F.col("value").isNotNull())
    best = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    top = present.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 5)
    samples = top.groupBy("name").agg(
        F.sort_array(F.collect_list(F.struct("place", "value"))).value.alias("sample_values"))
    sizes = present.groupBy("name").agg(
        F.sum("n").alias("frequency"), F.max("n").alias("top_count"),
        F.count(F.lit(1)).alias("n_unique"))
    low = F.lower("name")
    kind = F.lit("dimension")
    for entity_type, keys in reversed(words.ENTITY_TYPE_WORDS):
        kind = F.when(has_any(low, keys), entity_type).otherwise(kind)
    importance = F.least(F.lit(1.0), F.try_divide(F.col("top_count"), n_rows)
                         * (1 + F.col("n_unique") / 10))
    return sizes.join(samples, "name").select(
        "name", kind.alias("entity_type"), "sample_values", "frequency",
        F.round(importance, 3).alias("importance"))


def kpi_signals(df: DataFrame, roles: TableRoles, order_by) -> DataFrame:
    """Per measure: current and previous value, threshold, direction, status, trend,
    change and where the current value stands among all of them."""
    measures, thresholds = roles.measures, roles.thresholds

    def partner(m):
        near = [t for t in thresholds if t.lower()[:4] == m.lower()[:4]
                or any(w in t.lower() for w in words.SIGNAL_THRESHOLD_WORDS)]
        return (near or thresholds or [None])[0]

    partners = {m: partner(m) for m in measures}
    wanted = measures + sorted({t for t in partners.values() if t})
    # every table below has one row per column
    latest = ordered.change_of_current(df, wanted, order_by)
    share = ordered.percentile_of_current(df, measures, order_by).select("column", "percentile")
    chosen = F.create_map(*[F.lit(x).cast("string") for kv in partners.items() for x in kv])
    limits = latest.select(F.col("column").alias("_thr"), F.col("current_val").alias("threshold"))
    signals = (
        latest.where(F.col("column").isin(measures))
        .withColumn("_thr", F.element_at(chosen, F.col("column")))
        .join(limits, "_thr", "left").join(share, "column", "left"))
    has_time = bool(roles.times)
    if has_time:
        signals = signals.join(ordered.row_slopes(df, measures, order_by), "column", "left")
    else:
        signals = signals.select("*", *[F.lit(None).cast("double").alias(c)
                                        for c in ("n", "slope", "std")])
    direction = select.kpi_direction(F.col("column"))
    status = select.kpi_status(F.col("current_val"), F.col("threshold"), direction)
    if roles.statuses:
        word = select.last_status(df, roles.statuses[0], order_by).select("status").scalar()
        status = F.when(status == "unknown", word).otherwise(status)
    return signals.select(
        F.col("column").alias("name"), "current_val", "prev_val", "threshold",
        direction.alias("direction"), status.alias("status"),
        ordered.trend_label(direction, F.col("pct_change"), F.col("slope"), F.col("std"),
                            F.col("n"), has_time).alias("trend"),
        "pct_change", "percentile")


def relationships(df: DataFrame, roles: TableRoles) -> DataFrame:
    """Threshold gaps, correlations, hierarchies and time series, strongest first."""
    measures, thresholds, dims = roles.measures, roles.thresholds, roles.dimensions
    parts = []
    pairs = [(m, t) for m in measures for t in thresholds]
    if pairs:
        parts.append(aggregate.mean_gap(df, pairs).select(
            F.col("measure").alias("col_a"), F.col("threshold").alias("col_b"),
            F.lit("threshold").alias("rel_type"),
            F.least(F.lit(1.0), 1 - F.col("gap_pct") / 100).alias("strength"),
            F.format_string("%s is %.1f%% %s %s", "measure", "gap_pct", "side", "threshold")
            .alias("note")))
    if len(measures) >= 2:
        r = F.col("correlation")
        parts.append(aggregate.correlation_pairs(df, measures, None).where(F.abs(r) > 0.6)
                     .select("col_a", "col_b", F.lit("correlation").alias("rel_type"),
                             F.round(F.abs(r), 3).alias("strength"),
                             F.format_string("r=%.2f (%s correlation)", r,
                                             F.when(r > 0, "positive").otherwise("negative"))
                             .alias("note")))
    if len(dims) >= 2:
        parts.append(structure.hierarchies(df, dims).select(
            F.col("parent").alias("col_a"), F.col("child").alias("col_b"),
            F.lit("hierarchy").alias("rel_type"), F.lit(0.9).alias("strength"),
            F.concat("parent", F.lit(" is a parent of "), "child").alias("note")))
    over_time = [(t, m) for t in roles.times for m in measures]
    if over_time:
        row = df.sparkSession.range(1)
        parts.append(row.select(F.inline(F.array(*[
            F.struct(F.lit(t).alias("col_a"), F.lit(m).alias("col_b"),
                     F.lit("time_series").alias("rel_type"), F.lit(0.8).alias("strength"),
                     F.lit(f"{m} can be trended over {t}").alias("note"))
            for t, m in over_time]))))
    return _union(parts).orderBy(F.desc("strength"), "rel_type", "col_a", "col_b")


TEMPORAL_SCHEMA = (
    "time_col string, measure_col string, trend_dir string, trend_slope double, "
    "min_period string, max_period string, n_periods bigint, latest_val double, "
    "baseline_val double, pct_change double, is_seasonal boolean")


def temporal_patterns(df: DataFrame, roles: TableRoles, grain=None) -> DataFrame:
    """Patterns of every measure over every time column."""
    return _union([ordered.temporal_patterns(df, t, roles.measures, grain)
                   for t in roles.times])


_SIGNAL = ("signal_type", "severity", "description", "column", "affected_rows", "value",
           "context")


def anomaly_signals(df: DataFrame, roles: TableRoles, profile: DataFrame, kpis: DataFrame,
                    grain=None, max_rows=None) -> DataFrame:
    """Breaching KPIs, outliers, missing data and reversals, most severe first."""
    n_rows = profile.agg(F.max("n_rows")).scalar()
    value = format_fact(F.col("current_val"))
    at_risk = (F.col("status") == "at_risk") & (F.col("trend") == "deteriorating")
    parts = [kpis.where((F.col("status") == "breaching") | at_risk).select(
        F.lit("breach").alias("signal_type"),
        F.when(F.col("status") == "breaching", "critical").otherwise("high").alias("severity"),
        F.when(F.col("status") == "breaching", F.concat(
            "name", F.lit(" is breaching its threshold: current="), value,
            F.lit(" vs threshold="), format_fact(F.col("threshold"))))
        .otherwise(F.concat("name", F.lit(" is at risk and deteriorating: "), value))
        .alias("description"),
        F.col("name").alias("column"), n_rows.cast("long").alias("affected_rows"),
        F.col("current_val").alias("value"),
        F.when(F.col("status") == "breaching", F.concat(F.lit("Direction: "), "direction"))
        .otherwise(F.format_string("Change: %+.1f%%", F.col("pct_change"))).alias("context"))]
    if roles.measures:
        parts.append(select.iqr_anomalies(df, roles.measures).select(
            F.lit("outlier").alias("signal_type"), "severity",
            F.concat(F.col("n_outliers").cast("string"), F.lit(" outlier(s) in "), "column",
                     F.lit(" outside ["), format_fact(F.col("lo")), F.lit(", "),
                     format_fact(F.col("hi")), F.lit("]")).alias("description"),
            "column", F.col("n_outliers").alias("affected_rows"),
            F.get("examples", F.lit(0)).alias("value"),
            F.concat(F.lit("IQR range: Q1="), format_fact(F.col("q1")), F.lit(", Q3="),
                     format_fact(F.col("q3"))).alias("context")))
    parts.append(select.missing_signals(profile).select(
        F.lit("missing").alias("signal_type"), "severity",
        F.concat("column", F.lit(" has "), F.format_string("%.0f%%", F.col("null_share") * 100),
                 F.lit(" missing values")).alias("description"),
        "column", F.col("n_null").alias("affected_rows"), F.col("null_share").alias("value"),
        F.lit("Consider data quality investigation").alias("context")))
    if roles.times and roles.measures:
        parts.append(ordered.trend_reversals(df, roles.times[0], roles.measures, grain).select(
            F.lit("trend_reversal").alias("signal_type"), F.lit("medium").alias("severity"),
            F.concat("measure", F.lit(" reversed its trend in the latest period ("),
                     "last_period", F.lit(")")).alias("description"),
            F.col("measure").alias("column"), F.lit(1).cast("long").alias("affected_rows"),
            F.col("last_val").alias("value"),
            F.format_string("Long-term slope: %.4f, last change: %.4f", "long_slope",
                            "last_move").alias("context")))
    return ordered.by_severity(_union(parts).select(*_SIGNAL), max_rows,
                               ("signal_type", "column"))


def narrative(source_name: str, roles: TableRoles, kpis: DataFrame, temporal: DataFrame,
              anomalies: DataFrame) -> DataFrame:
    """A one-row plain-language summary assembled from the finding tables."""
    n_rows, n_cols = roles.n_rows, len(roles.rows)
    head = f"{source_name} contains {n_rows:,} records across {n_cols} fields. "
    if roles.dimensions:
        head += f"Key dimensions: {', '.join(roles.dimensions)}. "
    if roles.measures:
        head += f"Measures tracked: {', '.join(roles.measures)}. "
    # KPI signals are one row per measure
    state = kpis.agg(
        F.sort_array(F.collect_list(F.when(F.col("status") == "breaching", F.col("name"))))
        .alias("b"),
        F.count_if(F.col("status") == "at_risk").alias("r"),
        F.count_if(F.col("status") == "on_track").alias("t"))
    kpi_text = state.select(F.concat(
        F.when(F.size("b") > 0, F.concat(
            F.size("b").cast("string"), F.lit(" KPI(s) are currently breaching thresholds ("),
            F.array_join("b", ", "), F.lit("). "))).otherwise(F.lit("")),
        F.when(F.col("r") > 0, F.concat(F.col("r").cast("string"),
                                        F.lit(" KPI(s) are at risk. "))).otherwise(F.lit("")),
        F.when(F.col("t") > 0, F.concat(F.col("t").cast("string"),
                                        F.lit(" KPI(s) are on track. "))).otherwise(F.lit(""))))
    words_for = F.create_map(*[F.lit(x) for x in (
        "up", "upward", "down", "downward", "flat", "stable", "volatile", "volatile")])
    time_text = temporal.orderBy("time_col", "measure_col").limit(1).select(F.concat(
        "measure_col", F.lit(" shows a "), F.element_at(words_for, F.col("trend_dir")),
        F.format_string(" trend over %d periods (%+.1f%% from %s to %s). ", "n_periods",
                        "pct_change", "min_period", "max_period")))
    worst = anomalies.where(F.col("severity") == "critical").orderBy("description").limit(2).agg(
        F.sort_array(F.collect_list("description")).alias("d")).select(
        F.when(F.size("d") > 0, F.concat(F.lit("CRITICAL: "), F.array_join("d", "; "),
                                         F.lit(". "))))
    text = F.concat_ws("", F.lit(head), kpi_text.scalar(), time_text.scalar(), worst.scalar())
    return kpis.sparkSession.range(1).select(F.trim(text).alias("narrative"))


def insights(anomalies: DataFrame, kpis: DataFrame, temporal: DataFrame,
             summary: DataFrame) -> DataFrame:
    """Insight cards: the narrative, the anomalies, the breaching KPIs and the strong
    trends."""
    color = (F.when(F.col("severity").isin("critical", "high"), "red")
             .when(F.col("severity") == "medium", "amber").otherwise("blue"))
    card = lambda df, group, kind, severity, shade, title, detail, category: df.select(
        F.lit(group).alias("card_group"), kind.alias("type"), severity.alias("severity"),
        shade.alias("color"), title.alias("title"), detail.alias("detail"),
        F.lit(category).alias("category"))
    top = anomalies
    breaching = kpis.where(F.col("status") == "breaching")
    trends = temporal.where(F.abs("pct_change") > 10)
    return _union([
        card(summary, 0, F.lit("summary"), F.lit("info"), F.lit("blue"),
             F.lit("Dashboard Summary"), F.col("narrative"), "summary"),
        card(top, 1, F.col("signal_type"), F.col("severity"), color, F.col("description"),
             F.col("context"), "anomaly"),
        card(breaching, 2, F.lit("kpi_breach"), F.lit("critical"), F.lit("red"),
             F.concat("name", F.lit(" is breaching its threshold")),
             F.format_string("Current: %s | Threshold: %s | Trend: %s | Change: %+.1f%%",
                             F.col("current_val").cast("string"),
                             F.col("threshold").cast("string"), F.col("trend"),
                             F.coalesce("pct_change", F.lit(0.0))), "kpi"),
        card(trends, 3, F.lit("trend"),
             F.when(F.abs("pct_change") < 20, "medium").otherwise("high"),
             F.when(F.col("trend_dir").isin("down", "volatile"), "amber").otherwise("green"),
             F.format_string("%s %s trend: %+.1f%% over %d periods", "measure_col", "trend_dir",
                             "pct_change", "n_periods"),
             F.format_string("From %s (%.3f) to %s (%.3f)", "min_period", "baseline_val",
                             "max_period", "latest_val"), "temporal"),
    ]).orderBy("card_group", "title")


def context_text(sections, max_chars=None) -> DataFrame:
    """Finding tables as one text: `sections` is a list of (title, one-column DataFrame
    of lines, row limit or None) in priority order; `max_chars` cuts the text."""
    parts = []
    for title, lines, n in sections:
        column = lines.columns[0]
        gathered = (lines if n is None else lines.limit(n)).agg(
            F.array_join(F.collect_list(F.concat(F.lit("  "), column)), "\n").alias("body"))
        body = gathered.select("body").scalar()
        parts.append(F.when(F.length(body) > 0, F.concat(F.lit(f"{title}:\n"), body)))
    row = sections[0][1].sparkSession.range(1)
    text = F.concat_ws("\n\n", *parts)
    return row.select((text if max_chars is None else F.substring(text, 1, max_chars)).alias("context"))
