"""Row selection: breaches, status words, outliers, missing data, filter trees."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesense.functions import words
from tablesense.functions.numbers import clean, percent
from tablesense.functions.periods import period_order
from tablesense.functions.text import has_any
from tablesense.operators.quantiles import long_measures, wide_quantiles


def breach_condition(df: DataFrame, value: str, threshold: str, direction=None) -> Column:
    """The breach test of a (value, threshold) pair as a row condition.

    Without a direction the means decide: values that run below their threshold on
    average are expected to stay above it.  The means are a one-row subquery.
    """
    v, t = clean(df.schema, value), clean(df.schema, threshold)
    if direction == "below":
        return v < t
    if direction == "above":
        return v > t
    means = df.agg((F.avg(v) < F.avg(t)).alias("below"))
    return F.when(means.scalar(), v < t).otherwise(v > t)


def breach_rows(df: DataFrame, value: str, threshold: str, direction=None) -> DataFrame:
    """Rows whose value breaches its threshold."""
    return df.where(breach_condition(df, value, threshold, direction))


def breach_rows_by_status(df: DataFrame, status: str) -> DataFrame:
    """Rows whose status says breach."""
    return df.where(F.lower(F.col(status).cast("string")).isin(words.BREACH_STATUS_VALUES))


def breaches(df: DataFrame, pairs, status=None) -> DataFrame:
    """All breaches of several (value, threshold) pairs in one union, marked by `kpi`;
    rows with a breach status when no pair has any."""
    hits = [F.when(breach_condition(df, v, t), F.lit(v)) for v, t in pairs]
    found = None
    if hits:
        found = df.withColumn("kpi", F.explode(F.array_compact(F.array(*hits))))
    if status is None:
        return found
    by_status = breach_rows_by_status(df, status).withColumn("kpi", F.lit(status))
    if found is None:
        return by_status
    counted = df.agg(F.coalesce(F.bool_or(
        F.coalesce(F.size(F.array_compact(F.array(*hits))) > 0, F.lit(False))),
        F.lit(False)).alias("any"))
    return found.unionByName(by_status.where(~counted.scalar()))


def rag_rows(df: DataFrame, status: str, question: str) -> DataFrame:
    """Rows whose status holds the first status word of the question that occurs in the
    data, with the word in `matched`.  No row when none occurs."""
    asked = [w for w in words.RAG_QUESTION_WORDS if w in question.lower()]
    low = F.lower(F.col(status).cast("string"))
    if not asked:
        return df.withColumn("matched", F.lit(None).cast("string")).where(F.lit(False))
    present = df.agg(*[F.bool_or(low.contains(w)).alias(w) for w in asked])
    first = F.lit(None).cast("string")
    for w in reversed(asked):
        first = F.when(F.col(w), F.lit(w)).otherwise(first)
    word = present.select(first.alias("word")).scalar()
    return df.where(low.contains(word)).withColumn("matched", word)


def breach_analysis(df: DataFrame, value: str, threshold: str, keep=(), direction=None,
                    order_by=None, max_rows=None) -> DataFrame:
    """Breaching rows with their absolute gap, widest first; all, or `max_rows` of them."""
    v, t = clean(df.schema, value), clean(df.schema, threshold)
    order = order_by or [F.desc("_gap"), *keep]
    rows = breach_rows(df, value, threshold, direction).select(
        *keep, value, threshold, F.round(F.abs(v - t), 4).alias("_gap")).orderBy(*order)
    return rows if max_rows is None else rows.limit(max_rows)


def breach_summary(df: DataFrame, value: str, threshold: str, direction=None) -> DataFrame:
    """Number of breaches, rows, and the rate in percent."""
    hit = breach_condition(df, value, threshold, direction)
    return df.agg(F.count_if(hit).alias("breach_count"), F.count(F.lit(1)).alias("total")).select(
        "breach_count", "total",
        percent(F.col("breach_count"), F.greatest("total", F.lit(1))).alias("breach_rate"))


def iqr_bounds(df: DataFrame, measures, k: float) -> DataFrame:
    """Quartiles and fences [Q1 − k·IQR, Q3 + k·IQR] per measure."""
    iqr = F.col("q3") - F.col("q1")
    return wide_quantiles(df, measures, [0.25, 0.75], ["q1", "q3"]).select(
        "column", "q1", "q3", (F.col("q1") - k * iqr).alias("lo"),
        (F.col("q3") + k * iqr).alias("hi"))


def iqr_outliers(df: DataFrame, measure: str, k=1.5) -> DataFrame:
    """Rows outside the fences of one measure."""
    fences = iqr_bounds(df, [measure], k).select(F.struct("lo", "hi")).scalar()
    v = clean(df.schema, measure)
    return df.where((v < fences["lo"]) | (v > fences["hi"]))


def iqr_anomalies(df: DataFrame, measures, k=2.5) -> DataFrame:
    """Per measure with outliers: how many, the three farthest, fences and severity."""
    chosen = list(measures)
    # one row per measure: bounded whatever the data size
    bounds = F.broadcast(iqr_bounds(df, chosen, k))
    values = long_measures(df, chosen)
    sized = values.groupBy("column").agg(F.count("v").alias("n")).where(F.col("n") >= 4)
    outside = values.join(bounds, "column").where(
        (F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")))
    far = Window.partitionBy("column").orderBy(
        F.desc(F.abs(F.col("v") - (F.col("q1") + F.col("q3")) / 2)), F.desc("v"))
    examples = (
        outside.withColumn("place", F.row_number().over(far)).where(F.col("place") <= 3)
        .groupBy("column").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("e"))
        .select("column", F.col("e.v").alias("examples")))
    counts = outside.groupBy("column", "q1", "q3", "lo", "hi").agg(
        F.count(F.lit(1)).alias("n_outliers"))
    return (
        counts.join(examples, "column").join(sized.select("column"), "column")
        .withColumn("severity", F.when(F.col("n_outliers") < 3, "medium").otherwise("high"))
    )


def missing_signals(profile: DataFrame, share=0.3) -> DataFrame:
    """Columns with more nulls than the share; severity high from 60 % on."""
    ratio = F.try_divide(F.col("n_null").cast("double"), F.col("n_rows"))
    return profile.select("source_id", "column", "n_null", ratio.alias("null_share")).where(
        F.col("null_share") > share
    ).withColumn("severity", F.when(F.col("null_share") < 0.6, "medium").otherwise("high"))


def kpi_direction(name: Column) -> Column:
    """Whether a higher or a lower value is better, by words in the column name."""
    low = F.lower(name)
    return (
        F.when(has_any(low, words.LOWER_IS_BETTER_WORDS), "lower_is_better")
        .when(has_any(low, words.HIGHER_IS_BETTER_WORDS), "higher_is_better")
        .otherwise("neutral"))


def kpi_status(current: Column, threshold: Column, direction: Column) -> Column:
    """on_track / at_risk / breaching against a threshold; unknown without one."""
    gap = F.abs(current - threshold) / F.greatest(F.abs(threshold), F.lit(1e-9))
    bad = (
        F.when(direction == "lower_is_better", current > threshold)
        .when(direction == "higher_is_better", current < threshold))
    return (
        F.when(current.isNull() | threshold.isNull(), "unknown")
        .when(direction == "neutral",
              F.when(gap > 0.2, "breaching").when(gap > 0.05, "at_risk").otherwise("on_track"))
        .otherwise(F.when(bad, "breaching").otherwise("on_track")))


def status_word(text: Column) -> Column:
    """A status text read as breaching / at_risk / on_track / unknown."""
    low = F.lower(text)
    return (
        F.when(has_any(low, words.STATUS_BREACHING_WORDS), "breaching")
        .when(has_any(low, words.STATUS_AT_RISK_WORDS), "at_risk")
        .when(has_any(low, words.STATUS_ON_TRACK_WORDS), "on_track")
        .otherwise("unknown"))


def last_status(df: DataFrame, status: str, order_by) -> DataFrame:
    """The latest status text by `order_by`, and how it reads."""
    keys = [k.alias(f"_o{2 * i + j}") for i, name in enumerate(order_by)
            for j, k in enumerate((period_order(df, name), F.col(f"`{name}`")))]
    rows = df.select(F.col(f"`{status}`").cast("string").alias("_status"), F.struct(*keys)
                     .alias("_order")).where(F.col("_status").isNotNull())
    return rows.agg(
        F.max_by("_status", "_order").alias("last_status")
    ).withColumn("status", status_word(F.coalesce("last_status", F.lit(""))))


def variance_breach(df: DataFrame, current: str, previous: str, share=0.10) -> DataFrame:
    """Rows that moved by more than the share of the previous value."""
    now, before = clean(df.schema, current), clean(df.schema, previous)
    return df.where(F.abs(F.try_divide(now - before, F.abs(before))) > share)


def search_any_column(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any column contains the text, ignoring case."""
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(
            F.lower(F.col(f"`{c}`").cast("string")).contains(text.lower()), F.lit(False))
    return df.where(hit)


def unexpired(df: DataFrame, expires="expires_dt", now=None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


def older_than(df: DataFrame, column: str, days: int, now=None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return df.where(F.col(column) < now - F.make_dt_interval(F.lit(days)))


# --- filter trees ---------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """`column is value`, or is one of the values found in `values[value_column]`."""

    column: str
    value: object = None
    values: DataFrame | None = None
    value_column: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class Group:
    """AND / OR over rules and further groups."""

    logic: str
    items: list = field(default_factory=list)


def _rules(node):
    if isinstance(node, Rule):
        return [node]
    return [r for item in node.items for r in _rules(item)]


def _with_flags(df: DataFrame, tree) -> tuple[DataFrame, dict]:
    """Attach one flag per rule.  Value tables are joined once each, deduplicated, so
    they never multiply rows; their size decides the join strategy at run time."""
    flags = {}
    for i, rule in enumerate(_rules(tree)):
        flag = f"_rule{i}"
        flags[id(rule)] = flag
        if rule.values is None:
            df = df.withColumn(flag, F.coalesce(F.col(rule.column) == F.lit(rule.value),
                                                F.lit(False)))
            continue
        wanted = rule.values.select(F.col(rule.value_column).alias(f"_value{i}")).where(
            F.col(f"_value{i}").isNotNull()).distinct().withColumn(flag, F.lit(True))
        df = df.join(wanted, df[rule.column] == wanted[f"_value{i}"], "left").drop(f"_value{i}")
        df = df.withColumn(flag, F.coalesce(flag, F.lit(False)))
    return df, flags


def _condition(node, flags) -> Column:
    if isinstance(node, Rule):
        return F.col(flags[id(node)])
    parts = [_condition(item, flags) for item in node.items]
    out = parts[0]
    for part in parts[1:]:
        out = out & part if node.logic.upper() == "AND" else out | part
    return out


def filter_tree(df: DataFrame, tree, columns=None) -> DataFrame:
    """Rows that satisfy the tree, restricted to `columns` when given."""
    flagged, flags = _with_flags(df, tree)
    return flagged.where(_condition(tree, flags)).select(*(columns or df.columns))


def filter_counts(df: DataFrame, tree) -> DataFrame:
    """Rows matched by each rule and by the whole tree, from one pass."""
    flagged, flags = _with_flags(df, tree)
    rules = _rules(tree)
    counts = flagged.agg(
        *[F.count_if(F.col(flags[id(r)])).alias(f"n{i}") for i, r in enumerate(rules)],
        F.count_if(_condition(tree, flags)).alias("n"))
    label = lambda r, i: r.name or f"rule_{i + 1}"
    return counts.select(F.inline(F.array(
        *[F.struct(F.lit(label(r, i)).alias("rule"), F.col(f"n{i}").alias("rows"))
          for i, r in enumerate(rules)],
        F.struct(F.lit("total").alias("rule"), F.col("n").alias("rows")))))


def in_value_list(df: DataFrame, column: str, values: DataFrame, value_column: str,
                  negate=False) -> DataFrame:
    """Rows whose value occurs (or does not occur) in the values table."""
    wanted = values.select(F.col(value_column).alias("_value")).distinct()
    how = "left_anti" if negate else "left_semi"
    return df.join(wanted, df[column] == wanted["_value"], how)

