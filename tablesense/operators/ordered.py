"""Operators that depend on row or period order.  Order is always explicit."""

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from tablesense.functions import words
from tablesense.functions.numbers import (
    clean, guarded_change, relative_change, rounded,
)
from tablesense.functions.periods import period_order
from tablesense.functions.text import short_hash, token_estimate
from tablesense.operators.indexing import dense_index
from tablesense.operators.profile import estimate_distinct

_WINDOW_PERIODS = 100_000  # periods one window task may order
_CALENDAR = ("day", "week", "month", "quarter", "year")  # few periods by nature


def _ordered(df: DataFrame, order_by):
    """Sort keys `_o0`, `_o1`, … as columns, and their names.  Text columns that read as
    periods are ordered as periods before they are ordered as text."""
    if not order_by:
        raise ValueError("this operator needs explicit order_by columns")
    keys = []
    for name in order_by:
        if isinstance(df.schema[name].dataType, StringType):
            keys.append(period_order(df, name))
        keys.append(F.col(f"`{name}`"))
    return [k.alias(f"_o{i}") for i, k in enumerate(keys)], [f"_o{i}" for i in range(len(keys))]


def _long(df: DataFrame, measures, keep=()) -> DataFrame:
    cells = [F.struct(F.lit(m).alias("column"), clean(df.schema, m).alias("v"))
             for m in measures]
    return df.select(*keep, F.inline(F.array(*cells))).where(F.col("v").isNotNull())


def current_and_previous(df: DataFrame, measures, order_by) -> DataFrame:
    """Last and second-last non-null value per measure.

    The rank filter is applied in every task before rows move, so at most two rows per
    task and measure are shuffled.
    """
    keys, order = _ordered(df, order_by)
    newest = Window.partitionBy("column").orderBy(*[F.desc(c) for c in order])
    ranked = _long(df, measures, keys).withColumn("rn", F.row_number().over(newest)).where(
        F.col("rn") <= 2)
    return ranked.groupBy("column").agg(
        F.max(F.when(F.col("rn") == 1, F.col("v"))).alias("current_val"),
        F.max(F.when(F.col("rn") == 2, F.col("v"))).alias("prev_val"))


def change_of_current(df: DataFrame, measures, order_by, digits=2) -> DataFrame:
    """Current, previous and the change in percent of the previous."""
    return current_and_previous(df, measures, order_by).withColumn(
        "pct_change", relative_change(F.col("current_val"), F.col("prev_val"), digits))


def percentile_of_current(df: DataFrame, measures, order_by, digits=1) -> DataFrame:
    """Share of all values that do not exceed the current one, in percent."""
    # one row per measure
    current = F.broadcast(current_and_previous(df, measures, order_by))
    share = F.avg((F.col("v") <= F.col("current_val")).cast("double")) * 100
    return _long(df, measures).join(current, "column").groupBy("column").agg(
        F.max("current_val").alias("current_val"),
        F.when(F.count("v") > 1, rounded(share, digits)).alias("percentile"))


def row_slopes(df: DataFrame, measures, order_by) -> DataFrame:
    """Least-squares slope of each measure over its row order, and its deviation."""
    keys, order = _ordered(df, order_by)
    numbered = dense_index(_long(df, measures, keys), order, within=["column"], name="i")
    return numbered.groupBy("column").agg(
        F.count("v").alias("n"),
        F.regr_slope("v", F.col("i").cast("double")).alias("slope"),
        F.stddev_samp("v").alias("std"))


def trend_label(direction: Column, pct_change: Column, slope: Column, std: Column,
                n: Column, has_time: bool) -> Column:
    """improving / deteriorating / stable, by change and, over time, by slope."""
    up = F.when(direction == "neutral", pct_change > 0).when(
        direction == "higher_is_better", pct_change > 0).otherwise(pct_change < 0)
    margin = F.when(direction == "neutral", 3.0).otherwise(1.0)
    by_change = (
        F.when(pct_change.isNull(), "insufficient_data")
        .when(F.abs(pct_change) <= margin, "stable")
        .when(up, "improving").otherwise("deteriorating"))
    if not has_time:
        return by_change
    rising = F.when(direction == "higher_is_better", slope > 0).when(
        direction == "lower_is_better", slope < 0)
    by_slope = (
        F.when(F.abs(slope) < std * 0.05, "stable")
        .when((direction == "neutral") | (slope == 0), by_change)
        .when(rising, "improving").otherwise("deteriorating"))
    return F.when((n >= 4) & slope.isNotNull(), by_slope).otherwise(by_change)


def period_rows(df: DataFrame, time: str, measures, grain=None) -> DataFrame:
    """Mean per period and measure with the period's ordinal and the mean before it.

    Periods are few in practice and are ordered in one window per measure; where a
    raw timestamp or a grain finer than a day has more than 100,000 of them, they are numbered with a distributed sort
    and looked up by number instead.
    """
    period = F.col(f"`{time}`") if grain is None else F.date_trunc(grain, F.col(f"`{time}`"))
    source = df.withColumn("_period", period).where(F.col("_period").isNotNull())
    label = period_order(df, time) if grain is None else F.lit(None).cast("int")
    means = source.groupBy("_period", label.alias("_key")).agg(
        *[F.avg(clean(df.schema, m)).alias(f"m{i}") for i, m in enumerate(measures)])
    cells = [F.struct(F.lit(m).alias("measure"), F.col(f"m{i}").alias("mean"))
             for i, m in enumerate(measures)]
    rows = means.select("_key", F.col("_period").alias("period"), F.inline(F.array(*cells))).where(
        F.col("mean").isNotNull())
    if grain in _CALENDAR or estimate_distinct(source, ["_period"])["_period"] <= _WINDOW_PERIODS:
        by_period = Window.partitionBy("measure").orderBy("_key", "period")
        return rows.select(
            "*", (F.row_number().over(by_period) - 1).cast("long").alias("ordinal"),
            F.lag("mean").over(by_period).alias("prev_mean"))
    numbered = dense_index(rows, ["_key", "period"], within=["measure"], name="ordinal")
    before = numbered.select("measure", (F.col("ordinal") + 1).alias("ordinal"),
                             F.col("mean").alias("prev_mean"))
    return numbered.join(before, ["measure", "ordinal"], "left")


def temporal_patterns(df: DataFrame, time: str, measures, grain=None, digits=4) -> DataFrame:
    """Per measure: first and latest period mean, change, slope over periods, direction
    and whether the steps vary strongly."""
    rows = period_rows(df, time, list(measures), grain).withColumn(
        "step", F.col("mean") - F.col("prev_mean"))
    stats = rows.groupBy("measure").agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.min_by("period", "ordinal").cast("string").alias("min_period"),
        F.max_by("period", "ordinal").cast("string").alias("max_period"),
        F.min_by("mean", "ordinal").alias("baseline"),
        F.max_by("mean", "ordinal").alias("latest"),
        F.regr_slope("mean", F.col("ordinal").cast("double")).alias("slope"),
        F.stddev_pop("mean").alias("std"),
        F.count("step").alias("n_steps"),
        F.stddev_pop("step").alias("step_std"),
        F.avg(F.abs("step")).alias("step_size"),
    ).where(F.col("n_periods") >= 2)
    return stats.select(
        F.lit(time).alias("time_col"), F.col("measure").alias("measure_col"),
        F.when(F.abs("slope") < F.col("std") * 0.03, "flat").when(F.col("slope") > 0, "up")
        .when(F.col("slope") < 0, "down").otherwise("volatile").alias("trend_dir"),
        rounded(F.col("slope"), digits).alias("trend_slope"),
        "min_period", "max_period", "n_periods",
        rounded(F.col("latest"), digits).alias("latest_val"),
        rounded(F.col("baseline"), digits).alias("baseline_val"),
        guarded_change(F.col("latest"), F.col("baseline")).alias("pct_change"),
        ((F.col("n_steps") >= 4) & (F.col("step_std") > F.col("step_size") * 0.5))
        .alias("is_seasonal"))


def trend_reversals(df: DataFrame, time: str, measures, grain=None) -> DataFrame:
    """Measures whose last step runs against the slope before it, by over twice its size."""
    rows = period_rows(df, time, list(measures), grain)
    last = rows.groupBy("measure").agg(
        F.max("ordinal").alias("last"), F.count(F.lit(1)).alias("n_periods"),
        F.max_by("mean", "ordinal").alias("last_val"),
        F.max_by("prev_mean", "ordinal").alias("before_last"),
        F.max_by("period", "ordinal").cast("string").alias("last_period"))
    # `last` is one row per measure
    slopes = rows.join(F.broadcast(last.select("measure", "last")), "measure").where(
        F.col("ordinal") < F.col("last")).groupBy("measure").agg(
        F.regr_slope("mean", F.col("ordinal").cast("double")).alias("long_slope"))
    move = F.col("last_val") - F.col("before_last")
    limit = F.abs("long_slope") * 2
    return last.join(slopes, "measure").where(F.col("n_periods") >= 4).withColumn(
        "last_move", move
    ).where(((F.col("long_slope") > 0) & (move < -limit))
            | ((F.col("long_slope") < 0) & (move > limit))).select(
        "measure", "last_period", "last_val", "long_slope", "last_move")


def period_variance(df: DataFrame, value: str, previous: str) -> DataFrame:
    """Every row with `_delta` and `_pct_chg` against the previous value."""
    now, before = clean(df.schema, value), clean(df.schema, previous)
    return df.withColumn("_delta", F.round(now - before, 4)).withColumn(
        "_pct_chg", relative_change(now, before))


def variance_summary(df: DataFrame, value: str, previous: str) -> DataFrame:
    return period_variance(df, value, previous).agg(
        F.avg("_delta").alias("mean_delta"), F.avg("_pct_chg").alias("mean_pct_chg"))


def highest(df: DataFrame, measure: str, n=5, tie_break=()) -> DataFrame:
    """The n rows with the largest values, nulls last; ties by `tie_break` ascending."""
    return df.orderBy(F.col(f"`{measure}`").desc_nulls_last(), *tie_break).limit(n)


def lowest(df: DataFrame, measure: str, n=5, tie_break=()) -> DataFrame:
    return df.orderBy(F.col(f"`{measure}`").asc_nulls_last(), *tie_break).limit(n)


def ranking(df: DataFrame, measure=None, n=10, tie_break=()) -> DataFrame:
    """The n best rows by a measure, or the first n rows in `tie_break` order."""
    if measure is None:
        if not tie_break:
            raise ValueError("a ranking without a measure needs tie_break columns")
        return df.orderBy(*tie_break).limit(n)
    return highest(df, measure, n, tie_break)


def top_rows(df: DataFrame, measures, dims, n=3, tie_break=()) -> DataFrame:
    """The n best rows of each measure with their dimension values."""
    dims, measures = list(dims), list(measures)
    tie_break = list(tie_break)
    keep = list(dict.fromkeys([*dims, *tie_break]))
    best = Window.partitionBy("column").orderBy(F.desc("v"), *tie_break)
    return (
        _long(df, measures, keep).withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= n)
        .select(F.col("column").alias("measure"), "place", F.col("v").alias("value"), *dims))


CSV_LINES = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def one_line(text: Column) -> Column:
    """A text without line breaks: backslash, line feed and return are escaped, and an
    empty text is `\\0`, which a CSV field tells from null."""
    for raw, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.when(text == "", "\\0").otherwise(text)


def many_lines(text: Column) -> Column:
    """The text that `one_line` escaped."""
    plain = lambda part: F.replace(
        F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.when(text != "\\0", F.array_join(
        F.transform(F.split(text, r"\\\\"), plain), "\\")).when(text.isNotNull(), "")


def row_batches(df: DataFrame, order_by, source_id=None, rows_per_chunk=words.ROWS_PER_CHUNK,
                source_column=None) -> DataFrame:
    """Rows in `order_by` order as CSV chunks of `rows_per_chunk`, per source.

    Each chunk has a banner, a header line and its rows, one line each (`one_line`);
    the numbering is global per
    source, and every chunk is built from its own few rows.
    """
    within = [source_column] if source_column else []
    data = [c for c in df.columns if c != source_column]
    numbered = dense_index(df, order_by, within=within, name="_no")
    source = F.col(source_column) if source_column else F.lit(source_id)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    cell = lambda c: one_line(F.col(f"`{c}`")) if kinds[c] == "string" else F.col(f"`{c}`")
    lines = numbered.select(
        source.cast("string").alias("source_id"), "_no",
        F.to_csv(F.struct(*[cell(c).alias(c) for c in data]), CSV_LINES).alias("_line"))
    sizes = lines.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"))
    batches = lines.withColumn("batch_no", F.floor(F.col("_no") / rows_per_chunk)).groupBy(
        "source_id", "batch_no"
    ).agg(F.sort_array(F.collect_list(F.struct("_no", "_line"))).alias("_rows"))
    start = F.col("batch_no") * rows_per_chunk
    end = F.least(start + rows_per_chunk, F.col("total"))
    header = ",".join(data)
    content = F.concat(
        F.format_string("=== DATA ROWS %d–%d of %d ===\n", start + 1, end, F.col("total")),
        F.lit(header + "\n"), F.array_join(F.col("_rows._line"), "\n"), F.lit("\n"))
    return batches.join(sizes, "source_id").select(
        "source_id", "batch_no", start.alias("row_start"), end.alias("row_end"), "total",
        content.alias("content")
    ).select("*", short_hash(F.col("content")).alias("chunk_id"),
             token_estimate(F.col("content")).alias("token_count"))


def rank_in(column: str, order: list[str]) -> Column:
    """Position of a word in a fixed order; unknown words last."""
    place = F.array_position(F.array(*[F.lit(w) for w in order]), F.col(column))
    return F.when(place > 0, place).otherwise(F.lit(len(order) + 1))


def by_status(signals: DataFrame) -> DataFrame:
    return signals.orderBy(rank_in("status", words.STATUS_ORDER), "name")


def by_severity(signals: DataFrame, n=None, tie_break=()) -> DataFrame:
    ranked = signals.orderBy(rank_in("severity", words.SEVERITY_ORDER), *tie_break)
    return ranked if n is None else ranked.limit(n)
