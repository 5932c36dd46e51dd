"""Grouped and scalar aggregates.  Null keys are left out, as in the catalogue's spec."""

from pyspark.sql import DataFrame, Window, functions as F

from tablesense.functions.numbers import clean, pearson, percent, rounded
from tablesense.functions.periods import period_order
from tablesense.operators.gram import pair_correlations
from tablesense.operators.quantiles import wide_quantiles


def _keyed(df: DataFrame, *keys) -> DataFrame:
    return df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))


def average_by(df: DataFrame, dim: str, measures, digits=4) -> DataFrame:
    """Mean of each measure per group, `avg_<measure>`."""
    return _keyed(df, dim).groupBy(dim).agg(
        *[rounded(F.avg(clean(df.schema, m)), digits).alias(f"avg_{m}") for m in measures])


def averages(df: DataFrame, measures, digits=4) -> DataFrame:
    """Mean of each measure over the table, one row per measure."""
    row = df.agg(*[F.avg(clean(df.schema, m)).alias(m) for m in measures])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), rounded(F.col(m), digits).alias("average"))
        for m in measures])))


def total(df: DataFrame, measure: str) -> DataFrame:
    """Sum of a measure; 0 when it has no values."""
    return df.agg(F.coalesce(F.sum(clean(df.schema, measure)), F.lit(0.0)).alias("total"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def count_by(df: DataFrame, dim: str) -> DataFrame:
    """Rows per value."""
    return _keyed(df, dim).groupBy(dim).agg(F.count(F.lit(1)).alias("count"))


def distribution(df: DataFrame, column: str, of="present", digits=1) -> DataFrame:
    """(value, count, pct); `of="rows"` divides by all rows instead of non-null ones.

    The total of present values comes from the grouped rows, whose exchange is reused;
    the row count reads no column at all.
    """
    counts = df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    present = counts.where(F.col("value").isNotNull())
    whole = (df.agg(F.count(F.lit(1))) if of == "rows" else present.agg(F.sum("count"))).scalar()
    return present.select(
        "value", "count", percent(F.col("count"), whole, digits).alias("pct"))


def summary_stats(df: DataFrame, measures) -> DataFrame:
    """count, sum, mean, min, max and sample deviation per measure, in one scan."""
    chosen = list(measures)
    aggs = []
    for i, m in enumerate(chosen):
        c = clean(df.schema, m)
        aggs += [F.count(c).alias(f"c{i}"), F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s{i}"),
                 F.avg(c).alias(f"a{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
                 F.stddev_samp(c).alias(f"d{i}")]
    aggs.append(F.count(F.lit(1)).alias("total_rows"))
    rows = [F.struct(F.lit(m).alias("column"), F.col(f"c{i}").alias("count"),
                     F.col(f"s{i}").alias("sum"), F.col(f"a{i}").alias("mean"),
                     F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
                     F.col(f"d{i}").alias("std"), F.col("total_rows"),
                     F.lit(len(df.columns)).alias("total_cols"))
            for i, m in enumerate(chosen)]
    return df.agg(*aggs).select(F.inline(F.array(*rows))).where(F.col("count") > 0)


def describe(df: DataFrame, measures, digits=3) -> DataFrame:
    """count, mean, deviation, minimum, exact quartiles and maximum per measure."""
    quartiles = wide_quantiles(df, measures, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    stats = summary_stats(df, measures)
    joined = stats.join(quartiles, "column", "left")
    return joined.select("column", "count", *[
        rounded(F.col(c), digits).alias(c)
        for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def top_values(df: DataFrame, columns, n=5) -> DataFrame:
    """The n most frequent values of each text column, with their share of all rows."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
             for c in columns]
    counts = df.select(F.inline(F.array(*cells))).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("count"))
    whole = df.agg(F.count(F.lit(1))).scalar()
    best = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return (
        counts.where(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
        .select("column", "rank", "value", "count",
                percent(F.col("count"), whole).alias("pct"))
    )


def trend(df: DataFrame, time: str, measure: str, digits=None) -> DataFrame:
    """Mean per period."""
    return _keyed(df, time, measure).groupBy(time).agg(
        rounded(F.avg(clean(df.schema, measure)), digits).alias("mean"))


def trend_change(df: DataFrame, time: str, measure: str, digits=None) -> DataFrame:
    """Number of periods and change from the first to the last period's mean."""
    periods = trend(df, time, measure).withColumn("_key", period_order(df, time))
    order = F.struct("_key", time)
    return periods.agg(
        F.count(F.lit(1)).alias("n_periods"),
        rounded(F.max_by("mean", order) - F.min_by("mean", order), digits).alias("change"))


def trend_by(df: DataFrame, time: str, dim: str, measure: str, values, digits=None) -> DataFrame:
    """Mean per period, one column per value of `dim` (given, at most a few dozen)."""
    return _keyed(df, time, dim, measure).groupBy(time).pivot(dim, list(values)).agg(
        rounded(F.avg(clean(df.schema, measure)), digits))


def time_series(df: DataFrame, time: str, measure: str, dim=None) -> DataFrame:
    """Block form: sum per (period, series), or sum, mean and count per period when no
    dimension is given."""
    value = clean(df.schema, measure)
    if dim is not None:
        return _keyed(df, time, dim).groupBy(
            F.col(time).alias("period"), F.col(dim).cast("string").alias("series")
        ).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("value"))
    return _keyed(df, time).groupBy(F.col(time).alias("period")).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"), F.avg(value).alias("mean"),
        F.count(value).alias("count"))


def top_n(df: DataFrame, measure: str, dim: str, n=10) -> DataFrame:
    """The n groups with the largest sums."""
    value = clean(df.schema, measure)
    sums = _keyed(df, dim).groupBy(F.col(dim).cast("string").alias("label")).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("value"))
    return sums.orderBy(F.desc("value"), "label").limit(n)


def cross_tab(df: DataFrame, rows: str, cols: str, measure: str, values) -> DataFrame:
    """Sums by `rows` × `cols`, 0 in empty cells; `values` lists the columns."""
    return _keyed(df, rows, cols, measure).groupBy(rows).pivot(cols, list(values)).agg(
        F.sum(clean(df.schema, measure))).na.fill(0.0)


def cross_cells(df: DataFrame, rows: str, cols: str, measure: str) -> DataFrame:
    """The cells of a cross-tab in long form, for columns with any number of values."""
    return _keyed(df, rows, cols, measure).groupBy(
        F.col(f"`{rows}`").alias("row"), F.col(f"`{cols}`").alias("col")
    ).agg(F.sum(clean(df.schema, measure)).alias("value"))


#: Up to so many measures, all pairs are expressions of one aggregate.
FEW_MEASURES = 12


def _pair_values(df: DataFrame, cols) -> DataFrame:
    """(col_a, col_b, correlation) for every pair, the earlier measure first."""
    if len(cols) > FEW_MEASURES:
        name = lambda at: F.get(F.array(*[F.lit(c) for c in cols]), F.col(at))
        return pair_correlations(df, cols).select(
            name("i").alias("col_a"), name("j").alias("col_b"), "correlation")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[pearson(clean(df.schema, a), clean(df.schema, b)).alias(f"r{i}")
                   for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)])))


def correlation_pairs(df: DataFrame, measures, digits=3) -> DataFrame:
    """Pearson correlation of every pair of measures, strongest first.

    Few measures take one aggregate, many take matrices of moments: two scans, whatever
    their number.
    """
    r = F.abs("correlation")
    return (
        _pair_values(df, list(measures))
        .withColumn("correlation", rounded(F.col("correlation"), digits))
        .withColumn("strength",
                    F.when(r > 0.7, "strong").when(r > 0.4, "moderate").otherwise("weak"))
        .orderBy(F.desc_nulls_last(r), "col_a", "col_b")
    )


def correlation_matrix(df: DataFrame, measures, digits=3) -> DataFrame:
    """The full matrix: one row per measure, one column per measure."""
    cols = list(measures)
    if len(cols) > FEW_MEASURES:
        return _matrix_of_pairs(df, cols, digits)
    pairs = {(a, b): f"r{i}_{j}" for i, a in enumerate(cols)
             for j, b in enumerate(cols) if i < j}
    aggs = [pearson(clean(df.schema, a), clean(df.schema, b)).alias(n)
            for (a, b), n in pairs.items()]
    aggs += [F.stddev_samp(clean(df.schema, a)).alias(f"s{i}") for i, a in enumerate(cols)]
    cell = lambda a, b: (
        F.when(F.col(f"s{cols.index(a)}") > 0, F.lit(1.0)) if a == b
        else F.col(pairs.get((a, b)) or pairs[(b, a)]))
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("measure"),
                 *[rounded(cell(a, b), digits).alias(b) for b in cols])
        for a in cols])))


def _matrix_of_pairs(df: DataFrame, cols, digits) -> DataFrame:
    """The matrix from its pairs; a table of columns times columns, whatever the data."""
    spreads = df.agg(*[F.stddev_samp(clean(df.schema, c)).alias(f"s{i}") for i, c in enumerate(cols)])
    own = spreads.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.when(F.col(f"s{i}") > 0, 1.0).alias("r"))
        for i, c in enumerate(cols)])))
    pairs = _pair_values(df, cols)
    cells = own.union(pairs).union(pairs.select("col_b", "col_a", "correlation"))
    return cells.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "r"))).alias("m")
                                  ).select(F.col("a").alias("measure"), *[
        rounded(F.element_at("m", F.lit(c)), digits).alias(c) for c in cols])


def geo_aggregate(df: DataFrame, geo: str, measure: str) -> DataFrame:
    """Sum, mean and count per place, largest sum first."""
    value = clean(df.schema, measure)
    return _keyed(df, geo).groupBy(F.col(geo).cast("string").alias("geo")).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"), F.avg(value).alias("mean"),
        F.count(value).alias("count")
    ).orderBy(F.desc("sum"), "geo")


def histogram(df: DataFrame, measure: str, bins=20) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed, empty ones
    included.  Fewer than five distinct values give no histogram."""
    values = df.select(clean(df.schema, measure).alias("v")).where(F.col("v").isNotNull())
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                        F.approx_count_distinct("v").alias("d"))
    found = bounds.select(F.struct("lo", "hi", "d")).scalar()
    lo, hi, estimate = found["lo"], found["hi"], found["d"]
    # The exact distinct count matters only while it may be below the number of bins;
    # otherwise the filter empties the input of the distinct step.
    few = values.where(estimate <= 5 * bins).distinct().agg(F.count(F.lit(1)).alias("n"))
    n = F.when(estimate > 5 * bins, F.lit(bins)).otherwise(
        F.least(F.lit(bins), few.select("n").scalar())).cast("int")
    placed = values.groupBy(
        F.least(F.width_bucket("v", lo, hi, n), n).cast("long").alias("bin")
    ).agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("hi") - F.col("lo")) / F.col("n")
    frame = bounds.withColumn("n", n).where(F.col("n") >= 5).select(
        "lo", "hi", "n", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    return frame.select(
        F.col("i").cast("long").alias("bin"),
        (F.col("lo") + width * (F.col("i") - 1)).alias("bin_start"),
        (F.col("lo") + width * F.col("i")).alias("bin_end"),
    ).join(placed, "bin", "left").na.fill(0, ["count"])


def bin_aggregate(df: DataFrame, bin_col: str, measure: str) -> DataFrame:
    """Sum per value of an already binned column, in bin order."""
    return _keyed(df, bin_col).groupBy(F.col(bin_col).alias("bin")).agg(
        F.coalesce(F.sum(clean(df.schema, measure)), F.lit(0.0)).alias("value")
    ).orderBy("bin")


def flag_summary(df: DataFrame, flag: str, measure: str, digits=4) -> DataFrame:
    """Count and mean of a measure per flag value."""
    return _keyed(df, flag).groupBy(F.col(flag).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count"),
        rounded(F.avg(clean(df.schema, measure)), digits).alias(f"avg_{measure}"))


def deviation(df: DataFrame, measure: str, digits=4) -> DataFrame:
    return df.agg(rounded(F.stddev_samp(clean(df.schema, measure)), digits).alias("std"))


def distinct_values(df: DataFrame, dim: str) -> DataFrame:
    return _keyed(df, dim).select(dim).distinct()


def kpi_cards(df: DataFrame, status, measures) -> DataFrame:
    """Summary cards: rows per status value, then mean and range of every measure."""
    cards = averages_with_range(df, measures)
    if status is None:
        return cards
    shares = distribution(df, status, of="rows", digits=0).select(
        F.lit("status").alias("card"), F.col("value").alias("label"),
        F.col("count").cast("double").alias("number"), F.col("pct").alias("low"),
        F.lit(None).cast("double").alias("high"))
    return shares.unionByName(cards)


def averages_with_range(df: DataFrame, measures) -> DataFrame:
    return summary_stats(df, measures).select(
        F.lit("measure").alias("card"), F.col("column").alias("label"),
        F.col("mean").alias("number"), F.col("min").alias("low"), F.col("max").alias("high"))


def kpi_rollup(signals: DataFrame) -> DataFrame:
    """How many KPI signals breach, are at risk and are on track."""
    return signals.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s)
          for s in ("breaching", "at_risk", "on_track")])


def group_means(df: DataFrame, dims, measures, digits=4) -> DataFrame:
    """Mean of every measure per value of every dimension: one scan, one shuffle.

    Rows are unfolded by dimension and pre-aggregated before they move.
    """
    dims, measures = list(dims), list(measures)
    # unfolding before the aggregate keeps partial sums per (dimension, value)
    cells = [F.struct(F.lit(d).alias("dim"), F.col(f"`{d}`").cast("string").alias("dim_val"))
             for d in dims]
    unfolded = df.select(
        F.inline(F.array(*cells)),
        *[clean(df.schema, m).alias(f"m{i}") for i, m in enumerate(measures)]
    ).where(F.col("dim_val").isNotNull())
    means = unfolded.groupBy("dim", "dim_val").agg(
        *[F.avg(f"m{i}").alias(f"m{i}") for i in range(len(measures))])
    facts = [F.struct(F.lit(m).alias("measure"), F.col(f"m{i}").alias("value"))
             for i, m in enumerate(measures)]
    return means.select("dim", "dim_val", F.inline(F.array(*facts))).withColumn(
        "value", rounded(F.col("value"), digits))


def token_totals(chunks: DataFrame) -> DataFrame:
    """Tokens per source."""
    return chunks.groupBy("source_id").agg(F.sum("token_count").alias("total_tokens"))


def mean_gap(df: DataFrame, pairs) -> DataFrame:
    """Relative gap in percent between the means of (measure, threshold) pairs."""
    columns = sorted({c for pair in pairs for c in pair})
    row = df.agg(*[F.avg(clean(df.schema, c)).alias(f"m{i}") for i, c in enumerate(columns)])
    mean = lambda c: F.col(f"m{columns.index(c)}")
    return row.select(F.inline(F.array(*[
        F.struct(
            F.lit(m).alias("measure"), F.lit(t).alias("threshold"),
            (F.abs(mean(m) - mean(t)) / F.greatest(F.abs(mean(t)), F.lit(1e-9)) * 100)
            .alias("gap_pct"),
            F.when(mean(m) < mean(t), "below").otherwise("above").alias("side"))
        for m, t in pairs]))).where(F.col("gap_pct").isNotNull())

