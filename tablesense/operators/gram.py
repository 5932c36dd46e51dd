"""Moments of all pairs of many measures, as one matrix per task.

With hundreds of measures, an aggregate with one expression for each pair is too long to
compile. Here a task multiplies its rows, a batch at a time, with themselves and with the
masks of what is present; the small matrices of the tasks are then added by pair. Values
are first shifted by their column's mean, so that large values of small spread keep their
digits.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesense.functions.numbers import clean

_MOMENTS = "i int, j int, n double, sum_i double, square_i double, product double"
#: Part of the sum of squares below which a variance is rounding alone.
_ROUNDING = 1e-12


def _task_moments(width: int):
    """(i, j) rows of a task: how many rows have both, and over these the sums of the
    i-th value, of its square, and of both values' product."""
    def run(batches):
        n, sums, squares, products = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x = np.array(columns, dtype=np.float64).reshape(width, -1)
            here = ~np.isnan(x)
            x, mask = np.where(here, x, 0.0), here.astype(np.float64)
            n += mask @ mask.T
            sums += x @ mask.T
            squares += (x * x) @ mask.T
            products += x @ x.T
        at = np.indices((width, width), dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.ravel()) for a in (*at, n, sums, squares, products)],
            [c.split()[0] for c in _MOMENTS.split(", ")])
    return run


def pair_correlations(df: DataFrame, columns) -> DataFrame:
    """(i, j, correlation) for i < j, Pearson's over the rows that have both values; null
    where fewer than two rows do or one side is constant. Two scans: one for the means of
    the columns, one for everything else. Infinite values count as missing."""
    columns = list(columns)
    value = [F.when(F.abs(v) < float("inf"), v) for v in (clean(df.schema, c) for c in columns)]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(value)]).first()
    shifted = df.select(*[(v - F.lit(m or 0.0)).alias(f"c{i}")
                          for i, (v, m) in enumerate(zip(value, means))])
    totals = shifted.mapInArrow(_task_moments(len(columns)), _MOMENTS).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sum_i", "square_i", "product")])
    upper, lower = F.col("i") < F.col("j"), F.col("i") > F.col("j")
    pairs = totals.where("i != j").groupBy(
        F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(
        *[F.max(F.when(upper, F.col(c))).alias(c) for c in ("n", "sum_i", "square_i", "product")],
        *[F.max(F.when(lower, F.col(c))).alias(d)
          for c, d in (("sum_i", "sum_j"), ("square_i", "square_j"))])

    def spread(total, square):
        left = F.col(square) - F.col(total) * F.col(total) / F.col("n")
        return F.when(left > F.col(square) * _ROUNDING, left)

    both = F.col("product") - F.col("sum_i") * F.col("sum_j") / F.col("n")
    r = both / F.sqrt(spread("sum_i", "square_i") * spread("sum_j", "square_j"))
    return pairs.select(F.col("a").alias("i"), F.col("b").alias("j"),
                        F.when((F.col("n") >= 2) & r.isNotNull(),
                               F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
                        .alias("correlation"))
