"""Exact quantiles by distributed selection, without bringing a column to one task.

Each round counts the values of a scan in slices of the range that still holds a wanted
rank, and keeps the slices the ranks fall in. The first slices are logarithmic, so that
values of any size part at once; later ones divide the range between the least and the
greatest value counted. Ranges of one round are equal or apart, so a value is counted at
most once however many quantiles are asked. When few values are left, or one value fills
its slice, values themselves are counted. Only the chosen slices reach the driver: two for
each column and quantile.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesense.functions.numbers import clean

#: Slices of a range, and slices per unit of the natural logarithm in the first round.
SLICES, PER_LOG = 4096, 32
#: Values of a range that are counted one by one.
FEW = 1 << 16
#: Beyond the logarithm of every double, in slices.
_FAR = 1 << 16


@dataclass(frozen=True)
class _Range:
    """Values from lo to hi of column number c: how many, how many lesser ones."""

    c: int
    lo: float
    hi: float
    n: int
    below: int

    @property
    def settled(self) -> bool:
        return self.n <= FEW or self.lo == self.hi


def long_measures(df: DataFrame, columns) -> DataFrame:
    """(column, v) rows for the non-null values of several numeric columns."""
    cells = [
        F.struct(F.lit(c).alias("column"), clean(df.schema, c).alias("v")) for c in columns
    ]
    return df.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull())


def _log_slice(v: Column) -> Column:
    """A number that never falls while v rises: Java's logarithm is monotonic."""
    size = F.greatest(F.least(F.floor(F.log(F.abs(v)) * PER_LOG), F.lit(_FAR - 1)), F.lit(1 - _FAR))
    return F.when(v == 0, F.lit(0)).otherwise(
        F.when(v > 0, size + _FAR).otherwise(-size - _FAR)).cast("long")


def _slice(v: Column, held: _Range) -> Column:
    share = (v - F.lit(held.lo)) / F.lit(held.hi - held.lo)
    return F.least(F.floor(share * SLICES), F.lit(SLICES - 1)).cast("long")


def _cells(df: DataFrame, columns, part) -> DataFrame:
    """(c, held, part, v): each value with the range that holds it and its slice there."""
    cells = []
    for c, name in enumerate(columns):
        v = clean(df.schema, name)
        held, piece = part(c, v)
        cells.append(F.struct(F.lit(c).alias("c"), held.cast("int").alias("held"),
                              piece.cast("long").alias("part"), v.alias("v")))
    return df.select(F.inline(F.filter(
        F.array(*cells), lambda x: x["held"].isNotNull() & x["v"].isNotNull())))


def _held(v: Column, ranges: list[_Range], value) -> Column:
    """value(number, range) of the range that holds v, null if none does."""
    out = F.lit(None)
    for i, held in enumerate(ranges):
        out = F.when(v.between(F.lit(held.lo), F.lit(held.hi)), value(i, held)).otherwise(out)
    return out


def _below(keys, order) -> Column:
    """How many values of the same keys come before."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(earlier), F.lit(0))


def _pieces(cells: DataFrame) -> DataFrame:
    """Counted slices, with the values of their range before them; a range has a fixed
    number of slices, which bounds the window."""
    counted = cells.groupBy("c", "held", "part").agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return counted.withColumn("before", _below(["c", "held"], "part"))


def _holds(rank, below, n):
    return (below <= rank) & (rank < below + n)


def _chosen(pieces: DataFrame, wanted: dict[int, list[int]], base: list[int]) -> list[_Range]:
    """The slices that hold a wanted rank; `base` has the values below each range."""
    ranks = pieces.sparkSession.createDataFrame(
        [(c, r) for c, own in wanted.items() for r in own], "_c int, rank long")
    below = F.col("before") + F.get(F.array(*[F.lit(b).cast("long") for b in base]), F.col("held"))
    # A few ranks per column, which bounds the broadcast.
    met = pieces.withColumn("below", below).join(
        F.broadcast(ranks), (F.col("c") == F.col("_c")) & _holds(
            F.col("rank"), F.col("below"), F.col("n")), "left_semi")
    return [_Range(r.c, r.lo, r.hi, r.n, r.below) for r in met.collect()]


def _ranks(n: int, probs) -> list[int]:
    """The ranks between which the quantiles of n values lie."""
    places = [p * (n - 1) for p in probs]
    return sorted({r for x in places for r in (int(x), math.ceil(x))})


def _selected(df: DataFrame, columns, probs):
    """(values of each column, the settled ranges that hold its wanted ranks)."""
    pieces = _pieces(_cells(df, columns, lambda c, v: (F.lit(0), _log_slice(v)))).persist()
    try:
        sizes = {r.c: r.n for r in pieces.groupBy("c").agg(F.sum("n").alias("n")).collect()}
        wanted = {c: _ranks(n, probs) for c, n in sizes.items()}
        ranges = _chosen(pieces, wanted, [0]) if wanted else []
    finally:
        pieces.unpersist()
    while not all(held.settled for held in ranges):
        done, rest = [x for x in ranges if x.settled], [x for x in ranges if not x.settled]

        def part(c, v):
            own = [(i, x) for i, x in enumerate(rest) if x.c == c]
            held = _held(v, [x for _, x in own], lambda i, _: F.lit(own[i][0]))
            return held, _held(v, [x for _, x in own], lambda _, x: _slice(v, x))

        ranges = done + _chosen(_pieces(_cells(df, columns, part)), wanted, [x.below for x in rest])
    return sizes, ranges


def exact_quantiles(df: DataFrame, columns, probs) -> DataFrame:
    """Linearly interpolated quantiles: rows of (column, prob, quantile).

    Runs a few scans when called and returns a table of one more. Columns without values
    have no rows.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    spark = df.sparkSession
    sizes, ranges = _selected(df, columns, probs)
    few = [x for x in ranges if x.lo != x.hi]
    equal = [(x.c, r, x.lo) for x in ranges if x.lo == x.hi
             for r in _ranks(sizes[x.c], probs) if x.below <= r < x.below + x.n]
    wanted = spark.createDataFrame(
        [(c, r) for c, n in sizes.items() for r in _ranks(n, probs)], "_c int, rank long")
    found = spark.createDataFrame(equal, "c int, rank long, v double")
    if few:
        def part(c, v):
            own = [(i, x) for i, x in enumerate(few) if x.c == c]
            return _held(v, [x for _, x in own], lambda i, _: F.lit(own[i][0])), F.lit(0)

        values = _cells(df, columns, part).groupBy("c", "held", "v").agg(F.count("v").alias("n"))
        below = _below(["c", "held"], "v") + F.get(
            F.array(*[F.lit(x.below).cast("long") for x in few]), F.col("held"))
        # At most FEW values a range in a window, and a few ranks per column to broadcast.
        found = found.union(values.withColumn("below", below).join(
            F.broadcast(wanted), (F.col("c") == F.col("_c")) & _holds(
                F.col("rank"), F.col("below"), F.col("n"))).select("c", "rank", "v"))
    places = []
    for c, n in sizes.items():
        for p in probs:
            x = p * (n - 1)
            places.append((c, columns[c], p, int(x), math.ceil(x), x - int(x)))
    asked = spark.createDataFrame(
        places, "c int, column string, prob double, one long, other long, part double")
    # One row per column and quantile, or rank: small on both sides.
    ends = F.broadcast(asked).join(found, "c").groupBy("column", "prob", "part").agg(
        F.max(F.when(F.col("rank") == F.col("one"), F.col("v"))).alias("a"),
        F.max(F.when(F.col("rank") == F.col("other"), F.col("v"))).alias("b"))
    return ends.select("column", "prob", (F.col("a") + (F.col("b") - F.col("a")) * F.col(
        "part")).alias("quantile"))


def wide_quantiles(df: DataFrame, columns, probs, names) -> DataFrame:
    """One row per column with the quantiles side by side under `names`."""
    long = exact_quantiles(df, columns, probs)
    return long.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(n)
          for p, n in zip(probs, names)]
    )
