"""Numeric helpers as column expressions that never throw under ANSI mode."""

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def finite(v: Column) -> Column:
    """NaN and infinities become NULL."""
    d = v.cast("double")
    return F.when(~F.isnan(d) & ~d.isin(float("inf"), float("-inf")), d)


def clean(schema: StructType, name: str) -> Column:
    """A numeric column as double, with NaN as NULL when the type can hold NaN."""
    col = F.col(f"`{name}`").cast("double")
    if isinstance(schema[name].dataType, (DoubleType, FloatType)):
        return F.nanvl(col, F.lit(None).cast("double"))
    return col


def rounded(v: Column, digits) -> Column:
    """Round to `digits`, or leave the value alone when `digits` is None."""
    return v if digits is None else F.round(v, digits)


def percent(part: Column, whole: Column, digits=1) -> Column:
    """part / whole in percent; NULL when the whole is 0."""
    return rounded(F.try_divide(part * F.lit(100.0), whole), digits)


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs; NULL where one side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    # A constant side has a spread of rounding errors, not of exactly 0.
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))


def relative_change(now: Column, before: Column, digits=2) -> Column:
    """(now - before) / |before| in percent; NULL when `before` is 0."""
    return rounded(F.try_divide(now - before, F.abs(before)) * 100, digits)


def guarded_change(now: Column, before: Column, digits=2) -> Column:
    """As `relative_change`, with a floor of 1e-9 under the divisor instead of NULL."""
    return rounded((now - before) / F.greatest(F.abs(before), F.lit(1e-9)) * 100, digits)
