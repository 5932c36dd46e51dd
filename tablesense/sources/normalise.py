"""Normalisation of raw exports: names, null markers, number texts, long measures."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from tablesense.functions import words
from tablesense.operators.indexing import dense_index


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def fix_columns(df: DataFrame) -> DataFrame:
    """Trim names, collapse double blanks, and number repeated names `c_1`, `c_2`, …"""
    counts: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = str(raw).strip().replace("  ", " ")
        if name in counts:
            counts[name] += 1
            names.append(f"{name}_{counts[name]}")
        else:
            counts[name] = 0
            names.append(name)
    return df.toDF(*names)


def _mapped(df: DataFrame, change) -> DataFrame:
    """Rewrite some columns in one projection, keeping the order of columns."""
    return df.select(
        *[change.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns]
    )


def fix_nulls(df: DataFrame, markers=tuple(words.NULL_MARKERS)) -> DataFrame:
    """Trim strings and turn null markers (and NaN) into NULL."""
    change: dict[str, Column] = {}
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType):
            text = F.trim(c)
            change[field.name] = F.when(~text.isin(list(markers)), text)
        elif isinstance(field.dataType, (DoubleType, FloatType)):
            change[field.name] = F.nanvl(c, F.lit(None).cast(field.dataType))
    return _mapped(df, change)


def clean_strings(df: DataFrame) -> DataFrame:
    """Trim strings; `nan`, `None` and the empty text become NULL."""
    return fix_nulls(df, markers=tuple(words.TEXT_NULL_MARKERS))


def number_from_text(c: Column) -> Column:
    """`1,000` → 1000.0 and `12%` → 12.0; NULL when it is no number."""
    return F.translate(c, ",%", "").try_cast("double")


def numeric_text_shares(df: DataFrame) -> DataFrame:
    """Per string column: the share of its non-null values that read as numbers."""
    cols = string_columns(df)
    shares = df.agg(
        *[
            F.avg(
                F.when(F.col(f"`{c}`").isNotNull(),
                       number_from_text(F.col(f"`{c}`")).isNotNull().cast("double"))
            ).alias(f"s{i}")
            for i, c in enumerate(cols)
        ]
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("share"))
            for i, c in enumerate(cols)]
    return shares.select(F.inline(F.array(*rows)))


def coerce_numeric(df: DataFrame, min_ratio=0.85) -> DataFrame:
    """String columns of which more than `min_ratio` reads as numbers become double.

    The test looks at the whole column in one pass; only one row per string column
    comes back to decide the new schema.
    """
    if not string_columns(df):
        return df
    chosen = numeric_text_shares(df).where(F.col("share") > min_ratio).select("column")
    change = {r[0]: number_from_text(F.col(f"`{r[0]}`")) for r in chosen.collect()}
    return _mapped(df, change) if change else df


def pivot_measure_names(df: DataFrame, order_by=(), names=None) -> DataFrame:
    """Long `(dims…, Measure Names, Measure Values)` to one column per measure.

    The first non-null value by `order_by` wins in each cell (the least value when no
    order is given).  Without dimensions the k-th value of every measure forms row k.
    `names` lists the measures; when absent they are read from the data.
    """
    lower = {c.lower(): c for c in df.columns}
    name_col, value_col = lower.get("measure names"), lower.get("measure values")
    if name_col is None or value_col is None:
        return df
    order_by = list(order_by)
    dims = [c for c in df.columns if c not in (name_col, value_col, *order_by)]
    if names is None:
        found = df.select(name_col).where(F.col(f"`{name_col}`").isNotNull()).distinct()
        names = sorted(r[0] for r in found.collect())
    value = F.col(f"`{value_col}`")
    if dims:
        grouped = df.dropna(subset=dims).groupBy(*dims)
    else:
        if not order_by:
            raise ValueError("a table without dimensions needs order_by to number its rows")
        df = dense_index(df, order_by, within=[name_col], name="_row")
        grouped = df.groupBy("_row")
    first = (
        F.min_by(value, F.when(value.isNotNull(), F.struct(*order_by)))
        if order_by else F.min(value)
    )
    wide = grouped.pivot(name_col, names).agg(first)
    return wide if dims else wide.orderBy("_row").drop("_row")


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold no value at all, found in one counting pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}")
                      for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if counts[i] == 0])


def normalise(df: DataFrame, order_by=()) -> DataFrame:
    """The whole clean-up: names, nulls, number texts, measure pairs, empty parts."""
    df = fix_nulls(fix_columns(df))
    df = pivot_measure_names(coerce_numeric(df), order_by)
    return drop_empty_columns(drop_empty_rows(df))
