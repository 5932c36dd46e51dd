"""Column profiles: one row of facts per column, read in a bounded number of scans."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DateType, DoubleType, FloatType, MapType, NumericType,
    StringType, StructType, TimestampNTZType, TimestampType,
)

from tablesense.functions import words
from tablesense.functions.numbers import rounded

_STATISTICS = ("min", "max", "mean", "std", "sum")
_LISTED = 30  # longest value list kept; no list of status words is longer
_VISUAL_DATE = r"(?i)^\s*(?:" + words.VISUAL_DATE_VALUE.replace("^", "") + ")"
_SEMANTIC_DATE = r"(?i)^\s*(?:" + words.SEMANTIC_DATE_VALUE.replace("^", "") + ")"
_SAMPLED = 1000  # up to here samples are the five least values, beyond the extremes
_SMALL = 1500  # estimated distinct values up to which a column's value set is gathered


def profiled_columns(df: DataFrame) -> list[str]:
    """Columns with plain values; nested ones carry no role."""
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (ArrayType, MapType, StructType))]


def _estimates(columns) -> list[str]:
    return ["approx_count_distinct(`" + c.replace("`", "``") + "`, 0.02)" for c in columns]


def estimate_distinct(df: DataFrame, columns) -> dict[str, int]:
    """HyperLogLog estimate per column: one scan, one row back."""
    if not columns:
        return {}
    row = df.selectExpr(*_estimates(columns)).first()
    return {c: row[i] for i, c in enumerate(columns)}


def profile_columns(df: DataFrame, source_id="table", exact=True, columns=None) -> DataFrame:
    """One row per column: type, nulls, distinct values, statistics, samples.

    A first scan estimates distinct counts, a second reads the statistics.  Columns with
    few values get their value set, its size and the facts of texts from their counted
    values, in one scan for each data type; map-side aggregation keeps them small.  The
    others are counted exactly (`exact=True`), each in its own one-column subquery that
    moves long texts as their SHA-256, or keep the estimate, marked
    `n_unique_exact = false`; that is the setting for tables where counting every distinct
    key is not worth a shuffle of the column.
    """
    columns = columns or profiled_columns(df)
    return _described(df, source_id, exact, columns, estimate_distinct(df, columns))


def _quoted(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _value_counts(df: DataFrame, columns: list[tuple[int, str]]):
    """Map of each column's number to its sorted (v, n), values and their counts; columns of
    one type with few values, which bounds it."""
    structs = [f"named_struct('i', {i}, 'v', {c})" for i, c in columns]
    each = (df.selectExpr(f"{columns[0][0]} AS i", f"{columns[0][1]} AS v") if len(columns) == 1
            else df.selectExpr(f"inline(array({', '.join(structs)}))"))
    counted = each.where("v IS NOT NULL").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    sets = counted.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("s"))
    return sets.agg(F.map_from_entries(F.collect_list(F.struct("i", "s")))).scalar()


def _total(i: int, value: str) -> str:
    """Whole sum over the counted values `p` of column `i`."""
    return f"aggregate(counts{i}, 0L, (a, p) -> a + {value})"


def _described(df: DataFrame, source_id: str, exact: bool, columns, estimate) -> DataFrame:
    # SQL texts rather than column objects: a wide table has hundreds of expressions
    aggregates, counters, records = ["count(1) AS n_rows"], {}, []
    alike, counts = {}, {}  # few-valued columns by type, and what their counted values give
    for i, name in enumerate(columns):
        kind = df.schema[name].dataType
        numeric, is_text = isinstance(kind, NumericType), isinstance(kind, StringType)
        c = "`" + name.replace("`", "``") + "`"
        if isinstance(kind, (DoubleType, FloatType)):
            c = f"nanvl({c}, NULL)"  # NaN counts as missing
        few = estimate[name] <= _SMALL
        stats, length, visual, semantic = ["NULL"] * 5, "0", "0", "0"
        if few:
            alike.setdefault(kind, []).append((i, c))
            counts[f"n{i}"] = _total(i, "p.n")
            counts[f"set{i}"] = f"transform(counts{i}, p -> p.v)"
            unique = f"CAST(size(set{i}) AS BIGINT)"
            samples = (f"CASE WHEN size(set{i}) <= {_SAMPLED} THEN slice(set{i}, 1, 5) "
                       f"ELSE array(set{i}[0], element_at(set{i}, -1)) END")
            values = f"CASE WHEN size(set{i}) <= {_LISTED} THEN set{i} END"
            if is_text:
                hits = lambda p: _total(i, f"IF(p.v RLIKE {_quoted(p)}, p.n, 0L)")
                length = f"try_divide({_total(i, 'length(p.v) * p.n')}, n{i})"
                visual, semantic = hits(_VISUAL_DATE), hits(_SEMANTIC_DATE)
        else:
            aggregates.append(f"count({c}) AS n{i}")
            if exact:
                # plain texts of 32 bytes and more are told apart by 32 bytes of SHA-256
                v = (f"IF(octet_length({c}) < 32, CAST({c} AS BINARY), unhex(sha2({c}, 256)))"
                     if kind == StringType() else c)
                distinct = df.selectExpr(f"{v} AS v").where("v IS NOT NULL").distinct()
                counters[f"u{i}"] = distinct.agg(F.count(F.lit(1))).scalar()
            else:
                aggregates.append(f"approx_count_distinct({c}, 0.02) AS u{i}")
            aggregates += [f"min({c}) AS lo{i}", f"max({c}) AS hi{i}"]
            unique, samples, values = f"u{i}", f"array(lo{i}, hi{i})", "NULL"
            if is_text:
                aggregates += [f"avg(length({c})) AS len{i}",
                               f"count_if({c} RLIKE {_quoted(_VISUAL_DATE)}) AS vdate{i}",
                               f"count_if({c} RLIKE {_quoted(_SEMANTIC_DATE)}) AS sdate{i}"]
                length, visual, semantic = f"len{i}", f"vdate{i}", f"sdate{i}"
        if numeric:
            aggregates += [f"min({c}) AS min{i}", f"max({c}) AS max{i}", f"avg({c}) AS mean{i}",
                           f"stddev_samp({c}) AS std{i}", f"sum(CAST({c} AS DOUBLE)) AS sum{i}"]
            stats = [f"{s}{i}" for s in _STATISTICS]
        flag = lambda b: "true" if b else "false"
        dated = isinstance(kind, (DateType, TimestampType, TimestampNTZType))
        fields = {
            "position": str(i), "column": _quoted(name), "dtype": _quoted(kind.simpleString()),
            "is_numeric": flag(numeric), "is_boolean": flag(isinstance(kind, BooleanType)),
            "is_dated": flag(dated), "is_text": flag(is_text), "n_null": f"n_rows - n{i}",
            "n_unique": unique, "n_unique_exact": flag(few or exact),
            "samples": f"CAST({samples} AS ARRAY<STRING>)",
            "value_list": f"CAST({values} AS ARRAY<STRING>)",
            **{s: f"CAST({e} AS DOUBLE)" for s, e in zip(_STATISTICS, stats)},
            "mean_length": f"CAST({length} AS DOUBLE)",
            "visual_dates": f"CAST({visual} AS BIGINT)",
            "semantic_dates": f"CAST({semantic} AS BIGINT)",
        }
        records.append("named_struct(" + ", ".join(
            f"'{k}', {v}" for k, v in fields.items()) + ")")
    gathered = df.selectExpr(*aggregates)
    maps = {i: (f"kind{k}", _value_counts(df, own)) for k, own in enumerate(alike.values())
            for i, _ in own}
    counters |= dict(maps.values())
    if counters:
        gathered = gathered.withColumns(counters)
    for more in ({f"counts{i}": f"coalesce({m}[{i}], array())" for i, (m, _) in maps.items()},
                 counts):
        gathered = gathered.selectExpr("*", *[f"{e} AS {name}" for name, e in more.items()])
    rows = gathered.selectExpr(f"{_quoted(source_id)} AS source_id", "n_rows",
                               f"inline(array({', '.join(records)}))")
    keep = [c for c in rows.columns if c not in _STATISTICS]
    return rows.selectExpr(*keep[:12], *[
        f"CASE WHEN n_unique > 1 THEN {s} END AS {s}" for s in _STATISTICS], *keep[12:])


def value_flags(profile: DataFrame) -> DataFrame:
    """Whether the values of a column with few of them look like statuses or flags."""
    low = F.transform("value_list", lambda v: F.lower(v))
    listed = lambda ws: F.split(F.lit("|".join(ws)), r"\|")
    within = lambda ws: F.coalesce(
        (F.size(low) > 0) & (F.size(F.array_except(low, listed(ws))) == 0), F.lit(False))
    return profile.withColumns({
        "profile_rag": within(words.PROFILE_RAG_VALUES),
        "visual_rag": within(words.VISUAL_RAG_VALUES),
        "status_like": within(words.STATUS_LIKE_VALUES),
        "boolean_like": within(words.BOOLEAN_LIKE_VALUES),
        "semantic_rag": F.coalesce(
            F.arrays_overlap(low, listed(words.SEMANTIC_RAG_VALUES)), F.lit(False)),
    })


def null_percent(profile: DataFrame) -> DataFrame:
    """Add the share of nulls in percent, one decimal."""
    share = F.try_divide(F.col("n_null") * 100.0, F.col("n_rows"))
    return profile.withColumn("null_pct", rounded(F.coalesce(share, F.lit(0.0)), 1))


def profile_catalogue(tables: dict[str, DataFrame], exact=True) -> DataFrame:
    """The profile rows of many tables in one DataFrame, keyed by source.

    All estimates come from one job, all profiles from another.
    """
    columns = {name: profiled_columns(df) for name, df in tables.items()}
    estimates = reduce(DataFrame.unionByName, [
        df.selectExpr(f"{_quoted(name)} AS source_id",
                      f"array({', '.join(_estimates(columns[name]))}) AS estimates")
        for name, df in tables.items() if columns[name]])
    found = {r["source_id"]: dict(zip(columns[r["source_id"]], r["estimates"]))
             for r in estimates.collect()}
    return reduce(DataFrame.unionByName, [
        _described(df, name, exact, columns[name], found[name])
        for name, df in tables.items() if columns[name]])


def fingerprint(df: DataFrame) -> DataFrame:
    """12 hex digits over the sorted column names and the row count."""
    names = str(sorted(df.columns))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.substring(F.md5(F.concat(F.lit(names), F.col("n_rows").cast("string"))), 1, 12)
        .alias("fingerprint"),
    )
