"""Comparison of two versions of a keyed table, without a join.

Both sides are stacked and counted per distinct row, so equal rows cancel before
anything is compared and a key of any multiplicity is combined map-side first.  Only
what is left over is grouped by key.
"""

from pyspark.sql import DataFrame, functions as F


def _leftovers(left: DataFrame, right: DataFrame, keys, column_map) -> DataFrame:
    """One row per key: equal rows, unmatched rows per side, and their values."""
    cols = list(column_map)
    l = left.select(*keys, *cols, F.lit(1).alias("_l"), F.lit(0).alias("_r"),
                    F.lit(False).alias("_odd"))
    # a value the left type cannot hold is a change, never equal to a null
    odd = F.lit(False)
    for c in cols:
        value = F.col(f"`{column_map[c]}`")
        odd = odd | (value.isNotNull() & value.try_cast(left.schema[c].dataType).isNull())
    r = right.select(
        *keys, *[F.col(f"`{column_map[c]}`").try_cast(left.schema[c].dataType).alias(c)
                 for c in cols],
        F.lit(0).alias("_l"), F.lit(1).alias("_r"), odd.alias("_odd"))
    rows = l.unionByName(r).groupBy(*keys, *cols, "_odd").agg(
        F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    same = F.least("_l", "_r")
    values = F.struct(*cols)
    return rows.groupBy(*keys).agg(
        F.sum(same).alias("same_rows"),
        F.sum(F.col("_l") - same).alias("left_rows"),
        F.sum(F.col("_r") - same).alias("right_rows"),
        F.max(F.when(F.col("_l") > same, values)).alias("_left"),
        F.max(F.when(F.col("_r") > same, values)).alias("_right"),
    ).withColumn(
        "status",
        F.when((F.col("left_rows") == 0) & (F.col("right_rows") == 0), "matched")
        .when(F.col("right_rows") == 0, "left_only")
        .when(F.col("left_rows") == 0, "right_only")
        .when((F.col("left_rows") == 1) & (F.col("right_rows") == 1), "changed")
        .otherwise("duplicate_key"))


def compare_rows(left: DataFrame, right: DataFrame, keys, column_map) -> DataFrame:
    """Keys with their status and row counts.

    `matched`, `changed` (one differing row on each side), `left_only`, `right_only`,
    or `duplicate_key` where several differing rows per side cannot be paired.
    """
    return _leftovers(left, right, keys, column_map).drop("_left", "_right")


def compare_cells(left: DataFrame, right: DataFrame, keys, column_map) -> DataFrame:
    """The differing cells of changed rows: key, column, both values as text."""
    changed = _leftovers(left, right, keys, column_map).where(F.col("status") == "changed")
    cells = [F.struct(
        F.lit(c).alias("column"),
        F.col(f"_left.{c}").cast("string").alias("left_value"),
        F.col(f"_right.{c}").cast("string").alias("right_value"),
        (~F.col(f"_left.{c}").eqNullSafe(F.col(f"_right.{c}"))).alias("differs"))
        for c in column_map]
    return changed.select(*keys, F.inline(F.array(*cells))).where("differs").drop("differs")


def compare_summary(left: DataFrame, right: DataFrame, keys, column_map) -> DataFrame:
    """Rows per outcome, and matching and differing cells of the paired rows."""
    cols = list(column_map)
    keyed = _leftovers(left, right, keys, column_map)
    changed = F.col("status") == "changed"
    differing = F.lit(0)
    for c in cols:
        differing = differing + F.when(
            F.col(f"_left.{c}").eqNullSafe(F.col(f"_right.{c}")), 0).otherwise(1)
    total = lambda condition, n: F.coalesce(
        F.sum(F.when(condition, n).otherwise(0)), F.lit(0)).cast("long")
    is_status = lambda s: F.col("status") == s
    return keyed.agg(
        F.coalesce(F.sum("same_rows"), F.lit(0)).alias("matched_rows"),
        total(changed, F.lit(1)).alias("changed_rows"),
        total(is_status("left_only"), F.col("left_rows")).alias("left_only_rows"),
        total(is_status("right_only"), F.col("right_rows")).alias("right_only_rows"),
        total(is_status("duplicate_key"), F.col("left_rows")).alias("unpaired_left_rows"),
        total(is_status("duplicate_key"), F.col("right_rows")).alias("unpaired_right_rows"),
        (F.coalesce(F.sum("same_rows"), F.lit(0)) * len(cols)
         + total(changed, F.lit(len(cols)) - differing)).alias("matched_cells"),
        total(changed, differing).alias("changed_cells"),
    )
