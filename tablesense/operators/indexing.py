"""Dense row numbers over a whole table without a single-partition window."""

from pyspark.sql import DataFrame, Window, functions as F

from tablesense.session import durable

_POSITION_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id


def dense_index(df: DataFrame, order_by, within=(), name="row_no") -> DataFrame:
    """Number rows 0, 1, 2, … by `order_by`, restarting per `within` group if given.

    The table is range-sorted over all cores and stored once, so that the placement
    of rows is fixed.  A row's number is its position in its partition plus the rows
    in earlier partitions; only one count per partition is combined.  A group of any
    size therefore spreads over as many partitions as its sort keys allow.
    """
    within, order_by = list(within), list(order_by)
    if not order_by:
        raise ValueError("row numbers need explicit order_by columns")
    stored = durable(df.sort(*within, *order_by)).select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)).alias("_pos"),
    )
    if within:
        return _within_groups(df, stored, within, name)
    # One row per partition: a window without keys is bounded by the partition count.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset")
    )
    # The offsets are one row per partition, which bounds the broadcast.
    return stored.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_offset") + F.col("_pos")
    ).drop("_part", "_pos", "_offset")


def _within_groups(df: DataFrame, stored: DataFrame, within, name: str) -> DataFrame:
    """Numbers that restart per group.

    The sort keeps a group's rows together, so a row's number is its distance from the
    group's first row in its partition plus the group's rows in earlier partitions.  The
    join is on partition and group: a group of any size meets its counts in pieces.
    """
    groups = [f"_g{i}" for i in range(len(within))]
    earlier = Window.partitionBy(*groups).orderBy("_p").rowsBetween(
        Window.unboundedPreceding, -1)
    pieces = stored.groupBy(
        F.col("_part").alias("_p"), *[F.col(f"`{c}`").alias(g) for c, g in zip(within, groups)]
    ).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")).select(
        "_p", *groups,
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for c, g in zip(within, groups):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(g))
    return stored.join(pieces, same).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_pos") + F.col("_shift")).alias(name))
