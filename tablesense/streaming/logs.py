"""Structured Streaming jobs over append-only logs.

Each function maps a (streaming or batch) DataFrame to another; the caller starts the
query.  Event times must be TIMESTAMP, since watermarks do not take TIMESTAMP_NTZ.
"""

from pyspark.sql import DataFrame, Window, functions as F

from tablesense.functions.numbers import clean


def with_event_time(log: DataFrame, column: str) -> DataFrame:
    """The event time as TIMESTAMP (session time zone UTC)."""
    return log.withColumn(column, F.col(column).cast("timestamp"))


def windowed_counts(log: DataFrame, time: str, key: str, value: str, width="1 day",
                    late="1 hour") -> DataFrame:
    """Rows and mean value per tumbling window and key."""
    return log.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(clean(log.schema, value)).alias("total")
    ).select(F.col("w.start").alias("window_start"), key, "n", "total")


def activity_sessions(log: DataFrame, time: str, key: str, gap="30 minutes",
                      late="1 hour") -> DataFrame:
    """Spans of activity per key that end after a gap without events."""
    return log.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n")
    ).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
             "n")


def drop_replays(log: DataFrame, time: str, keys, ttl="1 hour") -> DataFrame:
    """The rows that no row of the same key precedes by the time to live or less.

    A batch walks the gaps between ordered times, so a replay renews the time to live; of
    rows of one time, the least hash stays. A stream keeps the first row of a key and drops
    others until its watermark, which follows the latest time by the time to live, has
    passed that row's own: it may take a row for a replay that a batch keeps, while its
    watermark is behind, and start a long chain of replays anew, which a batch does not.
    """
    keys = list(keys)
    if log.isStreaming:
        return log.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(time, "_hash"))
    marked = log.withColumn("_hash", F.xxhash64(*log.columns)).withColumn(
        "_fresh", before.isNull() | (F.col(time) > before + F.expr(f"INTERVAL {ttl}")))
    return marked.where("_fresh").drop("_hash", "_fresh")


def breach_alerts(log: DataFrame, key: str, value: str, thresholds: DataFrame,
                  threshold: str, direction: str) -> DataFrame:
    """Rows that breach the static threshold of their key; the direction was fixed by a
    batch run."""
    joined = log.join(thresholds, key)
    v, t = F.col(value), F.col(threshold)
    return joined.where(v < t if direction == "below" else v > t)
