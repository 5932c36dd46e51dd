"""The chunk store: an append-only Parquet table, latest version wins on read.

Writers only ever append, so a lost executor or a second writer cannot damage what is
there, and an upsert costs what it writes rather than what a source already holds.
Invalidation appends a marker; `compact` rewrites the live rows elsewhere.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_KEY = ("source_id", "chunk_id")


def _now(now) -> Column:
    return F.current_timestamp() if now is None else now


def save_chunks(chunks: DataFrame, path: str, ttl_seconds=3600, now: Column = None) -> None:
    """Append chunks with their extraction and expiry time."""
    stored = chunks.withColumn("extracted_dt", _now(now)).withColumn(
        "expires_dt",
        F.col("extracted_dt") + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    # few files per source, while a source of any size is still written by many tasks
    balanced = stored.hint("rebalance", F.col("source_id"))
    balanced.write.mode("append").partitionBy("source_id").parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, with source ids as they were written: the folder names alone
    would make numbers of ids such as 007."""
    schema = T.StructType([
        T.StructField(f.name, T.StringType() if f.name == "source_id" else f.dataType)
        for f in spark.read.parquet(path).schema.fields])
    return spark.read.schema(schema).parquet(path)


def invalidate(spark: SparkSession, path: str, source_id: str, now: Column = None) -> None:
    """Append a marker that hides everything the source stored before it."""
    schema = _read(spark, path).schema
    marker = spark.range(1).select(*[
        (F.lit(source_id) if f.name == "source_id"
         else _now(now) if f.name == "extracted_dt"
         else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])
    marker.write.mode("append").partitionBy("source_id").parquet(path)


def live_chunks(spark: SparkSession, path: str, now: Column = None, source_id=None) -> DataFrame:
    """The latest version of every chunk that is neither hidden nor expired.

    The key includes the chunk, so a source of any size spreads over all tasks; a
    source filter prunes partitions.
    """
    stored = _read(spark, path)
    if source_id is not None:
        stored = stored.where(F.col("source_id") == source_id)
    markers = stored.where(F.col("chunk_id").isNull()).groupBy("source_id").agg(
        F.max("extracted_dt").alias("_hidden"))
    rest = [c for c in stored.columns if c not in _KEY]
    latest = stored.where(F.col("chunk_id").isNotNull()).groupBy(*_KEY).agg(
        F.max_by(F.struct(*rest), "extracted_dt").alias("_row")
    ).select(*_KEY, "_row.*")
    visible = latest.join(markers, "source_id", "left").where(
        F.col("_hidden").isNull() | (F.col("extracted_dt") > F.col("_hidden"))).drop("_hidden")
    return visible.where(F.col("expires_dt").isNull() | (F.col("expires_dt") > _now(now)))


def load_chunks(spark: SparkSession, path: str, source_id: str, now: Column = None) -> DataFrame:
    """A source's live chunks by type and id."""
    return live_chunks(spark, path, now, source_id).orderBy("chunk_type", "chunk_id")


def list_cached(spark: SparkSession, path: str, now: Column = None) -> DataFrame:
    """Per source: live chunks, newest extraction, earliest expiry."""
    return live_chunks(spark, path, now).groupBy("source_id", "source_name").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max("extracted_dt").alias("extracted_dt"),
        F.min("expires_dt").alias("expires_dt"))


def compact(spark: SparkSession, path: str, target: str, now: Column = None) -> None:
    """Write the live rows to a new location."""
    live_chunks(spark, path, now).write.mode("errorifexists").partitionBy(
        "source_id").parquet(target)
