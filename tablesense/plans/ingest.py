"""From a table to stored text chunks, and from stored chunks to a context text."""

from pyspark.sql import Column, DataFrame, SparkSession

from tablesense.functions import words
from tablesense.operators import chunks
from tablesense.plans.onboard import Onboarded
from tablesense.sources import chunkstore


def ingest(o: Onboarded, path: str, rows_per_chunk=words.ROWS_PER_CHUNK, ttl_seconds=3600,
           now: Column = None) -> DataFrame:
    """Build all chunks of a source, store them, and return what was stored."""
    built = chunks.table_chunks(o.table, o.profile, o.roles, list(o.order_by), o.source_id,
                                o.source_name, rows_per_chunk)
    chunkstore.save_chunks(built, path, ttl_seconds, now)
    return chunkstore.load_chunks(o.table.sparkSession, path, o.source_id, now)


def stored_context(spark: SparkSession, path: str, max_tokens=words.CONTEXT_TOKENS,
                   now: Column = None) -> DataFrame:
    """The budgeted context text of every stored source."""
    return chunks.budgeted_context(chunkstore.live_chunks(spark, path, now), max_tokens)
