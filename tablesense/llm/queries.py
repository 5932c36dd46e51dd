"""The registered queries of this subpackage, and their SQL where it can say them."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesense.llm import (
    exactdedup, langid, lattice, linedup, mixing, packing, quality, repair, secrets, simhash,
    tokencounts, topk, wordruns)

QUERIES = {}
SQL = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_lattice_likelihood(spark, folder):
    return lattice.lattice_scores(_table(spark, folder, "documents"))


@_query
def op2_norm_sorted_topk(spark, folder):
    return topk.top_products(_table(spark, folder, "embeddings"))


@_query
def op3_pivotal_mixing(spark, folder):
    return mixing.mixed(_table(spark, folder, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken")


@_query
def op4_blob_ledger(spark, folder):
    return secrets.secrets(_table(spark, folder, "documents"))


@_query
def op5_simhash_pigeonhole(spark, folder):
    return simhash.near_groups(_table(spark, folder, "documents"))


@_query
def op6_kneser_ney_quality(spark, folder):
    return quality.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


SQL["op7_heavy_hitter_dedup"] = r"""
  WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
             FROM documents)
  SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
         row_number() OVER best = 1 AS kept, sha256(bare) AS text_sha256
  FROM d WINDOW best AS (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST)"""


@_query
def op7_heavy_hitter_dedup(spark, folder):
    return exactdedup.exact_groups(_table(spark, folder, "documents")).drop("hot")


@_query
def op8_hierarchical_packing(spark, folder):
    return packing.packed(_table(spark, folder, "documents"))


@_query
def op9_log_template_lines(spark, folder):
    return linedup.without_recurring_lines(_table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@_query
def op10_byte_network_language(spark, folder):
    return langid.languages(_table(spark, folder, "documents"))


@_query
def op11_overlap_token_counts(spark, folder):
    return tokencounts.token_counts(_table(spark, folder, "documents"))


@_query
def op12_grammar_repair(spark, folder):
    return repair.damaged_and_repaired(_table(spark, folder, "conversations"))


@_query
def op13_grammar_word_runs(spark, folder):
    return wordruns.word_runs(_table(spark, folder, "documents"), plant=True, texts=False)


@_query
def pipeline(spark, folder):
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)
