"""Exact duplicates by a heavy-hitter split.

Misra-Gries summaries find the digests that may be frequent; their exact counts and
winners are verified and broadcast, so copies of a hot text never meet in one task. All
other digests take an ordinary shuffle.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesense.llm.common import SPACES, give_back, own_columns, split_by_keys, stored

#: Counters per Misra-Gries summary. Any digest on more than 1/COUNTERS of all rows is
#: found, and no more than COUNTERS digests are ever broadcast.
COUNTERS = 256


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, SHA-256 of the text without white space, and its length in code points.

    A null text counts as empty. `row` tells repeated rows apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    squeezed = F.regexp_replace(text, f"[{SPACES}]+", "")
    return own_columns(docs, "doc_id", "text").select(
        "doc_id", F.unhex(F.sha2(squeezed.cast("binary"), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("length"),
        F.monotonically_increasing_id().alias("row"))


def misra_gries(keys, counters: int) -> dict:
    """The summary of a stream of keys: each count is at most len(keys)/counters short."""
    held: dict = {}
    for key in keys:
        if key in held:
            held[key] += 1
        elif len(held) < counters:
            held[key] = 1
        else:
            held = {k: n - 1 for k, n in held.items() if n > 1}
    return held


def frequent(rows: DataFrame, total: int, counters: int = COUNTERS) -> DataFrame:
    """The digests that may cover over 1/counters of the rows, at most 2 * counters.

    Summaries of 2 * counters entries, one per partition, are added up by digest. Their
    counts add up to `total` at most, and one that is short by total / (2 * counters) at
    most still reaches that value for every digest looked for.
    """
    def summarise(batches):
        give_back()  # an earlier stage's
        held = misra_gries((key for batch in batches
                            for key in batch.column("digest").to_pylist()), 2 * counters)
        yield pa.RecordBatch.from_pydict({
            "digest": pa.array(list(held), pa.binary()),
            "n": pa.array(list(held.values()), pa.int64())})

    return rows.select("digest").mapInArrow(summarise, "digest binary, n long").groupBy(
        "digest").agg(F.sum("n").alias("n")).where(
        F.col("n") * (2 * counters) >= total).select("digest")


def winner():
    """The row that stays: longest text, then smallest id (null last), then first row."""
    return F.min(F.struct((-F.col("length")).alias("least"), F.col("doc_id").isNull().alias("no_id"),
                          "doc_id", "row"))


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and `hot`
    (the group was split off as a heavy hitter).

    Texts are equal when identical without white space. Null text counts as empty, and
    empty texts are one group. Repeated rows are copies of one another: exactly one row of
    a group is kept. A null doc_id stays only if no row of equal length has an id. An empty
    table gives an empty result. Other columns of `docs` are ignored.
    """
    rows = stored(digests(docs), "digests")
    total = rows.count()
    candidates = F.broadcast(frequent(rows, total, counters))
    counted = rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(
        F.count("*").alias("group_size"), winner().alias("best"))
    hot = stored(counted.where(F.col("group_size") * counters > total), "hot-digests")
    cold_rows = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    cold = cold_rows.groupBy("digest").agg(
        F.count("*").alias("group_size"), winner().alias("best"))
    parts = [
        rows.join(F.broadcast(hot), "digest").withColumn("hot", F.lit(True)),
        cold_rows.join(cold, "digest").withColumn("hot", F.lit(False)),
    ]
    return parts[0].unionByName(parts[1]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "hot")


def without_exact_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns.

    Texts move only where an id repeats: of rows that share both id and normalised text,
    one stays. Dropped copies are known by their ids, and a null id by its text.
    """
    groups = stored(exact_groups(docs, counters), "exact-groups")
    by_id = groups.groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.bool_or("kept").alias("kept"))
    alone, several = split_by_keys(
        docs, "doc_id", by_id.where("rows > 1").select("doc_id"))
    alone, no_id = alone.where("doc_id IS NOT NULL"), alone.where("doc_id IS NULL")
    stay = split_by_keys(alone, "doc_id", by_id.where("rows = 1 AND NOT kept").select("doc_id"))[0]
    text = F.regexp_replace(F.coalesce("text", F.lit("")), f"[{SPACES}]+", "")
    doubt = several.unionByName(no_id).withColumn(
        "_exact_here", F.sha2(text.cast("binary"), 256))
    winners = groups.where("kept").select(
        F.col("doc_id").alias("_exact_id"), F.col("text_sha256").alias("_exact_digest"))
    same = (F.col("doc_id").eqNullSafe(F.col("_exact_id"))
            & (F.col("_exact_here") == F.col("_exact_digest")))
    return stay.unionByName(doubt.join(winners, same, "left_semi").dropDuplicates(
        ["doc_id", "_exact_here"]).drop("_exact_here"))
