"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is wanted target / size of source times. The whole copies are
certain; the fractional rest is rounded so that what one document gains another of the
same source loses: two documents are paired and words are moved from one to the other at
random, keeping both expectations, until one of them is integral. Every block of documents
leaves at most one undecided document per source, and a tree of blocks combines those.
"""

import math

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesense.llm.common import SPACES, numbered, stored, with_small_values
from tablesense.operators.indexing import dense_index

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Documents per block of the reduction tree; a level shrinks the undecided ones so much.
BLOCK = 1024

_UNIT = "row long, number long, doc_id long, source string, size long, source_size long, target double, " \
        "whole long, part double, settled boolean"


def sizes(docs: DataFrame, number: str | None = None) -> DataFrame:
    """number, doc_id, source and size: the number of words between ASCII white space.

    Lower-casing changes no count. Null and empty texts have size 0.
    """
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{SPACES}]+", " "))
    words = F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1
    return docs.select(
        (F.lit(None) if number is None else F.col(f"`{number}`")).cast("long").alias("number"), F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.when(text == "", F.lit(0)).otherwise(words).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share=1.5, most=2.0) -> DataFrame:
    """source, source_size, target: `share` of all words dealt out by weight.

    Weights go to sources by code point order, null last, repeating. A target stops at
    `most` times its source; the excess is dealt out again by weight until none is above.
    Only sums over all sources reach the driver.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = dense_index(sources.withColumn("_none", F.col("source").isNull()),
                         ["_none", "source"], name="rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    capped_at, level = F.col("source_size") * F.lit(float(most)), 0.0
    while True:
        # The words per unit of weight for sources below their cap; it only ever rises.
        full = F.col("weight") * F.lit(level) >= capped_at if level else F.lit(False)
        taken, free = ranked.agg(F.sum(F.when(full, capped_at).otherwise(0.0)),
                                 F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        raised = max(level, (share * total - taken) / free)
        if raised == level:
            break
        level = raised
    return ranked.select("source", "source_size", F.least(
        F.col("weight") * F.lit(level), capped_at).alias("target"))


def _draw(seed: int, one: int, other: int) -> float:
    """A number in [0, 1) that depends on the seed and the pair only."""
    x = (one * 0x9E3779B97F4A7C15 + other * 0xC2B2AE3D27D4EB4F + seed) & (2 ** 64 - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & (2 ** 64 - 1)
    return (x ^ x >> 31) / 2 ** 64


def pivot(p: float, s: int, q: float, t: int, draw: float) -> tuple[float, float]:
    """Move words between copies of sizes s and t with probabilities p and q.

    p * s + q * t is kept and both expectations are too; one result is exactly 0 or 1.
    """
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    if draw * (up + down) < down:
        return (1.0, q - up / t) if (1 - p) * s <= q * t else (p + up / s, 0.0)
    return (0.0, q + down / t) if p * s <= (1 - q) * t else (p - down / s, 1.0)


def _round_block(seed: int):
    """Pair the undecided documents of each (block, source) in the order they come."""
    def run(batches):
        group, held = None, None
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for row in rows:
                if (row["block"], row["source"]) != group:
                    if held:
                        out.append(held)
                    group, held = (row["block"], row["source"]), None
                if row["settled"]:
                    out.append(row)
                elif held is None:
                    held = row
                else:
                    a, b = pivot(held["part"], held["size"], row["part"], row["size"],
                                 _draw(seed, held["row"], row["row"]))
                    for unit, part in ((held, a), (row, b)):
                        unit["part"] = part
                        unit["settled"] = part in (0.0, 1.0)
                    done = [u for u in (held, row) if u["settled"]]
                    out += done
                    held = next((u for u in (held, row) if not u["settled"]), None)
            yield _unit_batch(out)
        if held:
            yield _unit_batch([held])
    return run


def _unit_batch(rows):
    schema = pa.schema([
        ("row", pa.int64()), ("number", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()),
        ("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()),
        ("whole", pa.int64()), ("part", pa.float64()), ("settled", pa.bool_())])
    return pa.RecordBatch.from_pylist(
        [{name: row[name] for name in schema.names} for row in rows], schema)


def mixed(docs: DataFrame, weights=WEIGHTS, share=1.5, most=2.0, seed: int = 42,
          block: int = BLOCK, number: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken; and
    number, if that names a column that numbers the rows.

    `taken` is copies * size. The words taken of a source differ from its target by less
    than its last undecided document, and no document is taken more than `most` times,
    rounded up. Documents without words are not taken. Order and randomness depend on
    doc_id, size and the seed only, so reruns agree; rows that share both are alike.
    A null source is a source of its own, the last. Repeated rows are rounded one by one.
    An empty table gives an empty result. Other columns are ignored.
    """
    sized = stored(sizes(docs, number), "sizes")
    targets = source_targets(sized, weights, share, most)
    same = F.col("source").eqNullSafe(F.col("_source"))
    wanted = sized.join(targets.withColumnRenamed("source", "_source"), same)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = rate - F.floor(rate)
    units = wanted.select(
        F.xxhash64(F.lit(seed), "doc_id", "size").alias("row"), "number", "doc_id", "source", "size",
        "source_size", "target", F.floor(rate).alias("whole"), part.alias("part"),
        (part == 0).alias("settled"))
    total = sized.count()
    levels = max(1, math.ceil(math.log(max(total, 2), block)))
    settled = []
    for level in range(levels + 1):
        # Blocks are runs of the hashed ids; the last level is one block for each source.
        blocks = 1 if level == levels else max(1, math.ceil(total / block ** (level + 1)))
        dealt = units.withColumn("block", F.pmod(F.col("row"), F.lit(blocks)))
        # Long documents first: the one left undecided at the end is then rarely long.
        rounded = stored(dealt.repartition("block", "source").sortWithinPartitions(
            "block", "source", F.desc("size"), "row", "doc_id").mapInArrow(
            _round_block(seed + level), _UNIT), f"rounded-{level}")
        settled.append(rounded.where("settled"))
        units = rounded.where("not settled")
        if blocks == 1:
            break
    settled.append(units.withColumn("part", F.round("part")))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    given = [] if number is None else ["number"]
    copies = F.col("whole") + F.col("part").cast("long")
    return out.select(*given, "doc_id", "source", "size", "source_size", "target",
                      copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated_to_targets(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The documents, each as often as the mix takes it, with all their columns.

    Rows are told apart by a number, so each of several rows with one id, or without, has
    the copies that the mix gives it.
    """
    rows, number = numbered(docs, "_mixed_row")
    counts = stored(mixed(rows, seed=seed, number=number).select("number", "copies"), "copies")
    top = counts.agg(F.max("copies")).first()[0] or 0  # a source's words are taken twice at most
    given = with_small_values(rows, number, counts, top, "_mixed_copies")
    return given.where("_mixed_copies > 0").select(
        *[F.col(f"`{name}`") for name in docs.columns],
        F.explode(F.sequence(F.lit(1), F.col("_mixed_copies"))).alias("_mixed_copy")).drop("_mixed_copy")
