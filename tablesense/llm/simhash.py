"""Near duplicates by SimHash, searched with the generalised pigeonhole principle.

Fingerprints within `bits` of each other agree on at least one of m groups of bits up to
that group's own threshold, whenever the thresholds add up to bits - m + 1 (-1 leaves a
group out). Correlated bits go into one group, and dynamic programming deals the
thresholds out so that the estimated candidates and probes are fewest. The estimates come
from a bounded sample and only steer the cost: the search is exact.
"""

import itertools
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablesense.llm.common import (
    hashed_sample, own_columns, stored, texts_of, words_of)
from tablesense.llm.components import components

#: Fingerprints in the sample that estimates correlations and candidate counts.
SAMPLE = 4096
#: Cost of storing and shuffling a probe, in verified candidates.
PROBE_COST = 8.0


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """SimHash over the word shingles of a text, repeats included; 0 without words."""
    found = words_of(text)
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(x) + 1 for x in found])
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()[words - 1:] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends)], dtype="<u8")
    return print_of(hashes)


def print_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 without hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, print): the fingerprint of each whole text as a signed long."""
    def run(batches):
        for batch in batches:
            prints = [fingerprint(t, words, seed) for t in texts_of(batch)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "print": pa.array(np.array(prints, dtype=np.uint64).view(np.int64))})

    own = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.mapInArrow(run, "doc_id long, print long")


def _distances(sample: np.ndarray, mask: int) -> np.ndarray:
    """How many pairs of the sample differ by 0, 1, … bits under a mask."""
    found = np.zeros(65, dtype=np.int64)
    part = sample & np.uint64(mask)
    for i in range(0, len(part), 256):
        apart = np.bitwise_count(part[i:i + 256, None] ^ part[None, :])
        found += np.bincount(apart.ravel(), minlength=65)
    return found


def _grouped_bits(sample: np.ndarray, groups: int) -> list[int]:
    """Masks of `groups` groups of bits, correlated bits together.

    Greedy: a group starts with the bit most correlated to any free one and takes the
    free bit with the largest mean absolute correlation to the group until it is full.
    """
    on = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    spread = on - on.mean(0)
    scale = np.sqrt((spread ** 2).sum(0)) + 1e-9
    alike = np.abs(spread.T @ spread) / np.outer(scale, scale)
    np.fill_diagonal(alike, 0)
    free, masks = set(range(64)), []
    for size in [len(x) for x in np.array_split(np.arange(64), groups)]:
        pool = sorted(free)
        own = [max(pool, key=lambda b: (alike[b, pool].max(), -b))]
        while len(own) < size:
            pool = sorted(free.difference(own))
            own.append(max(pool, key=lambda b: (alike[b, own].mean(), -b)))
        free.difference_update(own)
        masks.append(sum(1 << b for b in own))
    return masks


def _dealt(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds, one per group from -1 up, that add up to `total`.

    costs[i][t + 1] is what threshold t costs in group i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for (sum_, (paid, chosen)), t in itertools.product(best.items(), range(-1, len(cost) - 1)):
            option = (paid + cost[t + 1], [*chosen, t])
            if sum_ + t not in step or option < step[sum_ + t]:
                step[sum_ + t] = option
        best = step
    return best[total]


def allocation(sample: np.ndarray, rows: int, bits: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the groups to search, chosen over all group counts to bits + 1."""
    pairs = max(1, len(sample) ** 2)
    plans = []
    for groups in range(1, bits + 2):
        masks = _grouped_bits(sample, groups)
        costs = []
        for mask in masks:
            width, apart = mask.bit_count(), _distances(sample, mask)
            cost = [0.0]
            for t in range(bits + 1):
                # a pair the sample does not show may still be there: spread over 2^width
                seen = max(apart[:t + 1].sum() / pairs,
                           sum(comb(width, k) for k in range(t + 1)) / 2.0 ** width)
                probes = sum(comb(width, k) for k in range(t + 1))
                cost.append(seen * rows * rows / 2 + PROBE_COST * rows * (1 + probes))
            costs.append(cost)
        paid, chosen = _dealt(costs, bits - groups + 1)
        plans.append((paid, [(m, t) for m, t in zip(masks, chosen) if t >= 0]))
    return min(plans, key=lambda plan: plan[0])[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _flips(mask: int, most: int) -> list[int]:
    """All masks with at most `most` of the bits of `mask`."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [_signed(sum(1 << b for b in chosen))
            for k in range(most + 1) for chosen in itertools.combinations(bits, k)]


def close_pairs(prints: DataFrame, bits: int) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in at most `bits`.

    `prints` has one row per distinct fingerprint. Each is stored once per group and
    probed with all values within the group's threshold. A pair that several groups
    find is kept by the first of them only, and distances are verified inside the
    join, so no candidate leaves it.
    """
    rows = prints.count()
    sample = np.array([r[0] for r in hashed_sample(prints, ["print"], SAMPLE, rows).collect()],
                      dtype=np.int64).view(np.uint64)
    if rows < 2:
        return prints.select(F.col("print").alias("a"), F.col("print").alias("b")).limit(0)
    groups = allocation(sample, rows, bits)
    kept, probes = [], []

    def address(i, key):
        return F.struct(F.lit(i).alias("i"), key.alias("key"))

    for i, (mask, most) in enumerate(groups):
        part = F.col("print").bitwiseAND(F.lit(_signed(mask)))
        kept.append(address(i, part))
        probes.append(F.array(*[address(i, part.bitwiseXOR(F.lit(x)))
                                for x in _flips(mask, most)]))
    index = prints.select(F.col("print").alias("b"), F.explode(F.array(*kept)).alias("at"))
    probe = prints.select(F.col("print").alias("a"), F.explode(F.concat(*probes)).alias("at"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(False)
    for i, (mask, most) in enumerate(groups):
        near = F.bit_count(apart.bitwiseAND(F.lit(_signed(mask)))) <= most
        earlier = earlier | ((F.col("i") > i) & near)
    found = probe.select("a", "at.i", "at.key").join(
        index.select("b", F.col("at.i").alias("i"), F.col("at.key").alias("key")), ["i", "key"])
    return found.where((F.col("a") < F.col("b")) & (F.bit_count(apart) <= bits) & ~earlier).select(
        "a", "b")


def near_groups(docs: DataFrame, words: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, class_size, links.

    A fingerprint is over the whole text: A-Z lower-cased, words between ASCII white space,
    shingles of `words` words joined by a space (all words, if fewer). Fingerprints link
    at `bits` or fewer differing bits; component_id is the smallest doc_id reachable.
    class_size counts the documents with the same fingerprint and links the other
    fingerprints that it links to; copies are never paired with one another. Null and
    empty texts have fingerprint zero and link like any other. Repeated rows come out
    repeated. A document with a null id takes part; a component of such documents alone
    has a null component_id. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, words, seed), "prints")
    classes = stored(prints.groupBy("print").agg(
        F.count("*").alias("class_size"), F.min("doc_id").alias("first_id")), "classes")
    links = stored(close_pairs(classes.select("print"), bits), "pairs")
    reach = components(links).withColumnRenamed("node", "print")
    degree = links.select(F.col("a").alias("print")).union(links.select("b")).groupBy(
        "print").agg(F.count("*").alias("links"))
    joined = classes.join(reach, "print", "left").join(degree, "print", "left").select(
        "print", "class_size", "first_id", F.coalesce("component", "print").alias("component"),
        F.coalesce("links", F.lit(0)).alias("links"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = joined.join(least, "component").select(
        "print", "class_size", "links", "component_id")
    return prints.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id", "class_size", "links")
