"""Line deduplication by a log-template tree.

Lines are parsed to a fixed depth: the number of tokens, then the leading tokens, with
tokens that hold a digit as a variable field. A leaf has as many templates as its lines
need: lines that agree with a centre line in enough of the places after the leaf are one
template, with a variable field where they differ. Lines that agree on one group of places
meet the most frequent line of that group first; those that this does not drop meet each
other. Templates that recur across different documents are dropped.
"""

import re
from collections import Counter
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablesense.llm.common import (
    broadcast_value, own_columns, sized_slices, split_by_keys, stored, texts_of)

#: Leading tokens that lead to a leaf.
DEPTH = 3
#: Shorter lines are never dropped.
LEAST_TOKENS = 4
#: Part of a line's places after the leaf that must agree with its template's centre.
ALIKE = 0.7
#: Different texts a template must occur in to be dropped. All its lines go, none is kept, so
#: at two every pair of near copies would lose what it shares in both.
LEAST_DOCS = 3
#: Bits of the filter that spares most lines the shuffle, whatever the number of leaves.
FILTER_BITS = 1 << 24
#: Distinct counts a task holds before it passes them on.
COUNTED = 300_000
#: Bytes of texts a task works on at once, and of a batch that goes to Python.
PART, BATCH = 1 << 20, "8m"

_DIGIT = re.compile(rb"[0-9]")
FIELD = b"<*>"


def tokens_of(line: bytes) -> list[bytes]:
    """The tokens of a line, variable fields as FIELD; only lines with digits have any."""
    found = line.split()
    if _DIGIT.search(line):
        found = [FIELD if _DIGIT.search(t) else t for t in found]
    return found


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def leaf_of(tokens: list[bytes], depth: int = DEPTH) -> int:
    """The leaf a line reaches: by its token count, then its leading tokens."""
    return _hash(b"%d " % len(tokens) + b" ".join(tokens[:depth]))


def text_key(text: bytes) -> bytes:
    """A whole text's 128-bit key: copies of a text share their lines' fate."""
    return xxhash.xxh128_digest(text)


def _slots(leaves: np.ndarray) -> np.ndarray:
    return (leaves.astype(np.uint64) >> np.uint64(40)).astype(np.int64) % FILTER_BITS


def _leaf_counts(depth: int):
    """(leaf, documents) of the texts, added up in the task."""
    def run(batches):
        found = Counter()

        def counted():
            return pa.RecordBatch.from_pydict({
                "leaf": pa.array(list(found), pa.int64()),
                "docs": pa.array(list(found.values()), pa.int64())})

        for _, texts in chain.from_iterable(map(_parts, batches)):
            for text in texts:
                lines = [tokens_of(x) for x in text.split(b"\n")]
                found.update({leaf_of(t, depth) for t in lines if len(t) >= LEAST_TOKENS})
            if len(found) > COUNTED:
                yield counted()
                found = Counter()
        yield counted()
    return run


def _parts(batch: pa.RecordBatch):
    """A batch in runs of about PART bytes of text, with their texts, which bounds what is
    held beside the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    for at, stop in sized_slices(sizes.tolist(), PART):
        part = batch.slice(at, stop - at)
        yield part, texts_of(part)


def _leaf_lines(sent, depth: int):
    """A row for each distinct line of a text that lies in a leaf of several documents:
    hashes of the text, the line and each token."""
    def run(batches):
        bits = sent.value
        for _, texts in chain.from_iterable(map(_parts, batches)):
            out = {"key": [], "leaf": [], "line": [], "tokens": []}
            for text in texts:
                lines = {b" ".join(t): t for t in map(tokens_of, text.split(b"\n"))
                         if len(t) >= LEAST_TOKENS}
                leaves = np.array([leaf_of(t, depth) for t in lines.values()], dtype=np.int64)
                slots = _slots(leaves)
                key = None
                for (line, tokens), leaf, held in zip(
                        lines.items(), leaves, bits[slots >> 3] >> (slots & 7) & 1):
                    if held:
                        key = key or text_key(text)
                        for column, value in zip(out.values(), (
                                key, leaf, _hash(line), [_hash(t) for t in tokens[depth:]])):
                            column.append(value)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(out["key"], pa.binary()), "leaf": pa.array(out["leaf"], pa.int64()),
                "line": pa.array(out["line"], pa.int64()),
                "tokens": pa.array(out["tokens"], pa.list_(pa.int64()))})
    return run


def _least_alike(places: int) -> int:
    """Places after the leaf that must agree, of so many."""
    return max(1, ceil(places * ALIKE - 1e-9))


def _buckets(batches):
    """(line, n, bucket): lines of a leaf that differ in at most d places agree on all of at
    least one of d + 1 groups of places. Lines too short to differ have no bucket."""
    for batch in batches:
        out = {"line": [], "n": [], "bucket": []}
        tokens = batch.column("tokens")
        ends, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        leaves, lines, counts = (batch.column(x).to_pylist() for x in ("leaf", "line", "n"))
        for i, (leaf, line, n) in enumerate(zip(leaves, lines, counts)):
            own = flat[ends[i]:ends[i + 1]]
            differ = len(own) - _least_alike(len(own))
            for g in range(differ + 1 if differ > 0 else 0):
                for column, value in zip(out.values(), (line, n, _hash(
                        b"%d %d " % (leaf, g) + own[g::differ + 1].tobytes()))):
                    column.append(value)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})


def _alike(pairs: DataFrame, unique: DataFrame) -> DataFrame:
    """The (line, centre) of `pairs` that agree in enough places after the leaf."""
    pairs = pairs.where("line != centre").distinct()
    both = pairs.join(unique.select("line", "tokens"), "line").join(
        unique.select(F.col("line").alias("centre"), F.col("tokens").alias("common")), "centre")
    same = F.aggregate(F.zip_with("tokens", "common", lambda a, b: F.when(a == b, 1).otherwise(0)),
                       F.lit(0), lambda x, y: x + y)
    least = F.greatest(F.lit(1), F.ceil(F.size("tokens") * F.lit(ALIKE) - F.lit(1e-9)))
    return both.where((F.size("tokens") == F.size("common")) & (same >= least)).select(
        "line", "centre")


def _often(alike: DataFrame, lines: DataFrame, least_docs: int) -> DataFrame:
    """The lines of templates, each a centre with the lines alike to it, that occur in
    `least_docs` different texts or more."""
    centres = alike.select("centre").distinct()
    members = stored(alike.union(centres.select(F.col("centre").alias("line"), "centre")), "members")
    often = lines.select("key", "line").join(members, "line").select(
        "centre", "key").distinct().groupBy("centre").agg(F.count("*").alias("docs")).where(
        F.col("docs") >= least_docs).select("centre")
    return members.join(often, "centre", "left_semi").select("line")


def recurring(texts: DataFrame, depth: int = DEPTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(key, line): lines, by the hash of their masked tokens, whose template occurs in
    `least_docs` different texts or more. `texts` has every different text once."""
    leaves = texts.select("text").mapInArrow(_leaf_counts(depth), "leaf long, docs long").groupBy(
        "leaf").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    # Only bytes of the filter reach the driver, however many leaves there are.
    at = F.pmod(F.shiftrightunsigned("leaf", 40), F.lit(FILTER_BITS)).cast("int")
    held = leaves.groupBy(F.shiftright(at, 3).alias("byte")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), at % 8)).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    bits[held.column("byte").to_numpy()] = held.column("bits").to_numpy()
    sent = broadcast_value(texts, bits)
    lines = stored(texts.select("text").mapInArrow(
        _leaf_lines(sent, depth),
        "key binary, leaf long, line long, tokens array<long>"), "leaf-lines", BATCH)
    sent.unpersist()
    unique = stored(lines.groupBy("leaf", "line").agg(
        F.count("*").alias("n"), F.first("tokens").alias("tokens")), "unique-lines")
    # A text has each of its lines once, so n counts different texts.
    same = unique.where(F.col("n") >= least_docs).select("line")
    entries = stored(unique.mapInArrow(_buckets, "line long, n long, bucket long"), "buckets")
    tops = entries.groupBy("bucket").agg(
        F.max(F.struct("n", "line")).alias("top"), F.count("*").alias("lines")).where(
        "lines > 1").select("bucket", F.col("top.line").alias("centre"))
    first = stored(_alike(entries.join(tops, "bucket").select("line", "centre"), unique), "alike")
    found = stored(same.union(_often(first, lines, least_docs)).distinct(), "found")
    # Lines that no frequent line took along meet each other.
    left = entries.join(found, "line", "left_anti").select("bucket", "line")
    left = stored(left, "left")
    several = left.groupBy("bucket").agg(F.count("*").alias("lines")).where("lines > 1")
    left = left.join(several.select("bucket"), "bucket", "left_semi")
    met = left.join(left.withColumnRenamed("line", "centre"), "bucket").select("line", "centre")
    second = stored(_alike(met, unique), "alike")
    found = found.union(_often(second, lines, least_docs)).distinct()
    return lines.join(found, "line", "left_semi").select("key", "line").distinct()


def without_recurring_lines(docs: DataFrame, depth: int = DEPTH,
                            least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per document: doc_id, text without its recurring lines, n_lines, n_dropped.

    A line ends at a line feed. Lines of fewer than LEAST_TOKENS tokens always stay.
    Templates count once per different text, so copies of one document alone drop nothing;
    lines equal but for white space or fields with digits are one template. Null and empty
    texts have no lines and stay as they are. Repeated rows come out repeated. Other
    columns are ignored.
    """
    own = own_columns(docs, "doc_id", "text")
    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    copies = stored(own.groupBy(key.alias("sha")).agg(F.count("*").alias("n")).where(
        "n > 1").select("sha"), "copies")
    # Texts are told apart by their key alone, whatever their ids.
    others, shared = split_by_keys(own.withColumn("sha", key), "sha", copies)
    texts = others.select("text").union(shared.select("text").distinct())
    drops = recurring(texts, depth, least_docs).groupBy("key").agg(
        F.collect_set("line").alias("lines"))
    drops = stored(drops, "drops")

    def keyed(batches):
        for part, texts in chain.from_iterable(map(_parts, batches)):
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "text": part.column("text"),
                "key": pa.array([text_key(t) for t in texts], pa.binary())})

    kind = own.schema["doc_id"].dataType.simpleString()
    marked = own.mapInArrow(keyed, f"doc_id {kind}, text string, key binary")
    plain, cut = split_by_keys(marked, "key", drops.select("key"))

    def rewritten(batches):
        for part, texts in chain.from_iterable(map(_parts, batches)):
            out, counts, gone = [], [], []
            null = part.column("text").is_null().to_pylist()
            for text, none, drop in zip(texts, null, part.column("lines").to_pylist()):
                drop, lines = set(drop or ()), text.split(b"\n")
                kept = [x for x in lines if not drop or _hash(b" ".join(tokens_of(x))) not in drop
                        or len(x.split()) < LEAST_TOKENS]
                out.append(None if none else b"\n".join(kept))
                counts.append(len(lines) if text else 0)
                gone.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "text": pa.array(out, pa.binary()).cast(pa.string()),
                "n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array(gone, pa.int64())})

    none = F.array().cast("array<long>")
    both = plain.select("doc_id", "text", none.alias("lines")).union(
        cut.join(drops, "key").select("doc_id", "text", "lines"))
    return stored(both.mapInArrow(
        rewritten, f"doc_id {kind}, text string, n_lines long, n_dropped long"), "rewritten", BATCH)
