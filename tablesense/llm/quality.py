"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model.

The model is counted on all texts that train, and every n-gram of theirs keeps its value.
Words go by 64-bit hashes, so no task needs the vocabulary. The log probability of a text
is a sum of one value for each word, pair and trigram: what the n-gram adds to the
probability of the next shorter one, and what backing off from it costs; n-grams that the
model has not seen add nothing. Words seen once are unknown: n-grams that end in one, and
contexts that do, have no value. So a text's n-grams and the model are dealt into buckets by
those hashes, a bucket's meet in one task, and a text adds up what its buckets give. A bounded
number of the most frequent values is at hand in every task, and a filter of fixed size
spares n-grams that are surely unseen; both only save work. Documents above their
language's quantile of trusted perplexity are rejected. There is no lower limit: near
copies of trained text lie there as well.
"""

import math
import zlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tablesense.llm.common import (
    addressed, broadcast_value, forget, give_back, numbered, own_columns, sized_slices, slices, split_by_keys,
    stored, texts_of)

#: Values of the most frequent n-grams that every task has at hand, at most.
HEAD = 1 << 20
#: The quantile of trusted perplexity that is still accepted, and the margin beyond it in
#: parts of its distance from the median.
QUANTILE, MARGIN = 0.995, 0.1
#: Trusted documents a language needs for a quantile of its own.
CALIBRATED = 50
#: Mean tokens that are added to a text, so that a few odd words decide nothing.
PRIOR_TOKENS = 30
#: Bits of the filter that spares unseen n-grams the join, and bits sent at once.
FILTER_BITS, PAGE = 1 << 27, 1 << 23
#: Rounds in which the n-grams of texts with stored row numbers are looked up, a power of two;
#: each moves that part of the n-grams only, so that the files of one go before the next.
ROUNDS = 4
#: Bytes of a batch of texts that goes to Python at once, and of those worked on at once.
BATCH, PART = "4m", 1 << 18
#: Tokens that are counted at once, and n-grams that a task sends at once.
COUNTED, SENT = 1 << 18, 1 << 17
#: Words whose values meet the trigrams without moving these, and n-grams of a bucket.
WORDS, BUCKET = 1 << 18, 1 << 18

UNKNOWN = 0
START, END = 0x5BD1E995D6E8FEB8, 0x1B873593CC9E2D51


def trusted(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic; `fit` ones train, the others calibrate."""
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(
        F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct().withColumn(
        "fit", F.pmod(F.xxhash64(F.lit(6), "_id"), F.lit(2)) == 0)


def _fitting(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts that train."""
    ids = trusted(labels).where("fit").select("_id")
    own = own_columns(docs, "doc_id", "text").where("text IS NOT NULL")
    return own.join(ids, F.col("doc_id") == F.col("_id"), "left_semi").select("text")


_rng = np.random.default_rng(6)
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = 0x9E3779B97F4A7C15
_GAPS = np.zeros(256, dtype=bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True


def _powers(of: int, many: int) -> np.ndarray:
    """The first powers of an odd number modulo 2 ** 64; those of a usual part are held."""
    if 0 < many < 2 * PART:
        return _held_powers(of)[:many]
    out = np.full(many, of, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=2)
def _held_powers(of: int) -> np.ndarray:
    return _powers(of, 2 * PART)


def _coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two starts, the hashes of the words and an end, text after text; and how many each has.

    A word's hash is a polynomial of its bytes' numbers modulo 2 ** 64, then mixed; all words
    come from one running sum."""
    joined = np.frombuffer(b" ".join(texts).lower() + b" ", dtype=np.uint8)
    gap = _GAPS[joined]
    edges = np.flatnonzero(np.diff(gap, prepend=True))
    first, end = edges[::2], edges[1::2]
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[joined] * _powers(_POWER, len(joined)), out=sums[1:])
    back = _powers(pow(_POWER, -1, 1 << 64), len(joined))
    found = (sums[end] - sums[first]) * back[first]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        found ^= found >> np.uint64(shift)
        found *= np.uint64(factor)
    found ^= found >> np.uint64(33)
    stops = np.cumsum([len(t) + 1 for t in texts])
    words = np.diff(np.searchsorted(first, stops), prepend=0)
    sizes = words + 3
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype=np.int64)
    own = np.ones(len(out), dtype=bool)
    for at, what in ((starts, START), (starts + 1, START), (starts + sizes - 1, END)):
        out[at], own[at] = what, False
    out[own] = found.view(np.int64)
    return out, sizes


def _thirds(sizes: np.ndarray) -> np.ndarray:
    """The places of all but the first two of each text."""
    out = np.ones(int(sizes.sum()), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    out[starts], out[starts + 1] = False, False
    return np.flatnonzero(out)


def _key(*ids: np.ndarray) -> np.ndarray:
    """One hash of the hashes of two or three words in a row; `_key_of` in numpy."""
    out = ids[0].view(np.uint64).copy()
    for i, x in enumerate(ids[1:], 1):
        x, by = x.view(np.uint64), np.uint64(23 * i)
        out ^= x << by | x >> np.uint64(64) - by
    return out.view(np.int64)


def _key_of(*names: str):
    out = F.col(names[0])
    for i, name in enumerate(names[1:], 1):
        out = out.bitwiseXOR(F.shiftleft(name, 23 * i).bitwiseOR(
            F.shiftrightunsigned(name, 64 - 23 * i)))
    return out


def _counted(texts: DataFrame, words: dict[bytes, int] | None = None) -> DataFrame:
    """(u, v, w, c): trigrams of word ids, counted within the tasks. Words have their hashes;
    those of `words` have the ids given there, and then all others are UNKNOWN."""
    def run(batches):
        held, size = [], 0
        given = {START: START, END: END}
        if words is not None:
            given |= {int(_coded([word])[0][2]): number for word, number in words.items()}

        def counted():
            u, v, w = (np.concatenate(x) for x in zip(*held))
            _, first, counts = np.unique(_key(u, v, w), return_index=True, return_counts=True)
            order = np.argsort(v[first], kind="stable")
            first, counts = first[order], counts[order]
            return pa.RecordBatch.from_pydict({
                "u": pa.array(u[first]), "v": pa.array(v[first]), "w": pa.array(w[first]),
                "c": pa.array(counts, pa.int64())})

        for batch in batches:
            found = texts_of(batch)
            for at, stop in slices(found, PART):
                flat, sizes = _coded(found[at:stop])
                third = _thirds(sizes)
                if words is not None:
                    flat = np.array([given.get(x, UNKNOWN) for x in flat.tolist()], dtype=np.int64)
                held.append((flat[third - 2], flat[third - 1], flat[third]))
                size += len(third)
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()
        held = None
        give_back()

    return texts.mapInArrow(run, "u long, v long, w long, c long")


def _with_contexts(counts: DataFrame) -> DataFrame:
    """Each trigram once, with what the probabilities need, all whole numbers.

    c: its count. total, one, two, kinds: the counts of its context (u, v) together, and how
    many trigrams of that context occur once, twice, at all. n: how many words precede
    (v, w). v_total, v_one, v_two, v_kinds: the same of the context v over n; v_often: how
    often v occurs. opens, leads and starts mark one row of each (u, v), (v, w) and v.
    """
    context, pair, word = (Window.partitionBy(*x) for x in (["v", "u"], ["v", "w"], ["v"]))
    each = counts.repartition("v").groupBy("v", "u", "w").agg(F.sum("c").alias("c"))

    def many(condition, over):
        return F.count(F.when(condition, 1)).over(over)

    each = each.withColumns({
        "total": F.sum("c").over(context), "one": many(F.col("c") == 1, context),
        "two": many(F.col("c") == 2, context), "kinds": F.count("*").over(context),
        "opens": F.min("w").over(context) == F.col("w")})
    each = each.withColumns({
        "n": F.count("*").over(pair), "leads": F.min("u").over(pair) == F.col("u")})
    return each.withColumns({
        "v_total": F.count("*").over(word), "v_often": F.sum("c").over(word),
        "v_one": many(F.col("leads") & (F.col("n") == 1), word),
        "v_two": many(F.col("leads") & (F.col("n") == 2), word),
        "v_kinds": many(F.col("leads"), word),
        "starts": F.col("leads") & (F.min("w").over(word) == F.col("w"))})


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how many n-grams
    have count 1, 2, 3 and 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i for i in (1, 2, 3)]
    return tuple(min(max(d, 0.05), i - 0.05) for d, i in zip(raw, (1, 2, 3)))


def _ones_to_fours(column: str, condition=True) -> list:
    return [F.count(F.when(F.lit(condition) & (F.col(column) == i), 1)) for i in range(1, 5)]


def _left(count: str, d: tuple[float, float, float]):
    """A count less its discount."""
    c = F.col(count)
    return c - F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, float] | None:
    """((key, value, often), log10 probability of an unknown word) of trigram counts.

    The values of all rows of the n-grams of a text, and the unknown word's for each token,
    add up to the text's log10 probability. A pair has a row as such and one as a context, a
    word likewise. `often` tells about how frequent the n-gram is. None without counts.
    """
    each = stored(_with_contexts(counts), "trigrams")
    found = each.agg(*_ones_to_fours("c"), *_ones_to_fours("n", F.col("leads"))).first()
    d3, d2 = _discounts(found[:4]), _discounts(found[4:])
    words = stored(each.groupBy("w").agg(
        F.count(F.when(F.col("leads"), 1)).alias("m"), F.sum("c").alias("often")), "words")
    once = (F.col("often") == 1) & (F.col("w") != END)
    size, total, alone, *few = words.agg(
        F.count("*"), F.sum("m"), F.count(F.when(once, 1)), *_ones_to_fours("m")).first()
    if not size:
        return None
    d1 = _discounts(few)
    kept = words.agg(F.sum(_left("m", d1))).first()[0]
    share = (1 - kept / total) / (size + 1)
    # An unknown word is one more of those seen once.
    unknown = share + alone / (alone + 1) * (1 - d1[0]) / total

    def freed(prefix, d):
        one, two, kinds = (F.col(prefix + x) for x in ("one", "two", "kinds"))
        return (d[0] * one + d[1] * two + d[2] * (kinds - one - two)) / F.col(prefix + "total")

    known = words.where(~once).withColumn("p1", _left("m", d1) / total + share)
    all_ = _with_words(each.where((F.col("v_often") > 1) | (F.col("v") == START)), known).withColumns(
        {"back1": freed("v_", d2), "back2": freed("", d3)})
    all_ = all_.withColumn("p2", _left("n", d2) / F.col("v_total") + F.col("back1") * F.col("p1"))
    all_ = all_.withColumn("p3", _left("c", d3) / F.col("total") + F.col("back2") * F.col("p2"))

    def row(key, value, often):
        return F.struct(key.alias("key"), F.log10(value).cast("float").alias("value"),
                        F.col(often).alias("often"))

    rows = all_.select(F.inline(F.filter(F.array(
        F.when(F.col("p1").isNotNull(), row(
            _key_of("u", "v", "w"), F.col("p3") / F.col("back2") / F.col("p2"), "c")),
        F.when(F.col("p1").isNotNull() & F.col("leads"), row(
            _key_of("v", "w"), F.col("p2") / F.col("back1") / F.col("p1"), "n")),
        F.when(F.col("opens"), row(_key_of("u", "v"), F.col("back2"), "total")),
        F.when(F.col("starts"), row(F.col("v"), F.col("back1"), "v_often"))),
        lambda x: x.isNotNull())))
    rows = rows.union(known.select(F.inline(F.array(
        row(F.col("w"), F.col("p1") / F.lit(unknown), "often")))))
    rows = stored(rows, "n-grams")
    forget(each, words)
    return rows, float(np.log10(unknown))


def _step():
    """About how frequent an n-gram is, in quarters of a power of two."""
    return F.floor(F.log2("often") * 4)


def _least_step(grams: DataFrame, most: int) -> int | None:
    """The least step from which on there are at most `most` rows; None if there is none."""
    left, least = most, None
    for found in sorted(grams.groupBy(_step().alias("step")).count().collect(), reverse=True):
        left -= found["count"]
        if left < 0:
            break
        least = found["step"]
    return least


def _with_words(each: DataFrame, known: DataFrame) -> DataFrame:
    """The trigrams with `p1` of their last word, null if it has none. The values of at most
    WORDS of the most frequent words go to the trigrams; others meet in a join."""
    values, least = known.select("w", "p1"), _least_step(known, WORDS)
    if least is None:
        return each.join(values, "w", "left")
    met = each.join(F.broadcast(known.where(_step() >= least).select("w", "p1")), "w", "left")
    rare = known.where(_step() < least)
    if rare.isEmpty():
        return met
    rest = met.where("p1 IS NULL").drop("p1").join(rare.select("w", "p1"), "w", "left")
    return met.where("p1 IS NOT NULL").unionByName(rest)


def _at_hand(grams: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of at most `most` of the most frequent n-grams, and their whole values."""
    least = _least_step(grams, most)
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    keys = grams.where(_step() >= least).select("key").distinct()  # `most` rows bound it
    table = grams.join(F.broadcast(keys), "key", "left_semi").groupBy("key").agg(
        F.sum("value").cast("float").alias("value")).toArrow()
    keys = table.column("key").to_numpy()
    order = np.argsort(keys)
    return keys[order], table.column("value").to_numpy()[order]


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(
        np.int64) % FILTER_BITS


def _filter(grams: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, those of all keys set. Each of as many tasks as there are cores
    sends one filter, in pages."""
    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for batch in batches:
            slots = _slots(batch.column("key").to_numpy())
            np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
        for at in range(0, len(bits), PAGE // 8):
            part = bits[at:at + PAGE // 8]
            if part.any():
                yield pa.RecordBatch.from_pydict({
                    "at": pa.array([at], pa.int64()),
                    "bits": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})
        del bits
        give_back()

    tasks = grams.sparkSession.sparkContext.defaultParallelism
    pages = stored(grams.select("key").coalesce(tasks).mapInArrow(run, "at long, bits binary"), "filter")
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for page in pages.toLocalIterator():
        part = np.frombuffer(zlib.decompress(page["bits"]), dtype=np.uint8)
        bits[page["at"]:page["at"] + len(part)] |= part
    forget(pages)
    return bits


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray):
    """(is there, its value) of each wanted key."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def _buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each key, one of 2 ** bits."""
    mixed = keys.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)


def _runs(order: np.ndarray):
    """(value, start, stop) of the runs of equal values."""
    at = np.flatnonzero(np.diff(order, prepend=order[:1] - 1)) if len(order) else order
    return zip(order[at].tolist(), at.tolist(), [*at[1:].tolist(), len(order)])


_LOOKED = "bucket long, base long, rows binary, keys binary, texts array<struct<row: long, n: long, " \
          "p: double, doc_id: long, of: long>>"
_TEXT = pa.struct([("row", pa.int64()), ("n", pa.int64()), ("p", pa.float64()),
                   ("doc_id", pa.int64()), ("of", pa.int64())])


def _looked_up(sent, turn: int, rounds: int):
    """For each bucket the n-grams of a task's texts whose value is not at hand, with the
    rows they are of (`base` and 32 bits); of the buckets that leave `turn` divided by `rounds`.
    Each text goes along with its tokens and log probability so far, in one bucket of the turn."""
    def run(batches):
        unknown, bits, keys, values, filled = sent.value
        give_back()  # what unpacking the model has left
        held, size, texts, flushed = [], 0, [], 0

        def maybe(grams):
            slots = _slots(grams)
            return filled[slots >> 3] >> (slots & 7) & 1 > 0

        def packed():
            rows, grams = (np.concatenate(x) for x in zip(*held))
            found = {"bucket": [], "base": [], "rows": [], "keys": [], "texts": []}

            def add(*one):
                for column, value in zip(found.values(), one):
                    column.append(value)

            high = rows >> 32
            for base in np.unique(high):
                mine = high == base
                low, own = rows[mine].astype(np.uint32), grams[mine]
                at = _buckets(own, bits)
                order = np.argsort(at, kind="stable")
                low, own = low[order], own[order]
                for bucket, start, stop in _runs(at[order]):
                    add(bucket, int(base) << 32, low[start:stop].tobytes(), own[start:stop].tobytes(), None)
            each = pa.StructArray.from_arrays(
                [pa.concat_arrays(x) for x in zip(*texts)], fields=list(_TEXT))
            many = max(1, (1 << bits) // rounds)
            for i, at in enumerate(range(0, len(each), 256)):
                add((flushed + i) % many * rounds + turn, None, None, None, each[at:at + 256])
            lists = pa.array([None if x is None else x.to_pylist() for x in found.pop("texts")],
                             pa.list_(_TEXT))
            return pa.RecordBatch.from_arrays(
                [pa.array(found["bucket"], pa.int64()), pa.array(found["base"], pa.int64()),
                 pa.array(found["rows"], pa.binary()), pa.array(found["keys"], pa.binary()), lists],
                names=["bucket", "base", "rows", "keys", "texts"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(
                zero_copy_only=False).tolist()
            for at, stop in sized_slices(lengths, PART):
                own = batch.slice(at, stop - at)
                flat, sizes = _coded(texts_of(own))
                third = _thirds(sizes)
                sizes = sizes - 2
                u, v, w = flat[third - 2], flat[third - 1], flat[third]
                first, each = np.full(len(sizes), START), np.repeat(np.arange(len(sizes)), sizes)
                pairs = _key(v, w)
                seen = maybe(pairs)
                # A trigram is unseen if its last pair is, or its first, the pair before.
                both = np.concatenate([seen[:1], seen[:-1]])
                both[np.cumsum(sizes) - sizes] = True
                both &= seen
                alone = maybe(w)
                texts_at = np.arange(len(sizes))
                grams = [first, w[alone], pairs[seen], _key(first, first), _key(u, v, w)[both]]
                which = np.concatenate([texts_at, each[alone], each[seen], texts_at, each[both]])
                grams = np.concatenate(grams)
                mine = _buckets(grams, bits) & rounds - 1 == turn
                mine[mine] = maybe(grams[mine])
                grams, which = grams[mine], which[mine]
                has, p = _found(keys, values, grams)
                totals = np.bincount(which[has], p[has], minlength=len(sizes))
                if not turn:
                    totals = totals + sizes * unknown
                rows = own.column("row").to_numpy()
                held.append((rows[which[~has]], grams[~has]))
                texts.append((own.column("row"), pa.array(sizes), pa.array(totals, pa.float64()),
                              own.column("doc_id"), own.column("of")))
                size += len(held[-1][0]) + len(rows)
                if size >= SENT:
                    yield packed()
                    held, size, texts, flushed = [], 0, [], flushed + 1
        if held:
            yield packed()
        held, texts = None, None
        give_back()
    return run


def _dealt(turn: int, rounds: int, bits: int):
    """The n-grams of a turn's buckets with their values, packed by bucket."""
    def run(batches):
        held, size = [], 0

        def packed():
            keys, values = (np.concatenate(x) for x in zip(*held))
            at = _buckets(keys, bits)
            order = np.argsort(at, kind="stable")
            keys, values = keys[order], values[order]
            runs = list(_runs(at[order]))
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array([b for b, _, _ in runs], pa.int64()),
                "keys": pa.array([keys[i:j].tobytes() for _, i, j in runs], pa.binary()),
                "values": pa.array([values[i:j].tobytes() for _, i, j in runs], pa.binary())})

        for batch in batches:
            keys, values = batch.column("key").to_numpy(), batch.column("value").to_numpy()
            mine = _buckets(keys, bits) & rounds - 1 == turn
            held.append((keys[mine], values[mine].astype(np.float32)))
            size += len(held[-1][0])
            if size >= SENT:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()
        held = None
        give_back()
    return run


def _numbers(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype=kind)


def _met(wanted: pa.Table, model: pa.Table) -> pa.Table:
    """The texts of a bucket with what their n-grams there add."""
    grams, of = np.unique(_numbers(model.column("keys"), np.int64), return_inverse=True)
    values = np.bincount(of, _numbers(model.column("values"), np.float32), minlength=len(grams))
    keys = _numbers(wanted.column("keys"), np.int64)
    lists = wanted.column("rows").to_pylist()
    bases = np.repeat(np.array([x or 0 for x in wanted.column("base").to_pylist()], dtype=np.int64),
                      [len(x or b"") // 4 for x in lists])
    rows = bases + _numbers(wanted.column("rows"), np.uint32).astype(np.int64)
    has, p = _found(grams, values, keys)
    rows, at = np.unique(rows[has], return_inverse=True)
    sums = pa.StructArray.from_arrays(
        [pa.array(rows), pa.nulls(len(rows), pa.int64()),
         pa.array(np.bincount(at, p[has], minlength=len(rows)), pa.float64()),
         pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], fields=list(_TEXT))
    texts = pa.chunked_array([sums, *(x.flatten() for x in wanted.column("texts").chunks)], _TEXT)
    give_back()
    return pa.Table.from_arrays(texts.flatten(), names=_TEXT.names)


def perplexities(docs: DataFrame, labels: DataFrame, head: int = HEAD,
                 row: str | None = None) -> DataFrame | None:
    """row, doc_id, lang, n_tokens, log_prob (log10) of every whole text; None if there is
    no trusted text to learn from. A text's tokens are its words and one end; row
    numbers the rows, by the column that `row` names or anew."""
    number = F.monotonically_increasing_id() if row is None else F.col(f"`{row}`")
    model = kneser_ney(_counted(_fitting(docs, labels)))
    if model is None:
        return None
    grams, unknown = model
    bits = max(6, math.ceil(math.log2(max(1, grams.count() / BUCKET))))
    sent = broadcast_value(docs, (unknown, bits, *_at_hand(grams, head), _filter(grams)))
    of = F.when(F.col("lang").isNotNull(), F.xxhash64("lang"))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", of.alias("of"), number.alias("row"))
    # Numbers that are given anew may differ from one reading to the next.
    rounds, parts = 1 if row is None else ROUNDS, []
    for turn in range(rounds):
        wanted = own.mapInArrow(_looked_up(sent, turn, rounds), _LOOKED)
        mine = grams.select("key", "value").mapInArrow(
            _dealt(turn, rounds, bits), "bucket long, keys binary, values binary")
        met = wanted.groupBy("bucket").cogroup(mine.groupBy("bucket")).applyInArrow(
            _met, "row long, n long, p double, doc_id long, of long")
        parts.append(stored(met.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("of").alias("of"), F.max("n").alias("n_tokens"),
            F.sum("p").alias("log_prob")), "summed", BATCH))
    forget(grams)
    scored = parts[0]
    if rounds > 1:
        more = reduce(DataFrame.union, [part.select("row", "log_prob") for part in parts[1:]])
        more = more.groupBy("row").agg(F.sum("log_prob").alias("more"))
        scored = scored.join(more, "row").withColumn("log_prob", F.col("log_prob") + F.col("more"))
    sent.unpersist()
    langs = docs.select("lang").where("lang IS NOT NULL").distinct().select(
        "lang", F.xxhash64("lang").alias("of"))
    return scored.join(langs, "of", "left").select("row", "doc_id", "lang", "n_tokens", "log_prob")


def quality(docs: DataFrame, labels: DataFrame, head: int = HEAD) -> DataFrame:
    """One row per document: doc_id, lang, n_tokens, log_prob, perplexity, surprise, limit, kept.

    Half of the trusted labelled documents train the model, all of them with their whole
    texts; the other half calibrates. Values of `head` n-grams are at hand in every task,
    which changes no result. `surprise` is a text's mean -log10 probability with PRIOR_TOKENS tokens
    of its language's mean added; `limit` is the QUANTILE of the calibrating texts of the
    language, raised by MARGIN. A language with few of them, and a null one, takes the
    limit of all. Null and empty texts are an end alone and stay, as few tokens decide
    nothing. Without trusted text all documents stay, with null scores. Repeated rows come
    out repeated. Other columns are ignored.
    """
    own = own_columns(docs, "doc_id", "text", "lang")
    rows = addressed(own, "_quality_row")
    judged = _judged(own, labels, head) if rows is None else _judged(rows, labels, head, "_quality_row")
    if judged is None:
        null = F.lit(None).cast("double")
        return own.select(
            F.col("doc_id").cast("long").alias("doc_id"), "lang",
            F.lit(None).cast("long").alias("n_tokens"), null.alias("log_prob"),
            null.alias("perplexity"), null.alias("surprise"), null.alias("limit"),
            F.lit(True).alias("kept"))
    return judged.drop("row")


def _judged(docs: DataFrame, labels: DataFrame, head: int, row: str | None = None) -> DataFrame | None:
    """`quality` with the rows' numbers; None without trusted text."""
    scored = perplexities(docs, labels, head, row)
    if scored is None:
        return None
    scored = stored(scored, "scored")
    ids = trusted(labels).where("not fit")
    good = scored.join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    surprise = -F.col("log_prob")
    means = [surprise, F.col("n_tokens")]
    overall = good.agg(*[F.sum(m) for m in means]).first()
    if not overall[1]:  # too few labels to set some aside
        good, overall = scored, scored.agg(*[F.sum(m) for m in means]).first()
    mean_all = (overall[0] or 0.0) / (overall[1] or 1)
    by_lang = good.groupBy(F.col("lang").alias("_lang")).agg(
        (F.sum(surprise) / F.sum("n_tokens")).alias("mean"), F.count("*").alias("docs")).where(
        (F.col("docs") >= CALIBRATED) & F.col("_lang").isNotNull())

    def shrunk(df):
        return df.join(by_lang, F.col("lang") == F.col("_lang"), "left").withColumn(
            "mean", F.coalesce("mean", F.lit(mean_all))).withColumn(
            "x", (surprise + PRIOR_TOKENS * F.col("mean")) / (F.col("n_tokens") + PRIOR_TOKENS))

    def limit(name):
        q = F.percentile_approx("x", [0.5, QUANTILE], 10_000)
        return (q[1] + (q[1] - q[0]) * MARGIN).alias(name)

    good = stored(shrunk(good).select("_lang", "x"), "calibrating")
    highest = good.agg(limit("limit")).first()[0]
    own = good.where("_lang IS NOT NULL").groupBy(F.col("_lang").alias("_of")).agg(limit("limit"))
    judged = shrunk(scored).join(own, F.col("lang") == F.col("_of"), "left").withColumn(
        "limit", F.coalesce("limit", F.lit(highest)))
    return judged.select(
        "row", "doc_id", "lang", "n_tokens", "log_prob",
        F.pow(F.lit(10.0), surprise / F.col("n_tokens")).alias("perplexity"),
        F.col("x").alias("surprise"), "limit",
        F.coalesce(F.col("x") <= F.col("limit"), F.lit(True)).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, head: int = HEAD) -> DataFrame:
    """The documents that stay, with all their columns; only the rejected move.

    Rows are judged one by one, also where they share an id or have none.
    """
    rows, number = numbered(docs, "_quality_row")
    judged = _judged(rows, labels, head, number)
    if judged is None:
        return docs
    return split_by_keys(rows, number, judged.where("not kept").select("row"))[0].drop(number)
