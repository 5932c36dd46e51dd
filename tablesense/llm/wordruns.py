"""Periodic runs of words, found on a grammar of the texts.

The word ids of a slice of texts are compressed by Re-Pair in rounds: of the pairs that
occur twice or more, each place takes the one that is more frequent than its neighbours, and
each such pair becomes a rule. Runs that cross the middle of a rule are computed once, where it first
occurs, and translated to all places it derives. Each run of the text crosses the middle of
the least rule that holds it; what other rules cut off lies within it and goes.

Words of a run of exponent 4 stand in triples that occur three times or more. Places whose
triple surely does not are left out before any grammar is made, which loses no run.
"""

import hashlib
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablesense.llm.common import own_columns, slices, texts_of

#: Least length of a run, and least number of its periods.
LEAST, TIMES = 6, 4
#: Pairs of a rule and a period that are tried at once.
TRIED = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, or for a tenth of the ids, words that repeat from some place on."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def repeating(ids: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the stretches that may hold runs; `text` numbers each word's text.

    In a run of length max(LEAST, TIMES * q), each triple occurs at least TIMES - 1 times.
    Triples are counted by text in hashed slots, so a count is never too small.
    """
    if len(ids) < LEAST:
        return []
    x = ids.astype(np.uint64)
    bits = max(8, int(len(ids)).bit_length() + 2)
    mixed = (x[:-2] * _FACTOR + x[1:-1]) * _FACTOR + x[2:]
    mixed = (mixed ^ mixed >> np.uint64(29)) + text[:-2].astype(np.uint64)
    slots = (mixed * _FACTOR >> np.uint64(64 - bits)).astype(np.int64)
    held = np.bincount(slots, minlength=1 << bits)[slots] >= TIMES - 1
    if not held.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], held.view(np.int8), [0]])))
    starts, stops = edges[::2], edges[1::2] + 2
    return [(a, b) for a, b in zip(starts.tolist(), stops.tolist()) if b - a >= LEAST]


def grammar(ids: np.ndarray, stretches: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """(first place, middle, end of each rule; rule and place of each derivation).

    Symbols of different stretches never pair. What Re-Pair leaves is joined two by two.
    """
    symbols = np.concatenate([ids[a:b] for a, b in stretches]).astype(np.int64)
    starts = np.concatenate([np.arange(a, b) for a, b in stretches])
    lengths = np.ones(len(starts), dtype=np.int64)
    rules, derived, made, fresh = [], [], 0, int(symbols.max()) + 1
    paired = True
    while len(symbols) > 1:
        near = starts[:-1] + lengths[:-1] == starts[1:]
        if not near.any():
            break
        if paired:
            pairs, which, counts = np.unique(
                symbols[:-1] * fresh + symbols[1:], return_inverse=True, return_counts=True)
            # Frequent ones first; equally frequent ones in an order without pattern.
            mixed = pairs.astype(np.uint64) * _FACTOR
            rank = np.empty(len(pairs), dtype=np.int64)
            rank[np.lexsort((mixed ^ mixed >> np.uint64(29), counts))] = np.arange(len(pairs))
            rank = np.where((counts[which] > 1) & near, rank[which], -1)
            padded = np.concatenate([[-1], rank, [-1]])
            taken = (rank >= 0) & (rank >= padded[:-2]) & (rank >= padded[2:])
            paired = bool(taken.any())
            if not paired:
                continue
        else:
            which, taken = np.arange(len(near)), near
        at = np.flatnonzero(taken)
        # Of places that follow one another, every second one.
        opens = np.concatenate([[True], np.diff(at) > 1])
        at = at[(at - at[np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))]) % 2 == 0]
        _, first, own = np.unique(which[at], return_index=True, return_inverse=True)
        heads = at[first]
        rules.append((starts[heads], starts[heads + 1], starts[heads + 1] + lengths[heads + 1]))
        derived.append((own + made, starts[at]))
        lengths[at] += lengths[at + 1]
        symbols[at] = fresh + own
        made, fresh = made + len(heads), fresh + len(heads)
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols, starts, lengths = symbols[keep], starts[keep], lengths[keep]
    if not rules:
        return (np.zeros(0, dtype=np.int64),) * 5
    return tuple(map(np.concatenate, zip(*rules))) + tuple(map(np.concatenate, zip(*derived)))


class _Same:
    """How far two places of a text agree, by hashes of its beginnings."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        factors = np.full(n + 1, _FACTOR, dtype=np.uint64)
        factors[0] = 1
        self._powers = np.cumprod(factors, dtype=np.uint64)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(31)
        # Each word is weighed by its place; stretches are compared after a shift.
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed * self._powers[:n], out=self._sums[1:])

    def along(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """For i < j, how many words from there on (way 1) or before (way -1) agree, `most`
        at most."""
        done = np.zeros(len(i), dtype=np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        shift, sums = self._powers[j - i], self._sums
        while step:
            more = np.minimum(done + step, most)
            one, other = sums[i + way * more] - sums[i], sums[j + way * more] - sums[j]
            done = np.where(one * shift == other, more, done)
            step >>= 1
        return done


class _Compared:
    """The same by comparing word for word, for texts whose hashes collide."""

    def __init__(self, ids: np.ndarray):
        self._ids = ids

    def along(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        done = np.zeros(len(i), dtype=np.int64)
        back = (way - 1) // 2
        open_ = np.flatnonzero(done < most)
        while len(open_):
            at = way * done[open_] + back
            equal = self._ids[i[open_] + at] == self._ids[j[open_] + at]
            open_ = open_[equal]
            done[open_] += 1
            open_ = open_[done[open_] < most[open_]]
        return done


def _tried(most: np.ndarray):
    """(rule, period) for all periods from 1 to each rule's most, TRIED or so at a time."""
    ends = np.cumsum(most)
    first = 0
    while first < len(most):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + TRIED, side="right")))
        n = int(ends[last - 1] - before)
        rule = np.repeat(np.arange(first, last), most[first:last])
        yield rule, np.arange(n) - (ends[rule] - most[rule] - before) + 1
        first = last


def crossing(ids: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, same):
    """(rule, start, stop, period) of the runs across each rule's middle, within the rule.

    A run of TIMES periods has half of them on one side of the middle, so one more period
    to that side still lies in it.
    """
    found = []
    whole = (end - begin) // TIMES
    for left in (False, True):
        side = (middle - begin if left else end - middle) // (TIMES // 2)
        for rule, q in _tried(np.minimum(whole, side)):
            m = middle[rule]
            shift = -q if left else np.zeros_like(q)
            hit = (ids[m + shift] == ids[m + shift + q]) & (ids[m + shift - 1] == ids[m + shift + q - 1])
            rule, q, m, shift = rule[hit], q[hit], m[hit], shift[hit]
            i, j = m + shift, m + shift + q
            start = i - same.along(i, j, i - begin[rule], -1)
            stop = j + same.along(i, j, end[rule] - j, 1)
            fits = (start < m) & (stop > m) & (stop - start >= np.maximum(LEAST, TIMES * q))
            found.append((rule[fits], start[fits], stop[fits], q[fits]))
    return tuple(map(np.concatenate, zip(*found)))


def _least_periods(group, start, stop, q):
    """The smallest period of each (group, start, stop)."""
    order = np.lexsort((q, stop, start, group))
    group, start, stop, q = group[order], start[order], stop[order], q[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (np.diff(group) != 0) | (np.diff(start) != 0) | (np.diff(stop) != 0)
    return group[new], start[new], stop[new], q[new]


def runs(ids: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and then period.

    Several texts may stand one after another, numbered by `text`, if a word that occurs
    nowhere else stands between them.
    """
    none = np.zeros((0, 3), dtype=np.int64)
    stretches = repeating(ids, np.zeros_like(ids) if text is None else text)
    if not stretches:
        return none
    begin, middle, end, rule_of, place = grammar(ids, stretches)
    rule, start, stop, q = _least_periods(*crossing(ids, begin, middle, end, _Same(ids)))
    # A hash can only tell too much: a run that is one leaves nothing to doubt.
    if not all(np.array_equal(ids[a:b - p], ids[a + p:b]) for a, b, p in zip(start, stop, q)):
        rule, start, stop, q = _least_periods(*crossing(ids, begin, middle, end, _Compared(ids)))
    if not len(rule):
        return none
    # Each derivation of a rule has the rule's runs at its own place.
    order = np.argsort(rule_of, kind="stable")
    rule_of, place = rule_of[order], place[order]
    low, high = np.searchsorted(rule_of, rule), np.searchsorted(rule_of, rule, side="right")
    n = high - low
    run = np.repeat(np.arange(len(rule)), n)
    at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + low[run]
    shift = place[at] - begin[rule[run]]
    start, stop, q = start[run] + shift, stop[run] + shift, q[run]
    # Maximal ones of each period, then the smallest period of each stretch.
    order = np.lexsort((-stop, start, q))
    start, stop, q = start[order], stop[order], q[order]
    span = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + q * span)
    kept = np.concatenate([[True], (stop + q * span)[1:] > reach[:-1]])
    _, start, stop, q = _least_periods(np.zeros(int(kept.sum()), dtype=np.int64),
                                       start[kept], stop[kept], q[kept])
    order = np.lexsort((q, start))
    return np.stack([start, stop - start, q], axis=1)[order]


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words without those a run holds after its first period."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(kept)]


_RUNS = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
    ("collapsed_sha256", pa.string()), ("text", pa.string())])
_RUNS_DDL = "doc_id long, n_runs long, start long, length long, period long, " \
    "exponent_milli long, runs_sha256 string, collapsed_sha256 string, text string"


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text, found on one grammar of them all."""
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    parted = chain.from_iterable((*words, i) for i, words in enumerate(texts))
    lengths = np.array([len(words) + 1 for words in texts])
    numbers = np.fromiter(map(ids.__getitem__, parted), np.int64, int(lengths.sum()))
    found = runs(numbers, np.repeat(np.arange(len(texts)), lengths))
    ends = np.cumsum(lengths)
    cuts = np.searchsorted(found[:, 0], ends)
    return [found[a:b] - np.array([end - n, 0, 0])
            for a, b, end, n in zip([0, *cuts[:-1]], cuts, ends, lengths)]


def _row(doc_id, words: list[bytes], found: np.ndarray, texts: bool) -> tuple:
    longest = (None,) * 4
    if len(found):
        s, n, q = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
        longest = s, n, q, 1000 * n // q
    listed = b"".join(b"%d,%d,%d\n" % tuple(x) for x in found.tolist())
    left = b" ".join(collapsed(words, found))
    return (doc_id, len(found), *longest, hashlib.sha256(listed).hexdigest(),
            hashlib.sha256(left).hexdigest(), left.decode() if texts else None)


def _found(plant: bool, texts: bool):
    def run(batches):
        for batch in batches:
            held, ids = texts_of(batch), batch.column("doc_id").to_pylist()
            for first, stop in slices(held):
                own = ids[first:stop]
                split = [text.split() for text in held[first:stop]]
                if plant:
                    split = [planted(words, doc_id) for words, doc_id in zip(split, own)]
                rows = [_row(doc_id, words, found, texts)
                        for doc_id, words, found in zip(own, split, runs_of_texts(split))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _RUNS)], schema=_RUNS)
    return run


def word_runs(docs: DataFrame, plant: bool = False, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli of the
    longest run, runs_sha256, collapsed_sha256, and with `texts`, text without repeats.

    Words lie between ASCII white space. A run is a maximal stretch of smallest period q
    and at least max(LEAST, TIMES * q) words; of equally long runs the first, then that of
    smaller period is told. A word goes if a run holds it after its first q words. `plant`
    makes a tenth of the documents repeat first, by a checksum of doc_id; a document with a
    null id stays as it is. Null and empty texts have no words and no runs. Repeated rows
    come out repeated, very long texts are read whole, an empty table gives an empty
    result, other columns are ignored. No row depends on another, so nothing is shuffled.
    """
    own = own_columns(docs, "doc_id", "text")
    own = own.withColumn("doc_id", own["doc_id"].cast("long"))
    found = own.mapInArrow(_found(plant, texts), _RUNS_DDL)
    return found if texts else found.drop("text")
