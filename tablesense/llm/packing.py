"""Hierarchical packing of documents into sequences of several lengths.

Whole windows of the longest tier are cut off each document first. What remains is routed
to the smallest tier that holds it. Each tier is packed from the longest down: a remainder
opens a window, the gap takes the longest remainders of shorter tiers that fit, and the
last hole takes the head of a shorter one, cut freely. All windows come out full, at a
power of two, except one last sequence of the whole table: what a block of documents
cannot fill goes on, as tokens, to a block of the next level.
"""

import bisect
import os
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window, functions as F

from tablesense.llm.common import own_columns, slices, stored, texts_of

#: Window lengths, longest first. The longest is the padded length.
TIERS = (2048, 1024, 512, 256)
#: Id appended to each document.
END = 1
#: Tokens packed at once; bounds a task's memory besides its longest document.
BLOCK_TOKENS = 1 << 20
#: Words whose ids a task keeps at hand; the store starts anew when it is full.
WORDS_KEPT = 1_000_000
#: Blocks whose left-over tokens are packed together at the next level.
FAN_IN = 512
#: Sequences per step group.
GROUP = 16

VOCABULARY = "word_bpe_49k.json"
#: Stands between words that are encoded together: a control character of one id.
_MARK = b" \x01 "
#: What special tokens begin with.
_SPECIAL = b"<|"
#: The vocabulary ignores case, but for special tokens and before combining marks, which
#: may compose with a small letter alone.
_CASED = (_SPECIAL, b"\xcc", b"\xcd")
_TAIL = re.compile(rb"(.*[a-z0-9])([!-/:-@\[-`{-~]+)", re.DOTALL)

_PIECE = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("block", pa.int64()),
    ("window", pa.int64()), ("offset", pa.int64()), ("window_tokens", pa.int64()),
    ("tier", pa.int32()), ("ids", pa.binary())])
_PIECE_DDL = "row long, doc_id long, start long, length long, ids_crc32 long, " \
    "doc_tokens long, block long, window long, offset long, window_tokens long, tier int, ids binary"


class Encoder:
    """Ids of whole texts through a word store.

    The vocabulary's normaliser and splitter treat white space as a separator that no
    token spans, so a text has the ids of its words, one after another.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._mark, = self._tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        self._clear()

    def _clear(self):
        self._place: dict[bytes, int] = {}
        self._ends = np.zeros(1, dtype=np.int64)
        self._ids = np.zeros(0, dtype=np.uint32)

    def _coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and where each word's ids end.

        Words are encoded together, a mark between them that the splitter keeps apart.
        The fast form leaves out the places in the text, which nothing here needs.
        """
        coded = np.array(self._tokenizer.encode_batch_fast(
            [b"".join(w + _MARK for w in words).decode()], add_special_tokens=False)[0].ids,
            dtype=np.uint32)
        ends = np.flatnonzero(coded == self._mark)
        if len(ends) != len(words):
            raise ValueError("the vocabulary does not keep the mark apart")
        return np.delete(coded, ends), ends - np.arange(len(ends))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the stored words at these places, and where each word's ids end."""
        starts, counts = self._ends[at], self._ends[at + 1] - self._ends[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self._ids[np.repeat(starts - ends + counts, counts) + np.arange(total)], ends

    def _add(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray):
        first = len(self._place)
        self._place.update(zip(words, range(first, first + len(words))))
        self._ends = np.concatenate([self._ends, self._ends[-1] + ends])
        self._ids = np.concatenate([self._ids, ids])

    def _learn(self, words: set[bytes]):
        """Add words that are not at hand.

        Marks after a letter or digit are a token run of their own, so a word has the ids
        of its stem and then its tail, and the stems are shared. A word that may hold a
        special token is left whole; one that holds the mark goes alone.
        """
        parted = [(w, m[1], m[2]) for w in words if _SPECIAL not in w and (m := _TAIL.fullmatch(w))]
        joint = {w for w, _, _ in parted}
        need = (words - joint).union(*[(a, b) for _, a, b in parted]) if parted else words
        need = [w for w in need if w not in self._place]
        plain = [w for w in need if _MARK[1:2] not in w]
        if plain:
            self._add(plain, *self._coded(plain))
        for w in need:
            if _MARK[1:2] in w:
                own = self._tokenizer.encode(w.decode(), add_special_tokens=False).ids
                self._add([w], np.array(own, dtype=np.uint32), np.array([len(own)]))
        parted = [x for x in parted if x[0] not in self._place]
        if parted:
            place = self._place
            ids, ends = self._gather(np.array([place[x] for _, a, b in parted for x in (a, b)]))
            self._add([w for w, _, _ in parted], ids, ends[1::2])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, then END."""
        split = [(t if any(x in t for x in _CASED) else t.lower()).split() for t in texts]
        words = list(chain.from_iterable(split))
        if len(self._place) > WORDS_KEPT:
            self._clear()
        at = np.fromiter(map(self._place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn({words[i] for i in missing})
            at[missing] = [self._place[words[i]] for i in missing]
        ids, ends = self._gather(at)
        cuts = np.concatenate([[0], ends])[np.cumsum([0] + [len(ws) for ws in split])]
        end = np.array([END], dtype=np.uint32)
        return [np.concatenate([ids[a:b], end]) for a, b in zip(cuts[:-1], cuts[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(pieces: list[tuple], tiers=TIERS) -> tuple[list[tuple[int, list]], list]:
    """Full windows (tier, pieces) and the pieces left over, together shorter than the
    shortest tier.

    A piece is (key, start, ids). Pieces are cut where a window ends.
    """
    windows, routed = [], {tier: [] for tier in tiers}

    def route(piece):
        left = len(piece[2])
        routed[min(t for t in tiers if t >= left)].append(piece)

    for key, start, ids in pieces:
        whole = len(ids) // tiers[0] * tiers[0]
        for at in range(0, whole, tiers[0]):
            windows.append((tiers[0], [(key, start + at, ids[at:at + tiers[0]])]))
        if whole < len(ids):
            route((key, start + whole, ids[whole:]))
    waiting = []
    for i, tier in enumerate(tiers):
        openers = sorted(routed[tier] + waiting, key=lambda p: len(p[2]))
        shorter = sorted((p for t in tiers[i + 1:] for p in routed[t]), key=lambda p: len(p[2]))
        lengths = [len(p[2]) for p in shorter]
        waiting = []
        while openers:
            window = [openers.pop()]
            gap = tier - len(window[0][2])
            while gap:
                at = bisect.bisect_right(lengths, gap) - 1
                if at >= 0:  # the longest that fits
                    lengths.pop(at)
                    piece = shorter.pop(at)
                elif shorter or openers:  # none fits: the head of the shortest fills the hole
                    source = shorter if shorter else openers
                    key, start, ids = source.pop(0)
                    if source is shorter:
                        lengths.pop(0)
                    piece, rest = (key, start, ids[:gap]), (key, start + gap, ids[gap:])
                    if len(rest[2]):
                        if source is shorter:
                            place = bisect.bisect_left(lengths, len(rest[2]))
                            shorter.insert(place, rest)
                            lengths.insert(place, len(rest[2]))
                        else:
                            bisect.insort(openers, rest, key=lambda p: len(p[2]))
                else:
                    break
                window.append(piece)
                gap -= len(piece[2])
            if gap:  # nothing is left at all: smaller tiers take these tokens
                waiting = window
            else:
                windows.append((tier, window))
        for t in tiers[i + 1:]:
            routed[t] = [p for p in shorter if min(x for x in tiers if x >= len(p[2])) == t]
        waiting = _cut_to(waiting, tiers[i + 1]) if i + 1 < len(tiers) else waiting
    return windows, waiting


def _cut_to(pieces: list, length: int) -> list:
    """The same tokens in pieces of at most `length`."""
    return [(key, start + at, ids[at:at + length])
            for key, start, ids in pieces for at in range(0, len(ids), length)]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def _batch(windows, left, block: int, first: int, keys) -> pa.RecordBatch:
    """Rows of pieces, windows numbered from `first`; those left over carry their ids and
    no window."""
    rows = []
    for number, (tier, window) in enumerate(windows, first):
        tokens, offset = sum(len(p[2]) for p in window), 0
        for key, start, ids in window:
            rows.append((*keys[key][:2], start, len(ids), _crc(ids), keys[key][2], block, number,
                         offset, tokens, tier, None))
            offset += len(ids)
    for key, start, ids in left:
        rows.append((*keys[key][:2], start, len(ids), _crc(ids), keys[key][2], block, None, None,
                     None, None, np.ascontiguousarray(ids, dtype="<u4").tobytes()))
    columns = list(zip(*rows)) if rows else [[] for _ in _PIECE.names]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)


def _packed_texts(path: str, tiers):
    """Encode texts and pack them, a block of about BLOCK_TOKENS at a time."""
    def run(batches):
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        row, block, window, keys, pieces, held = 0, 0, task << 36, {}, [], 0

        def finished():
            windows, left = pack(pieces, tiers)
            return len(windows), _batch(windows, left, (task << 33) + block, window, keys)

        for batch in batches:
            texts, ids = texts_of(batch), batch.column("doc_id").to_pylist()
            for at, stop in slices(texts, 4 << 20):
                coded = encoder(path).encode(texts[at:stop])
                for doc_id, tokens in zip(ids[at:stop], coded):
                    key = (task << 33) + row
                    row += 1
                    keys[key] = (key, doc_id, len(tokens))
                    pieces.append((key, 0, tokens))
                    held += len(tokens)
                    if held >= BLOCK_TOKENS:
                        made, out = finished()
                        yield out
                        block, window, keys, pieces, held = block + 1, window + made, {}, [], 0
        if pieces:
            yield finished()[1]
    return run


def _packed_left(tiers, level: int, last: bool):
    """Pack what blocks of the level below left over; groups come sorted by `group`.

    At the last level, what is still left is one shorter sequence.
    """
    def run(batches):
        group, keys, pieces, number = None, {}, [], 0

        def finished():
            windows, left = pack(pieces, tiers)
            if last and left:
                windows, left = [*windows, (tiers[0], left)], []
            # Below zero, so that no level shares a number with texts or another level.
            first = -(level << 56) - (group + 1 << 28)
            return _batch(windows, left, -(level << 40) - group - 1, first, keys)

        for batch in batches:
            for r in batch.to_pylist():
                if r["group"] != group:
                    if pieces:
                        yield finished()
                    group, keys, pieces, number = r["group"], {}, [], 0
                number += 1
                keys[number] = (r["row"], r["doc_id"], r["doc_tokens"])
                pieces.append((number, r["start"], np.frombuffer(r["ids"], dtype="<u4")))
        if pieces:
            yield finished()
    return run


def packed(docs: DataFrame, path: str | None = None, tiers=TIERS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, tier, sequence_tokens, step_group.

    A document is its ids by the tokenizer file at `path` and then END; null and empty
    texts are END alone, very long ones are cut as any other. Repeated rows are packed
    once each, under the same doc_id. Sequences hold at most tiers[0] tokens, and all but
    one of the whole table are full at a power of two. step_group deals the sequences of
    a tier and block out, by their attention cost, in turn and back, so that the groups of
    GROUP sequences cost about the same. An empty table gives an empty result. Other
    columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    own = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    done = stored(own.mapInArrow(_packed_texts(path, tiers), _PIECE_DDL), "packed")
    parts, level = [done.where("window IS NOT NULL")], 0
    left = done.where("window IS NULL")
    blocks = left.select("block").distinct().count()
    while blocks:
        level += 1
        groups = -(-blocks // FAN_IN)
        dealt = left.withColumn(
            "group", F.lit(0).cast("long") if groups == 1
            else F.pmod(F.xxhash64("block"), F.lit(groups)))
        done = stored(dealt.repartition("group").sortWithinPartitions(
            "group", "block", "row", "start").mapInArrow(
            _packed_left(tiers, level, groups == 1), _PIECE_DDL), f"packed-{level}")
        parts.append(done.where("window IS NOT NULL"))
        left = done.where("window IS NULL")
        blocks = 0 if groups == 1 else left.select("block").distinct().count()
    pieces = parts[0]
    for more in parts[1:]:
        pieces = pieces.unionByName(more)
    return _grouped(pieces)


def _grouped(pieces: DataFrame) -> DataFrame:
    """Name sequences and deal them into step groups; a block bounds every window."""
    squares = F.sum(F.col("length") * F.col("length"))
    sequence = Window.partitionBy("block", "window")
    costed = pieces.withColumn("_cost", squares.over(sequence))
    tier = Window.partitionBy("block", "tier")
    placed = costed.withColumn("_place", F.dense_rank().over(
        tier.orderBy(F.desc("_cost"), "window")) - 1).withColumn(
        "_groups", F.ceil((F.max("_place").over(tier) + 1) / GROUP))
    turn, at = F.floor(F.col("_place") / F.col("_groups")), F.pmod("_place", "_groups")
    dealt = F.when(turn % 2 == 0, at).otherwise(F.col("_groups") - 1 - at)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.col("window").alias("sequence_id"), "offset", "tier",
        F.col("window_tokens").alias("sequence_tokens"),
        F.xxhash64("block", "tier", dealt.cast("long")).alias("step_group"))
