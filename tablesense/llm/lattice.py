"""Subword lattice likelihood: the probability of a text over all its segmentations.

The pieces are an existing public vocabulary's. Their scores start from the vocabulary's
own and are fitted to the words of the training documents by expectation-maximisation over
the lattice of all segmentations, never over one chosen split. Pieces do not span words,
so the lattice of a text narrows to one node at every word's start: its log-space forward
recursion is the sum of its words' recursions, and each distinct word needs only one.

A word seen in training is one more edge over its whole span. Its count is lowered by an
absolute discount, and what the discounts free weighs the segmentations into pieces. All
texts' probabilities add up to one.
"""

from collections import Counter
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesense.llm.common import broadcast_value, fold, own_columns, stored, texts_of, words_of

VOCABULARY = "piece_bpe_32k.model"
#: Rounds of expectation-maximisation over all training words.
ROUNDS = 2
#: Added to the expected count of every piece, so that any text has a probability.
PRIOR = 0.01
#: A word on more than 1/HEAD of all tokens is known to every task: at most HEAD words.
HEAD = 1 << 20
#: Longer words are not held by every task, whatever their count.
HEAD_BYTES = 64
#: Distinct words a task counts before it passes them on.
COUNTED = 500_000
#: Lattice cells computed at once.
CELLS = 1 << 16

#: What adds up over the words of a text.
SUMMED = ("known", "base", "score", "subword")

_FACTOR = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _sum_of_logs(ways: list[np.ndarray]) -> np.ndarray:
    """log(sum(exp)); one way at least is finite, as any byte is a piece."""
    ways = np.stack(ways)
    most = ways.max(0)
    return np.log(np.exp(ways - most).sum(0)) + most


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The vocabulary's pieces as bytes, a word's start as one space, and their ranks.

    Control pieces and pieces that reach beyond a word are left out, byte pieces are the
    bytes themselves and rank last. Pieces that differ in the case of A-Z alone are one.
    """
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).encode().replace("▁".encode(), b" ").lower()
            if b" " not in piece[1:]:
                found[piece] = min(max(0.0, -model.get_score(i)),
                                   found.get(piece, model.get_piece_size()))
    for b in range(256):
        found.setdefault(bytes([b]), float(model.get_piece_size()))
    return list(found), np.array(list(found.values()))


class Lattice:
    """Forward and backward recursions over words, many at a time."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.longest = max(map(len, pieces))
        self._powers = np.cumprod(np.concatenate(
            [[np.uint64(1)], np.full(self.longest, _FACTOR, dtype=np.uint64)]), dtype=np.uint64)
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        # Open addressing: a piece lies at its hash's top bits or in one of the next slots.
        self._bits = np.uint64(64 - 18)
        slots = np.full((1 << 18) + 64, -1, dtype=np.int64)
        self._tries = 1
        for i, at in enumerate((hashes * _SPREAD >> self._bits).tolist()):
            place = at
            while slots[place] >= 0:
                place += 1
            slots[place] = i
            self._tries = max(self._tries, place - at + 1)
        self._ids = slots
        self._hashes = np.where(slots >= 0, hashes[slots], np.uint64(0))
        self._lengths = sorted({len(p) for p in pieces})
        self.scores = scores

    @staticmethod
    def _hash(piece: bytes) -> int:
        value = 0
        for b in piece:
            value = (value * int(_FACTOR) + b + 1) & (2 ** 64 - 1)
        return value

    def _edges(self, words: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For words of one length, as rows of bytes: (piece length, piece ids by place).

        An id is -1 where the bytes are no piece.
        """
        count, length = words.shape
        prefix = np.zeros((count, length + 1), dtype=np.uint64)
        for i in range(length):
            prefix[:, i + 1] = prefix[:, i] * _FACTOR + words[:, i] + np.uint64(1)
        edges = []
        for size in self._lengths:
            if size > length:
                break
            hashes = prefix[:, size:] - prefix[:, :-size] * self._powers[size]
            at = (hashes * _SPREAD >> self._bits).astype(np.int64)
            ids = np.where(self._hashes[at] == hashes, self._ids[at], -1)
            for more in range(1, self._tries):
                ids = np.where(self._hashes[at + more] == hashes, self._ids[at + more], ids)
            if (ids >= 0).any():
                edges.append((size, ids))
        return edges

    def _weighted(self, edges):
        return [(size, ids, np.where(ids >= 0, self.scores[ids], -np.inf)) for size, ids in edges]

    def _forward(self, weighted, count: int, length: int) -> np.ndarray:
        """Log probability of each prefix, over all its segmentations."""
        alpha = np.full((count, length + 1), -np.inf)
        alpha[:, 0] = 0
        for end in range(1, length + 1):
            ways = [alpha[:, end - size] + w[:, end - size]
                    for size, _, w in weighted if size <= end]
            alpha[:, end] = _sum_of_logs(ways)
        return alpha

    def _blocks(self, words: list[bytes]):
        """(positions, matrix of bytes) of words of one length, CELLS cells at a time.

        A space stands before each word. Bytes beyond ASCII make no difference.
        """
        lengths = np.array([len(w) + 1 for w in words])
        order = np.argsort(lengths, kind="stable")
        starts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for at in np.split(order, starts[1:]) if len(order) else []:
            length = int(lengths[at[0]])
            step = max(1, CELLS // length)
            for i in range(0, len(at), step):
                chosen = at[i:i + step]
                flat = b"".join(b" " + words[j] for j in chosen)
                yield chosen, np.frombuffer(flat, dtype=np.uint8).reshape(-1, length).astype(
                    np.uint64)

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the marginal probability of each word."""
        out = np.empty(len(words))
        for chosen, block in self._blocks(words):
            weighted = self._weighted(self._edges(block))
            out[chosen] = self._forward(weighted, *block.shape)[:, -1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all segmentations of the counted words."""
        total = np.zeros(len(self.scores))
        for chosen, block in self._blocks(words):
            count, length = block.shape
            weighted = self._weighted(self._edges(block))
            alpha = self._forward(weighted, count, length)
            beta = np.full((count, length + 1), -np.inf)
            beta[:, length] = 0
            for start in range(length - 1, -1, -1):
                ways = [beta[:, start + size] + w[:, start]
                        for size, _, w in weighted if start + size <= length]
                beta[:, start] = _sum_of_logs(ways)
            for size, ids, w in weighted:
                share = np.exp(alpha[:, :length - size + 1] + w + beta[:, size:]
                               - alpha[:, -1:]) * counts[chosen][:, None]
                held = ids >= 0
                total += np.bincount(ids[held], share[held], minlength=len(total))
        return total


def _train_flag():
    return fold("doc_id", 7) != 2


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, everywhere): counts in training documents and in all documents."""
    def run(batches):
        train, rest = Counter(), Counter()

        def counted():
            words = list(train.keys() | rest.keys())
            return pa.RecordBatch.from_pydict({
                "word": pa.array(words, pa.binary()),
                "c": pa.array([train[w] for w in words], pa.int64()),
                "everywhere": pa.array([train[w] + rest[w] for w in words], pa.int64())})

        for batch in batches:
            for text, learn in zip(texts_of(batch), batch.column("learn").to_pylist()):
                (train if learn else rest).update(words_of(text))
            if len(train) + len(rest) > COUNTED:
                yield counted()
                train, rest = Counter(), Counter()
        yield counted()

    own = own_columns(docs, "doc_id", "text").select("text", _train_flag().alias("learn"))
    return own.mapInArrow(run, "word binary, c long, everywhere long").groupBy("word").agg(
        F.sum("c").alias("c"), F.sum("everywhere").alias("everywhere"))


def fitted(words: DataFrame, path: str, rounds: int = ROUNDS) -> tuple:
    """(pieces, natural log probabilities, log probability that a word stops).

    A word is drawn as one piece that starts a word, then pieces within it until it stops:
    either choice adds up to one. Expected counts over all training words are gathered for
    each piece, so the vocabulary bounds what reaches the driver.
    """
    pieces, rank = vocabulary(path)
    starts = np.array([p[:1] == b" " for p in pieces])
    scores, stop = -np.log(rank + 20.0), 0.0
    total = words.agg(F.sum("c")).first()[0] or 0
    for _ in range(rounds):
        sent = broadcast_value(words, (pieces, scores))

        def run(batches, sent=sent):
            lattice = Lattice(*sent.value)
            counts = np.zeros(len(sent.value[0]))
            for batch in batches:
                counts += lattice.expected(batch.column("word").to_pylist(),
                                           batch.column("c").to_numpy().astype(float))
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "piece": pa.array(held, pa.int64()), "n": pa.array(counts[held])})

        counts = np.full(len(pieces), PRIOR)
        for r in words.where("c > 0").select("word", "c").mapInArrow(
                run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            counts[r["piece"]] += r["n"]
        first, within = counts[starts].sum(), counts[~starts].sum() + total + PRIOR
        scores = np.log(np.where(starts, counts / first, counts / within))
        stop = float(np.log((total + PRIOR) / within))
    return pieces, scores, stop


def lattice_scores(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, subword_score, per_token.

    A text is its lower-cased (A-Z) words and one end. `score` is the log10 probability of
    that sequence; in `subword_score` words have no edge of their own and only pieces
    weigh. Counts and scores learn from documents whose crc32(doc_id as text) modulo 7 is
    not 2; a null id counts as empty text there. `base_score` is the add-one word
    unigram's. Null and empty texts are an end alone. Without training documents all
    weight lies on the pieces and their scores are the prior's. Repeated rows come out
    repeated; other columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    words = stored(word_counts(docs), "words")
    ends = docs.where(_train_flag()).count()
    seen = {n: F.count(F.when(F.col("c") == n, 1)) for n in (1, 2)}
    n, v, once, twice, everywhere = words.agg(
        F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), seen[1], seen[2],
        F.sum("everywhere")).first()
    n, everywhere = (n or 0) + ends, everywhere or 0
    discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    # One token more for texts that end and one for words, so that neither is impossible.
    whole, freed = n + 2.0, discount * v + 1.0
    end, types = (ends + 1.0) / whole, v + (ends > 0)
    pieces, scores, stop = fitted(words, path, rounds)
    sent = broadcast_value(docs, (pieces, scores))

    def score(batches):
        lattice = Lattice(*sent.value)
        for batch in batches:
            c = batch.column("c").to_numpy()
            subword = lattice.log_probability(batch.column("word").to_pylist()) + stop
            own = np.log(np.maximum(c - discount, 1e-300) / whole)
            both = np.logaddexp(own, subword + np.log(freed / whole))
            yield pa.RecordBatch.from_pydict({
                "word": batch.column("word"), "known": pa.array((c > 0).astype(float)),
                "base": pa.array(np.log10(c + 1.0)),
                "score": pa.array(both / np.log(10)),
                "subword": pa.array((subword + np.log1p(-end)) / np.log(10)),
                "everywhere": batch.column("everywhere")})

    scored = stored(words.mapInArrow(
        score, "word binary, known double, base double, score double, subword double, "
        "everywhere long"), "scored")
    head = scored.where((F.col("everywhere") * HEAD > everywhere)
                        & (F.octet_length("word") <= HEAD_BYTES)).toArrow()
    at_hand = broadcast_value(docs, (
        {w: i for i, w in enumerate(head.column("word").to_pylist())},
        np.stack([np.append(head.column(c).to_numpy().astype(float), 0.0)
                  for c in SUMMED])))

    def look_up(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 33
        place, values = at_hand.value
        find = place.get
        for batch in batches:
            out = {name: [] for name in ("row", "word", "n", *SUMMED)}

            def add(*values):
                for column, value in zip(out.values(), values):
                    column.append(value)

            keys, texts = np.arange(row, row + batch.num_rows), texts_of(batch)
            for key, text in zip(keys, texts):
                found = words_of(text)
                at = list(map(find, found, repeat(-1)))
                add(key, None, len(found), *values[:, np.array(at, dtype=np.int64)].sum(1))
                for w, times in Counter(w for w, i in zip(found, at) if i < 0).items():
                    add(key, w, times, 0.0, 0.0, 0.0, 0.0)
            row += batch.num_rows
            first = np.searchsorted(np.array(out["row"], dtype=np.int64), keys)
            ids = [None] * len(out["row"])
            for i, doc_id in zip(first, batch.column("doc_id").to_pylist()):
                ids[i] = doc_id
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(out["row"], pa.int64()), "doc_id": pa.array(ids, pa.int64()),
                "word": pa.array(out["word"], pa.binary()), "n": pa.array(out["n"], pa.int64()),
                **{c: pa.array(out[c], pa.float64()) for c in SUMMED}})

    own = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    met = stored(own.mapInArrow(look_up, "row long, doc_id long, word binary, n long, "
                                "known double, base double, score double, subword double"),
                 "looked-up")
    texts = met.where("word IS NULL").drop("word")
    rare = met.where("word IS NOT NULL").select("row", "word", "n").join(
        scored.drop("everywhere"), "word").groupBy("row").agg(
        *[F.sum(F.col("n") * F.col(c)).alias(f"more_{c}") for c in SUMMED])
    total = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0)) for c in SUMMED}
    tokens, last = F.col("n") + 1, float(np.log10(end))
    return texts.join(rare, "row", "left").select(
        "doc_id", (~_train_flag()).alias("held_out"), tokens.alias("n_tokens"),
        (total["known"].cast("long") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (total["base"] + float(np.log10(ends + 1.0))
         - tokens * float(np.log10(n + types + 1.0))).alias("base_score"),
        (total["score"] + last).alias("score"),
        (total["subword"] + last).alias("subword_score"),
        ((total["score"] + last) / tokens).alias("per_token"))
