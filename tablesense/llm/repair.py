"""Structure repair of conversations by a dynamic programme over a grammar.

Each row becomes a symbol for its role and fault, and a conversation, in blocks of bounded
length, a string of symbols. Re-Pair on the distinct strings gives rules that all
conversations share. A symbol or rule has one min-plus transfer matrix over the states of
the wanted form, `(s?(ua)+)?`, computed from those of its two parts; an entry is the least
cost and a rope of the edits' initials. Conversations are vectors times a few such matrices.

Two equally cheap ropes between the same states and rows never begin one another, since
what follows in the longer one would be insertions that cost more. So the least of each
part is part of the least, and costs with ropes are a semiring.
"""

import hashlib
import os.path
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesense.llm.common import own_columns, stored

#: Costs of edits; a truncated row that stays costs one more.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Rows per block; a power of two.
BLOCK = 4096
#: Rounds of Re-Pair, rules per round, and the share of symbols a round must save.
ROUNDS, RULES, SAVED = 16, 32, 0.03
#: First code point for rules, in the private use area; ROUNDS * RULES of them at most.
FIRST_RULE = 0xE000
#: Block strings whose packed form a task keeps at hand.
KEPT = 100_000

#: Symbols of roles s, u, a and others, row by row: sound, truncated, duplicate, blank.
SOUND, CUT, TWICE, BLANK = "suax", "SUAX", "1234", "5678"
_ROLES = str.maketrans(SOUND + CUT + TWICE + BLANK, SOUND * 4)
#: For the grammar, rows that must go are all alike.
_GONE = "-" * 8
_LEGAL = {"su", "ua", "au"}

#: States: nothing yet, after s, after u, after a. Where s, u, a lead; None leads nowhere.
_NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: Insertions from each state to each that they reach, fewest first.
_INSERTED = [{0: 0, 2: 1, 3: 2}, {1: 0, 2: 1, 3: 2}, {2: 0, 3: 1}, {3: 0, 2: 1}]
#: States in which a conversation may end.
_ENDS = (0, 3)


def flat(rope) -> str:
    """The text of a rope: text, or a pair of ropes."""
    out, todo = [], [rope]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            todo += (part[1], part[0])
    return "".join(out)


def _less(one: tuple, other: tuple | None) -> bool:
    """Whether (cost, rope) one is cheaper than the other, or as cheap and ASCII-less."""
    return other is None or one[0] < other[0] or (
        one[0] == other[0] and flat(one[1]) < flat(other[1]))


def product(x: list[dict], y: list[dict]) -> list[dict]:
    """The min-plus product of two matrices, each a list of {state: (cost, rope)}."""
    out = []
    for row in x:
        best: dict = {}
        for middle, (cost, rope) in row.items():
            for state, (more, rest) in y[middle].items():
                found = (cost + more, (rope, rest))
                if _less(found, best.get(state)):
                    best[state] = found
        out.append(best)
    return out


def row_matrix(symbol: str) -> list[dict]:
    """Insertions, then one row: deleted, kept or given another role."""
    out = []
    for state in range(4):
        steps: dict = {state: (DELETE, "D")}
        if symbol != "-":
            cost = TRUNCATED if symbol.isupper() else 0
            goal = _NEXT[state].get(symbol.lower())
            if goal is not None:
                steps[goal] = (cost, "K")
            other = next(s for r, s in _NEXT[state].items() if r != "s")
            if other not in steps or cost + REROLE < steps[other][0]:
                steps[other] = (cost + REROLE, "R")
        out.append(steps)
    inserted = [{s: (INSERT * n, "I" * n) for s, n in row.items()} for row in _INSERTED]
    return product(inserted, out)


def matrices(rules: list[str]) -> dict[str, list[dict]]:
    """The matrix of every symbol and rule, bottom up; rule i derives the pair rules[i]."""
    found = {x: row_matrix(x) for x in SOUND + CUT + "-"}
    for i, (a, b) in enumerate(rules):
        found[chr(FIRST_RULE + i)] = product(found[a], found[b])
    return found


def packed(symbols: str, rules: list[str]) -> str:
    """A string by the grammar."""
    for i, pair in enumerate(rules):
        if len(symbols) < 2:
            break
        symbols = symbols.replace(pair, chr(FIRST_RULE + i))
    return symbols


def _pairs(batches):
    """(pair, n) of the strings of a task; a pair of none counts all symbols."""
    found = Counter()
    for batch in batches:
        for text in batch.column("symbols").to_pylist():
            found.update(map("".join, zip(text, text[1:])))
            found[""] += len(text)
    yield pa.RecordBatch.from_pydict({
        "pair": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})


def _replaced(rules: list[str], first: int):
    def run(batches):
        for batch in batches:
            out = batch.column("symbols").to_pylist()
            for i, pair in enumerate(rules):
                rule = chr(FIRST_RULE + first + i)
                out = [x.replace(pair, rule) for x in out]
            yield pa.RecordBatch.from_pydict({"symbols": pa.array(out, pa.string())})
    return run


def grammar(strings: DataFrame) -> list[str]:
    """The pairs that rules stand for, by Re-Pair on the distinct strings of one column.

    A round counts all pairs, on all strings and in every task, and replaces the most
    frequent one by one. At most RULES pairs a round reach the driver. Strings are still
    evaluated whole where the rounds end early; they only take more products.
    """
    strings = stored(strings.select(F.col(f"`{strings.columns[0]}`").alias("symbols")).distinct(),
                     "strings")
    rules, before = [], None
    for _ in range(ROUNDS):
        counts = stored(strings.mapInArrow(_pairs, "pair string, n long").groupBy("pair").agg(
            F.sum("n").alias("n")), "pairs")
        total = counts.where("pair = ''").agg(F.sum("n")).first()[0] or 0
        best = counts.where("pair != '' AND n > 1").orderBy(F.desc("n"), "pair").limit(RULES)
        pairs = [r.pair for r in best.select("pair").collect()]
        if not pairs or (before is not None and total > before * (1 - SAVED)):
            break
        strings = stored(strings.mapInArrow(_replaced(pairs, len(rules)), "symbols string"),
                         "strings")
        rules, before = rules + pairs, total
    return rules


class Walk:
    """The cheapest edits of a conversation whose blocks come one by one.

    The states' ropes soon agree on how they begin; that part is put aside, so that what
    is compared stays short however long the conversation is.
    """

    def __init__(self, found: dict[str, list[dict]]):
        self._matrices, self._done, self._now = found, [], {0: (0, "")}

    def add(self, symbols: str):
        """The next block, packed."""
        row = self._now
        for symbol in symbols:
            row, = product([row], self._matrices[symbol])
        now = {state: (cost, flat(rope)) for state, (cost, rope) in row.items()}
        shared = os.path.commonprefix([rope for _, rope in now.values()])
        self._done.append(shared)
        self._now = {s: (cost, rope[len(shared):]) for s, (cost, rope) in now.items()}

    def end(self) -> tuple[int, str]:
        """(cost, the initials of all edits)."""
        best = None
        for state, (cost, rope) in self._now.items():
            for goal, n in _INSERTED[state].items():
                found = (cost + INSERT * n, (rope, "I" * n))
                if goal in _ENDS and _less(found, best):
                    best = found
        return best[0], "".join(self._done) + flat(best[1])


class Repaired:
    """The repaired rows' digest, row by row along the edits."""

    def __init__(self, audit: str):
        self._audit, self._at, self._state, self._any = audit, 0, 0, False
        self._digest = hashlib.sha256()

    def _put(self, role: str, text: str):
        self._digest.update(("\n" if self._any else "").encode() + f"{role}:{text}".encode())
        self._any = True

    def _insert(self):
        while self._audit[self._at:self._at + 1] == "I":
            self._given("")
            self._at += 1

    def _given(self, text: str):
        role, self._state = ("assistant", 3) if self._state == 2 else ("user", 2)
        self._put(role, text)

    def add(self, role: str, text: str):
        self._insert()
        edit = self._audit[self._at]
        self._at += 1
        if edit == "K":
            self._state = _NEXT[self._state][role[0]]
            self._put(role, text)
        elif edit == "R":
            self._given(text)

    def end(self) -> str:
        self._insert()
        return self._digest.hexdigest()


def _illegal(roles: str) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(roles, roles[1:]))


class _Conversation:
    """All that is said of one conversation, as its blocks and then its rows come."""

    def __init__(self, key, found, pack):
        self.key, self._walk, self._pack, self._repaired = key, Walk(found), pack, None
        self._last, self._last_turn = "", None
        self._counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self._turns, self._low, self._high = 0, None, None

    def block(self, symbols: str, turns: int, low, high):
        roles = symbols.translate(_ROLES)
        for name, kinds in (("blank", BLANK), ("duplicate", TWICE), ("truncated", CUT)):
            self._counts[name] += sum(map(symbols.count, kinds))
        self._counts["illegal"] += _illegal(roles) + _illegal(self._last + roles[0])
        if low is not None:
            self._turns += turns - (self._high == low)
            self._low, self._high = low if self._low is None else self._low, high
        self._last = roles[-1]
        self._walk.add(self._pack(symbols))

    def row(self, role: str, text: str):
        if self._repaired is None:
            self._cost, self._audit = self._walk.end()
            self._repaired = Repaired(self._audit)
        self._repaired.add(role, text)

    def end(self) -> tuple:
        if self._repaired is None:  # no rows
            self._cost, self._audit, self._repaired = 0, "", Repaired("")
        gaps = 0 if self._low is None else self._high - self._low + 1 - self._turns
        return (self.key, gaps, *self._counts.values(), self._cost, self._audit,
                self._repaired.end())


_OUT = [("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()),
        ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
        ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_OUT_DDL = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _OUT)


def _walked(rules: list[str]):
    """Rows come sorted: of each conversation its id, then its blocks, then its rows."""
    def run(batches):
        found, kept = matrices(rules), {}

        def pack(symbols):
            if symbols not in kept:
                if len(kept) >= KEPT:
                    kept.clear()
                kept[symbols] = packed(symbols.translate(_FOR_GRAMMAR), rules)
            return kept[symbols]

        now = None
        for batch in batches:
            out = []
            for key, kind, role, text, turns, low, high in zip(*(batch.column(x).to_pylist() for x in (
                    "conv_id", "kind", "role", "text", "turns", "low", "high"))):
                if kind == 0:
                    if now is not None:
                        out.append(now.end())
                    now = _Conversation(key, found, pack)
                elif kind == 1:
                    now.block(text, turns, low, high)
                else:
                    now.row(role, text)
            if out:
                yield _ended(out)
        if now is not None:
            yield _ended([now.end()])
    return run


_FOR_GRAMMAR = str.maketrans(TWICE + BLANK, _GONE)


def _ended(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _OUT)], [n for n, _ in _OUT])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by a checksum of `conv_id:turn`, modulo 20:
    0 drops a row, 1 empties its text, 2 takes its [.!?] out, 3 gives it twice, 4 makes
    its role user. Null roles and texts, and null ids in the checksum, are one space."""
    said = own_columns(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit(" "))
                             for x in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    return said.withColumn("damage", kind).where("damage != 0").withColumn(
        "copy", F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0))))).select(
        "conv_id", "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(
            F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"))


def repaired(said: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.

    `said` has conv_id, turn, role and text; `ids` names further conversations, which may
    have no rows. Rows go by turn, nulls first, then by role, the beginning of the text and
    a digest, so that equal rows are neighbours. Null roles and texts are one space. A null
    conv_id is one conversation. Roles count by their first letter. No rows give zeros, an
    empty audit and the digest of an empty text. Other columns are ignored; an empty table
    gives an empty result.

    Rows are dealt out by their place, so a conversation of any length is spread over
    tasks until its symbols, one byte a row, meet; only its digest, which cannot be
    computed in parts, reads its rows in one task, one after another.
    """
    said = own_columns(said, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["turn", "role", "head", "print"]
    keyed = said.withColumn("head", F.substring("text", 1, 64)).withColumn(
        "print", F.unhex(F.sha2(F.concat(
            F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    role = F.substring("role", 1, 1)
    facts = keyed.select(
        "conv_id", *order, (F.instr(F.lit("sua"), role) * (role != "").cast("int")).alias("role_at"),
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    # Equal rows are alike, so a random last key may part a very large group of them.
    facts = stored(facts.repartitionByRange("conv_id", *order, F.rand(42)).sortWithinPartitions(
        "conv_id", *order).select(
        F.monotonically_increasing_id().alias("place"), "conv_id", "turn", "print", "role_at",
        "blank", "cut"), "facts")
    first = facts.where("NOT blank").groupBy("conv_id", "print").agg(
        F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marks = [F.when(F.col("role_at") == 0, kind[3]).otherwise(F.substring(F.lit(kind), F.col(
        "role_at"), F.lit(1))) for kind in (BLANK, TWICE, CUT, SOUND)]
    symbol = F.when(F.col("blank"), marks[0]).when(F.col("first").isNull(), marks[1]).when(
        F.col("cut"), marks[2]).otherwise(marks[3])
    block = F.floor(F.col("place") / BLOCK).alias("block")
    rows = F.array_sort(F.collect_list(F.struct("place", symbol.alias("symbol"))))
    blocks = stored(facts.join(first, "place", "left").groupBy("conv_id", block).agg(
        F.array_join(F.transform(rows, lambda x: x["symbol"]), "").alias("text"),
        F.min("turn").alias("low"), F.max("turn").alias("high"),
        F.size(F.collect_set("turn")).cast("long").alias("turns")), "blocks")
    rules = grammar(blocks.select(F.translate("text", TWICE + BLANK, _GONE)))
    every = blocks.select("conv_id") if ids is None else own_columns(ids, "conv_id").select(
        F.col("conv_id").cast("long").alias("conv_id")).union(blocks.select("conv_id"))
    every = every.distinct().select("conv_id", F.lit(0).alias("kind"))
    lines = every.unionByName(
        blocks.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(
        keyed.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    return lines.repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", "block", *order).select(
        "conv_id", "kind", "role", "text", "turns", "low", "high").mapInArrow(
        _walked(rules), _OUT_DDL)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The repair of `damaged` conversations; those that lose all rows are told as well."""
    return repaired(damaged(conversations), conversations)
