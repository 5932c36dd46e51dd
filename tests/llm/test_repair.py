"""Conversation repair against all edit sequences and a plain row-by-row programme."""

import hashlib
import random
import re
import zlib

import pytest

from tablesense.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, block long, kind string, place long"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def _rows():
    rng = random.Random(11)
    texts = ["Yes.", "No", "Why?", "Well!  ", " \t\n", "", "It is so.\n", "a.b", None, "x" * 200_000 + "."]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv if conv else None, rng.choice([turn, turn, 2 * turn, None]),
                         rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]),
                         rng.choice(texts if rng.random() < 0.02 else texts[:-1])))
    for conv in range(150, 400):
        for turn in range(rng.randint(1, 8)):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", "So %d." % rng.randrange(9)))
    for turn in range(700):
        rows.append((400, turn // 2, rng.choice(["user", "assistant"]), rng.choice(texts[:4]) + str(turn % 300)))
    rows += rows[5:9]
    return [(*r, 5, "k", 1) for r in rows]


def _damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = "%s:%s" % (" " if conv is None else conv, " " if turn is None else turn)
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def _faults(rows):
    """(role class, fault) of the rows of a conversation in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        role_class = role[:1] if role[:1] in ("s", "u", "a") else "x"
        left = text.rstrip(SPACE)
        fault = "blank" if not left else "duplicate" if (role, text) in seen \
            else "truncated" if left[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role_class, fault))
    return out


_STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _cheapest(faults):
    """(cost, audit) by a plain programme over rows; entries are compared as whole texts."""
    def with_inserts(now):
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                for role in "ua":
                    goal = _STEP.get((state, role))
                    if goal and (goal not in now or (cost + 2, audit + "I") < now[goal]):
                        now[goal] = (cost + 2, audit + "I")
        return now

    now = {"": (0, "")}
    for role_class, fault in faults:
        after = {}

        def put(state, found):
            if state not in after or found < after[state]:
                after[state] = found

        for state, (cost, audit) in with_inserts(now).items():
            put(state, (cost + 3, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + (fault == "truncated")
            for role in "ua":
                if (state, role) in _STEP:
                    put(_STEP[state, role], (more + 2, audit + "R"))
            if (state, role_class) in _STEP:
                put(_STEP[state, role_class], (more, audit + "K"))
        now = after
    return min(found for state, found in with_inserts(now).items() if state in ("", "a"))


def _all_edits(faults):
    """The same by trying every sequence of edits with up to two insertions in a row."""
    best = []

    def go(at, state, cost, audit, inserted):
        if at == len(faults) and state in ("", "a"):
            best.append((cost, audit))
        if inserted < 2:
            for role in "ua":
                if (state, role) in _STEP:
                    go(at, _STEP[state, role], cost + 2, audit + "I", inserted + 1)
        if at < len(faults):
            role_class, fault = faults[at]
            go(at + 1, state, cost + 3, audit + "D", 0)
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                for role in "ua":
                    if (state, role) in _STEP:
                        go(at + 1, _STEP[state, role], more + 2, audit + "R", 0)
                if (state, role_class) in _STEP:
                    go(at + 1, _STEP[state, role_class], more, audit + "K", 0)
    go(0, "", 0, "", 0)
    return min(best)


def _texts(rows, audit):
    state, out, rows = "", [], iter(rows)
    for edit in audit:
        forced = "assistant" if state == "u" else "user"
        if edit == "I":
            role, text = forced, ""
        else:
            _, _, role, text = next(rows)
            if edit == "D":
                continue
            role = forced if edit == "R" else role
        state = _STEP[state, role[0]]
        out.append(f"{role}:{text}")
    return "\n".join(out)


def _order(row):
    return (row[1] is not None, row[1] or 0, row[2], row[3][:64],
            hashlib.sha256(f"{len(row[2])}:{row[2]}{row[3]}".encode()).digest())


def _want(rows):
    said, out = {r[0]: [] for r in rows}, []
    for row in _damaged(rows):
        said[row[0]].append(row)
    for conv, own in said.items():
        own.sort(key=_order)
        faults = _faults(own)
        cost, audit = _cheapest(faults)
        turns = {r[1] for r in own} - {None}
        count = [sum(f == x for _, f in faults) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(faults, faults[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal,
                    cost, audit, hashlib.sha256(_texts(own, audit).encode()).hexdigest()))
    return out


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [4096, 4])
def test_repairs_agree_with_a_plain_programme(conversations, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    got = repair.damaged_and_repaired(conversations)
    assert got.columns == [n for n, _ in repair._OUT]
    assert _sorted(got.collect()) == _sorted(_want(_rows()))


def test_no_rows_and_rows_that_all_go(spark, conversations):
    assert repair.damaged_and_repaired(conversations.limit(0)).count() == 0
    gone = next(i for i in range(999) if zlib.crc32(b"%d:0" % i) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hm.")], "conv_id long, turn long, role string, text string")
    row, = repair.damaged_and_repaired(one).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_plain_programme_and_matrices_agree_with_all_edits():
    rng = random.Random(4)
    found = repair.matrices([])
    for _ in range(250):
        faults = [(rng.choice("suax"), rng.choice(["", "", "truncated", "blank"]))
                  for _ in range(rng.randint(0, 4))]
        want = _all_edits(faults)
        walk = repair.Walk(found)
        walk.add("".join("-" if f == "blank" else c.upper() if f else c for c, f in faults))
        assert walk.end() == want == _cheapest(faults)


def test_grammar_gives_the_strings_back_and_the_same_edits(spark):
    rng = random.Random(8)
    strings = ["".join(rng.choice(["sua", "ua", "uA", "u", "-", "x"]) for _ in range(rng.randint(0, 60)))
               for _ in range(300)] + ["ua" * 900]
    rules = repair.grammar(spark.createDataFrame([(s,) for s in strings], "s string"))
    assert rules
    parts = {chr(repair.FIRST_RULE + i): pair for i, pair in enumerate(rules)}
    found = repair.matrices(rules)

    def whole(text):
        return "".join(whole(parts[x]) if x in parts else x for x in text)

    assert len(repair.packed("ua" * 900, rules)) < 100
    for text in strings:
        short = repair.packed(text, rules)
        assert whole(short) == text
        plain, walk = repair.Walk(found), repair.Walk(found)
        plain.add(text)
        for at in range(0, len(short), 3):
            walk.add(short[at:at + 3])
        assert walk.end() == plain.end()
