"""Token counts against the library and word runs against all periods of all places."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tablesense.llm import tokencounts, wordruns

SCHEMA = "doc_id long, text string, row long, number long, at long, core string, n_tokens long"


def _table(spark, texts):
    rows = [(i, t, 1, 2, 3, "c", 4) for i, t in enumerate(texts)] + [
        (None, "no id", 1, 2, 3, "c", 4), (0, texts[0], 1, 2, 3, "c", 4)]
    return [r[:2] for r in rows], spark.createDataFrame(rows, SCHEMA).repartition(3)


def _some_texts():
    rng = random.Random(1)
    texts = [None, "", " ", "\n", "a" * 1000, " " * 500, "日本語" * 200, "\x01" * 200, "😀é" * 150,
             "▁ ▁▁" * 80, "x" + "a" * 999, "<s> </s> <unk> <0x0A>" * 9, "the cat sat " * 90]
    texts += ["".join(rng.choice("ab ▁éé日\n\t😀.thersing  ") for _ in range(rng.randint(0, 900)))
              for _ in range(40)]
    return texts + ["a" * rng.randint(1, 300) + rng.choice(["", "b", "é"]) + "a" * rng.randint(1, 300)
                    for _ in range(20)]


@pytest.mark.parametrize("chunk,lead", [(64, 4), (200, 64), (1 << 15, 512)])
def test_counts_agree_with_the_library(spark, chunk, lead):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path(tokencounts.VOCABULARY))
    rows, table = _table(spark, _some_texts())
    got = tokencounts.token_counts(table, chunk=chunk, lead=lead, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 100) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_counts_of_a_text_longer_than_a_slice(spark):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path(tokencounts.VOCABULARY))
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9)))
                    for _ in range(300_000)) + "z" * 200_000
    got, = tokencounts.token_counts(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert got.n_tokens == len(model.encode(long)) and got.over_limit
    empty = spark.createDataFrame([], SCHEMA)
    assert tokencounts.token_counts(empty).count() == 0


def _all_runs(x):
    out = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1 if j == i else j
    return sorted(((s, t - s, q) for (s, t), q in out.items()), key=lambda r: (r[0], r[2]))


def _periodic(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.randint(0, rng.choice([10, 40, 120, 300]))
    x = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 4 else 0):
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // rng.randint(2, 9)))
        for i in range(a, rng.randint(a, n)):
            x[i] = x[a + (i - a) % p]
    return x


def test_runs_agree_with_all_periods(monkeypatch):
    rng = random.Random(5)
    for turn in range(800):
        x = _periodic(rng)
        assert list(map(tuple, wordruns.runs(np.array(x, dtype=np.int64)).tolist())) == _all_runs(x)
    monkeypatch.setattr(wordruns, "_Same", wordruns._Compared)
    monkeypatch.setattr(wordruns, "TRIED", 16)
    for turn in range(200):
        x = _periodic(rng)
        assert list(map(tuple, wordruns.runs(np.array(x, dtype=np.int64)).tolist())) == _all_runs(x)


def test_hashes_that_collide_are_found_out():
    sides = [0, 1]
    for _ in range(11):  # Thue-Morse words, alike to any hash by powers modulo 2 ** 64
        sides = sides + [1 - x for x in sides]
    half = len(sides) // 2
    x = sides[:half] * 3 + sides[half:] + sides[:half] * 5
    assert list(map(tuple, wordruns.runs(np.array(x)).tolist())) == _all_runs(x)


def test_grammar_derives_each_stretch():
    rng = random.Random(6)
    for _ in range(100):
        x = np.array(_periodic(rng) + [0, 1], dtype=np.int64)
        begin, middle, end, rule, place = wordruns.grammar(x, [(0, len(x))])
        assert all(begin < middle) and all(middle < end) and set(rule) == set(range(len(begin)))
        for r, at in zip(rule, place):
            n = end[r] - begin[r]
            assert np.array_equal(x[begin[r]:end[r]], x[at:at + n])
        assert not len(begin) or max(end - begin) == len(x)


def test_rows_agree_with_all_periods(spark):
    rng = random.Random(7)
    texts = [None, "", " \t", "a", "a " * 7, "a b\n" * 3, "A a " * 5, "é\x0bü " * 9, "x\x00y z " * 6]
    texts += [" ".join("w%d" % rng.randrange(rng.choice([2, 9, 99])) for _ in range(rng.randint(1, 200)))
              for _ in range(150)] + ["long " * 300_000]
    rows, table = _table(spark, texts)
    got = wordruns.word_runs(table, plant=True)
    want = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = [(0, n, 1)] if n > 10_000 else _all_runs(words)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        listed = "".join("%d,%d,%d\n" % r for r in found)
        want.append((doc_id, len(found), *(best or (None,) * 3),
                     1000 * best[1] // best[2] if best else None,
                     hashlib.sha256(listed.encode()).hexdigest(),
                     hashlib.sha256(left).hexdigest(), left.decode()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert wordruns.word_runs(empty).count() == 0
    assert "text" not in wordruns.word_runs(empty, texts=False).columns
