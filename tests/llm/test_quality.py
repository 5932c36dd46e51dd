"""Kneser-Ney scores against a plain programme over all trusted texts."""

import math
import os
import random
import urllib.parse
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablesense.llm import quality


def _discounts(counts):
    n = [sum(c == i for c in counts.values()) for i in range(1, 5)]
    return quality._discounts(n)


def _plain(texts):
    """A function of a text: its log10 probability under the model of `texts`."""
    def padded(text):
        return ["<s>", "<s>", *text.lower().split(), "</s>"]

    three, seen = Counter(), Counter()
    for text in texts:
        t = padded(text)
        seen.update(t[2:-1])
        three.update(zip(t, t[1:], t[2:]))
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)
    orders = []
    for counts in (one, two, three):
        d, total, freed = _discounts(counts), Counter(), defaultdict(float)
        for gram, c in counts.items():
            context = gram[:-1] if counts is not one else ()
            total[context] += c
            freed[context] += d[min(c, 3) - 1]
        orders.append((counts, d, total, freed))

    counts, d, total, freed = orders[0]
    share = freed[()] / total[()] / (len(one) + 1)
    alone = sum(c == 1 for c in seen.values())
    unknown = (alone * ((1 - d[0]) / total[()] + share) + share) / (alone + 1)

    def p(gram):
        counts, d, total, freed = orders[len(gram) - 1]
        context, known = gram[:-1], gram[-1] in one and seen[gram[-1]] != 1
        if not context:
            c = one[gram[0]]
            return (c - d[min(c, 3) - 1]) / total[()] + share if known else unknown
        lower = p(gram[1:])
        if context not in total or seen[context[-1]] == 1:
            return lower
        lower *= freed[context] / total[context]
        c = counts[gram] if known else 0
        return lower + (c - d[min(c, 3) - 1]) / total[context] if c else lower

    def score(text):
        t = padded(text)
        return sum(math.log10(p(g)) for g in zip(t, t[1:], t[2:]))
    return score


@pytest.mark.parametrize("head", [0, 40, 1 << 20])
def test_scores_are_those_of_all_trusted_texts(spark, head):
    """Whatever part of the values is at hand, each text has the probability that a plain
    programme gives after counting all training texts, more than 4,096, not a sample."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[:1 + i % 60]) if rng.random() < 0.97 else f"x{i}"
                         for _ in range(rng.randint(0, 6))),
             "en" if i % 3 else None) for i in range(9000)]
    rows += [(9000, None, "en"), (9001, "w1 unseen W2 w1 unseen W2", None), (None, "w1", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9000)],
                                   "doc_id long, quality int, toxic int")
    fit = {r["_id"] for r in quality.trusted(labels).where("fit").collect()}
    assert len(fit) > 4096
    score = _plain([t for i, t, _ in rows if i in fit])
    got = {r.doc_id: r for r in quality.perplexities(docs, labels, head).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows:
        assert got[i].lang == lang and got[i].n_tokens == len((text or "").split()) + 1
        assert math.isclose(got[i].log_prob, score(text or ""), rel_tol=1e-5)


def test_rounds_move_parts_and_leave_no_files(spark, monkeypatch):
    """Looked up in rounds, texts have the scores of one round; no round moves more than its
    part, and neither the model nor what was shuffled for it stays on disk."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(40)), "en")
            for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn(
        "number", F.col("doc_id") * 7)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)],
                                   "doc_id long, quality int, toxic int")
    kept, moved = [], []
    stored, looked_up = quality.stored, quality._looked_up

    def watched(df, name, *more):
        kept.append((name, stored(df, name, *more)))
        return kept[-1][1]

    def counted(sent, turn, rounds):
        moved.append((turn, rounds))
        return looked_up(sent, turn, rounds)

    monkeypatch.setattr(quality, "stored", watched)
    monkeypatch.setattr(quality, "_looked_up", counted)
    one = {r.doc_id: r for r in quality.perplexities(docs, labels, 40).collect()}
    some = {r.row: r for r in quality.perplexities(docs, labels, 40, "number").collect()}
    assert moved == [(0, 1)] + [(turn, quality.ROUNDS) for turn in range(quality.ROUNDS)]
    assert sorted(some) == [7 * i for i in range(600)]
    for i in range(600):
        assert some[7 * i].doc_id == i and some[7 * i].n_tokens == one[i].n_tokens == 41
        assert math.isclose(some[7 * i].log_prob, one[i].log_prob, rel_tol=1e-6)
    for name, df in kept:
        files = [os.path.exists(urllib.parse.urlparse(f).path) for f in df.inputFiles()]
        assert all(files) if name == "summed" else not any(files)


def test_words_have_one_hash_wherever_they_stand():
    """Hashes that come from running sums depend on the word alone, in short and long parts."""
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcDEé　") for _ in range(rng.randint(1, 9)))
                      for _ in range(rng.randint(0, 400))).encode() for _ in range(2000)]
    texts += [b"", b" \t", b"\x0bAb\x0c aB"]
    hashes = {}
    for parts in ([texts], [texts[:3], texts[3:40], texts[40:1000], texts[1000:]]):
        for part in parts:
            flat, sizes = quality._coded(part)
            assert sizes.tolist() == [len(t.split()) + 3 for t in part]
            start = 0
            for text, size in zip(part, sizes.tolist()):
                own = flat[start:start + size].tolist()
                assert own[:2] == [quality.START] * 2 and own[-1] == quality.END
                for word, value in zip(text.lower().split(), own[2:]):
                    assert hashes.setdefault(word, value) == value
                start += size
    assert len(set(hashes.values())) == len(hashes) > 10000


def test_files_are_looked_up_in_rounds(spark, tmp_path, monkeypatch):
    """op6 tells rows of files apart by their places there, stores no copy of them, and moves
    the n-grams of a text packed by bucket, not one row each."""
    rng = random.Random(5)
    rows = [(i % 500, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(40)), "en")
            for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(
        str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)],
                                   "doc_id long, quality int, toxic int")
    names, moved = [], []
    stored, looked_up = quality.stored, quality._looked_up

    def watched(df, name, *more):
        names.append(name)
        return stored(df, name, *more)

    def counted(sent, turn, rounds):
        moved.append((turn, rounds))
        return looked_up(sent, turn, rounds)

    monkeypatch.setattr(quality, "stored", watched)
    monkeypatch.setattr(quality, "_looked_up", counted)
    got = quality.quality(docs, labels)
    assert got.count() == 600 and moved == [(turn, quality.ROUNDS) for turn in range(quality.ROUNDS)]
    assert "numbered" not in names
    key = ["doc_id", "n_tokens", "kept"]
    monkeypatch.undo()
    plain = quality.quality(spark.createDataFrame(docs.collect(), docs.schema), labels)
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, plain.select(key).collect()))
