"""The training-data operators against brute force on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tablesense.llm import (
    exactdedup, langid, lattice, linedup, minhash, mixing, packing, quality, secrets, simhash, topk)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, " \
    "digest string, key string, print long, word string"
SPACE = re.compile("[\x20\x09-\x0D]+")


def _rows():
    rng = random.Random(3)
    words = ["the", "of", "ander", "tion", "éau", "Über", "x.", "###", "a" * 70]
    texts = [None, "", " \t\n", "One", "one", "ONE\n", "0", "password = 'abcdefGHIJ12345'",
             "AKIA" + "Z9" * 8 + " deadbeefdeadbeef00 token:short", "word " * 3000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += texts[:12]
    rows = [(i, t, "en" if i % 3 else None, "s%d" % (i % 4) if i % 5 else None, 1, 7, "d", "k", 3, "w")
            for i, t in enumerate(texts)]
    return [*rows, rows[15], (None, "no id", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(12, 70)],
                                 "doc_id long, quality int, toxic int")


def test_exact_copies(docs, empty):
    got = exactdedup.exact_groups(docs, counters=4).collect()
    groups = {}
    for r in _rows():
        text = r[1] or ""
        groups.setdefault(hashlib.sha256(SPACE.sub("", text).encode()).hexdigest(), []).append(
            (-len(text), r[0] is None, r[0] or 0))
    assert len(got) == len(_rows())
    for digest, members in groups.items():
        own = [r for r in got if r.text_sha256 == digest]
        best = min(members)
        assert {r.keep_id for r in own} == {None if best[1] else best[2]}
        assert all(r.group_size == len(members) for r in own)
        assert sum(r.kept for r in own) == 1
    kept = exactdedup.without_exact_copies(docs)
    assert kept.count() == len(groups) and kept.columns == docs.columns
    assert exactdedup.exact_groups(empty).count() == 0


def test_near_copies_agree_with_all_pairs(docs, empty):
    got = simhash.near_groups(docs).collect()
    prints = [simhash.fingerprint((r[1] or "").encode(), 4) for r in _rows()]
    reach = list(range(len(prints)))
    for _ in prints:
        reach = [min(reach[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 4)
                 for p in prints]
    ids = [r[0] for r in _rows()]
    want = sorted((str(ids[i]), format(prints[i], "016x"), str(min(
        (ids[j] for j in range(len(ids)) if reach[j] == reach[i] and ids[j] is not None),
        default=None))) for i in range(len(ids)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_groups(empty).count() == 0


def test_close_pairs_of_random_prints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, n % 8, False))) for n in range(400)]
    prints = np.unique(np.array([base[i % 40] ^ f for i, f in enumerate(flips)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    for bits in (2, 4, 6):
        got = {(r.a, r.b) for r in simhash.close_pairs(df, bits).collect()}
        signed = prints.view(np.int64).tolist()
        want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i]
                if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= bits}
        assert got == want


def test_mix_reaches_targets(docs, empty):
    got = mixing.mixed(docs, block=8).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        map(tuple, mixing.mixed(docs.repartition(5), block=8).collect()), key=str)
    assert len(got) == len(_rows())
    taken, sizes, targets = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        sizes[r.source], targets[r.source] = r.source_size, r.target
    assert math.isclose(sum(targets.values()), 1.5 * sum(sizes.values()))
    longest = {s: max(r.size for r in got if r.source == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= longest[s] for s in sizes)
    assert mixing.mixed(empty).count() == 0


def test_pivot_keeps_words():
    rng = random.Random(5)
    for _ in range(500):
        p, q, s, t = rng.random(), rng.random(), rng.randint(1, 99), rng.randint(1, 99)
        a, b = mixing.pivot(p, s, q, t, rng.random())
        assert math.isclose(a * s + b * t, p * s + q * t, abs_tol=1e-9)
        assert a in (0.0, 1.0) or b in (0.0, 1.0)


def test_packing_is_a_round_trip(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows, got = {r[0]: r[1] for r in _rows()}, packing.packed(docs).collect()
    sequences, total = {}, 0
    for r in got:
        ids = np.array(tokenizer.encode(rows[r.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048
    loose = [s for s in sequences.values() if sum(n for _, n in s).bit_count() > 1]
    assert len(loose) <= 1
    assert total == sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1
                        for r in _rows())
    assert packing.packed(empty).count() == 0


def test_secrets(docs, empty, spark):
    got = {r.doc_id: r for r in secrets.secrets(docs).collect()}
    for row in _rows():
        text, found = row[1] or "", []
        for i, rule in enumerate(secrets.BASE_RULES):
            found += [(m.start(), i, f"{rule.kind}:{m.start()}:{m.end()}")
                      for m in re.finditer(rule.pattern, text) if len(m[rule.measured]) >= rule.least]
        joined = ",".join(x[2] for x in sorted(found))
        assert got[row[0]].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert got[row[0]].n_hex == sum(x[1] == 2 for x in found)
    assert secrets.secrets(empty).count() == 0
    paths = secrets.blobs(docs)
    ledger = spark.createDataFrame([], secrets.LEDGER)
    once = secrets.updated(ledger, docs, paths, secrets.BASE_RULES)
    assert once.count() == 3 * paths.select("blob").distinct().count()
    assert secrets.scan(docs, paths, once, secrets.BASE_RULES).count() == 0
    newer = (*secrets.BASE_RULES[:2], secrets.Rule("hex", r"[0-9a-f]+", 20, version=2))
    assert secrets.scan(docs, paths, once, newer).count() == once.count() / 3


def test_top_products_with_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 7)]) for i in range(300)]
    rows += [(50, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (None, [1.0] * 6),
             (303, [0.5, 0.5]), rows[7]]
    got = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    fine = [(i, np.array([math.floor(256 * float(np.float32(x))) for x in v] + [0] * (6 - len(v))))
            for i, v in rows if i is not None and v and all(
                x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, v in fine:
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in fine if j != i)[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_products(spark.createDataFrame(
        [], "vec_id long, embedding array<float>")).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = [b" a", b" ab", b"b", b"bc", b"c", b" abc", *[bytes([i]) for i in range(256)
                                                         if bytes([i]) not in (b"b", b"c")]]
    scores = np.log(np.linspace(0.001, 0.02, len(pieces)))
    p = dict(zip(pieces, np.exp(scores)))

    def total(word):
        return 1.0 if not word else sum(p[word[:n]] * total(word[n:])
                                        for n in range(1, len(word) + 1) if word[:n] in p)

    words = [b"abc", b"abcbc", b"xyz", b""]
    got = lattice.Lattice(pieces, scores).log_probability(words)
    assert np.allclose(got, [math.log(total(b" " + w)) for w in words])


def test_lattice_scores(docs, empty):
    got = lattice.lattice_scores(docs).collect()
    assert len(got) == len(_rows())
    learn = [(r[1] or "").encode().lower().split() for r in _rows()
             if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 != 2]
    n = sum(map(len, learn)) + len(learn)
    counts = {}
    for w in (w for ws in learn for w in ws):
        counts[w] = counts.get(w, 0) + 1
    texts = {r[0]: (r[1] or "").encode().lower().split() for r in _rows()}
    for r in got:
        ws = texts[r.doc_id]
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + len(counts) + 2)) for w in ws)
        base += math.log10((len(learn) + 1) / (n + len(counts) + 2))
        assert r.train_tokens == n and r.n_tokens == len(ws) + 1 and r.score < 0
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.n_known == sum(w in counts for w in ws) + 1
    assert lattice.lattice_scores(empty).count() == 0


def test_quality_and_lines_and_languages_take_odd_rows(docs, empty, labels):
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(_rows()) and all(r.kept is not None for r in got)
    assert quality.quality(docs, labels.limit(0)).where("kept").count() == len(_rows())
    assert quality.accepted(empty, labels).columns == empty.columns
    assert langid.languages(docs).where("lang_pred IS NULL").count() == 0
    unsure = {r.doc_id for r in langid.languages(docs).where("lang_pred = 'und'").collect()}
    assert {0, 1, 2, 6} <= unsure
    assert langid.languages(empty).count() == 0 and quality.quality(empty, labels).count() == 0
    assert linedup.without_recurring_lines(docs).count() == len(_rows())
    assert linedup.without_recurring_lines(empty).count() == 0


def test_recurring_templates_are_dropped(spark):
    texts = [f"own line of document {'abcdefgh'[i]} alone\nrequest 4{i} took 1{i} ms today" for i in range(6)]
    got = linedup.without_recurring_lines(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all("took" not in r.text for r in got)


def _shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _planted_copies(changes, size=200, each=20):
    """Pairs of texts of `size` words, the second with some words replaced, and a family that
    shares half of its text."""
    rng = random.Random(8)
    rows = []
    for n in changes:
        for _ in range(each):
            words = [str(rng.random()) for _ in range(size)]
            rows.append(" ".join(words))
            for at in rng.sample(range(size), n):
                words[at] = "other%d" % rng.randrange(10 ** 9)
            rows.append(" ".join(words))
    shared = " ".join(str(rng.random()) for _ in range(size))
    rows += [shared + "".join(" %s" % rng.random() for _ in range(40 + i)) for i in range(40)]
    return rows


def test_near_stage_agrees_with_all_pairs(spark, docs, empty):
    texts = _planted_copies([1, 2, 3, 4, 6])
    rows = [*_rows(), *[(1000 + i, t, "en", "s", 1, 7, "d", "k", 3, "w") for i, t in enumerate(texts)]]
    sets, links = [_shingles(r[1]) for r in rows], {}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a == b or 5 * both >= 4 * (len(a) + len(b) - both):
                links.setdefault(i, []).append(j)
                links.setdefault(j, []).append(i)
    want, parts = {}, set()
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo = [k for j in todo for k in links.get(j, ()) if k not in seen and not seen.add(k)]
        want[i] = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        parts.add(frozenset(seen))
    df = spark.createDataFrame(rows, docs.schema).repartition(3)
    got = minhash.near_copies(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted(
        (str(r[0]), str(want[i])) for i, r in enumerate(rows))
    kept = minhash.without_near_copies(df)
    assert kept.columns == df.columns
    # One row of each component, also where ids repeat or are missing.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(min((rows[k][0] for k in part if rows[k][0] is not None), default=None)) for part in parts)
    assert minhash.near_copies(empty).count() == 0


def test_top_products_of_a_repeated_query_row(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(101)]
    rows[50] = (50, [9.0] * 6)
    rows += [rows[50]] * 4
    got = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    whole = [(i, np.array([math.floor(256 * float(np.float32(x))) for x in v])) for i, v in rows]
    own = dict(whole)[50]
    best = sorted((-int(own @ w), j) for j, w in whole if j != 50)[:5]
    assert [(r.vec_id, r.score) for r in got.where("query_id = 50").orderBy("rank").collect()] == [
        (j, -s) for s, j in best]


def _lines_left(spark, texts):
    rows = linedup.without_recurring_lines(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: (r.text.split("\n") if r.text else []) for r in rows}


def test_unlike_short_lines_stay(spark):
    ends = ["high", "low", "unknown", "fair", "rising"]
    texts = [f"the cost is {w}\nwe all went home {w}\nthis is not the {w} {w}end" for w in ends]
    left = _lines_left(spark, texts)
    assert all(left[i] == t.split("\n") for i, t in enumerate(texts))


def test_all_templates_of_a_leaf_are_dropped(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(12))
    forms = ["the node was started by %s on %s with all of its disks",
             "the node was stopped after %s and %s had lost their last link",
             "the node was moved from %s to %s because of a broken fan"]
    assert len({len(f.split()) for f in forms}) == 1
    templated = [[f % (word(), word()) for f in forms] for _ in range(9)]
    prose = ["the node was " + " ".join(word() for _ in range(9)) for _ in range(9)]
    twice = "the node was quite dear to both of the old owners"
    texts = ["\n".join([*lines, own]) for lines, own in zip(templated, prose)]
    texts[0] += "\n" + twice
    texts[1] += "\n" + twice
    for more in (texts, [*texts, *prose[:2]]):
        left = _lines_left(spark, more)
        for i in range(9):
            assert left[i] == [prose[i], *([twice] if i < 2 else [])]


def test_every_language_is_a_label(spark):
    rows = [(i, f"text number {i} of many", "aa") for i in range(3000)]
    rows += [(5000 + i, f"other {i} words", f"l{i % 4}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    sample = langid.training_sample(df, 8)
    assert {lang for lang, _ in sample} == learnt
    assert len(sample) <= 8 + langid.LEAST_DOCS * len(learnt)


def test_whole_trusted_texts_are_counted(spark):
    sample = spark.createDataFrame([("a b " * 6000,), ("c",)], "text string")
    counts = quality._counted(sample, {b"a": 3, b"b": 4}).collect()
    assert sum(r.c for r in counts) == 12000 + 1 + 1 + 1


def test_lines_of_copies_without_ids_stay(spark):
    rows = [(i if i > 2 else None, t, None, None, 1, 1, "d", "k", 3, "w") for i, t in enumerate(
        ["one line that is here three times"] * 3 + ["a line that is here alone"] * 2)]
    got = linedup.without_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.n_dropped for r in got) == 0 and len(got) == 5


def test_rows_that_share_an_id_are_told_apart(spark):
    """Ids that repeat, or are missing, decide nothing in the pipeline's stages."""
    words = [f"w{i}" for i in range(40)]
    near = [" ".join(words), " ".join([*words, "more"])]
    rows = [(None, near[0]), (None, near[1]), (7, "quite another text"), (7, near[0]), (8, "x y z")]
    docs = spark.createDataFrame([(i, t, None, "s", 1, 7, "d", "k", 3, "w") for i, t in rows], SCHEMA)
    kept = minhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(
        map(str, spark.createDataFrame([rows[2], rows[3], rows[4]], "doc_id long, text string").collect()))
    many = spark.createDataFrame([(i // 4, f"a b c{i}", None, "s%d" % (i % 3), 1, 7, "d", "k", 3, "w")
                                  for i in range(400)], SCHEMA)
    mix, taken = mixing.mixed(many), mixing.repeated_to_targets(many)
    assert taken.columns == many.columns
    assert taken.count() == mix.groupBy().sum("copies").first()[0]
    assert taken.groupBy("source").count().collect() and taken.groupBy("text").count().where(
        "count > 2").count() == 0
    rng = random.Random(1)
    good = [" ".join(rng.choice(words[:12]) for _ in range(60)) for _ in range(300)]
    odd = " ".join(f"zz{i}q" for i in range(200))
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7, "d", "k", 3, "w")
                                  for i, t in [*enumerate(good), (5, odd), (None, odd)]], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    stay = [r.text for r in quality.accepted(docs, labels).collect()]
    assert odd not in stay and good[5] in stay and len(stay) > 280
