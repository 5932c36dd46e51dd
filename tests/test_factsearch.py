"""The fact index moves each text once and sorts no term rows."""

import io
import math
from collections import Counter
from contextlib import redirect_stdout

from tablesense.operators import factsearch


def _plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_index_counts_after_dealing_out_texts(spark):
    rows = [(1, "river river bank"), (2, "bank note"), (1, "note"), (None, "river"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = _plan(factsearch._terms(docs, "doc_id", "text", 1, ()))
    assert terms.count("Exchange") == 1
    postings, _ = factsearch.build_index(docs, ngrams=1, stop_words=())
    plan = _plan(postings)
    assert "Window" not in plan and "SortMergeJoin" not in plan

    counts = {}
    for key, text in rows:
        counts.setdefault(key, Counter()).update((text or "").split())
    df = Counter(t for c in counts.values() for t in c)
    got = {(r.doc_id, r.term): r.weight for r in postings.collect()}
    assert set(got) == {(k, t) for k, c in counts.items() for t in c}
    for key, c in counts.items():
        w = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        assert all(math.isclose(got[key, t], x / length) for t, x in w.items())
