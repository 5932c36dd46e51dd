import pytest
from pyspark.sql import functions as F

from tablesense.operators import answerrows, ask, factsearch, structure
from tablesense.operators.profile import profile_columns
from tablesense.operators.roles import profile_roles
from tablesense.plans.onboard import onboard, portable_document
from tablesense.plans import ingest
from tablesense.session import scratch_path
from tablesense.sources.export import document_from_json


def intents(spark, questions, mode="prefix"):
    df = spark.createDataFrame([(q,) for q in questions], "q string")
    return [r[0] for r in df.select(ask.classify_intent(F.col("q"), mode)).collect()]


def test_intents(spark):
    asked = ["Which KRIs are in breach?", "Show all Red status items",
             "Show the trend of CURRENT_VALUE over REPORT_MONTH", "Which KRI has the highest value?",
             "Which KRI is performing worst?", "Give me a summary of this dashboard",
             "Show RAG_STATUS distribution", "What changed vs previous period?",
             "Average revenue by region", "Total revenue", "Compare A and B", "hello"]
    assert intents(spark, asked) == [
        "breach", "rag_filter", "trend", "highest", "lowest", "summary", "rag_filter",
        "variance", "average", "count_sum", "compare", "summary"]
    assert intents(spark, ["What changed vs previous period?", "a hundred"], "substring") == [
        "trend", "rag_filter"]


def test_numbers(spark):
    df = spark.createDataFrame([("top 12 of 40",), ("top",), ("top 99999999999",)], "q string")
    assert [r[0] for r in df.select(ask.extract_n(F.col("q"), 5)).collect()] == [12, 5, 5]


@pytest.fixture(scope="module")
def known(survey):
    return onboard(survey, "wells", "Wells", order_by=["SURVEY_PERIOD", "STATION_CODE"])


def test_answers(spark, known):
    asked = spark.createDataFrame(list(enumerate([
        "Which KRIs are in breach?", "Show all Red status items",
        "Average ACTUAL_FLOW by STATION_NAME", "What are the top 2 by ACTUAL_FLOW?",
        "What changed vs previous period?", "Show outliers in ACTUAL_FLOW", "How many are there?",
        "Show the trend of ACTUAL_FLOW over SURVEY_PERIOD"])),
        "question_id int, question string")
    answers = known.answer(asked).collect()
    rows = lambda i: sorted(((r["label"], r["series"], r["value"]) for r in answers
                             if r["question_id"] == i), key=str)
    assert rows(0) == [("ACTUAL_FLOW", "breaches", 7.0)]
    assert rows(1) == [("Red", "matching", 2.0)]
    assert rows(2) == [(f"{x} well", "avg_ACTUAL_FLOW", v)
                       for x, v in (("dock", 31.5), ("mill", 11.5), ("park", 21.5))]
    assert len(rows(3)) == 2 and max(v for _, _, v in rows(3)) == 33.0
    assert [r[0] for r in rows(4)] == ["mean % change", "mean delta"]
    assert rows(6) == [("Amber", "count", 5.0), ("Green", "count", 5.0), ("Red", "count", 2.0)]
    assert [r["label"] for r in sorted(
        (r for r in answers if r["question_id"] == 7), key=lambda r: r["row_no"])] == [
        x for x in ("Feb-24", "Mar-24", "Apr-24", "May-24") for _ in range(3)]
    replies = {r["question_id"]: r for r in ask.replies(known.answer(asked)).collect()}
    assert replies[0]["confidence"] == 1.0 and "ACTUAL_FLOW=7" in replies[0]["reply"]


def test_route_uses_facts_when_there_is_no_answer(spark, harvests):
    no_time = onboard(harvests, "harvests", order_by=["FARM", "CROP", "SEASON"])
    asked = spark.createDataFrame(
        [(1, "trend of TONS average CROP beans lowest"), (2, "Total TONS"),
         (3, "monthly zebra")], "question_id int, question string")
    got = {r["question_id"]: r["tier"] for r in no_time.route(asked).collect()}
    assert got == {1: 2, 2: 1, 3: 0}


def test_search_finds_the_fact(spark, known):
    index = factsearch.build_index(known.facts())
    asked = spark.createDataFrame([(1, "ACTUAL_FLOW of dock well")],
                                  "question_id int, question string")
    best = factsearch.search(index, asked, 1).join(known.facts(), "doc_id").first()
    assert best["dim_val"] == "dock well" and best["measure"] == "ACTUAL_FLOW"


def test_search_weights_against_plain_formula(spark):
    import math
    texts = {1: "apple apple pear", 2: "pear plum", 3: "the plum"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    postings, _ = factsearch.build_index(docs)
    got = {(r["doc_id"], r["term"]): r["weight"] for r in postings.collect()}
    terms = {i: {} for i in texts}
    for i, text in texts.items():
        ws = [w for w in text.split() if w != "the"]
        for g in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]:
            terms[i][g] = terms[i].get(g, 0) + 1
    df = {}
    for counts in terms.values():
        for g in counts:
            df[g] = df.get(g, 0) + 1
    for i, counts in terms.items():
        w = {g: (1 + math.log(n)) * (math.log(4 / (1 + df[g])) + 1) for g, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for g, x in w.items():
            assert got[(i, g)] == pytest.approx(x / norm, rel=1e-12)


def test_suggestions_are_unique_and_start_with_alerts(survey):
    rows = profile_roles(profile_columns(survey, "wells"))
    context = ask.question_context(rows, kinds=structure.dashboard_type(rows))
    got = [r["question"] for r in ask.generate_questions(context, 40).orderBy("rank").collect()]
    assert len({q.lower() for q in got}) == len(got)
    assert got[0] == "Show all items where ALERT_BAND is Red."
    # `actual` in a name makes it a finance table, so nothing is asked about indicators
    assert "How many items are in each ALERT_BAND category?" in got
    assert "Which KRIs are in breach?" not in got


def test_document_round_trip(known):
    doc = document_from_json(portable_document(known)).first()
    assert doc["total_rows"] == 12 and doc["dashboard_type"] == "finance"
    assert doc["capabilities"]["geographic"] and len(doc["relationships"]) <= 10
    assert len(doc["agg_blocks"]) <= 8 and doc["questions"]


def test_ingest_and_read_back(spark, known):
    path = scratch_path(spark, "t-ingest")
    stored = ingest.ingest(known, path, rows_per_chunk=3)
    kinds = [r["chunk_type"] for r in stored.collect()]
    assert sorted(kinds) == ["rows"] * 4 + ["schema", "stats", "summary"]
    text = ingest.stored_context(spark, path).first()["context"]
    assert text.startswith("=== LIVE DATA SUMMARY: Wells ===") and "=== DATA ROWS 10–12 of 12" in text


def test_chart_shapes(survey):
    from tablesense.operators.roles import visual_roles
    shapes = structure.chart_shapes(visual_roles(profile_columns(survey)))
    found = {r["shape"]: r["confidence"] for r in shapes.collect()}
    assert found["kpi_scorecard"] == 0.72 and found["map"] == 0.75 and found["data_table"] == 0.25


def test_ranking_without_a_measure_and_a_failing_handler(spark, monkeypatch):
    names = spark.createDataFrame([(f"n{i}", f"t{i % 3}") for i in range(6)],
                                  "item_name string, team string")
    known = onboard(names, "names", order_by=["item_name"])
    asked = spark.createDataFrame([(1, "ranking of 2"), (2, "How many are there?")],
                                  "question_id int, question string")
    got = known.answer(asked).collect()
    first = [r for r in got if r["question_id"] == 1]
    assert [r["intent"] for r in first] == ["ranking"] * 2
    assert {r["confidence"] for r in first} == {0.7}

    def fails(df, roles, ask):
        raise ValueError("no such column")
    monkeypatch.setitem(ask.HANDLERS, "ranking", fails)
    got = {r["question_id"]: r["confidence"] for r in known.answer(asked).collect()}
    assert got == {1: 0.3, 2: 1.0}


def test_search_keeps_rare_terms_and_repeated_questions(spark):
    """Every term is searchable, however many are more frequent; equal texts all get hits."""
    docs = spark.createDataFrame(
        [(f"d{i:04}", " ".join(f"common{i % 7} filler{j}" for j in range(40)) +
          (" zanzibar" if i == 123 else f" own{i}")) for i in range(4000)],
        "doc_id string, text string")
    asked = spark.createDataFrame(
        [(1, "zanzibar"), (2, "zanzibar"), (3, ""), (4, None)],
        "question_id int, question string")
    hits = factsearch.search(factsearch.build_index(docs, ngrams=1), asked, 5, ngrams=1).collect()
    assert sorted((r.question_id, r["rank"], r.doc_id) for r in hits) == [
        (1, 1, "d0123"), (2, 1, "d0123")]


def test_index_takes_only_the_terms_asked_for(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "red green")],
                                 "doc_id int, text string")
    postings, _ = factsearch.build_index(docs, ngrams=1, max_terms=1)
    assert {r.term for r in postings.collect()} == {"red"}


def test_rows_behind_answers(spark, known):
    """Breaches by threshold, the first status word that occurs, outliers, all variances."""
    asked = spark.createDataFrame(list(enumerate([
        "Which KRIs are in breach?", "Show critical or amber status items", "What changed vs previous period?",
        "Show outliers in ACTUAL_FLOW", "Which KRIs are in breach?", "Show all pass status items"])),
        "question_id int, question string")
    named, rows = known.answer_rows(asked)
    combos = {r["question_id"]: r["combo"] for r in named.collect()}
    assert len(combos) == 6 and combos[0] == combos[4]
    found = {}
    for r in sorted(rows.collect(), key=lambda r: r["row_no"]):
        found.setdefault(r["combo"], []).append((r["row"]["SURVEY_PERIOD"], r["row"]["STATION_CODE"],
                                                 r["delta"], r["pct_change"]))
    breaching = [(m, c, None, None) for m, cs in (
        ("Feb-24", ""), ("Mar-24", "BC"), ("Apr-24", "BC"), ("May-24", "ABC")) for c in
        (f"W-{x}" for x in cs)]
    assert sorted(found[combos[0]]) == sorted(breaching)
    assert len(found[combos[1]]) == 5 and combos[3] not in found and combos[5] not in found
    changes = found[combos[2]]
    assert len(changes) == 12 and {d for _, _, d, _ in changes} == {1.0}
    assert changes[0][:2] == ("May-24", "W-C") and changes[-1][3] == 11.11  # 1 / 32 and 1 / 9
    shown = {r["question_id"]: r for r in answerrows.previews(named, rows, 2).collect()}
    assert shown[0]["row_count"] == 7 and len(shown[0]["rows"]) == 2 and shown[3]["row_count"] == 0
