import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesense.operators import (
    aggregate, chunks, findings, ordered, quantiles, reconcile, select, structure,
)
from tablesense.operators.indexing import dense_index
from tablesense.operators.profile import profile_columns
from tablesense.operators.roles import profile_roles, semantic_roles, table_roles, visual_roles
from tablesense.operators.select import Group, Rule


def roles_of(df, classify=profile_roles, **kw):
    rows = classify(profile_columns(df), **kw).collect()
    return {r["column"]: r["role"] for r in rows}, {r["column"]: r["sub_role"] for r in rows}


def test_profile_roles_of_fixtures(survey, harvests, checks):
    role, sub = roles_of(survey)
    assert role == {
        "STATION_CODE": "id", "STATION_NAME": "dimension", "ACTUAL_FLOW": "measure",
        "PRIOR_FLOW": "measure", "FLOW_THRESHOLD": "measure", "ALERT_BAND": "status",
        "COUNTY": "dimension", "SURVEY_PERIOD": "time"}
    assert (sub["ACTUAL_FLOW"], sub["PRIOR_FLOW"], sub["FLOW_THRESHOLD"]) == (
        "kpi_value", "previous", "threshold")
    assert roles_of(survey, mode="reference")[0]["COUNTY"] == "status"
    assert roles_of(harvests)[0] == {
        "FARM": "dimension", "CROP": "dimension", "TONS": "measure", "PLAN": "measure",
        "WATERED": "status", "SEASON": "dimension"}
    assert roles_of(checks)[0] == {
        "FIELD": "dimension", "MISSES": "measure", "ASPECT": "dimension", "CHECK_STATUS": "status",
        "CHECK_DATE": "time"}


def test_visual_and_semantic_roles(survey):
    assert roles_of(survey, visual_roles)[0]["COUNTY"] == "geographic"
    assert roles_of(survey, visual_roles)[0]["FLOW_THRESHOLD"] == "threshold"
    assert roles_of(survey, semantic_roles)[0]["SURVEY_PERIOD"] == "time"


def test_partners_and_kpis(survey, survey_roles):
    row = survey_roles.row("ACTUAL_FLOW")
    assert (row["threshold_partner"], row["previous_partner"]) == ("FLOW_THRESHOLD", "PRIOR_FLOW")
    found = {r["kpi_name"]: (r["below_count"], r["above_count"])
             for r in structure.kpi_patterns(survey, survey_roles).collect()}
    assert found == {"mill well": (3, 1), "park well": (1, 3), "dock well": (1, 3)}


def test_inexact_profile_keeps_small_counts_exact(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("g"))
    rows = {r["column"]: r for r in profile_columns(df, exact=False).collect()}
    assert rows["g"]["n_unique"] == 7 and rows["g"]["n_unique_exact"]
    assert not rows["id"]["n_unique_exact"]
    assert abs(rows["id"]["n_unique"] - 5000) < 500


def test_profile_of_awkward_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5), (float("nan"), None, 5)],
                               "x double, nothing string, same int")
    rows = {r["column"]: r for r in profile_columns(df).collect()}
    assert rows["x"]["n_null"] == 1 and rows["x"]["mean"] is None
    assert rows["nothing"]["n_unique"] == 0 and rows["same"]["min"] is None


def test_profile_counts_few_values_and_moves_digests_of_long_texts(spark):
    """Facts of few-valued columns come from their counted values, not from every row, and
    counting long texts moves no text; both have the facts a plain programme gives."""
    n = 4000
    words = ["red", "green", "2024-01-05", None]
    df = spark.createDataFrame(
        [(words[i % 4], i % 3, i % 2 == 0, float("nan") if i % 5 == 0 else i % 5 / 2, None,
          "long text " * 5 + str(i // 2), str(i)) for i in range(n)],
        "word string, few int, flag boolean, real double, none string, text string, short string")
    profile = profile_columns(df)
    plan = profile._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "sha2" in plan
    rows = {r["column"]: r for r in profile.collect()}
    assert rows["word"].value_list == sorted(words[:3]) and rows["word"].n_null == n // 4
    assert rows["word"].samples == sorted(words[:3])
    assert rows["word"].mean_length == (3 + 5 + 10) / 3
    assert rows["word"].semantic_dates == rows["word"].visual_dates == n // 4
    few = [i % 3 for i in range(n)]
    assert (rows["few"].n_unique, rows["few"].min, rows["few"].max) == (3, 0, 2)
    assert rows["few"].sum == sum(few) and abs(rows["few"].mean - sum(few) / n) < 1e-12
    assert rows["flag"].value_list == ["false", "true"]
    assert (rows["real"].n_null, rows["real"].n_unique) == (n // 5, 4)
    assert (rows["none"].n_null, rows["none"].n_unique, rows["none"].samples) == (n, 0, [])
    assert rows["none"].mean_length is None
    assert (rows["text"].n_unique, rows["short"].n_unique) == (n // 2, n)


def test_hierarchy(spark):
    df = spark.createDataFrame(
        [("Eu", "Fr", "Paris"), ("Eu", "Fr", "Lyon"), ("Eu", "De", "Bonn"), ("As", "Jp", "Kobe"),
         ("As", None, "Oslo")], "region string, country string, city string")
    found = {(r["parent"], r["child"]) for r in structure.hierarchies(df, df.columns).collect()}
    assert found == {("region", "country"), ("region", "city"), ("country", "city")}


@pytest.mark.parametrize("values", [
    [float(i % 5) for i in range(300)], [3.0], [1.0, 2.0],
    [7.0] * 200 + [1e300, -5.0, 0.25], [random.Random(1).gauss(0, 1) for _ in range(500)],
    list(range(1000)) + [7.0] * 500,
    [random.Random(2).paretovariate(0.05) * random.choice([-1, 1]) for _ in range(2000)],
    [5.0] * 1800 + [5.0 + i * 1e-15 for i in range(200)],
    [5e-324, -5e-324, 0.0, -0.0, 1.7e308, -1.7e308, 1.0]])
@pytest.mark.parametrize("few", [1 << 16, 3])
def test_quantiles_against_numpy(spark, monkeypatch, values, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "SLICES", 16 if few == 3 else quantiles.SLICES)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r["prob"]: r["quantile"] for r in quantiles.exact_quantiles(df, ["v"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantiles_of_several_columns(spark):
    rng = random.Random(9)
    rows = [(rng.random(), rng.randrange(3), None, float("inf") if i % 2 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e long")
    got = {(r["column"], r["prob"]): r["quantile"]
           for r in quantiles.exact_quantiles(df, df.columns, [0.25, 0.5, 0.75]).collect()}
    for i, name in ((0, "a"), (1, "b"), (4, "e")):
        for p in (0.25, 0.5, 0.75):
            assert got.pop((name, p)) == pytest.approx(np.quantile([r[i] for r in rows], p), rel=1e-12)
    assert {k[0] for k in got} == {"d"}
    assert quantiles.exact_quantiles(df.limit(0), ["a"], [0.5]).count() == 0


def test_dense_index_with_a_hot_group(spark):
    rows = [("hot", i) for i in range(400)] + [(f"g{i % 5}", i) for i in range(50)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int").repartition(7)
    got = dense_index(df, ["k"], within=["g"]).collect()
    want = {}
    for g, k in sorted(rows):
        want.setdefault(g, []).append(k)
    assert {(r["g"], r["k"]): r["row_no"] for r in got} == {
        (g, k): i for g, ks in want.items() for i, k in enumerate(ks)}
    assert sorted(r["row_no"] for r in dense_index(df, ["k", "g"]).collect()) == list(range(450))
    with pytest.raises(ValueError):
        dense_index(df, [])


def test_aggregates_by_hand(harvests):
    rows = {r["FARM"]: r["avg_TONS"] for r in
            aggregate.average_by(harvests, "FARM", ["TONS"]).collect()}
    assert rows == {"Birch": 350.0, "Heath": 300.0, "Shore": 120.0}
    spread = {r["value"]: (r["count"], r["pct"]) for r in
              aggregate.distribution(harvests, "WATERED").collect()}
    assert spread == {"Yes": (4, 44.4), "No": (5, 55.6)}
    bars = aggregate.histogram(harvests, "TONS").collect()
    assert sum(r["count"] for r in bars) == 9 and len(bars) == 9
    assert aggregate.histogram(harvests, "PLAN").count() == 0  # three distinct values
    wide = {r["SEASON"]: (r["rye"], r["beans"]) for r in aggregate.cross_tab(
        harvests, "SEASON", "CROP", "TONS", ["rye", "beans"]).collect()}
    assert wide == {"spring": (550.0, 120.0), "autumn": (850.0, 0.0)}


def test_aggregates_of_empty_and_constant(spark, harvests):
    none = harvests.where("false")
    assert aggregate.total(none, "TONS").first()[0] == 0.0
    assert aggregate.histogram(none, "TONS").count() == 0
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert aggregate.correlation_pairs(same, ["a", "b"]).first()["correlation"] is None


def test_breach_directions(survey):
    # the mean rate (21.5) lies above the mean ceiling (21.17)
    assert select.breach_rows(survey, "ACTUAL_FLOW", "FLOW_THRESHOLD").count() == 7
    assert select.breach_rows(survey, "ACTUAL_FLOW", "FLOW_THRESHOLD", "below").count() == 5
    marked = select.breaches(survey, [("ACTUAL_FLOW", "FLOW_THRESHOLD")], "ALERT_BAND")
    assert {r["kpi"] for r in marked.collect()} == {"ACTUAL_FLOW"}
    calm = survey.withColumn("ACTUAL_FLOW", F.col("FLOW_THRESHOLD"))
    by_status = select.breaches(calm, [("ACTUAL_FLOW", "FLOW_THRESHOLD")], "ALERT_BAND")
    assert {r["kpi"] for r in by_status.collect()} == {"ALERT_BAND"} and by_status.count() == 2


def test_rag_rows_take_the_first_word_present(survey):
    assert select.rag_rows(survey, "ALERT_BAND", "any critical or amber ones?").count() == 5
    assert select.rag_rows(survey, "ALERT_BAND", "all of them").count() == 0


def test_filter_tree(spark):
    people = spark.createDataFrame(
        [("Bob", "Old", "Rome"), ("Ann", "Active", "Chicago"), ("Cy", "Active", "Rome"),
         ("Di", None, "Chicago")], "Name string, Status string, City string")
    cities = spark.createDataFrame([("Chicago",), ("Chicago",), (None,)], "c string")
    tree = Group("OR", [
        Group("AND", [Rule("Status", "Active"), Rule("City", values=cities, value_column="c")]),
        Rule("Name", "Bob", name="is Bob")])
    assert {r["Name"] for r in select.filter_tree(people, tree, ["Name"]).collect()} == {
        "Bob", "Ann"}
    assert {r["rule"]: r["rows"] for r in select.filter_counts(people, tree).collect()} == {
        "rule_1": 2, "rule_2": 2, "is Bob": 1, "total": 2}


def test_comparison_accounts_for_every_row(spark):
    left = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "c"), (3, "c"), (4, None), (5, "x"), (5, "y"), (6, "z")],
        "k int, v string")
    right = spark.createDataFrame(
        [(1, "a"), (2, "B"), (3, "c"), (4, None), (5, "p"), (5, "q"), (7, "n")],
        "k int, w string")
    rows = {r["k"]: r["status"] for r in
            reconcile.compare_rows(left, right, ["k"], {"v": "w"}).collect()}
    assert rows == {1: "matched", 2: "changed", 3: "left_only", 4: "matched",
                    5: "duplicate_key", 6: "left_only", 7: "right_only"}
    s = reconcile.compare_summary(left, right, ["k"], {"v": "w"}).first()
    assert s["matched_rows"] + s["changed_rows"] + s["left_only_rows"] + \
        s["unpaired_left_rows"] == left.count()
    assert s["matched_rows"] + s["changed_rows"] + s["right_only_rows"] + \
        s["unpaired_right_rows"] == right.count()


def test_reversal_and_pattern(spark):
    series = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 0])],
                                   "t int, v double")
    back = ordered.trend_reversals(series, "t", ["v"]).first()
    assert (back["long_slope"], back["last_move"]) == (1.0, -5.0)
    rising = ordered.temporal_patterns(series.where("t < 5"), "t", ["v"]).first()
    assert (rising["trend_dir"], rising["trend_slope"], rising["pct_change"]) == ("up", 1.0, 400.0)
    assert ordered.trend_reversals(series.where("t < 3"), "t", ["v"]).count() == 0
    assert ordered.temporal_patterns(series.where("t < 1"), "t", ["v"]).count() == 0


def test_period_texts_are_ordered_as_periods(spark, survey):
    found = ordered.temporal_patterns(survey, "SURVEY_PERIOD", ["ACTUAL_FLOW"]).first()
    assert (found["min_period"], found["max_period"]) == ("Feb-24", "May-24")  # not Apr, Mar
    assert (found["baseline_val"], found["latest_val"]) == (20.0, 23.0)
    change = aggregate.trend_change(survey, "SURVEY_PERIOD", "ACTUAL_FLOW").first()["change"]
    assert change == 3.0
    order = ["SURVEY_PERIOD", "STATION_CODE"]
    now = ordered.current_and_previous(survey, ["ACTUAL_FLOW"], order).first()
    assert (now["current_val"], now["prev_val"]) == (33.0, 23.0)  # May-24, W-C then W-B
    last = select.last_status(survey, "ALERT_BAND", order).first()
    assert last["status"] == "breaching"
    words = spark.createDataFrame([("b", 1.0), ("a", 3.0)], "t string, v double")
    assert ordered.temporal_patterns(words, "t", ["v"]).first()["max_period"] == "b"


def test_many_periods_take_the_distributed_way(spark, monkeypatch):
    series = spark.createDataFrame([(i, float((i * 7) % 5)) for i in range(40)], "t int, v double")
    near = ordered.temporal_patterns(series, "t", ["v"]).collect()
    monkeypatch.setattr(ordered, "_WINDOW_PERIODS", 10)
    assert ordered.temporal_patterns(series, "t", ["v"]).collect() == near


def test_kpi_signals_by_hand(spark, survey):
    df = survey.withColumn("n", F.monotonically_increasing_id())
    roles = table_roles(survey, "semantic")
    found = {r["name"]: r for r in findings.kpi_signals(df, roles, ["n"]).collect()}
    now = found["ACTUAL_FLOW"]
    assert (now["current_val"], now["prev_val"], now["threshold"]) == (33.0, 32.0, 30.5)
    assert now["status"] == "at_risk"  # 8 % away, no word in the name says which way is bad
    assert now["pct_change"] == 3.13  # 1 / 32
    assert now["percentile"] == 100.0  # all twelve lie at or below


def greedy(rows, budget):
    """The budgeted walk, plainly."""
    order = {"summary": 1, "stats": 2, "schema": 3, "rows": 4}
    taken = []
    for kind, cid, text in sorted(rows, key=lambda r: (order[r[0]], r[1])):
        t = len(text) // 4
        if t <= budget:
            taken.append(text)
            budget -= t
        elif kind == "rows":
            kept = []
            for line in text.split("\n"):
                if (len(line) + 1) // 4 > budget:
                    break
                budget -= (len(line) + 1) // 4
                kept.append(line)
            if kept:
                taken.append("\n".join(kept) + "\n[...truncated to fit token budget]")
            break
    return "\n\n".join(taken)


def test_budget_against_a_plain_walk(spark):
    rng = random.Random(3)
    rows = []
    for s in range(6):
        for c in range(30):
            kind = rng.choice(["summary", "stats", "schema", "rows"])
            text = "\n".join("x" * rng.randrange(60) for _ in range(rng.randrange(1, 9)))
            rows.append((f"s{s}", f"c{c:02d}", kind, "=== head\n" + text))
    df = spark.createDataFrame(rows, "source_id string, chunk_id string, chunk_type string, "
                                     "content string").withColumn(
        "token_count", F.floor(F.length("content") / 4))
    for budget in (40, 200, 900):
        got = {r["source_id"]: r["context"]
               for r in chunks.budgeted_context(df, budget).collect()}
        for s in {r[0] for r in rows}:
            want = greedy([(k, c, x) for sid, c, k, x in rows if sid == s], budget)
            assert got.get(s, "") == want


def test_chunks_round_trip(spark, harvests):
    order = ["FARM", "CROP", "SEASON"]
    stored = chunks.row_chunks(harvests, order, "harvests", "Harvests", rows_per_chunk=4)
    assert sorted(r["metadata"] for r in stored.collect()) == [
        '{"row_start":0,"row_end":4,"total":9}', '{"row_start":4,"row_end":8,"total":9}',
        '{"row_start":8,"row_end":9,"total":9}']
    back = chunks.rows_from_chunks(stored, harvests.schema.simpleString()[7:-1].replace(":", " "))
    assert sorted(back.drop("source_id").collect()) == sorted(harvests.collect())


def test_chunks_keep_any_text(spark):
    texts = ["=first", "two\nlines", "a\\nb", "back\\", " blank ", 'say "x", y', "cr\r\n", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, v string").select("v", "k")
    back = chunks.rows_from_chunks(
        chunks.row_chunks(df, ["k"], "s", "S", rows_per_chunk=4), "v string, k long")
    assert {r["k"]: r["v"] for r in back.collect()} == dict(enumerate(texts))


def test_nothing_is_cut(spark):
    df = spark.range(300).select(
        F.concat(F.lit("place "), "id").alias("place"),
        *[(F.rand(i) * 100).alias(f"measure_with_a_long_name_{i}") for i in range(12)])
    measures = df.columns[1:]
    assert aggregate.geo_aggregate(df, "place", measures[0]).count() == 300
    assert aggregate.bin_aggregate(df, "place", measures[0]).count() == 300
    assert aggregate.summary_stats(df, measures).count() == 12
    assert aggregate.correlation_pairs(df, measures).count() == 66
    assert aggregate.group_means(df, ["place"], measures).count() == 3600


def test_unreadable_values_are_changes(spark):
    left = spark.createDataFrame([(1, 5), (2, 7), (3, None)], "k int, v int")
    right = spark.createDataFrame([(1, "x"), (2, "7"), (3, "y")], "k int, w string")
    rows = {r["k"]: r["status"] for r in
            reconcile.compare_rows(left, right, ["k"], {"v": "w"}).collect()}
    assert rows == {1: "changed", 2: "matched", 3: "changed"}


def test_correlations_of_many_measures(spark, monkeypatch):
    """Matrices of moments agree with one expression for each pair, nulls pair by pair."""
    rng = random.Random(21)
    rows = []
    for _ in range(400):
        x = rng.gauss(1e8, 1)
        row = [x, x + rng.gauss(0, 0.5), rng.random(), 7.0, None, float("nan"), -x]
        rows.append([v if v is None or rng.random() < 0.8 else None for v in row])
    names = [f"m{i}" for i in range(7)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    plain = {(r["col_a"], r["col_b"]): r["correlation"]
             for r in aggregate.correlation_pairs(df, names, None).collect()}
    square = {r["measure"]: r.asDict() for r in aggregate.correlation_matrix(df, names).collect()}
    monkeypatch.setattr(aggregate, "FEW_MEASURES", 2)
    many = {(r["col_a"], r["col_b"]): r["correlation"]
            for r in aggregate.correlation_pairs(df, names, None).collect()}
    assert len(many) == 21 and many.keys() == plain.keys()
    for pair, r in plain.items():
        assert many[pair] == (None if r is None else pytest.approx(r, abs=1e-6)), pair
    assert {r["measure"]: r.asDict() for r in aggregate.correlation_matrix(df, names).collect()} == square


def test_three_hundred_measures(spark):
    df = spark.range(200).select(*[F.sin(F.col("id") * (i % 7 + 1)).alias(f"m{i}") for i in range(300)])
    found = aggregate.correlation_pairs(df, df.columns)
    assert found.count() == 300 * 299 // 2
    assert found.where("col_a = 'm0' AND col_b = 'm7'").first()["correlation"] == 1.0
