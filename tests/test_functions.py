import math

from pyspark.sql import functions as F

from tablesense.functions import periods, text
from tablesense.functions.numbers import finite, pearson


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_number_formats(spark):
    values = [0.5, 1.0, 1234.6, 2500000.0, 0.0, -0.25, float("nan"), float("inf"), 12.5]
    assert column(spark, values, "double", text.format_block) == [
        "50.00%", "1.000", "1,235", "2.50M", "0.000", "-25.00%", "N/A", "N/A", "12.500"]
    assert column(spark, [1.0], "double", text.format_fact) == ["100.00%"]
    assert column(spark, [0.5, 3.14159], "double", text.format_answer) == ["50.00%", "3.142"]


def test_tokens_and_hash(spark):
    assert column(spark, ["abcdefgh", "abc"], "string", text.token_estimate) == [2, 0]
    assert column(spark, ["abc"], "string", text.short_hash) == ["900150983cd2"]


def test_name_tokens(spark):
    hit = lambda c: text.token_matches(c, "rag|status|dt$")
    assert column(spark, ["average_x", "o_orderstatus", "rag_x", "load_dt", "dtx"], "string",
                  hit) == [False, True, True, True, False]


def test_period_keys_sort_like_time(spark):
    labels = ["Jan-26", "Feb-26", "Dec-25", "2026-03", "Q1 2026", "FY26", "2026", "soon"]
    keys = column(spark, labels, "string", periods.period_key)
    assert keys[2] < keys[0] < keys[1] < keys[3]
    assert keys[4] == keys[0] and keys[5] == keys[6] == 2026 * 12 and keys[7] is None


def test_finite_and_constant_correlation(spark):
    assert column(spark, [1.0, float("nan"), math.inf, None], "double", finite) == [
        1.0, None, None, None]
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert df.agg(pearson(F.col("a"), F.col("b"))).first()[0] is None
