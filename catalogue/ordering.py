"""Ordered analytics over whole tables."""

from pyspark.sql import functions as F

from catalogue.tables import MONTHLY_SQL, monthly_kpis, query
from tablesense.functions.numbers import relative_change
from tablesense.operators import ordered

_ORDER = ["o_orderdate", "o_orderkey"]
_LAST_TWO = """
  SELECT max(v) FILTER (rn = 1) AS cur, max(v) FILTER (rn = 2) AS prev FROM (
    SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders)"""


@query(f"""SELECT 'o_totalprice' AS "column", cur AS current_val, prev AS prev_val,
                  round((cur - prev) / abs(prev) * 100, 2) AS pct_change FROM ({_LAST_TWO})""")
def current_and_previous(t):
    return ordered.change_of_current(t["orders"], ["o_totalprice"], _ORDER)


@query(f"""SELECT 'o_totalprice' AS "column", any_value(cur) AS current_val,
                  round(avg((o_totalprice <= cur)::INT) * 100, 1) AS percentile
           FROM orders, ({_LAST_TWO})""")
def percentile_of_current(t):
    return ordered.percentile_of_current(t["orders"], ["o_totalprice"], _ORDER)


@query("""SELECT 'o_totalprice' AS "column", count(*) AS n, round(regr_slope(v, i), 6) AS slope,
                 round(stddev_samp(v), 4) AS std
          FROM (SELECT o_totalprice AS v,
                       (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::DOUBLE AS i
                FROM orders)""")
def slope_over_rows(t):
    return ordered.row_slopes(t["orders"], ["o_totalprice"], _ORDER).withColumns(
        {"slope": F.round("slope", 6), "std": F.round("std", 4)})


_LABEL_SQL = f"""
  SELECT *, CASE WHEN pct IS NULL THEN 'insufficient_data' WHEN abs(pct) <= 3 THEN 'stable'
                 WHEN pct > 0 THEN 'improving' ELSE 'deteriorating' END AS neutral,
         CASE WHEN pct IS NULL THEN 'insufficient_data' WHEN abs(pct) <= 1 THEN 'stable'
              WHEN pct < 0 THEN 'improving' ELSE 'deteriorating' END AS cost
  FROM (SELECT kri_name, report_month,
               round((current_value - previous_value) / abs(previous_value) * 100, 2) AS pct
        FROM ({MONTHLY_SQL}))"""


@query(_LABEL_SQL)
def trend_labels(t):
    none = F.lit(None).cast("double")
    label = lambda direction: ordered.trend_label(
        F.lit(direction), F.col("pct"), none, none, none, has_time=False)
    return monthly_kpis(t).select(
        "kri_name", "report_month",
        relative_change(F.col("current_value"), F.col("previous_value")).alias("pct")
    ).select("*", label("neutral").alias("neutral"), label("lower_is_better").alias("cost"))


def _pattern_sql(table, time, grain, measures):
    return " UNION ALL ".join(f"""
      SELECT '{time}' AS time_col, '{m}' AS measure_col,
        CASE WHEN abs(slope) < std * 0.03 THEN 'flat' WHEN slope > 0 THEN 'up'
             WHEN slope < 0 THEN 'down' ELSE 'volatile' END AS trend_dir,
        round(slope, 4) AS trend_slope, lo AS min_period, hi AS max_period, n AS n_periods,
        round(latest, 4) AS latest_val, round(baseline, 4) AS baseline_val,
        round((latest - baseline) / greatest(abs(baseline), 1e-9) * 100, 2) AS pct_change,
        steps >= 4 AND step_std > step_size * 0.5 AS is_seasonal
      FROM (SELECT count(*) AS n, min(p)::VARCHAR AS lo, max(p)::VARCHAR AS hi,
                   min_by(v, p) AS baseline, max_by(v, p) AS latest,
                   regr_slope(v, i) AS slope, stddev_pop(v) AS std, count(d) AS steps,
                   stddev_pop(d) AS step_std, avg(abs(d)) AS step_size
            FROM (SELECT p, v, (row_number() OVER (ORDER BY p) - 1)::DOUBLE AS i,
                         v - lag(v) OVER (ORDER BY p) AS d
                  FROM (SELECT date_trunc('{grain}', {time}) AS p, avg({m}) AS v
                        FROM {table} GROUP BY 1) WHERE v IS NOT NULL)) WHERE n >= 2"""
        for m in measures)


@query(_pattern_sql("lineitem", "l_shipdate", "month", ["l_quantity", "l_extendedprice"]))
def temporal_patterns_by_month(t):
    return ordered.temporal_patterns(
        t["lineitem"], "l_shipdate", ["l_quantity", "l_extendedprice"], "month")


@query(_pattern_sql("events", "ts", "day", ["value"]))
def temporal_patterns_by_day(t):
    return ordered.temporal_patterns(t["events"], "ts", ["value"], "day")


@query("""WITH r AS (SELECT p, v, (row_number() OVER (ORDER BY p) - 1)::DOUBLE AS i,
                            lag(v) OVER (ORDER BY p) AS pv, count(*) OVER () AS n
                     FROM (SELECT date_trunc('day', ts) AS p, avg(value) AS v
                           FROM events GROUP BY 1)),
          s AS (SELECT regr_slope(v, i) FILTER (i < n - 1) AS slope,
                       max(v) FILTER (i = n - 1) AS last_val, max(v - pv) FILTER (i = n - 1) AS mv,
                       max(p) AS lp, any_value(n) AS n FROM r)
          SELECT 'value' AS measure, lp::VARCHAR AS last_period, round(last_val, 6) AS last_val,
                 round(slope, 6) AS long_slope, round(mv, 6) AS last_move
          FROM s WHERE n >= 4 AND ((slope > 0 AND mv < -abs(slope) * 2)
                                   OR (slope < 0 AND mv > abs(slope) * 2))""")
def trend_reversals(t):
    found = ordered.trend_reversals(t["events"], "ts", ["value"], "day")
    return found.withColumns({c: F.round(c, 6) for c in ("last_val", "long_slope", "last_move")})


@query(f"""SELECT kri_name, report_month, round(current_value - previous_value, 4) AS _delta,
                  round((current_value - previous_value) / abs(previous_value) * 100, 2)
                  AS _pct_chg FROM ({MONTHLY_SQL})""")
def period_variance(t):
    return ordered.period_variance(monthly_kpis(t), "current_value", "previous_value").select(
        "kri_name", "report_month", "_delta", "_pct_chg")


@query(f"""SELECT round(avg(round(c - p, 4)), 6) AS mean_delta,
                  round(avg(round((c - p) / abs(p) * 100, 2)), 6) AS mean_pct_chg
           FROM (SELECT current_value AS c, previous_value AS p FROM ({MONTHLY_SQL}))""")
def variance_summary(t):
    out = ordered.variance_summary(monthly_kpis(t), "current_value", "previous_value")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("""SELECT o_orderkey, o_totalprice FROM orders
          ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 5""")
def highest_rows(t):
    return ordered.highest(t["orders"], "o_totalprice", tie_break=["o_orderkey"]).select(
        "o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_totalprice FROM orders
          ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 5""")
def lowest_rows(t):
    return ordered.lowest(t["orders"], "o_totalprice", tie_break=["o_orderkey"]).select(
        "o_orderkey", "o_totalprice")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
          ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10""")
def ranked_rows(t):
    return ordered.ranking(
        t["lineitem"], "l_extendedprice", 10, ["l_orderkey", "l_linenumber", "l_partkey"]
    ).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(" UNION ALL ".join(f"""
  SELECT '{m}' AS measure, place, value, p_brand, p_type FROM (
    SELECT {m}::DOUBLE AS value, p_brand, p_type,
           row_number() OVER (ORDER BY {m} DESC, p_partkey) AS place FROM part)
  WHERE place <= 3""" for m in ["p_size", "p_retailprice"]))
def top_rows_of_measures(t):
    return ordered.top_rows(t["part"], ["p_size", "p_retailprice"], ["p_brand", "p_type"],
                            tie_break=["p_partkey"]).withColumn(
        "place", F.col("place").cast("long"))


@query("""SELECT 'o_orderstatus' AS grouping, o_orderstatus AS value,
                 (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1)
                 AS row_no, o_orderkey FROM orders""")
def dense_row_numbers(t):
    from tablesense.operators.indexing import dense_index
    numbered = dense_index(t["orders"].select("o_orderstatus", "o_orderkey"), ["o_orderkey"],
                           within=["o_orderstatus"])
    return numbered.select(F.lit("o_orderstatus").alias("grouping"),
                           F.col("o_orderstatus").alias("value"), "row_no", "o_orderkey")


@query("""WITH q AS (SELECT unnest([0.01, 0.25, 0.5, 0.9, 0.999]) AS prob)
          SELECT 'l_extendedprice' AS "column", prob::DOUBLE AS prob, round(quantile, 6) AS quantile
          FROM (SELECT unnest([0.01, 0.25, 0.5, 0.9, 0.999]) AS prob,
                       unnest(quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.9, 0.999]))
                       AS quantile FROM lineitem)""")
def exact_quantiles(t):
    from tablesense.operators.quantiles import exact_quantiles as quantiles
    found = quantiles(t["lineitem"], ["l_extendedprice"], [0.01, 0.25, 0.5, 0.9, 0.999])
    return found.withColumn("quantile", F.round("quantile", 6))
