"""Findings over whole tables: entities, KPI signals, relationships, anomalies, blocks."""

from pyspark.sql import functions as F

from catalogue.ordering import _LAST_TWO, _pattern_sql
from catalogue.selection import _iqr_sql
from catalogue.tables import MONTHLY_SQL, PRICED_SQL, monthly_kpis, priced_orders, query
from tablesense.operators import aggregate, findings
from tablesense.operators.roles import table_roles
from tablesense.plans.blocks import aggregation_blocks, blocks_long
from tablesense.plans.onboard import onboard


def _entity_sql(table, column, kind):
    return f"""
      SELECT '{column}' AS name, '{kind}' AS entity_type,
             string_agg(v, '|' ORDER BY c DESC, v) FILTER (place <= 5) AS sample_values,
             sum(c)::BIGINT AS frequency,
             round(least(1.0, max(c) / (SELECT count(*) FROM {table}) * (1 + count(*) / 10)), 3)
             AS importance
      FROM (SELECT {column}::VARCHAR AS v, count(*) AS c,
                   row_number() OVER (ORDER BY count(*) DESC, {column}::VARCHAR) AS place
            FROM {table} WHERE {column} IS NOT NULL GROUP BY {column})"""


@query(" UNION ALL ".join(_entity_sql("part", c, k) for c, k in (
    ("p_name", "dimension"), ("p_brand", "dimension"), ("p_type", "product"))))
def entities(t):
    found = findings.entities(t["part"], ["p_name", "p_brand", "p_type"])
    return found.withColumn("sample_values", F.array_join("sample_values", "|"))


_SIGNALS_SQL = f"""
  WITH p AS (SELECT *, price_threshold AS price_target FROM ({PRICED_SQL})),
  l AS (SELECT * FROM ({_LAST_TWO})),
  th AS (SELECT arg_max(price_target, (o_orderdate, o_orderkey)) AS threshold,
                arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st FROM p),
  s AS (SELECT count(*) AS n, regr_slope(v, i) AS slope, stddev_samp(v) AS std
        FROM (SELECT o_totalprice AS v,
                     (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::DOUBLE AS i
              FROM orders)),
  a AS (SELECT cur, prev, threshold, slope, std, abs(cur - threshold) / abs(threshold) AS gap,
               round((cur - prev) / abs(prev) * 100, 2) AS pct FROM l, th, s)
  SELECT 'o_totalprice' AS name, cur AS current_val, prev AS prev_val,
         round(threshold, 4) AS threshold, 'neutral' AS direction,
         CASE WHEN gap > 0.2 THEN 'breaching' WHEN gap > 0.05 THEN 'at_risk'
              ELSE 'on_track' END AS status,
         CASE WHEN abs(slope) < std * 0.05 THEN 'stable' WHEN abs(pct) <= 3 THEN 'stable'
              WHEN pct > 0 THEN 'improving' ELSE 'deteriorating' END AS trend,
         pct AS pct_change,
         (SELECT round(avg((o_totalprice <= cur)::INT) * 100, 1) FROM orders) AS percentile
  FROM a"""


def _targeted(t):
    return priced_orders(t).withColumnRenamed("price_threshold", "price_target")


def _signals(t):
    orders = _targeted(t)
    roles = table_roles(orders, "semantic", "orders")
    return findings.kpi_signals(orders, roles, ["o_orderdate", "o_orderkey"])


@query(_SIGNALS_SQL)
def kpi_signals(t):
    found = _signals(t).where(F.col("name") == "o_totalprice")
    return found.withColumn("threshold", F.round("threshold", 4))


@query(f"""WITH s AS ({MONTHLY_SQL}), x AS (
             SELECT CASE WHEN current_value < red_threshold * 0.8
                           OR current_value > red_threshold * 1.2 THEN 'breaching'
                         WHEN current_value < red_threshold * 0.95
                           OR current_value > red_threshold * 1.05 THEN 'at_risk'
                         ELSE 'on_track' END AS status FROM s)
           SELECT count(*) AS total, count(*) FILTER (status = 'breaching') AS breaching,
                  count(*) FILTER (status = 'at_risk') AS at_risk,
                  count(*) FILTER (status = 'on_track') AS on_track FROM x""")
def kpi_rollup(t):
    from tablesense.operators.select import kpi_status
    months = monthly_kpis(t).withColumn("status", kpi_status(
        F.col("current_value"), F.col("red_threshold"), F.lit("neutral")))
    return aggregate.kpi_rollup(months)


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
          SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, 'correlation' AS rel_type,
                 round(abs(r), 3) AS strength, 'r=' || printf('%.2f', r) || ' ('
                 || CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END || ' correlation)' AS note
          FROM c WHERE abs(r) > 0.6
          UNION ALL SELECT 'l_shipdate', m, 'time_series', 0.8::DOUBLE,
                 m || ' can be trended over l_shipdate'
          FROM (SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity',
                               'l_extendedprice', 'l_discount', 'l_tax']) AS m)""")
def relationships(t):
    # order and part numbers are measures here: the semantic id rule wants `_id` or `_key`
    lines = t["lineitem"]
    return findings.relationships(lines, table_roles(lines, "semantic", "lineitem"))


@query(_pattern_sql("orders", "o_orderdate", "month", ["o_orderkey", "o_custkey",
                                                       "o_totalprice"]))
def temporal_findings(t):
    orders = t["orders"]
    return findings.temporal_patterns(orders, table_roles(orders, "semantic", "orders"), "month")


@query(f"""WITH o AS ({_iqr_sql('events', 'value')})
           SELECT 'outlier' AS signal_type, severity, "column", n_outliers AS affected_rows
           FROM o""")
def anomaly_findings(t):
    known = onboard(t["events"], "events", order_by=["ts", "event_id"], grain="day",
                    normalised=True)
    found = known.anomalies
    return found.where(F.col("signal_type") == "outlier").select(
        "signal_type", "severity", "column", "affected_rows")


@query()
def insight_cards(t):
    known = onboard(t["orders"], "orders", "Orders", grain="month", normalised=True)
    return findings.insights(known.anomalies, known.kpis, known.temporal, known.narrative)


@query("""SELECT 'orders contains ' || replace(format('{:,}', count(*)), '.', '')
                 || ' records across 6 fields. Key dimensions: o_orderpriority. '
                 || 'Measures tracked: o_orderkey, o_custkey, o_totalprice.' AS opening
          FROM orders""")
def narrative_opening(t):
    known = onboard(t["orders"], "orders", grain="month", normalised=True)
    return known.narrative.select(F.regexp_extract(
        "narrative", r"^(.*? fields\. Key dimensions: .*?\. Measures tracked: .*?\.)", 1)
        .alias("opening"))


@query("SELECT 3::BIGINT AS n_lines")
def finding_context(t):
    known = onboard(t["orders"], "orders", grain="month", normalised=True)
    lines = known.kpis.select(F.concat_ws(" ", "name", "status", "trend").alias("line"))
    text = findings.context_text([("KEY PERFORMANCE INDICATORS", lines.orderBy("line"), 8)])
    return text.select((F.size(F.split("context", "\n")) - 1).cast("long").alias("n_lines"))


@query("""SELECT 'dist_o_orderpriority' AS agg_id, count(DISTINCT o_orderpriority) AS n_rows
          FROM orders
          UNION ALL SELECT 'dist_o_orderstatus', count(DISTINCT o_orderstatus) FROM orders
          UNION ALL SELECT 'summary_stats', 3 UNION ALL SELECT 'correlation', 3
          UNION ALL SELECT 'topn_' || m || '_o_orderpriority', 5
          FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice']) AS m)
          UNION ALL SELECT 'topn_' || m || '_o_orderstatus', 3
          FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice']) AS m)
          UNION ALL SELECT 'xtab_o_orderstatus_o_orderpriority',
            count(DISTINCT (o_orderstatus, o_orderpriority)) FROM orders
          UNION ALL SELECT 'hist_o_orderkey', 20 UNION ALL SELECT 'hist_o_custkey', 20
          UNION ALL SELECT 'hist_o_totalprice', 20
          UNION ALL SELECT 'ts_o_orderdate_' || m || '_o_orderstatus',
            (SELECT count(DISTINCT (o_orderdate, o_orderstatus)) FROM orders)
          FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice']) AS m)""")
def aggregation_block_rows(t):
    orders = t["orders"]
    blocks = aggregation_blocks(orders, table_roles(orders, "visual", "orders"))
    return blocks_long(blocks).groupBy("agg_id").agg(F.count(F.lit(1)).alias("n_rows"))
