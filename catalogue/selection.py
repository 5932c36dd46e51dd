"""Row selection, filter trees and table comparison over whole tables."""

from pyspark.sql import functions as F

from catalogue.tables import (
    LABELLED_SQL, MONTHLY_SQL, PRICED_SQL, labelled_documents, monthly_kpis, priced_orders,
    query,
)
from tablesense.operators import reconcile, select
from tablesense.operators.profile import profile_columns
from tablesense.operators.select import Group, Rule


@query(f"""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
           FROM ({PRICED_SQL}) WHERE o_totalprice > price_threshold GROUP BY 1""")
def breaching_orders(t):
    # the two means are equal here up to rounding noise, so the direction is stated
    rows = select.breach_rows(priced_orders(t), "o_totalprice", "price_threshold", "above")
    return rows.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH k AS ({MONTHLY_SQL}),
           m AS (SELECT avg(current_value) < avg(red_threshold) AS below FROM k)
           SELECT kri_name, report_month, current_value FROM k, m
           WHERE CASE WHEN below THEN current_value < red_threshold
                      ELSE current_value > red_threshold END""")
def breaches_by_mean_direction(t):
    return select.breach_rows(monthly_kpis(t), "current_value", "red_threshold").select(
        "kri_name", "report_month", "current_value")


@query(f"""SELECT kri_name, report_month, rag_status FROM ({MONTHLY_SQL})
           WHERE lower(rag_status) IN ('red', 'fail', 'breach', 'critical', 'no', 'false')""")
def breaches_by_status(t):
    return select.breach_rows_by_status(monthly_kpis(t), "rag_status").select(
        "kri_name", "report_month", "rag_status")


@query(f"""WITH k AS ({MONTHLY_SQL}),
           m AS (SELECT avg(current_value) < avg(red_threshold) AS below FROM k)
           SELECT 'current_value' AS kpi, kri_name, count(*) AS n FROM k, m
           WHERE CASE WHEN below THEN current_value < red_threshold
                      ELSE current_value > red_threshold END GROUP BY 2""")
def breaches_of_all_kpis(t):
    found = select.breaches(monthly_kpis(t), [("current_value", "red_threshold")], "rag_status")
    return found.groupBy("kpi", "kri_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT kri_name, report_month, rag_status, 'amber' AS matched FROM ({MONTHLY_SQL})
           WHERE contains(lower(rag_status), 'amber')""")
def rows_by_status_word(t):
    rows = select.rag_rows(monthly_kpis(t), "rag_status", "Which were amber or failing?")
    return rows.select("kri_name", "report_month", "rag_status", "matched")


@query(f"""SELECT o_orderstatus, o_orderkey, o_totalprice, price_threshold,
                  round(abs(o_totalprice - price_threshold), 4) AS _gap FROM ({PRICED_SQL})
           WHERE o_totalprice > price_threshold""")
def breach_analysis_rows(t):
    # means of doubles: the threshold is compared as the rounded gap shows it
    return select.breach_analysis(
        priced_orders(t), "o_totalprice", "price_threshold", ["o_orderstatus", "o_orderkey"],
        "above", [F.desc("_gap"), F.asc("o_orderkey")])


@query(f"""SELECT count(*) FILTER (o_totalprice > price_threshold) AS breach_count,
                  count(*) AS total,
                  round(count(*) FILTER (o_totalprice > price_threshold) * 100.0::DOUBLE
                        / greatest(count(*), 1), 1) AS breach_rate FROM ({PRICED_SQL})""")
def breach_analysis_summary(t):
    return select.breach_summary(priced_orders(t), "o_totalprice", "price_threshold", "above")


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
                     FROM events)
          SELECT event_id, value FROM events, q
          WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def outlier_rows(t):
    return select.iqr_outliers(t["events"], "value").select("event_id", "value")


def _iqr_sql(table, column):
    return f"""
      SELECT '{column}' AS "column", round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3,
             round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi,
             count(*) AS n_outliers,
             CASE WHEN count(*) < 3 THEN 'medium' ELSE 'high' END AS severity,
             string_agg(round(v, 4)::VARCHAR, ',' ORDER BY place) FILTER (place <= 3) AS examples
      FROM (SELECT *, row_number() OVER (ORDER BY abs(v - (q1 + q3) / 2) DESC, v DESC) AS place
            FROM (SELECT {column}::DOUBLE AS v, q1, q3, q1 - 2.5 * (q3 - q1) AS lo,
                         q3 + 2.5 * (q3 - q1) AS hi
                  FROM {table}, (SELECT quantile_cont({column}, 0.25) AS q1,
                                        quantile_cont({column}, 0.75) AS q3 FROM {table}))
            WHERE v < lo OR v > hi) HAVING count(*) > 0"""


@query(_iqr_sql("documents", "n_chars"))
def outlier_findings_documents(t):
    return _examples_as_text(select.iqr_anomalies(t["documents"], ["n_chars"]))


@query(_iqr_sql("events", "value"))
def outlier_findings_events(t):
    return _examples_as_text(select.iqr_anomalies(t["events"], ["value"]))


def _examples_as_text(found):
    texts = F.transform("examples", lambda v: F.round(v, 4).cast("string"))
    return found.select(
        "column", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "lo", "hi")], "n_outliers",
        "severity", F.array_join(texts, ",").alias("examples"))


@query(f"""WITH d AS ({LABELLED_SQL}), s AS (
             SELECT 'quality' AS "column", count(*) - count(quality) AS n_null,
                    count(*) AS n FROM d
             UNION ALL SELECT 'toxic', count(*) - count(toxic), count(*) FROM d
             UNION ALL SELECT 'n_chars', count(*) - count(n_chars), count(*) FROM d)
           SELECT 'labelled' AS source_id, "column", n_null,
                  round(n_null::DOUBLE / n, 6) AS null_share,
                  CASE WHEN n_null::DOUBLE / n < 0.6 THEN 'medium' ELSE 'high' END AS severity
           FROM s WHERE n_null::DOUBLE / n > 0.3""")
def missing_data_signals(t):
    profile = profile_columns(labelled_documents(t), "labelled",
                              columns=["quality", "toxic", "n_chars"])
    return select.missing_signals(profile).withColumn("null_share", F.round("null_share", 6))


@query(f"""SELECT kri_name, report_month,
                  CASE WHEN abs(current_value - red_threshold) / red_threshold > 0.2
                       THEN 'breaching'
                       WHEN abs(current_value - red_threshold) / red_threshold > 0.05
                       THEN 'at_risk' ELSE 'on_track' END AS neutral,
                  CASE WHEN current_value > red_threshold THEN 'breaching' ELSE 'on_track' END
                       AS cost,
                  CASE WHEN current_value < red_threshold THEN 'breaching' ELSE 'on_track' END
                       AS revenue
           FROM ({MONTHLY_SQL})""")
def kpi_status_by_direction(t):
    status = lambda name: select.kpi_status(
        F.col("current_value"), F.col("red_threshold"), select.kpi_direction(F.lit(name)))
    return monthly_kpis(t).select(
        "kri_name", "report_month", status("current_value").alias("neutral"),
        status("total_cost").alias("cost"), status("revenue").alias("revenue"))


@query(f"""WITH l AS (SELECT max_by(rag_status, (report_month, kri_name)) AS last_status
                      FROM ({MONTHLY_SQL}))
           SELECT last_status, CASE lower(last_status) WHEN 'red' THEN 'breaching'
                  WHEN 'amber' THEN 'at_risk' WHEN 'green' THEN 'on_track' END AS status FROM l""")
def status_of_last_row(t):
    return select.last_status(monthly_kpis(t), "rag_status", ["report_month", "kri_name"])


@query(f"""SELECT kri_name, report_month, current_value, previous_value FROM ({MONTHLY_SQL})
           WHERE abs((current_value - previous_value) / abs(previous_value)) > 0.1""")
def variance_breaches(t):
    return select.variance_breach(monthly_kpis(t), "current_value", "previous_value").select(
        "kri_name", "report_month", "current_value", "previous_value")


_TREE_SQL = """
  (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
  OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""


def _tree(t):
    building = t["customer"].where(F.col("c_mktsegment") == "BUILDING")
    return Group("OR", [
        Group("AND", [Rule("o_orderstatus", "F", name="status"),
                      Rule("o_orderpriority", "1-URGENT", name="priority")]),
        Rule("o_custkey", values=building, value_column="c_custkey", name="customer")])


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {_TREE_SQL}")
def filter_tree_rows(t):
    return select.filter_tree(t["orders"], _tree(t), ["o_orderkey", "o_custkey", "o_totalprice"])


@query(f"""SELECT 'status' AS rule, count(*) AS rows FROM orders WHERE o_orderstatus = 'F'
           UNION ALL SELECT 'priority', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'
           UNION ALL SELECT 'customer', count(*) FROM orders WHERE o_custkey IN
             (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
           UNION ALL SELECT 'total', count(*) FROM orders WHERE {_TREE_SQL}""")
def filter_tree_counts(t):
    return select.filter_counts(t["orders"], _tree(t))


@query("""SELECT doc_id, lang, source FROM documents
          WHERE contains(lower(text), 'license') OR contains(lower(lang), 'license')
             OR contains(lower(source), 'license') OR contains(doc_id::VARCHAR, 'license')""")
def search_any_column(t):
    docs = t["documents"].select("doc_id", "text", "lang", "source")
    return select.search_any_column(docs, "license").select("doc_id", "lang", "source")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey IN
          (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def rows_in_value_list(t):
    nations = t["nation"].where(F.col("n_regionkey") == 1)
    return select.in_value_list(t["customer"], "c_nationkey", nations, "n_nationkey").select(
        "c_custkey", "c_mktsegment")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN
          (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def rows_not_in_value_list(t):
    urgent = t["orders"].where(F.col("o_orderpriority") == "1-URGENT")
    return select.in_value_list(t["customer"], "c_custkey", urgent, "o_custkey", negate=True
                                ).select("c_custkey", "c_mktsegment")


@query("""WITH n AS (SELECT max(ts) AS now FROM events)
          SELECT event_type, count(*) AS n FROM events, n
          WHERE ts < now - INTERVAL 7 DAY GROUP BY 1""")
def rows_past_retention(t):
    now = t["events"].agg(F.max("ts")).scalar()
    return select.older_than(t["events"], "ts", 7, now).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT *, CASE WHEN event_type <> 'error'
                                    THEN ts + INTERVAL 10 DAY END AS expires_dt FROM events),
          n AS (SELECT max(ts) AS now FROM events)
          SELECT event_type, count(*) AS n FROM e, n
          WHERE expires_dt IS NULL OR expires_dt > now GROUP BY 1""")
def unexpired_rows(t):
    ends = F.when(F.col("event_type") != "error",
                  F.col("ts") + F.make_dt_interval(F.lit(10)))
    now = t["events"].agg(F.max("ts")).scalar()
    return select.unexpired(t["events"].withColumn("expires_dt", ends), now=now).groupBy(
        "event_type").agg(F.count(F.lit(1)).alias("n"))


# --- comparison: orders against a later version of themselves ---------------------------

_VERSION_SQL = """
  SELECT o_orderkey, o_custkey AS customer,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'F' ELSE o_orderstatus END AS status,
         o_totalprice AS price
  FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW'
  UNION ALL
  SELECT -1 - c_custkey, c_custkey, 'N', c_acctbal FROM customer WHERE c_acctbal < 0"""
_MAP = {"o_custkey": "customer", "o_orderstatus": "status", "o_totalprice": "price"}


def _later_version(t):
    orders = t["orders"].where(
        (F.col("o_orderstatus") != "P") | (F.col("o_orderpriority") != "5-LOW")).select(
        "o_orderkey", F.col("o_custkey").alias("customer"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "F").otherwise(F.col("o_orderstatus"))
        .alias("status"), F.col("o_totalprice").alias("price"))
    added = t["customer"].where(F.col("c_acctbal") < 0).select(
        (-1 - F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("customer"),
        F.lit("N").alias("status"), F.col("c_acctbal").alias("price"))
    return orders.unionByName(added)


_JOINED_SQL = f"""
  SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey AS ak,
         b.o_orderkey AS bk, o_orderstatus, status,
         a.o_custkey IS NOT DISTINCT FROM b.customer AS same_customer,
         a.o_orderstatus IS NOT DISTINCT FROM b.status AS same_status,
         a.o_totalprice IS NOT DISTINCT FROM b.price AS same_price
  FROM orders a FULL JOIN ({_VERSION_SQL}) b ON a.o_orderkey = b.o_orderkey"""


@query(f"""SELECT o_orderkey,
             CASE WHEN bk IS NULL THEN 'left_only' WHEN ak IS NULL THEN 'right_only'
                  WHEN same_customer AND same_status AND same_price THEN 'matched'
                  ELSE 'changed' END AS status,
             CASE WHEN ak IS NOT NULL AND bk IS NOT NULL AND same_customer AND same_status
                       AND same_price THEN 1::BIGINT ELSE 0 END AS same_rows
           FROM ({_JOINED_SQL})""")
def compared_rows(t):
    return reconcile.compare_rows(t["orders"], _later_version(t), ["o_orderkey"], _MAP).select(
        "o_orderkey", "status", "same_rows")


@query(f"""SELECT o_orderkey, 'o_orderstatus' AS "column", o_orderstatus AS left_value,
                  status AS right_value
           FROM ({_JOINED_SQL}) WHERE ak IS NOT NULL AND bk IS NOT NULL AND NOT same_status""")
def compared_cells(t):
    return reconcile.compare_cells(t["orders"], _later_version(t), ["o_orderkey"], _MAP)


@query(f"""WITH j AS ({_JOINED_SQL}), p AS (
             SELECT *, same_customer::INT + same_status::INT + same_price::INT AS hits FROM j
             WHERE ak IS NOT NULL AND bk IS NOT NULL)
           SELECT count(*) FILTER (hits = 3) AS matched_rows,
                  count(*) FILTER (hits < 3) AS changed_rows,
                  (SELECT count(*) FROM j WHERE bk IS NULL) AS left_only_rows,
                  (SELECT count(*) FROM j WHERE ak IS NULL) AS right_only_rows,
                  0::BIGINT AS unpaired_left_rows, 0::BIGINT AS unpaired_right_rows,
                  sum(hits)::BIGINT AS matched_cells, sum(3 - hits)::BIGINT AS changed_cells
           FROM p""")
def comparison_summary(t):
    return reconcile.compare_summary(t["orders"], _later_version(t), ["o_orderkey"], _MAP)
