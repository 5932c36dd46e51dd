"""Aggregates over whole tables."""

from pyspark.sql import functions as F

from catalogue.tables import LABELLED_SQL, PRICED_SQL, labelled_documents, priced_orders, query
from tablesense.operators import aggregate as agg

_LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""SELECT l_returnflag, round(avg(l_extendedprice), 4) AS avg_l_extendedprice
          FROM lineitem GROUP BY 1""")
def average_by_status(t):
    return agg.average_by(t["lineitem"], "l_returnflag", ["l_extendedprice"])


@query("""SELECT 'l_quantity' AS measure, round(avg(l_quantity), 4) AS average FROM lineitem
          UNION ALL SELECT 'l_extendedprice', round(avg(l_extendedprice), 4) FROM lineitem
          UNION ALL SELECT 'l_discount', round(avg(l_discount), 4) FROM lineitem
          UNION ALL SELECT 'l_tax', round(avg(l_tax), 4) FROM lineitem""")
def averages_of_measures(t):
    return agg.averages(t["lineitem"], _LINE_MEASURES)


@query("SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem")
def total_of_measure(t):
    return agg.total(t["lineitem"], "l_extendedprice").select(F.round("total", 2).alias("total"))


@query("SELECT l_linestatus, count(*) AS count FROM lineitem GROUP BY 1")
def count_by_status(t):
    return agg.count_by(t["lineitem"], "l_linestatus")


@query("SELECT count(*) AS count FROM lineitem")
def count_of_rows(t):
    return agg.count_rows(t["lineitem"])


@query("""SELECT o_orderpriority AS value, count(*) AS count,
                 round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 1) AS pct
          FROM orders GROUP BY 1""")
def distribution_of_rows(t):
    return agg.distribution(t["orders"], "o_orderpriority", of="rows")


@query(f"""WITH d AS ({LABELLED_SQL})
           SELECT quality::VARCHAR AS value, count(*) AS count,
                  round(count(*) * 100.0::DOUBLE
                        / (SELECT count(quality) FROM d), 1) AS pct
           FROM d WHERE quality IS NOT NULL GROUP BY 1""")
def distribution_of_present(t):
    return agg.distribution(labelled_documents(t), "quality", of="present")


_STATS_SQL = " UNION ALL ".join(
    f"""SELECT '{m}' AS "column", count({m}) AS count, round(sum({m}), 2) AS sum,
        round(avg({m}), 6) AS mean, min({m})::DOUBLE AS min, max({m})::DOUBLE AS max,
        round(stddev_samp({m}), 6) AS std, count(*) AS total_rows, 11 AS total_cols
        FROM lineitem""" for m in _LINE_MEASURES)


@query(_STATS_SQL)
def summary_statistics(t):
    stats = agg.summary_stats(t["lineitem"], _LINE_MEASURES)
    return stats.withColumns({
        "sum": F.round("sum", 2), "mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(" UNION ALL ".join(
    f"""SELECT '{m}' AS "column", count({m}) AS count, round(avg({m}), 3) AS mean,
        round(stddev_samp({m}), 3) AS std, round(min({m})::DOUBLE, 3) AS min,
        round(quantile_cont({m}, 0.25), 3) AS q25, round(quantile_cont({m}, 0.5), 3) AS q50,
        round(quantile_cont({m}, 0.75), 3) AS q75, round(max({m})::DOUBLE, 3) AS max
        FROM lineitem""" for m in ["l_quantity", "l_extendedprice"]))
def describe_measures(t):
    return agg.describe(t["lineitem"], ["l_quantity", "l_extendedprice"])


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", rank, value, count, pct FROM (
          SELECT {c} AS value, count(*) AS count,
                 round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 1) AS pct,
                 row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank
          FROM part GROUP BY {c}) WHERE rank <= 5""" for c in ["p_name", "p_brand", "p_type"]))
def top_text_values(t):
    return agg.top_values(t["part"], ["p_name", "p_brand", "p_type"]).withColumn(
        "rank", F.col("rank").cast("long"))


@query("""SELECT o_orderpriority, round(avg(o_totalprice), 4) AS avg_o_totalprice
          FROM orders GROUP BY 1""")
def compare_groups(t):
    return agg.average_by(t["orders"], "o_orderpriority", ["o_totalprice"])


@query("""SELECT date_trunc('month', o_orderdate) AS month, round(avg(o_totalprice), 4) AS mean
          FROM orders GROUP BY 1""")
def trend_by_month(t):
    orders = t["orders"].withColumn("month", F.date_trunc("month", "o_orderdate").cast(
        "timestamp_ntz"))
    return agg.trend(orders, "month", "o_totalprice", digits=4)


@query("""WITH p AS (SELECT date_trunc('month', o_orderdate) AS m, avg(o_totalprice) AS a
                     FROM orders GROUP BY 1)
          SELECT count(*) AS n_periods, round(max_by(a, m) - min_by(a, m), 4) AS change FROM p""")
def trend_change(t):
    orders = t["orders"].withColumn("month", F.date_trunc("month", "o_orderdate"))
    return agg.trend_change(orders, "month", "o_totalprice", digits=4)


@query("""SELECT date_trunc('month', o_orderdate) AS month,
                 round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS "F",
                 round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS "O",
                 round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS "P"
          FROM orders GROUP BY 1""")
def trend_by_status(t):
    orders = t["orders"].withColumn("month", F.date_trunc("month", "o_orderdate").cast(
        "timestamp_ntz"))
    return agg.trend_by(orders, "month", "o_orderstatus", "o_totalprice", ["F", "O", "P"], 4)


@query("""SELECT date_trunc('month', l_shipdate) AS period, l_returnflag AS series,
                 round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2""")
def time_series_by_flag(t):
    lines = t["lineitem"].withColumn("month", F.date_trunc("month", "l_shipdate").cast(
        "timestamp_ntz"))
    return agg.time_series(lines, "month", "l_quantity", "l_returnflag").withColumn(
        "value", F.round("value", 2))


@query("""SELECT date_trunc('day', ts) AS period, round(sum(value), 4) AS sum,
                 round(avg(value), 4) AS mean, count(value) AS count FROM events GROUP BY 1""")
def time_series_of_events(t):
    events = t["events"].withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return agg.time_series(events, "day", "value").withColumns({
        "sum": F.round("sum", 4), "mean": F.round("mean", 4)})


@query("""SELECT p_brand AS label, round(sum(p_retailprice), 2) AS value FROM part
          GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_groups(t):
    return agg.top_n(t["part"], "p_retailprice", "p_brand").withColumn(
        "value", F.round("value", 2))


_FLAGS = ["A", "N", "R"]


@query("SELECT l_linestatus, " + ", ".join(
    f"""coalesce(round(sum(l_quantity) FILTER (l_returnflag = '{f}'), 2), 0) AS "{f}" """
    for f in _FLAGS) + " FROM lineitem GROUP BY 1")
def cross_table(t):
    table = agg.cross_tab(t["lineitem"], "l_linestatus", "l_returnflag", "l_quantity", _FLAGS)
    return table.select("l_linestatus", *[F.round(f, 2).alias(f) for f in _FLAGS])


def _pairs_sql(table, cols):
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 3) AS correlation
            FROM {table}""" for i, a in enumerate(cols) for b in cols[i + 1:])


@query(f"""SELECT *, CASE WHEN abs(correlation) > 0.7 THEN 'strong'
                          WHEN abs(correlation) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength
           FROM ({_pairs_sql('lineitem', _LINE_MEASURES)})""")
def correlation_pairs(t):
    return agg.correlation_pairs(t["lineitem"], _LINE_MEASURES)


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS measure, " + ", ".join(
        f"round(corr({a}, {b}), 3) AS {b}" if a != b else f"1.0::DOUBLE AS {b}"
        for b in _LINE_MEASURES) + " FROM lineitem" for a in _LINE_MEASURES))
def correlation_matrix(t):
    return agg.correlation_matrix(t["lineitem"], _LINE_MEASURES)


@query("""SELECT n_name AS geo, round(sum(c_acctbal), 2) AS sum, round(avg(c_acctbal), 4) AS mean,
                 count(c_acctbal) AS count
          FROM customer JOIN nation ON c_nationkey = n_nationkey
          GROUP BY 1""")
def geo_totals(t):
    placed = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return agg.geo_aggregate(placed, "n_name", "c_acctbal").withColumns({
        "sum": F.round("sum", 2), "mean": F.round("mean", 4)})


@query("""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
          h AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 20))::BIGINT + 1, 20)
                       AS bin, count(*) AS count FROM lineitem, b GROUP BY 1),
          e AS (SELECT i AS bin, lo + (hi - lo) / 20 * (i - 1) AS bin_start,
                       lo + (hi - lo) / 20 * i AS bin_end
                FROM b, (SELECT unnest(range(1, 21)) AS i))
          SELECT e.bin, round(bin_start, 3) AS bin_start, round(bin_end, 3) AS bin_end,
                 coalesce(count, 0) AS count FROM e LEFT JOIN h ON e.bin = h.bin""")
def price_histogram(t):
    return agg.histogram(t["lineitem"], "l_extendedprice").withColumns({
        "bin_start": F.round("bin_start", 3), "bin_end": F.round("bin_end", 3)})


@query("""SELECT floor(l_quantity / 5)::BIGINT AS bin, round(sum(l_extendedprice), 2) AS value
          FROM lineitem GROUP BY 1""")
def binned_totals(t):
    binned = t["lineitem"].withColumn("quantity (bin)", F.floor(F.col("l_quantity") / 5))
    return agg.bin_aggregate(binned, "quantity (bin)", "l_extendedprice").withColumn(
        "value", F.round("value", 2))


@query(f"""WITH d AS ({LABELLED_SQL})
           SELECT toxic::BOOLEAN::VARCHAR AS value, count(*) AS count,
                  round(avg(n_chars), 4) AS avg_n_chars
           FROM d WHERE toxic IS NOT NULL GROUP BY 1""")
def flag_summary(t):
    docs = labelled_documents(t).withColumn("is_toxic", F.col("toxic").cast("boolean"))
    return agg.flag_summary(docs, "is_toxic", "n_chars")


@query("SELECT round(stddev_samp(o_totalprice), 4) AS std FROM orders")
def deviation_of_measure(t):
    return agg.deviation(t["orders"], "o_totalprice")


@query("""SELECT 'status' AS card, o_orderstatus AS label, count(*)::DOUBLE AS number,
                 round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 0) AS low,
                 NULL::DOUBLE AS high FROM orders GROUP BY 2
          UNION ALL SELECT 'measure', 'o_totalprice', round(avg(o_totalprice), 4),
                 min(o_totalprice), max(o_totalprice) FROM orders""")
def summary_cards(t):
    return agg.kpi_cards(t["orders"], "o_orderstatus", ["o_totalprice"]).withColumn(
        "number", F.round("number", 4))


def _group_means_sql(table, dims, measures):
    return " UNION ALL ".join(
        f"""SELECT '{d}' AS dim, {d}::VARCHAR AS dim_val, '{m}' AS measure,
            round(avg({m}), 4) AS value FROM {table} GROUP BY {d}"""
        for d in dims for m in measures)


@query(_group_means_sql("lineitem", ["l_returnflag", "l_linestatus"], _LINE_MEASURES))
def group_means(t):
    return agg.group_means(t["lineitem"], ["l_returnflag", "l_linestatus"], _LINE_MEASURES)


@query("""SELECT source AS source_id, sum(length(text) // 4)::BIGINT AS total_tokens
          FROM documents GROUP BY 1""")
def token_totals(t):
    from tablesense.functions.text import token_estimate
    chunks = t["documents"].select(
        F.col("source").alias("source_id"), token_estimate(F.col("text")).alias("token_count"))
    return agg.token_totals(chunks)


@query("SELECT DISTINCT p_brand FROM part")
def distinct_dimension_values(t):
    return agg.distinct_values(t["part"], "p_brand")


@query(f"""WITH m AS (SELECT avg(o_totalprice) AS v, avg(price_threshold) AS t
                      FROM ({PRICED_SQL}))
           SELECT 'o_totalprice' AS measure, 'price_threshold' AS threshold,
                  round(abs(v - t) / greatest(abs(t), 1e-9) * 100, 6) AS gap_pct FROM m""")
def mean_gap_to_threshold(t):
    # priority means weigh in with their row counts, so both means agree up to rounding;
    # the side of a zero gap is left out
    return agg.mean_gap(priced_orders(t), [("o_totalprice", "price_threshold")]).select(
        "measure", "threshold", F.round("gap_pct", 6).alias("gap_pct"))
