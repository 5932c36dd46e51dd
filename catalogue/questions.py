"""Questions over whole tables: intents, columns, answers, routing, suggestions."""

from pyspark.sql import functions as F

from catalogue.tables import MONTHLY_SQL, monthly_kpis, query
from tablesense.functions import words
from tablesense.operators import ask, factsearch, profile as prof, structure
from tablesense.operators.roles import profile_roles, read_roles, partner_columns
from tablesense.plans.onboard import onboard

# A question per order, worded by its priority; the top-n questions take their n from it.
_QUESTIONS_SQL = """
  SELECT o_orderkey AS question_id, CASE o_orderpriority
    WHEN '1-URGENT' THEN 'Which are the top ' || (1 + o_custkey % 9) || ' orders by o_totalprice?'
    WHEN '2-HIGH' THEN 'What is the average o_totalprice per o_orderstatus?'
    WHEN '3-MEDIUM' THEN 'Show the o_orderpriority breakdown'
    WHEN '4-NOT SPECIFIED' THEN 'How many orders are there?'
    ELSE 'Total o_totalprice please' END AS question FROM orders"""


def _questions(t):
    p = F.col("o_orderpriority")
    return t["orders"].select(
        F.lit("orders").alias("source_id"), F.col("o_orderkey").alias("question_id"),
        F.when(p == "1-URGENT", F.format_string("Which are the top %d orders by o_totalprice?",
                                                1 + F.col("o_custkey") % 9))
        .when(p == "2-HIGH", "What is the average o_totalprice per o_orderstatus?")
        .when(p == "3-MEDIUM", "Show the o_orderpriority breakdown")
        .when(p == "4-NOT SPECIFIED", "How many orders are there?")
        .otherwise("Total o_totalprice please").alias("question"))


def _intent_sql(text, prefix):
    import re

    def begins(keys):
        alternatives = "|".join(
            "(?:^|[^a-z0-9])" + re.escape(k)
            + ("(?:$|[^a-z0-9])" if k in words.WHOLE_WORD_INTENTS else "") for k in keys)
        return f"regexp_matches(lower({text}), '{alternatives}')"

    changes = [*dict(words.INTENT_WORDS)["variance"], "vs"]
    cases = [f"WHEN contains(lower({text}), 'previous') AND {begins(changes)} THEN 'variance'"
             ] if prefix else []
    for intent, keys in words.INTENT_WORDS:
        cond = begins(keys) if prefix else " OR ".join(
            f"contains(lower({text}), '{k}')" for k in keys)
        cases.append(f"WHEN {cond} THEN '{intent}'")
    return f"CASE {' '.join(cases)} ELSE 'summary' END"


@query(f"""SELECT conv_id, turn, {_intent_sql('text', False)} AS intent FROM conversations
           WHERE role = 'user'""")
def question_intents_by_substring(t):
    asked = t["conversations"].where(F.col("role") == "user")
    return asked.select("conv_id", "turn",
                        ask.classify_intent(F.col("text"), "substring").alias("intent"))


@query(f"SELECT doc_id, {_intent_sql('text', True)} AS intent FROM documents")
def question_intents(t):
    return t["documents"].select("doc_id", ask.classify_intent(F.col("text")).alias("intent"))


@query(r"""SELECT doc_id, coalesce(TRY_CAST(regexp_extract(text,
             '(?:^|[^\p{L}\p{N}_])(\d+)(?:$|[^\p{L}\p{N}_])', 1) AS INTEGER), 5) AS n
           FROM documents""")
def numbers_in_questions(t):
    return t["documents"].select("doc_id", ask.extract_n(F.col("text"), 5).alias("n"))


@query(f"""SELECT question_id, CASE WHEN contains(question, 'top') THEN 'highest'
                  WHEN contains(question, 'average') THEN 'average'
                  WHEN contains(question, 'breakdown') THEN 'distribution'
                  ELSE 'count_sum' END AS intent,
                  CASE WHEN contains(question, 'top')
                       THEN CAST(regexp_extract(question, '\\d+') AS INTEGER) ELSE 5 END AS n,
                  'o_totalprice' AS measure,
                  CASE WHEN contains(question, 'o_orderstatus') THEN 'o_orderstatus'
                       ELSE 'o_orderpriority' END AS dim
           FROM ({_QUESTIONS_SQL})""")
def resolved_questions(t):
    described = profile_roles(prof.profile_columns(t["orders"], "orders"))
    return ask.resolve_questions(_questions(t), described).select(
        "question_id", "intent", "n", "measure", "dim")


def _known(t):
    return onboard(t["orders"], "orders", order_by=["o_orderdate", "o_orderkey"],
                   grain="month", normalised=True)


def _answers(t):
    return _known(t).answer(_questions(t).drop("source_id"))


_ANSWERS_SQL = f"""
  WITH q AS ({_QUESTIONS_SQL}), top AS (
    SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey::VARCHAR
                              || '/' || o_custkey) AS row_no, o_orderpriority AS label,
           'o_totalprice' AS series, o_totalprice AS value FROM orders),
  best AS (SELECT * FROM top WHERE row_no <= 9),
  mean AS (SELECT row_number() OVER (ORDER BY o_orderstatus) AS row_no, o_orderstatus AS label,
                  'avg_o_totalprice' AS series, round(avg(o_totalprice), 4) AS value
           FROM orders GROUP BY o_orderstatus),
  spread AS (SELECT row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS row_no,
                    o_orderpriority AS label, 'count' AS series, count(*)::DOUBLE AS value
             FROM orders GROUP BY o_orderpriority),
  states AS (SELECT row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS row_no,
                    o_orderstatus AS label, 'count' AS series, count(*)::DOUBLE AS value
             FROM orders GROUP BY o_orderstatus)
  SELECT question_id, 'highest' AS intent, row_no, label, series, value FROM q JOIN best
    ON contains(question, 'top') AND row_no <= CAST(regexp_extract(question, '\\d+') AS INTEGER)
  UNION ALL SELECT question_id, 'average', row_no, label, series, value FROM q JOIN mean
    ON contains(question, 'average')
  UNION ALL SELECT question_id, 'distribution', row_no, label, series, value FROM q JOIN spread
    ON contains(question, 'breakdown')
  UNION ALL SELECT question_id, 'count_sum', row_no, label, series, value FROM q JOIN states
    ON contains(question, 'How many')
  UNION ALL SELECT question_id, 'count_sum', 1, 'o_totalprice', 'total',
    round((SELECT sum(o_totalprice) FROM orders), 2) FROM q WHERE contains(question, 'Total')"""


@query(_ANSWERS_SQL)
def answered_questions(t):
    return _answers(t).select(
        "question_id", "intent", F.col("row_no").cast("long").alias("row_no"), "label",
        "series", F.round("value", 4).alias("value"))


@query(f"""SELECT question_id, 1 AS tier, 'DIRECT' AS tier_label, 1.0::DOUBLE AS confidence,
                  CASE WHEN contains(question, 'top')
                       THEN CAST(regexp_extract(question, '\\d+') AS INTEGER)
                       WHEN contains(question, 'average') OR contains(question, 'How many') THEN 3
                       WHEN contains(question, 'breakdown') THEN 5 ELSE 1 END::BIGINT AS row_count
           FROM ({_QUESTIONS_SQL})""")
def routed_questions(t):
    known = _known(t)
    facts = known.facts()
    replies = ask.replies(known.answer(_questions(t).drop("source_id")))
    hits = factsearch.search(factsearch.build_index(facts), _questions(t), 6)
    routed = ask.route(replies, hits, facts)
    return routed.join(replies.select("question_id", "row_count"), "question_id").select(
        "question_id", "tier", "tier_label", "confidence", "row_count")


@query("""SELECT p_brand AS label, 'p_size' AS series, p_size::DOUBLE AS value FROM part
          UNION ALL SELECT p_brand, 'p_retailprice', p_retailprice FROM part""")
def chart_series(t):
    return ask.chart_series(t["part"], "p_brand", ["p_size", "p_retailprice"])


@query("""SELECT 'kpis' AS source_id, rank, question FROM (SELECT unnest([
            'Which KRIs are currently breaching their threshold?',
            'How many KRIs have exceeded their limits?',
            'Which records have current_value below red_threshold?',
            'Show all items where rag_status is Red.',
            'Which kri_name has the most Red / Fail statuses?',
            'Compare current_value and red_threshold trends over report_month.',
            'Which KRIs are in breach?', 'Are there any chronic Red KRIs?']) AS question,
            unnest(range(1, 9)) AS rank)""")
def suggested_questions(t):
    months = monthly_kpis(t)
    rows = partner_columns(profile_roles(prof.profile_columns(months, "kpis")))
    kpis = structure.kpi_patterns(months, read_roles(rows)).withColumn(
        "source_id", F.lit("kpis"))
    context = ask.question_context(rows, kpis, kinds=structure.dashboard_type(rows))
    return ask.generate_questions(context).withColumn("rank", F.col("rank").cast("long"))


@query()
def supplemented_questions(t):
    known = onboard(t["orders"], "orders", grain="month", normalised=True)
    offered = ask.generate_questions(ask.question_context(profile_roles(known.profile)))
    return ask.supplement_questions(offered, known.anomalies, known.temporal)


@query()
def fact_replies(t):
    facts = _known(t).facts()
    hits = factsearch.search(factsearch.build_index(facts), _questions(t), 6)
    return ask.fact_replies(_questions(t).select("question_id", "question"), hits, facts)


# One question of each kind that rows answer, for every month of the derived table.
_ROW_QUESTIONS = ["Which KRIs are in breach?", "Show all Red or Green status items",
                  "Show outliers in current_value", "What changed vs previous period?"]


@query(f"""
  WITH m AS ({MONTHLY_SQL}),
  f AS (SELECT quantile_cont(current_value, 0.25) AS q1, quantile_cont(current_value, 0.75) AS q3 FROM m),
  side AS (SELECT avg(current_value) < avg(red_threshold) AS below FROM m),
  hit AS (
    SELECT 'breach' AS intent, 'current_value' AS series, m.*, NULL::DOUBLE AS delta,
           NULL::DOUBLE AS pct_change FROM m, side
    WHERE CASE WHEN below THEN current_value < red_threshold ELSE current_value > red_threshold END
    UNION ALL SELECT 'rag_filter', w, m.*, NULL, NULL FROM m,
      (SELECT CASE WHEN count(*) FILTER (rag_status = 'Red') > 0 THEN 'red' ELSE 'green' END AS w FROM m)
      WHERE contains(lower(rag_status), w)
    UNION ALL SELECT 'outliers', 'current_value', m.*, NULL, NULL FROM m, f
      WHERE current_value < q1 - 1.5 * (q3 - q1) OR current_value > q3 + 1.5 * (q3 - q1)
    UNION ALL SELECT 'variance', 'current_value', m.*, round(current_value - previous_value, 4),
      round((current_value - previous_value) / abs(previous_value) * 100, 2) FROM m)
  SELECT intent, series, row_number() OVER (PARTITION BY intent, series ORDER BY
           pct_change NULLS LAST, report_month, kri_name) AS row_no, kri_name, report_month,
         current_value, rag_status, round(delta, 2) AS delta, pct_change FROM hit""")
def answer_rows(t):
    known = onboard(monthly_kpis(t), "kpis", order_by=["report_month", "kri_name"],
                    grain="month", normalised=True)
    asked = t.spark.createDataFrame(list(enumerate(_ROW_QUESTIONS)),
                                    "question_id int, question string")
    _, rows = known.answer_rows(asked)
    return rows.select("intent", "series", "row_no", "row.kri_name", "row.report_month",
                       "row.current_value", "row.rag_status", F.round("delta", 2).alias("delta"),
                       "pct_change")
