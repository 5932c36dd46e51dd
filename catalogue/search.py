"""Fact documents and TF-IDF search over whole texts."""

from pyspark.sql import functions as F

from catalogue.tables import query
from tablesense.functions import words
from tablesense.operators import factsearch
from tablesense.operators.roles import table_roles

_STOP = ", ".join(f"'{w}'" for w in words.STOP_WORDS)


def _tf_sql(table, key, grams):
    """Terms of every text, stop words out, single words or single words and pairs."""
    kept = (f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
            f"lambda w: w NOT IN ({_STOP}))")
    all_grams = kept if grams == 1 else (
        f"list_concat(k, [k[i] || ' ' || k[i + 1] FOR i IN range(1, len(k))])")
    source = f"SELECT {key} AS id, {kept} AS k FROM {table}"
    terms = "k" if grams == 1 else all_grams
    return f"""SELECT id, term, count(*) AS tf
               FROM (SELECT id, unnest({terms}) AS term FROM ({source})) GROUP BY 1, 2"""


def _index_sql(table, key, grams):
    return f"""
      tf AS ({_tf_sql(table, key, grams)}),
      terms AS (SELECT term, ln((1 + (SELECT count(*) FROM {table})) / (1 + count(*))) + 1 AS idf
                FROM tf GROUP BY term),
      w AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN terms USING (term)),
      postings AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight
                   FROM w)"""


@query(f"""WITH {_index_sql('documents', 'doc_id', 1)}
           SELECT id AS doc_id, count(*) AS n_terms, round(sum(weight), 6) AS total,
                  round(max(weight), 6) AS top FROM postings GROUP BY 1""")
def fact_index_words(t):
    postings, _ = factsearch.build_index(t["documents"], ngrams=1)
    return _summary(postings, "doc_id")


@query(f"""WITH {_index_sql('conversations', "conv_id || '-' || turn", 2)}
           SELECT id AS doc_id, count(*) AS n_terms, round(sum(weight), 6) AS total,
                  round(max(weight), 6) AS top FROM postings GROUP BY 1""")
def fact_index_pairs(t):
    turns = t["conversations"].select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    postings, _ = factsearch.build_index(turns)
    return _summary(postings, "doc_id")


def _summary(postings, key):
    return postings.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("total"),
        F.round(F.max("weight"), 6).alias("top"))


@query(f"""WITH {_index_sql('documents', 'doc_id', 1)},
           q AS ({_tf_sql('benchmark', 'item_id', 1)}),
           qw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM q JOIN terms USING (term)),
           qn AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM qw),
           s AS (SELECT qn.id AS question_id, p.id AS doc_id, sum(weight * w) AS score
                 FROM postings p JOIN qn ON p.term = qn.term GROUP BY 1, 2),
           r AS (SELECT *, row_number() OVER (PARTITION BY question_id
                                              ORDER BY round(score, 9) DESC, doc_id) AS rank
                 FROM s WHERE score > 0.05)
           SELECT question_id, rank, doc_id, round(score, 3) AS score FROM r WHERE rank <= 5""")
def fact_search(t):
    index = factsearch.build_index(t["documents"], ngrams=1)
    asked = t["benchmark"].select(F.col("item_id").alias("question_id"),
                                  F.col("text").alias("question"))
    found = factsearch.search(index, asked, 5, ngrams=1)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT 'column' AS kind, 6::BIGINT AS n
          UNION ALL SELECT 'fact', 3 * count(DISTINCT o_orderpriority) FROM orders
          UNION ALL SELECT 'status', count(DISTINCT o_orderstatus) FROM orders
          UNION ALL SELECT 'top_row', 9 UNION ALL SELECT 'trend', 3""")
def fact_documents(t):
    orders = t["orders"]
    facts = factsearch.fact_documents(
        orders, table_roles(orders, "semantic", "orders"), ["o_orderkey"], "month")
    return facts.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
