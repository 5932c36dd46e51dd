"""Facts about a table as short documents, and TF-IDF search over any documents."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tablesense.functions import words
from tablesense.functions.text import format_fact, spaced, words as tokens
from tablesense.operators import aggregate, ordered
from tablesense.operators.roles import TableRoles
from tablesense.session import stored


def fact_documents(df: DataFrame, roles: TableRoles, tie_break=(), grain=None) -> DataFrame:
    """Everything worth finding in a table, one text per fact.

    Columns, group means, status shares, best rows and trends are built as separate
    aggregates and stacked.  `tie_break` orders rows with equal values.
    """
    dims = roles.names("dimension", "geo", "geographic")
    meas = roles.names("measure", "threshold")
    parts = []
    rows = [F.struct(
        F.lit("column").alias("kind"), F.lit(r["column"]).alias("dim"),
        F.lit(f"{r['column']} {spaced(r['column']).replace('-', ' ')}").alias("text"))
        for r in roles.rows]
    parts.append(df.sparkSession.range(1).select(F.inline(F.array(*rows))))
    if dims and meas:
        means = aggregate.group_means(df, dims, meas)
        parts.append(means.select(
            F.lit("fact").alias("kind"), "dim", "dim_val", "measure", "value",
            F.concat_ws(" ", "dim", "dim_val", "measure", format_fact(F.col("value")),
                        F.lit("average"), F.translate("dim", "_", " "), F.lower("dim_val"))
            .alias("text")))
    for status in roles.statuses:
        shares = aggregate.distribution(df, status, of="rows")
        parts.append(shares.select(
            F.lit("status").alias("kind"), F.lit(status).alias("dim"),
            F.col("value").alias("dim_val"), F.col("count").cast("double").alias("value"),
            F.col("pct"),
            F.concat_ws(" ", F.lit(status), "value", F.col("count").cast("string"),
                        F.lit("items"), F.col("pct").cast("string"),
                        F.lit("percent status"), F.lower("value"), F.lit("count"))
            .alias("text")))
    if meas:
        best = ordered.top_rows(df, meas, dims, tie_break=tie_break)
        dim_text = [x for d in dims
                    for x in (F.lit(d), F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("")))]
        parts.append(best.select(
            F.lit("top_row").alias("kind"), "measure", "value",
            F.col("place").cast("string").alias("dim_val"),
            F.concat_ws(" ", F.lit("top highest maximum"), "measure",
                        format_fact(F.col("value")), *dim_text).alias("text")))
    if roles.times and meas:
        trends = ordered.temporal_patterns(df, roles.times[0], meas, grain)
        word = F.when(F.col("pct_change") > 0, "increasing").otherwise("decreasing")
        parts.append(trends.select(
            F.lit("trend").alias("kind"), F.col("time_col").alias("dim"),
            F.col("measure_col").alias("measure"), F.col("pct_change").alias("pct"),
            word.alias("dim_val"),
            F.concat_ws(" ", F.lit("trend"), "measure_col", F.lit("over time"), "time_col", word,
                        F.format_string("%+.1f", "pct_change"), F.lit("percent change period"),
                        "max_period").alias("text")))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    kinds = {"kind": "string", "dim": "string", "dim_val": "string", "measure": "string",
             "value": "double", "pct": "double", "text": "string"}
    facts = stacked.select(*[
        (F.col(c) if c in stacked.columns else F.lit(None)).cast(k).alias(c)
        for c, k in kinds.items()])
    key = F.concat_ws("|", "kind", "dim", "dim_val", "measure")
    return facts.withColumn("doc_id", F.substring(F.md5(key), 1, 12))


def _terms(docs: DataFrame, id_col: str, text_col: str, ngrams: int, stop_words) -> DataFrame:
    """(id, term, tf) with stop words removed before n-grams are formed.

    Texts are dealt out by document before they are unfolded: a text is smaller than its
    terms, and the counting of a document's terms then moves nothing more.
    """
    docs = docs.select(id_col, text_col).repartition(id_col)
    if ngrams == 1:
        # the stop words are dropped after unfolding, in compiled code
        found = docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term"))
        if stop_words:
            found = found.where(~F.col("term").isin(list(stop_words)))
        return found.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    kept = F.filter(tokens(F.col(text_col)),
                    lambda w: ~w.isin(list(stop_words)) if stop_words else F.lit(True))
    words_of = docs.select(id_col, kept.alias("_w"))
    grams = F.col("_w")
    for n in range(2, ngrams + 1):
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - (n - 1)))
        runs = F.transform(F.coalesce(starts, F.array().cast("array<int>")),
                           lambda i: F.array_join(F.slice(F.col("_w"), i, n), " "))
        grams = F.concat(grams, runs)
    exploded = words_of.select(id_col, F.explode(grams).alias("term"))
    return exploded.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def build_index(docs: DataFrame, id_col="doc_id", text_col="text", ngrams=2,
                max_terms=None, stop_words=tuple(words.STOP_WORDS)):
    """Postings (id, term, weight) and terms (term, idf) of an L2-normalised TF-IDF
    index: weight (1 + ln tf) · (ln((1+n)/(1+df)) + 1).

    All terms are indexed, or the `max_terms` most frequent ones where the caller asks for
    it. Texts are tokenised once, their counted terms stored.
    """
    counts = stored(_terms(docs, id_col, text_col, ngrams, stop_words), "terms")
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    found = counts.groupBy("term").agg(
        F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    if max_terms is not None:
        found = found.orderBy(F.desc("total"), "term").limit(max_terms)
    terms = found.select("term", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))
    # One row per term and per document is looked up; the many rows beside it need no sort.
    weighted = stored(counts.join(terms.hint("shuffle_hash"), "term").select(
        id_col, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w")), "weights")
    # A length for each document: less to move and to sort than all its terms.
    lengths = weighted.groupBy(F.col(id_col).alias("_of")).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_length"))
    return weighted.join(lengths.hint("shuffle_hash"), weighted[id_col].eqNullSafe(
        lengths["_of"])).select(
        id_col, "term", (F.col("w") / F.col("_length")).alias("weight")), terms


def _scaled(key: str):
    """Weights over their length; a window holds the terms of one text."""
    return F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))


def search(index, questions: DataFrame, k=5, id_col="doc_id", question_id="question_id",
           question_text="question", ngrams=2, stop_words=tuple(words.STOP_WORDS),
           min_score=words.SEARCH_MIN_SCORE) -> DataFrame:
    """The k best documents per question row by cosine, scores above `min_score`.

    Equal texts are asked once. Postings meet question terms in an equi-join on the term;
    products are summed per (text, document) before ranking, and each task ranks its own
    part first.
    """
    postings, terms = index
    named = questions.withColumn("_asked", F.sha2(question_text, 256))
    texts = named.select("_asked", F.col(question_text).alias("_text")).where(
        F.col("_asked").isNotNull()).distinct()
    asked = _terms(texts, "_asked", "_text", ngrams, stop_words).join(terms, "term").select(
        "_asked", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w")).select(
        "_asked", "term", _scaled("_asked").alias("qw"))
    scores = postings.join(asked, "term").groupBy("_asked", id_col).agg(
        F.sum(F.col("weight") * F.col("qw")).alias("score")
    ).where(F.col("score") > min_score)
    best = Window.partitionBy("_asked").orderBy(F.desc(F.round("score", 9)), id_col)
    ranked = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return named.select(question_id, "_asked").join(ranked, "_asked").select(
        question_id, "rank", id_col, F.round("score", 3).alias("score"))
