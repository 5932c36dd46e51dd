"""Questions: intent, columns, operator, answer rows; many questions in one run."""

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesense.functions import words
from tablesense.functions.periods import period_order
from tablesense.functions.text import has_any
from tablesense.operators import aggregate, ordered, select
from tablesense.operators.indexing import dense_index
from tablesense.operators.roles import TableRoles


# --- reading a question ---------------------------------------------------------------

def _bound_to(value: Column, expression) -> Column:
    """`expression(value)` with the value computed once per row, however often used."""
    return F.get(F.transform(F.array(value), expression), F.lit(0))


def _spaced_words(question: Column) -> Column:
    """The words of a question in lower case, each between single blanks."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(question), "[^a-z0-9]+", " "),
                    F.lit(" "))


def _begins_word(text: Column, keys) -> Column:
    """True when a word of the text begins with (a short key: is) one of the keys."""
    return has_any(text, [f" {w} " if w in words.WHOLE_WORD_INTENTS else f" {w}" for w in keys])


def classify_intent(question: Column, mode="prefix") -> Column:
    """The intent of a question; the first list with a hit wins, else `summary`.

    `mode="substring"` takes words anywhere, as the catalogue's spec does.  `"prefix"`
    asks them to begin a word (short ones to be a word), and puts variance before trend
    when a previous period is mentioned.
    """
    prefix = mode == "prefix"
    hit = _begins_word if prefix else has_any

    def choose(text):
        found = None
        if prefix:
            changes = dict(words.INTENT_WORDS)["variance"] + ["vs"]
            found = F.when(text.contains("previous") & hit(text, changes), "variance")
        for intent, keys in words.INTENT_WORDS:
            found = (F.when(hit(text, keys), intent) if found is None
                     else found.when(hit(text, keys), intent))
        return found.otherwise("summary")

    return _bound_to(_spaced_words(question) if prefix else F.lower(question), choose)


def extract_n(question: Column, default) -> Column:
    """The first whole number in the question."""
    number = F.regexp_extract(question, r"(?<![\p{L}\p{N}_])(\d+)(?![\p{L}\p{N}_])", 1)
    return F.coalesce(number.try_cast("int"), F.lit(default) if isinstance(default, int)
                      else default)


def resolve_column(question: Column, names: Column) -> Column:
    """The first of `names` (an array) that the question mentions, else the first one."""
    low = F.lower(question)
    mentioned = F.filter(names, lambda n: low.contains(F.lower(n)))
    return F.coalesce(F.get(mentioned, F.lit(0)), F.get(names, F.lit(0)))


def resolve_questions(questions: DataFrame, roles: DataFrame, mode="prefix") -> DataFrame:
    """Intent, n, measure and dimension of every question of a catalogue of sources.

    `questions` has (source_id, question_id, question); `roles` has the profile-role
    rows of all sources.  Groupable columns are dimensions, then status columns.
    """
    listed = lambda cond: F.sort_array(F.collect_list(
        F.when(cond, F.struct("position", "column")))).column
    is_role = lambda r: F.col("role") == r
    per_source = roles.groupBy("source_id").agg(
        listed(is_role("measure")).alias("_measures"),
        F.concat(listed(is_role("dimension")), listed(is_role("status"))).alias("_dims"),
        listed(is_role("time")).alias("_times"), listed(is_role("status")).alias("_statuses"))
    q = F.col("question")
    classified = questions.withColumn("intent", classify_intent(q, mode))
    return classified.join(per_source, "source_id", "left").select(
        "source_id", "question_id", "question", "intent",
        extract_n(q, F.when(F.col("intent") == "ranking", 10).otherwise(5)).alias("n"),
        resolve_column(q, F.col("_measures")).alias("measure"),
        resolve_column(q, F.col("_dims")).alias("dim"),
        F.get("_times", F.lit(0)).alias("time_col"),
        F.get("_statuses", F.lit(0)).alias("status_col"))


# --- operators by intent --------------------------------------------------------------

@dataclass(frozen=True)
class Ask:
    """One distinct combination of operator and columns, whatever questions share it."""

    intent: str
    measure: str | None
    dim: str | None
    detail: str
    n: int


def _rows(df: DataFrame, label, value, series="value", rank=None, tie=None) -> DataFrame:
    """Tidy (label, series, value) rows with their order: `_rank` (a column, least first,
    nulls last), then `_tie` (the label unless given), then the series."""
    label = label.cast("string")
    return df.select(
        label.alias("label"),
        (F.lit(series) if isinstance(series, str) else series.cast("string")).alias("series"),
        value.cast("double").alias("value"),
        (F.lit(0.0) if rank is None else rank.cast("double")).alias("_rank"),
        (label if tie is None else tie).alias("_tie"))


def _threshold_pairs(roles: TableRoles):
    return [(r["column"], r["threshold_partner"]) for r in roles.rows if r["threshold_partner"]]


def answer_breach(df, roles, ask):
    pairs = _threshold_pairs(roles)
    status = roles.statuses[0] if roles.statuses else None
    if not pairs and status is None:
        return None
    hits = select.breaches(df, pairs, status)
    return _rows(hits.groupBy("kpi").agg(F.count(F.lit(1)).alias("c")), F.col("kpi"),
                 F.col("c"), "breaches")


def answer_rag(df, roles, ask):
    if not roles.statuses:
        return None
    status = roles.statuses[0]
    hits = select.rag_rows(df, status, ask.detail)
    counted = hits.groupBy(status).agg(F.count(F.lit(1)).alias("c"))
    shares = aggregate.distribution(df, status, of="rows")
    matched = _rows(counted, F.col(status), F.col("c"), "matching")
    # with no status word found in the data the answer is the distribution
    none = counted.agg(F.count(F.lit(1)) == 0).scalar()
    spread = _rows(shares, F.col("value"), F.col("count"), "count", -F.col("count"))
    return matched.unionByName(spread.where(none))


def answer_trend(df, roles, ask):
    if not roles.times or ask.measure is None:
        return None
    time = roles.times[0]
    if ask.dim:
        means = df.dropna(subset=[time, ask.dim, ask.measure]).groupBy(time, ask.dim).agg(
            F.avg(ask.measure).alias("m"))
        return _rows(means, F.col(time), F.col("m"), F.col(ask.dim), period_order(df, time))
    return _rows(aggregate.trend(df, time, ask.measure), F.col(time), F.col("mean"), ask.measure,
                 period_order(df, time))


def _extreme(df, roles, ask, highest):
    if ask.measure is None:
        return None
    keys = roles.names("id") or [c for c in df.columns if c != ask.measure]
    pick = ordered.highest if highest else ordered.lowest
    tied = F.concat_ws("/", *[F.col(f"`{k}`").cast("string") for k in keys])
    # rows are picked and numbered in one order, ties included
    rows = pick(df.withColumn("_tied", tied), ask.measure, ask.n, ["_tied"])
    label = F.col(f"`{roles.dimensions[0]}`") if roles.dimensions else F.col("_tied")
    value = F.col(f"`{ask.measure}`").cast("double")
    return _rows(rows, label, value, ask.measure, -value if highest else value, F.col("_tied"))


def answer_highest(df, roles, ask):
    return _extreme(df, roles, ask, True)


def answer_ranking(df, roles, ask):
    """The best rows of the measure, or without one the first rows by their keys."""
    if ask.measure is not None:
        return _extreme(df, roles, ask, True)
    keys = roles.names("id") or list(df.columns)
    tied = F.concat_ws("/", *[F.col(f"`{k}`").cast("string") for k in keys])
    rows = ordered.ranking(df.withColumn("_tied", tied), None, ask.n, ["_tied"])
    return _rows(rows, F.col("_tied"), F.lit(None), "row")


def answer_lowest(df, roles, ask):
    return _extreme(df, roles, ask, False)


def answer_average(df, roles, ask):
    if ask.measure is None:
        return None
    if ask.dim is None:
        return _rows(aggregate.averages(df, [ask.measure]), F.col("measure"),
                     F.col("average"), "average")
    means = aggregate.average_by(df, ask.dim, [ask.measure])
    return _rows(means, F.col(ask.dim), F.col(f"avg_{ask.measure}"), f"avg_{ask.measure}")


def answer_count_sum(df, roles, ask):
    if ask.detail == "count" and roles.statuses:
        column = roles.statuses[0]
    elif ask.detail == "sum" and ask.measure:
        return _rows(aggregate.total(df, ask.measure), F.lit(ask.measure), F.col("total"),
                     "total")
    elif ask.dim:
        column = ask.dim
    else:
        return _rows(aggregate.count_rows(df), F.lit("rows"), F.col("count"), "count")
    return _rows(aggregate.count_by(df, column), F.col(column), F.col("count"), "count",
                 -F.col("count"))


def answer_variance(df, roles, ask):
    pairs = [(r["column"], r["previous_partner"]) for r in roles.rows if r["previous_partner"]]
    if pairs:
        changes = ordered.variance_summary(df, *pairs[0])
        tall = changes.select(F.inline(F.array(
            F.struct(F.lit("mean delta").alias("l"), F.col("mean_delta").alias("v")),
            F.struct(F.lit("mean % change").alias("l"), F.col("mean_pct_chg").alias("v")))))
        return _rows(tall, F.col("l"), F.col("v"), pairs[0][0])
    if ask.measure is None:
        return None
    return _rows(aggregate.deviation(df, ask.measure), F.lit(ask.measure), F.col("std"), "std")


def answer_distribution(df, roles, ask):
    column = roles.statuses[0] if ask.detail == "status" and roles.statuses else ask.dim
    if column is None:
        return answer_summary(df, roles, ask)
    shares = aggregate.distribution(df, column, of="rows")
    return _rows(shares, F.col("value"), F.col("count"), "count", -F.col("count"))


def answer_compare(df, roles, ask):
    if ask.dim is None or ask.measure is None:
        return None
    return answer_average(df, roles, ask)


def answer_outliers(df, roles, ask):
    if ask.measure is None:
        return None
    hits = select.iqr_outliers(df, ask.measure).agg(F.count(F.lit(1)).alias("c"))
    return _rows(hits, F.lit(ask.measure), F.col("c"), "outliers")


def answer_correlation(df, roles, ask):
    if len(roles.measures) < 2:
        return None
    pairs = aggregate.correlation_pairs(df, roles.measures)
    return _rows(pairs, F.concat("col_a", F.lit("↔"), "col_b"), F.col("correlation"),
                 "correlation", -F.abs("correlation"))


def answer_summary(df, roles, ask):
    status = roles.statuses[0] if roles.statuses else None
    if status is None and not roles.measures:
        return _rows(aggregate.count_rows(df), F.lit("rows"), F.col("count"), "count")
    cards = aggregate.kpi_cards(df, status, roles.measures)
    return _rows(cards, F.col("label"), F.col("number"), F.col("card"))


# An application adds an intent by adding an entry.
HANDLERS = {
    "breach": answer_breach, "rag_filter": answer_rag, "trend": answer_trend,
    "highest": answer_highest, "lowest": answer_lowest, "average": answer_average,
    "count_sum": answer_count_sum, "variance": answer_variance,
    "distribution": answer_distribution, "compare": answer_compare,
    "ranking": answer_ranking, "outliers": answer_outliers,
    "correlation": answer_correlation, "summary": answer_summary,
}
# fixed values: chart shape per intent, and confidence where it is not 1
CHARTS = {
    "breach": "table", "rag_filter": "table", "trend": "line", "highest": "bar",
    "lowest": "bar", "average": "bar", "count_sum": "bar", "variance": "bar",
    "distribution": "doughnut", "compare": "bar", "ranking": "bar", "outliers": "table",
    "correlation": "table", "summary": "kpi",
}
MISSING_CONFIDENCE = {"rag_filter": 0.5, "variance": 0.3}
NO_COLUMN_CONFIDENCE = 0.4
UNRANKED_CONFIDENCE = 0.7  # a ranking without a measure
FAILED_CONFIDENCE = 0.3


def _detail(low: Column) -> Column:
    """What a handler needs beyond columns: the status words asked for, or count / sum."""
    asked = F.concat_ws(" ", *[F.when(low.contains(w), F.lit(w))
                               for w in words.RAG_QUESTION_WORDS])
    counts = F.when(low.contains("how many") | low.contains("count"), "count").when(
        low.contains("sum") | low.contains("total"), "sum").otherwise("")
    return (
        F.when(F.col("intent") == "rag_filter", asked)
        .when(F.col("intent") == "count_sum", counts)
        .when((F.col("intent") == "distribution") & low.contains("status"), "status")
        .otherwise(""))


_UNUSED = {  # columns an intent does not look at, so that equal work is done once
    "measure": ("breach", "rag_filter", "distribution", "correlation", "summary"),
    "dim": ("breach", "rag_filter", "highest", "lowest", "ranking", "variance", "outliers",
            "correlation", "summary"),
}
_RANKED = ("highest", "lowest", "ranking")


def plan_questions(resolved: DataFrame) -> DataFrame:
    """Add the combination each question needs; equal combinations share one run."""
    drop = lambda c: F.when(~F.col("intent").isin(list(_UNUSED[c])), F.col(c))
    return resolved.select(
        "question_id", "question", "intent",
        drop("measure").alias("measure"), drop("dim").alias("dim"),
        _detail(F.lower("question")).alias("detail"),
        F.when(F.col("intent").isin(list(_RANKED)), F.col("n")).alias("n"))


def answer_questions(df: DataFrame, roles: TableRoles, resolved: DataFrame) -> DataFrame:
    """Answer rows for many questions on one table.

    Only the distinct combinations come to the driver; their number is bounded by
    intents × columns, whatever the number of questions.  Each runs once, with the
    largest n asked for, and its rows are joined back to the questions.  The rows of all
    are numbered together in one distributed sort.  A handler that cannot be planned
    costs its own answer only.
    """
    planned = plan_questions(resolved)
    keys = ["intent", "measure", "dim", "detail"]
    combos = planned.groupBy(*keys).agg(F.max("n").alias("n")).orderBy(*keys).collect()
    parts = []
    for i, c in enumerate(combos):
        ask = Ask(c["intent"], c["measure"], c["dim"], c["detail"], c["n"] or 0)
        missing = MISSING_CONFIDENCE.get(ask.intent, NO_COLUMN_CONFIDENCE)
        try:
            rows = HANDLERS[ask.intent](df, roles, ask)
        except (PySparkException, LookupError, ValueError):
            rows, missing = None, FAILED_CONFIDENCE
        confidence = 1.0
        if rows is None:
            confidence = missing
            rows = df.sparkSession.range(1).select(
                F.lit(None).cast("string").alias("label"),
                F.lit(None).cast("string").alias("series"),
                F.lit(None).cast("double").alias("value"), F.lit(0.0).alias("_rank"),
                F.lit("").alias("_tie"))
        elif ask.intent == "ranking" and ask.measure is None:
            confidence = UNRANKED_CONFIDENCE
        elif ask.intent == "variance" and not any(r["previous_partner"] for r in roles.rows):
            confidence = 0.7
        parts.append(rows.select(
            F.lit(i).alias("_combo"), *[F.lit(v).cast("string").alias(f"_{k}") for k, v in
              zip(keys, (ask.intent, ask.measure, ask.dim, ask.detail))],
            F.lit(confidence).alias("confidence"), "label", "series", "value", "_rank", "_tie"))
    if not parts:
        raise ValueError("no questions to answer")
    answers = parts[0]
    for part in parts[1:]:
        answers = answers.unionByName(part)
    answers = dense_index(answers, [F.asc_nulls_last("_rank"), "_tie", "series"], ["_combo"]
                          ).withColumn("row_no", F.col("row_no") + 1)
    on = None
    for k in keys:
        same = planned[k].eqNullSafe(answers[f"_{k}"])
        on = same if on is None else on & same
    charts = F.create_map(*[F.lit(x) for kv in CHARTS.items() for x in kv])
    return planned.join(answers, on).where(
        F.col("n").isNull() | (F.col("row_no") <= F.col("n"))
    ).select("question_id", "question", "intent", "confidence",
             F.element_at(charts, F.col("intent")).alias("chart_type"),
             "row_no", "label", "series", "value")


def replies(answers: DataFrame) -> DataFrame:
    """One reply per question: its first five rows as text, and how many rows there are."""
    shown = F.concat_ws(" ", F.col("series"), F.concat("label", F.lit("="), F.when(
        F.col("value") == F.floor("value"), F.format_string("%,.0f", "value"))
        .otherwise(F.format_string("%,.3f", "value"))))
    first = F.when((F.col("row_no") <= 5) & F.col("label").isNotNull(),
                   F.struct("row_no", "series", shown.alias("text")))
    return answers.groupBy("question_id", "question", "intent", "confidence", "chart_type").agg(
        F.count("label").alias("row_count"),
        F.array_join(F.sort_array(F.collect_list(first)).text, ", ").alias("_text")
    ).select("question_id", "question", "intent", "confidence", "chart_type", "row_count",
             F.when(F.col("row_count") > 0, F.col("_text"))
             .otherwise(F.concat(F.lit("Could not compute "), "intent")).alias("reply"))


# --- routing between answers and fact search ------------------------------------------

def route(answered: DataFrame, hits: DataFrame, facts: DataFrame,
          min_confidence=words.ANSWER_MIN_CONFIDENCE, min_score=words.FACT_MIN_SCORE) -> DataFrame:
    """Per question: the computed answer if it is confident, else the best facts, else
    a fallback.  `answered` comes from `replies`, `hits` from fact search."""
    sentences = fact_replies(answered.select("question_id", "question"), hits, facts)
    joined = answered.join(sentences, "question_id", "left")
    direct = F.col("confidence") >= min_confidence
    found = (F.coalesce("top_score", F.lit(0.0)) >= min_score) & (F.col("sentence") != "")
    pick = lambda a, b, c: F.when(direct, a).when(found, b).otherwise(c)
    return joined.select(
        "question_id",
        pick(F.lit(1), F.lit(2), F.lit(0)).alias("tier"),
        pick(F.lit("DIRECT"), F.lit("SEMANTIC"), F.lit("FALLBACK")).alias("tier_label"),
        pick(F.col("confidence"), F.least(F.lit(0.85), F.col("top_score") + 0.2), F.lit(0.3))
        .alias("confidence"),
        pick(F.col("reply"), F.col("sentence"), F.col("reply")).alias("reply"),
        pick(F.lit(False), F.lit(True), F.lit(False)).alias("escalated"))


def fact_replies(questions: DataFrame, hits: DataFrame, facts: DataFrame) -> DataFrame:
    """A sentence from the facts found for each question, plus up to three supporting
    facts.  Hits are at most k per question, so their grouping stays small."""
    found = hits.join(facts, "doc_id").join(questions, "question_id")
    fact = F.struct("rank", "dim", "dim_val", "measure", "value")
    grouped = found.groupBy("question_id", "question").agg(
        F.max("score").alias("top_score"),
        F.min_by(fact, F.when(F.col("kind") == "fact", F.struct("value", "rank")))
        .alias("least"),
        F.min_by(fact, F.when(F.col("kind") == "fact", F.struct(-F.col("value"), F.col("rank"))))
        .alias("most"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "fact", fact))).alias("facts"),
        F.min_by(F.struct("measure", "dim_val", "pct"),
                 F.when(F.col("kind") == "trend", F.col("rank"))).alias("trend"),
        F.min_by(F.struct("dim", "dim_val", "value", "pct"),
                 F.when(F.col("kind") == "status", F.col("rank"))).alias("status"))
    low = F.lower("question")
    says = lambda side, word: F.format_string(
        f"Based on %s analysis: %s has the {word} %s (%s).", F.col(f"{side}.dim"),
        F.col(f"{side}.dim_val"), F.col(f"{side}.measure"), F.col(f"{side}.value").cast("string"))
    lead = (
        F.when(has_any(low, words.LOWEST_QUESTION_WORDS),
               F.when(F.col("least.dim").isNotNull(), says("least", "lowest")))
        .when(has_any(low, words.HIGHEST_QUESTION_WORDS),
              F.when(F.col("most.dim").isNotNull(), says("most", "highest")))
        .when(has_any(low, words.TREND_QUESTION_WORDS), F.when(
            F.col("trend.measure").isNotNull(),
            F.format_string("%s shows a %s trend (%+.1f%% change).", F.col("trend.measure"),
                            F.col("trend.dim_val"), F.col("trend.pct"))))
        .when(F.col("status.dim").isNotNull(), F.format_string(
            "%s status distribution: %s accounts for %.0f items (%s%%).", F.col("status.dim"),
            F.col("status.dim_val"), F.col("status.value"), F.col("status.pct").cast("string"))))
    support = F.array_join(F.transform(
        F.slice("facts", 1, 3),
        lambda x: F.concat(x["dim_val"], F.lit("="), x["value"].cast("string"))), ", ")
    sentence = F.when(lead.isNotNull(), F.concat_ws(
        " ", lead, F.when(F.size("facts") > 0, F.concat(F.lit("Supporting data: "), support))))
    return grouped.select("question_id", "top_score",
                          F.coalesce(sentence, F.lit("")).alias("sentence"))


def fact_chart(hits: DataFrame, facts: DataFrame, max_bars=8) -> DataFrame:
    """Bar rows from the facts found for each question, when there are at least two."""
    found = hits.join(facts.where(F.col("kind") == "fact"), "doc_id")
    rows = Window.partitionBy("question_id").orderBy("rank")
    return found.withColumn("row_no", F.row_number().over(rows)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("question_id"))
    ).where((F.col("_n") >= 2) & (F.col("row_no") <= max_bars)).select(
        "question_id", "row_no", F.col("dim_val").alias("label"),
        F.col("measure").alias("series"), "value")


def chart_series(df: DataFrame, label: str, values) -> DataFrame:
    """(label, series, value) rows for a chart, missing values as 0."""
    cells = [F.struct(F.lit(v).alias("series"),
                      F.coalesce(F.nanvl(F.col(f"`{v}`").cast("double"), F.lit(0.0)),
                                 F.lit(0.0)).alias("value")) for v in values]
    return df.select(F.col(f"`{label}`").cast("string").alias("label"), F.inline(F.array(*cells)))


# --- suggested questions --------------------------------------------------------------

def question_context(roles: DataFrame, kpis: DataFrame = None, hierarchy: DataFrame = None,
                     kinds: DataFrame = None) -> DataFrame:
    """What the templates need, one row per source: columns by role, the first KPI,
    the first hierarchy, the dashboard type."""
    listed = lambda cond: F.sort_array(F.collect_list(
        F.when(cond, F.struct("position", "column")))).column
    is_role = lambda r: F.col("role") == r
    context = roles.groupBy("source_id").agg(
        listed(is_role("dimension")).alias("dims"), listed(is_role("measure")).alias("meas"),
        listed(is_role("time")).alias("times"), listed(is_role("status")).alias("stats"))
    kpi_type = ("struct<kpi_name:string,value_col:string,threshold_col:string,"
                "previous_col:string,breach_detected:boolean>")
    if kpis is None:
        context = context.withColumn("kpis", F.array().cast(f"array<{kpi_type}>"))
    else:
        # templates use the first two KPIs and whether any breaches
        first = Window.partitionBy("source_id").orderBy("kpi_name")
        two = kpis.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= 2)
        any_breach = kpis.groupBy("source_id").agg(
            F.bool_or("breach_detected").alias("_any"))
        fields = F.struct("_n", "kpi_name", "value_col", "threshold_col", "previous_col",
                          "breach_detected")
        packed = two.groupBy("source_id").agg(F.sort_array(F.collect_list(fields)).alias("_k"))
        packed = packed.join(any_breach, "source_id").select("source_id", F.transform(
            "_k", lambda k: F.struct(
                k["kpi_name"].alias("kpi_name"), k["value_col"].alias("value_col"),
                k["threshold_col"].alias("threshold_col"),
                k["previous_col"].alias("previous_col"),
                F.col("_any").alias("breach_detected"))).alias("kpis"))
        context = context.join(packed, "source_id", "left")
    if hierarchy is None:
        context = context.withColumn(
            "hierarchy", F.lit(None).cast("struct<parent:string,child:string>"))
    else:
        context = context.join(hierarchy.groupBy("source_id").agg(
            F.min(F.struct("parent", "child")).alias("hierarchy")), "source_id", "left")
    if kinds is None:
        return context.withColumn("kind", F.lit("generic"))
    return context.join(kinds.select("source_id", F.col("dashboard_type").alias("kind")),
                        "source_id", "left")


def generate_questions(context: DataFrame, max_questions=8) -> DataFrame:
    """Suggested questions per source, breach and alert questions first, deduplicated
    without regard to case, in a fixed order."""
    at = lambda a, i: F.get(F.col(a), F.lit(i))
    d0, d1, m0, m1 = at("dims", 0), at("dims", 1), at("meas", 0), at("meas", 1)
    t0, s0, k0, k1 = at("times", 0), at("stats", 0), at("kpis", 0), at("kpis", 1)
    thr = F.coalesce(k0["threshold_col"], F.lit("threshold"))
    term = F.coalesce(F.element_at(F.create_map(*[
        F.lit(x) for kv in words.RECORD_TERMS.items() for x in kv]), F.col("kind")),
        F.lit("records"))
    has = lambda *cols: F.coalesce(F.concat(*cols).isNotNull(), F.lit(False))
    has_thr, has_prev = k0["threshold_col"].isNotNull(), k0["previous_col"].isNotNull()
    breach = F.coalesce(k0["breach_detected"], F.lit(False))
    kind = lambda k: F.col("kind") == k
    f, yes = F.format_string, F.lit(True)
    one_dim = has(d0) & ~has(d1)
    measure = F.coalesce(m0, F.lit("value"))
    # fixed values: the wording of the templates, in order
    templates = [
        (breach, f("Which %s are currently breaching their threshold?", term)),
        (breach, f("How many %s have exceeded their limits?", term)),
        (has_thr, f("Which records have %s below %s?", k0["value_col"], thr)),
        (has(s0), f("Show all items where %s is Red.", s0)),
        (has(s0), f("How many items are in each %s category?", s0)),
        (has(s0), f("What is the overall %s distribution?", s0)),
        (has(s0, d0), f("Show the %s status for each %s.", s0, d0)),
        (has(s0, d0), f("Which %s has the most Red / Fail statuses?", d0)),
        (has(s0, t0), f("Has the %s improved over %s?", s0, t0)),
        (has(t0, m0), f("Show the trend of %s over %s.", m0, t0)),
        (has(t0, m0, k0["kpi_name"]), f("Plot %s over time.", k0["kpi_name"])),
        (has(t0, m0, d0), f("How has %s changed by %s over %s?", m0, d0, t0)),
        (has(t0, m0, m1), f("Compare %s and %s trends over %s.", m0, m1, t0)),
        (has(m0, d0), f("Which %s has the highest %s?", d0, m0)),
        (has(m0, d0), f("Which %s is performing the worst on %s?", d0, m0)),
        (has(m0, d0), f("Rank all %s values by %s.", d0, m0)),
        (has(m0, k0["kpi_name"]), f("What is the highest value of %s?", k0["kpi_name"])),
        (has(m0, k0["kpi_name"]), f("Show the top 5 %s values.", k0["kpi_name"])),
        (has(d0, d1), f("Compare %s by %s and %s.", measure, d0, d1)),
        (has(d0, d1), f("What is the breakdown of %s across %s?", measure, d0)),
        (one_dim, f("What is the average %s for each %s?", measure, d0)),
        (one_dim, f("Show %s grouped by %s.", measure, d0)),
        (F.col("hierarchy").isNotNull(), f("Show %s breakdown within each %s.",
                                           F.col("hierarchy.child"), F.col("hierarchy.parent"))),
        *[(k["previous_col"].isNotNull(), f(text, k["kpi_name"]))
          for k in (k0, k1)
          for text in ("What is the change in %s from the previous period?",
                       "Which %s had the largest variance?")],
        (has_prev, F.lit("Show all items with variance greater than 10%.")),
        (yes, F.lit("Give me a summary of this dashboard.")),
        (yes, f("How many %s are there in total?", term)),
        (has(m0), f("What is the average %s?", m0)),
        (has(m0), f("What is the total %s?", m0)),
        (has(d0), f("List all unique %s values.", d0)),
        (has(s0), F.lit("Show me all items that need attention.")),
        (has(s0), F.lit("What percentage of items are compliant?")),
        (kind("kri"), F.lit("Which KRIs are in breach?")),
        (kind("kri"), F.lit("Show the KRI dashboard summary.")),
        (kind("kri"), F.lit("Are there any chronic Red KRIs?")),
        (kind("compliance"), F.lit("Are there any control failures?")),
        (kind("compliance"), F.lit("Which controls have not been tested recently?")),
        (kind("compliance"), F.lit("Show all open breaches.")),
        (kind("sales"), F.lit("Which region is underperforming?")),
        (kind("sales"), F.lit("What is the total revenue this quarter?")),
        (kind("sales"), F.lit("Show pipeline by stage.")),
        (kind("scorecard"), F.lit("Which metrics are below target?")),
        (kind("scorecard"), F.lit("Show the overall scorecard summary.")),
        (kind("scorecard"), F.lit("What is the performance trend?")),
    ]
    offered = F.filter(F.array(*[
        F.struct(F.coalesce(fits, F.lit(False)).alias("fits"), F.lit(i).alias("place"),
                 text.alias("question")) for i, (fits, text) in enumerate(templates)]),
        lambda x: x["fits"] & x["question"].isNotNull())
    flat = context.select("source_id", F.inline(offered))
    return first_questions(flat, max_questions)


def first_questions(offered: DataFrame, max_questions: int) -> DataFrame:
    """Deduplicate without case, priority words first, keep the first few per source."""
    priority = has_any(F.lower("question"), words.PRIORITY_QUESTION_WORDS)
    same = Window.partitionBy("source_id", F.lower(F.trim("question"))).orderBy("place")
    order = Window.partitionBy("source_id").orderBy(F.desc("_first"), "place")
    return (
        offered.withColumn("_d", F.row_number().over(same)).where(F.col("_d") == 1)
        .withColumn("_first", priority)
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_questions)
        .select("source_id", "rank", "question"))


def supplement_questions(questions: DataFrame, anomalies: DataFrame, temporal: DataFrame,
                         max_questions=10) -> DataFrame:
    """Put a trend question and up to two breach questions before the generated ones."""
    trend = temporal.orderBy("time_col", "measure_col").limit(1).select(
        F.lit(-3).alias("place"), F.concat(
            F.lit("What is the trend for "), "measure_col", F.lit(" over "), "time_col",
            F.lit("?")).alias("question"))
    why = ordered.by_severity(anomalies, 2, ("signal_type", "column")).where(
        F.col("signal_type") == "breach").select(
        F.lit(-2).alias("place"),
        F.concat(F.lit("Why is "), "column", F.lit(" breaching its threshold?"))
        .alias("question"))
    joined = questions.select(F.col("rank").alias("place"), "question").unionByName(
        trend).unionByName(why)
    same = Window.partitionBy(F.lower(F.trim("question"))).orderBy("place")
    # at most a dozen rows reach this window
    return joined.withColumn("_d", F.row_number().over(same)).where(F.col("_d") == 1).withColumn(
        "rank", F.row_number().over(Window.orderBy("place", "question"))
    ).where(F.col("rank") <= max_questions).select("rank", "question")
