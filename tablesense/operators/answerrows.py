"""The rows behind answers: breaching rows, rows of a status, outliers, variances.

However many questions are asked, a table is read a fixed number of times: once for all
means, counts and status words that decide which rows belong, once or a few times for the
fences of all measures asked about, and once to give each row to every combination it
belongs to. Questions name their combination, so answer rows are not multiplied by the
number of questions.
"""

from pyspark.sql import DataFrame, functions as F

from tablesense.functions import words
from tablesense.functions.numbers import clean, relative_change
from tablesense.operators.ask import plan_questions
from tablesense.operators.indexing import dense_index
from tablesense.operators.quantiles import exact_quantiles
from tablesense.operators.roles import TableRoles

#: Intents whose answers are rows of the table.
ROW_INTENTS = ("breach", "rag_filter", "variance", "outliers")
#: Fences lie this many interquartile ranges beyond the quartiles.
FENCE = 1.5


def _pairs(roles: TableRoles, partner: str):
    return [(r["column"], r[partner]) for r in roles.rows if r[partner]]


def _decisions(df: DataFrame, roles: TableRoles, pairs):
    """One row that says which side of each threshold breaches, how often, and which
    status words occur."""
    cells = [F.count(F.lit(1)).alias("n")]
    for i, (value, threshold) in enumerate(pairs):
        v, t = clean(df.schema, value), clean(df.schema, threshold)
        cells += [(F.avg(v) < F.avg(t)).alias(f"below_{i}"), F.count_if(v < t).alias(f"under_{i}"),
                  F.count_if(v > t).alias(f"over_{i}")]
    if roles.statuses:
        low = F.lower(F.col(f"`{roles.statuses[0]}`").cast("string"))
        cells += [F.coalesce(F.bool_or(low.contains(w)), F.lit(False)).alias(f"has_{w}")
                  for w in words.RAG_QUESTION_WORDS]
    return df.agg(*cells).first()


def _breach_entries(df, roles, decided, pairs):
    """(series, condition) of the rows that breach: by thresholds, else by status."""
    found = []
    for i, (value, threshold) in enumerate(pairs):
        v, t = clean(df.schema, value), clean(df.schema, threshold)
        below = decided[f"below_{i}"]
        if decided[f"under_{i}" if below else f"over_{i}"]:
            found.append((value, v < t if below else v > t))
    if not found and roles.statuses:
        status = F.lower(F.col(f"`{roles.statuses[0]}`").cast("string"))
        found.append((roles.statuses[0], status.isin(words.BREACH_STATUS_VALUES)))
    return found


def _status_entries(df, roles, decided, detail):
    """Rows whose status holds the first of the words asked for that occurs at all."""
    for word in (detail or "").split():
        if roles.statuses and decided[f"has_{word}"]:
            low = F.lower(F.col(f"`{roles.statuses[0]}`").cast("string"))
            return [(word, low.contains(word))]
    return []


def _outlier_entries(df, measure, fences):
    lo, hi = fences.get(measure, (None, None))
    if lo is None:
        return []
    v = clean(df.schema, measure)
    return [(measure, (v < F.lit(lo)) | (v > F.lit(hi)))]


def _fences(df: DataFrame, measures) -> dict:
    """measure: (low, high), for all measures in one selection."""
    if not measures:
        return {}
    found = {}
    for r in exact_quantiles(df, measures, [0.25, 0.75]).collect():
        found.setdefault(r["column"], {})[r["prob"]] = r["quantile"]
    return {m: (q[0.25] - FENCE * (q[0.75] - q[0.25]), q[0.75] + FENCE * (q[0.75] - q[0.25]))
            for m, q in found.items()}


def answer_rows(df: DataFrame, roles: TableRoles, resolved: DataFrame, order_by) -> tuple[
        DataFrame, DataFrame]:
    """(asked, rows) for the questions that are answered by rows of the table.

    asked: question_id, combo. rows: combo, intent, series, row_no, delta, pct_change and
    the table's own columns in the struct `row`. A combination is an intent with the column
    or the words it looks at; breach rows come once for each threshold they breach, or by
    status if none is breached; a status answer takes the first word asked for that occurs.
    Variance gives all rows, the lowest change first, nulls last; the others go by
    `order_by`. Only the distinct combinations and one row of decisions reach the driver.
    """
    planned = plan_questions(resolved).where(F.col("intent").isin(list(ROW_INTENTS)))
    measure = F.when(F.col("intent") == "outliers", F.col("measure"))
    detail = F.when(F.col("intent") == "rag_filter", F.col("detail"))
    key = F.concat_ws("|", "intent", F.coalesce(measure, F.lit("")), F.coalesce(detail, F.lit("")))
    asked = planned.select("question_id", key.alias("combo"), "intent", measure.alias("measure"),
                           detail.alias("detail"))
    combos = asked.select("combo", "intent", "measure", "detail").distinct().orderBy("combo").collect()
    pairs = _pairs(roles, "threshold_partner")
    decided = _decisions(df, roles, pairs)
    fences = _fences(df, sorted({c.measure for c in combos if c.intent == "outliers" and c.measure}))
    previous = _pairs(roles, "previous_partner")
    delta = pct = F.lit(None).cast("double")
    if previous:
        now, before = (clean(df.schema, c) for c in previous[0])
        delta, pct = F.round(now - before, 4), relative_change(now, before)
    entries = []
    for c in combos:
        if c.intent == "breach":
            own = _breach_entries(df, roles, decided, pairs)
        elif c.intent == "rag_filter":
            own = _status_entries(df, roles, decided, c.detail)
        elif c.intent == "outliers":
            own = _outlier_entries(df, c.measure, fences)
        else:
            own = [(previous[0][0], F.lit(True))] if previous else []
        varied = c.intent == "variance"
        none = F.lit(None).cast("double")
        entries += [F.when(condition, F.struct(
            F.lit(c.combo).alias("combo"), F.lit(c.intent).alias("intent"),
            F.lit(series).alias("series"), (delta if varied else none).alias("delta"),
            (pct if varied else none).alias("pct_change"))) for series, condition in own]
    if not entries:
        kind = "struct<combo:string,intent:string,series:string,delta:double,pct_change:double>"
        entries = [F.lit(None).cast(kind)]
    order = [F.asc_nulls_last("pct_change"), *[F.col(f"row.`{c}`").asc_nulls_first() for c in order_by]]
    spread = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                       F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*", "row")
    numbered = dense_index(spread, order, ["combo", "series"])
    return asked.select("question_id", "combo"), numbered.select(
        "combo", "intent", "series", (F.col("row_no") + 1).alias("row_no"), "delta", "pct_change",
        "row")


def previews(asked: DataFrame, rows: DataFrame, n=20) -> DataFrame:
    """question_id, combo, row_count and the first `n` rows of each series as JSON texts.

    Rows are cut per combination before they meet the questions, so what a question
    carries is bounded by its series and `n`.
    """
    first = F.when(F.col("row_no") <= n, F.struct("series", "row_no", F.to_json("row").alias("json")))
    shown = rows.groupBy("combo").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.transform(F.array_sort(F.collect_list(first)), lambda x: x["json"]).alias("rows"))
    return asked.join(shown, "combo", "left").select(
        "question_id", "combo", F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"),
        F.coalesce("rows", F.array().cast("array<string>")).alias("rows"))
