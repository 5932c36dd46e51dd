"""What a table is about: KPIs, hierarchies, dashboard type, chart shapes, texts."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesense.functions import words
from tablesense.functions.numbers import clean
from tablesense.functions.text import has_any
from tablesense.operators.roles import TableRoles


def _breach_counts(v: Column, t: Column) -> list[Column]:
    return [F.count_if(v < t).alias("below_count"), F.count_if(v > t).alias("above_count")]


def kpi_patterns(df: DataFrame, roles: TableRoles) -> DataFrame:
    """One KPI per value column, or per name when a column names the KPIs in rows.

    Both breach counts are reported; `breach_count` is the below-count when there is
    any, else the above-count.
    """
    values = [r for r in roles.rows
              if r["role"] == "measure" and r["sub_role"] in ("kpi_value", "metric")]
    status = roles.statuses[0] if roles.statuses else None
    name_col = next(
        (r["column"] for r in roles.rows if r["role"] in ("id", "dimension")
         and any(w in r["column"].lower() for w in words.KPI_NAME_WORDS)), None)
    named = name_col is not None and roles.unique(name_col) > 1

    def facts(r) -> list:
        thr, prev = r["threshold_partner"], r["previous_partner"]
        text = lambda x: F.lit(x).cast("string")
        percentage = (r["min"] is not None and r["min"] >= 0 and r["max"] <= 1.01
                      and r["mean"] < 1)
        return [F.lit(r["column"]).alias("value_col"), text(thr).alias("threshold_col"),
                text(prev).alias("previous_col"), text(status).alias("status_col"),
                F.lit(percentage).alias("is_percentage")]

    def counts(r) -> list[Column]:
        v = clean(df.schema, r["column"])
        if r["threshold_partner"] is None:
            return [F.lit(0).cast("long").alias("below_count"),
                    F.lit(0).cast("long").alias("above_count")]
        return _breach_counts(v, clean(df.schema, r["threshold_partner"]))

    if named and values:
        r = values[0]
        found = df.where(F.col(name_col).isNotNull()).groupBy(
            F.col(name_col).cast("string").alias("kpi_name")
        ).agg(F.count(F.lit(1)).alias("n_rows"), *counts(r)).select(
            "kpi_name", *facts(r), "below_count", "above_count")
    elif values:
        found = None
        for r in values:
            label = r["column"] if name_col is None else f"KPI ({r['column']})"
            one = df.agg(F.count(F.lit(1)).alias("n_rows"), *counts(r)).select(
                F.lit(label).alias("kpi_name"), *facts(r), "below_count", "above_count")
            found = one if found is None else found.unionByName(one)
    else:
        raise ValueError("no value column to build KPIs from")
    breaches = F.when(F.col("below_count") > 0, F.col("below_count")).otherwise(
        F.col("above_count"))
    return found.withColumn("breach_count", breaches).withColumn(
        "breach_detected", F.col("breach_count") > 0)


def hierarchies(df: DataFrame, dims) -> DataFrame:
    """(parent, child) pairs of dimensions where every child value has one parent value
    and some parent value has several children.

    Rows are unfolded once per candidate child and reduced to the least and greatest
    value of every other dimension, which combines map-side; the pair test then runs
    on one row per child value.
    """
    dims = list(dims)
    text = [F.col(f"`{d}`").cast("string").alias(f"d{i}") for i, d in enumerate(dims)]
    cells = [F.struct(F.lit(i).alias("child"), F.col(f"d{i}").alias("value"))
             for i in range(len(dims))]
    unfolded = df.select(*text).select("*", F.inline(F.array(*cells))).where(
        F.col("value").isNotNull())
    per_value = unfolded.groupBy("child", "value").agg(
        *[F.min(f"d{i}").alias(f"lo{i}") for i in range(len(dims))],
        *[F.max(f"d{i}").alias(f"hi{i}") for i in range(len(dims))])
    parents = per_value.select(
        "child", F.inline(F.array(*[
            F.struct(F.lit(i).alias("parent"), F.col(f"lo{i}").alias("lo"),
                     F.col(f"hi{i}").alias("hi")) for i in range(len(dims))]))
    ).where((F.col("parent") != F.col("child")) & F.col("lo").isNotNull())
    by_parent_value = parents.groupBy("child", "parent", "lo").agg(
        F.count(F.lit(1)).alias("children"),
        F.bool_and(F.col("lo") == F.col("hi")).alias("single"))
    names = F.array(*[F.lit(d) for d in dims])
    return by_parent_value.groupBy("child", "parent").agg(
        F.bool_and("single").alias("single"), F.max("children").alias("most")
    ).where(F.col("single") & (F.col("most") > 1)).select(
        F.get(names, F.col("parent")).alias("parent"),
        F.get(names, F.col("child")).alias("child"))


def dashboard_type(profile: DataFrame) -> DataFrame:
    """Each source's most likely domain: keyword hits in names and sample values."""
    text = F.array_join(F.sort_array(F.collect_list(F.struct(
        "position", F.concat_ws(" ", F.lower("column"),
                                F.lower(F.array_join("samples", " "))).alias("t")))).t, " ")
    sources = profile.groupBy("source_id").agg(text.alias("text"))
    scored = []
    for place, (kind, signals) in enumerate(words.DASHBOARD_SIGNALS):
        hits = F.lit(0)
        for s in signals:
            hits = hits + F.col("text").contains(s).cast("int")
        scored.append(F.struct(hits.alias("hits"), F.lit(-place).alias("place"),
                               F.lit(kind).alias("kind"), F.lit(len(signals)).alias("size")))
    best = F.array_max(F.array(*scored))
    return sources.select("source_id", best.alias("b")).select(
        "source_id",
        F.when(F.col("b.hits") > 0, F.col("b.kind")).otherwise("generic")
        .alias("dashboard_type"),
        F.when(F.col("b.hits") > 0, F.round(F.least(F.lit(1.0), F.col("b.hits") / F.col("b.size")), 2))
        .otherwise(F.lit(0.5)).alias("confidence"))


def source_display_name(profile: DataFrame) -> DataFrame:
    """A display name per source from keywords in its column names."""
    # fixed values: keywords and the name they give, first match wins
    names = [
        (["kri", "risk indicator"], "KRI Dashboard"),
        (["control", "compliance", "breach"], "Compliance Dashboard"),
        (["revenue", "sales", "pipeline"], "Sales Dashboard"),
        (["scorecard", "kpi", "performance"], "Scorecard Dashboard"),
    ]
    joined = profile.groupBy("source_id").agg(F.lower(F.array_join(F.sort_array(
        F.collect_list(F.struct("position", "column"))).column, " ")).alias("columns"))
    label = F.concat(F.lit("Dashboard ("), F.substring("source_id", 1, 8), F.lit(")"))
    for keys, name in reversed(names):
        label = F.when(has_any(F.col("columns"), keys), name).otherwise(label)
    return joined.select("source_id", label.alias("source_name"))


def chart_shapes(roles: DataFrame) -> DataFrame:
    """Chart shapes that fit each source, best first, from its visual-role rows.

    One row per source is enough: roles, distinct counts and value ranges come from the
    profile, so no rule touches the table again.
    """
    def listed(role):
        entry = F.when(F.col("role") == role, F.struct(
            "position", F.col("column").alias("name"), F.col("n_unique").alias("u"),
            F.col("min").alias("lo"), F.col("max").alias("hi")))
        return F.sort_array(F.collect_list(entry))

    lists = {"time": "times", "dimension": "dims", "measure": "meas", "geographic": "geos",
             "status": "stats", "threshold": "thresh", "bin": "bins"}
    src = roles.groupBy("source_id").agg(
        F.max("n_rows").alias("n_rows"),
        F.bool_or(F.lower(F.trim("column")).isin(words.MEASURE_PAIR_NAMES)).alias("paired"),
        *[listed(role).alias(alias) for role, alias in lists.items()])
    size = lambda a: F.size(a)
    t, d, m, g = (size(c) for c in ("times", "dims", "meas", "geos"))
    unique = lambda a, i: F.coalesce(F.get(F.col(a), F.lit(i))["u"], F.lit(0))
    widest = F.coalesce(F.array_max(F.transform("dims", lambda x: x["u"])), F.lit(0))
    place_word = F.exists("dims", lambda x: F.lower(x["name"]).rlike(
        "country|state|city|region|province"))
    first = F.get(F.col("meas"), F.lit(0))
    grid = lambda a, b: F.abs(F.col("n_rows") - a * b)
    d0, d1, t0 = unique("dims", 0), unique("dims", 1), unique("times", 0)
    some = lambda n: (n >= 2) & (n <= 50)
    # fixed values: shape and confidence, in the order that breaks ties
    shapes = [
        ("multi_measure", 0.95, F.col("paired")),
        ("map", 0.92, g >= 2),
        ("map", 0.75, (g == 1) & (m >= 1)),
        ("map", 0.60, (g < 2) & ~((g == 1) & (m >= 1)) & place_word),
        ("kpi_scorecard", 0.88, (size("stats") > 0) & (size("thresh") > 0) & (m >= 1)),
        ("kpi_scorecard", 0.72, ((size("stats") > 0) | (size("thresh") > 0)) & (m >= 1)),
        ("kpi_cards", 0.85, (m >= 1) & (d == 0) & (t == 0) & (F.col("n_rows") <= 20)),
        ("histogram", 0.92, size("bins") > 0),
        ("multi_series_time", 0.87, (t >= 1) & (m >= 1) & (d >= 1) & (widest <= 30)),
        ("time_series", 0.85, (t >= 1) & (m >= 1)),
        ("bubble_chart", 0.78, (m >= 3) & (t == 0) & (d <= 3)),
        ("scatter_plot", 0.73, (m >= 2) & (t == 0) & (d <= 3)),
        ("heat_map", 0.70, (d >= 2) & (m >= 1) & some(d0) & some(d1)),
        ("heat_map", 0.62, (t >= 1) & (d >= 1) & (m >= 1) & some(t0) & some(d0)),
        ("treemap", 0.62, (d >= 2) & (m >= 1) & (t == 0) & (widest > 5)),
        ("bar_chart", 0.68, (d >= 1) & (m >= 1) & (widest <= 100)),
        ("pie_chart", 0.55, (d >= 1) & (m >= 1) & (widest <= 15)),
        ("box_plot", 0.45, (m >= 1) & (F.col("n_rows") > 30) & (d <= 2)),
        ("crosstab", 0.80, (d >= 2) & (m >= 1)
         & (grid(d0, d1) < F.greatest(F.lit(5.0), d0 * d1 * 0.15))),
        ("crosstab", 0.75, (t >= 1) & (d >= 1) & (m >= 1) & some(t0) & some(d0)
         & (grid(t0, d0) < F.greatest(F.lit(4.0), t0 * d0 * 0.15))),
        ("waterfall", 0.50, (m >= 1) & (d == 1) & (t == 0)
         & (first["lo"] < 0) & (first["hi"] > 0)),
        ("gantt", 0.55, (t >= 2) & (d >= 1)),
        ("data_table", 0.25, F.lit(True)),
    ]
    candidates = F.filter(F.array(*[
        F.struct(F.lit(name).alias("shape"), F.lit(conf).alias("confidence"),
                 F.lit(i).alias("place"), F.coalesce(fits, F.lit(False)).alias("fits"))
        for i, (name, conf, fits) in enumerate(shapes)]), lambda x: x["fits"])
    names = lambda a, n: F.transform(F.slice(F.col(a), 1, n), lambda x: x["name"])
    flat = src.select(
        "source_id", names("dims", 2).alias("dim_cols"), names("meas", 4).alias("measure_cols"),
        F.get(names("times", 1), F.lit(0)).alias("time_col"), F.inline(candidates))
    best = Window.partitionBy("source_id", "shape").orderBy(F.desc("confidence"), "place")
    order = Window.partitionBy("source_id").orderBy(F.desc("confidence"), "place")
    labels = F.create_map(*[F.lit(x) for kv in words.CHART_LABELS.items() for x in kv])
    return (
        flat.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == 1)
        .withColumn("rank", F.row_number().over(order))
        .select("source_id", "rank", "shape", "confidence",
                F.element_at(labels, F.col("shape")).alias("label"),
                "dim_cols", "measure_cols", "time_col"))


def schema_text(roles: DataFrame) -> DataFrame:
    """A readable description of every source's columns."""
    shown = F.format_string(
        "  %s [%s]: %s | %d unique values%s | sample: %s",
        F.col("column"), F.col("role"), F.col("dtype"), F.col("n_unique"),
        F.when(F.col("min").isNotNull(), F.concat(
            F.lit(" | range: "), F.col("min").cast("string"), F.lit("–"),
            F.col("max").cast("string"), F.lit(" | mean: "),
            F.round("mean", 4).cast("string"))).otherwise(F.lit("")),
        F.array_join(F.slice("samples", 1, 3), ", "))
    lines = F.sort_array(F.collect_list(F.struct("position", shown.alias("line")))).line
    return roles.groupBy("source_id").agg(
        F.concat(F.lit("=== DATA SCHEMA ===\n"), F.array_join(lines, "\n")).alias("schema_text"))


def summary_text(roles: DataFrame) -> DataFrame:
    """One line per source: size, then the columns of each main role."""
    def part(title, role, n=6):
        names = F.slice(F.sort_array(F.collect_list(F.when(
            F.col("role") == role, F.struct("position", "column")))).column, 1, n)
        return F.when(F.size(names) > 0, F.concat(
            F.lit(f"{title}: "), F.array_join(names, ", "), F.lit(".")))
    return roles.groupBy("source_id").agg(F.concat_ws(
        " ",
        F.concat(F.max("source_id"), F.lit(": "), F.format_number(F.max("n_rows"), 0),
                 F.lit(" rows × "), F.count(F.lit(1)).cast("string"), F.lit(" columns.")),
        part("Dimensions", "dimension"), part("Measures", "measure"),
        part("Time fields", "time", 50), part("Geographic fields", "geographic", 50),
    ).alias("summary_text"))
