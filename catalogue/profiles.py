"""Profiles, roles and structure of all driver tables in one run."""

from pyspark.sql import functions as F

from catalogue.tables import LABELLED_SQL, MONTHLY_SQL, labelled_documents, monthly_kpis, query
from tablesense.functions import words
from tablesense.operators import profile as prof, roles, structure

# Plain columns of the driver tables by kind: n(umber), t(ext), d(ate).
COLUMNS = {
    "region": "r_regionkey:n r_name:t",
    "nation": "n_nationkey:n n_name:t n_regionkey:n",
    "customer": "c_custkey:n c_name:t c_nationkey:n c_acctbal:n c_mktsegment:t",
    "supplier": "s_suppkey:n s_name:t s_nationkey:n s_acctbal:n",
    "part": "p_partkey:n p_name:t p_brand:t p_type:t p_size:n p_retailprice:n",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:t o_totalprice:n o_orderdate:d "
              "o_orderpriority:t",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n "
                "l_extendedprice:n l_discount:n l_tax:n l_returnflag:t l_linestatus:t "
                "l_shipdate:d",
    "events": "event_id:n ts:d user_id:n event_type:t value:n props:t",
    "documents": "doc_id:n text:t lang:t source:t n_chars:n",
    "labels": "doc_id:n quality:n toxic:n",
    "conversations": "conv_id:n turn:n role:t text:t",
    "pages": "page_id:n url:t html:t",
    "benchmark": "item_id:n text:t",
    "embeddings": "vec_id:n label:n",
}


def _listed(names):
    return ", ".join(f"'{n}'" for n in names)


def _facts_sql():
    parts = []
    for table, columns in COLUMNS.items():
        for place, spec in enumerate(columns.split()):
            c, kind = spec.split(":")
            number = kind == "n"
            stat = lambda e: (f"CASE WHEN count(DISTINCT {c}) > 1 THEN {e} END"
                              if number else "NULL")
            low = f"lower({c}::VARCHAR)"
            within = lambda w: (
                f"count(DISTINCT {c}) BETWEEN 1 AND 1500 AND bool_and({low} IN ({_listed(w)}))")
            hits = lambda p: (f"count(*) FILTER (regexp_matches(lower(trim({c})), '{p}'))"
                              if kind == "t" else "0")
            parts.append(f"""
              SELECT '{table}' AS source_id, {place} AS position, '{c}' AS "column",
                {number}::BOOLEAN AS is_numeric, {kind == 'd'}::BOOLEAN AS is_dated,
                {kind == 't'}::BOOLEAN AS is_text, count(*) AS n_rows,
                count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique,
                {stat(f'min({c})::DOUBLE')} AS min, {stat(f'max({c})::DOUBLE')} AS max,
                {stat(f'avg({c})')} AS mean, {stat(f'stddev_samp({c})')} AS std,
                {stat(f'sum({c})::DOUBLE')} AS sum,
                {f'avg(length({c}))' if kind == 't' else '0'} AS mean_length,
                {hits(words.VISUAL_DATE_VALUE)} AS visual_dates,
                {hits(words.SEMANTIC_DATE_VALUE)} AS semantic_dates,
                {within(words.PROFILE_RAG_VALUES)} AS profile_rag,
                {within(words.VISUAL_RAG_VALUES)} AS visual_rag,
                {within(words.STATUS_LIKE_VALUES)} AS status_like,
                {within(words.BOOLEAN_LIKE_VALUES)} AS boolean_like,
                bool_or({low} IN ({_listed(words.SEMANTIC_RAG_VALUES)})) AS semantic_rag,
                CASE WHEN count(DISTINCT {c}) <= 1000
                     THEN (list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)))[1:5]::VARCHAR[]
                     ELSE [min({c})::VARCHAR, max({c})::VARCHAR] END AS samples
              FROM {table}""")
    return " UNION ALL ".join(parts)


FACTS_SQL = _facts_sql()


def _token(pattern):
    parts = []
    for w in pattern.strip("()").split("|"):
        if w.startswith("^") or w.endswith("$"):
            parts.append(w)
        else:
            parts += [f"(?:^|[^a-z0-9]){w}", f"{w}(?:$|[^a-z0-9])"]
    return "|".join(parts)


def _name(pattern, mode):
    p = _token(pattern) if mode == "strict" else pattern
    return f"""regexp_matches(lower("column"), '{p}')"""


def _case(rules, otherwise, name="role"):
    body = " ".join(f"WHEN {cond} THEN {value}" for cond, value in rules)
    return f"CASE {body} ELSE {otherwise} END AS {name}"


def _profile_roles_sql(mode):
    w, hit = words, lambda p: _name(p, mode)
    flag = ("n_unique <= 2 AND (boolean_like OR status_like)" if mode == "strict"
            else "n_unique <= 2")
    time = hit(w.PROFILE_TIME) + (" OR is_dated" if mode == "strict" else "")
    rules = [
        (time, "'time'", "CASE WHEN contains(\"column\", 'date') THEN 'date' ELSE 'period' END"),
        (f"{hit(w.PROFILE_ID)} OR (NOT is_numeric AND n_unique = n_rows AND n_rows > 10)",
         "'id'", "'key'"),
        (hit(w.PROFILE_STATUS), "'status'", "'rag'"),
        ("NOT is_numeric AND profile_rag AND n_unique <= 10", "'status'", "'rag'"),
        (f"is_numeric AND {hit(w.PROFILE_THRESHOLD)}", "'measure'", "'threshold'"),
        (f"is_numeric AND {hit(w.PROFILE_PREVIOUS)}", "'measure'", "'previous'"),
        (f"is_numeric AND ({hit(w.PROFILE_CURRENT)} OR n_unique > 10)", "'measure'",
         "'kpi_value'"),
        ("is_numeric", "'measure'", "'metric'"),
        (flag, "'status'", "'flag'"),
        ("mean_length > 80", "'text'", "'description'"),
        ("n_unique / n_rows < 0.3 OR n_unique <= 50", "'dimension'", "'category'"),
    ]
    return f"""SELECT source_id, position, "column", n_rows,
        {_case([(c, r) for c, r, _ in rules], "'text'")},
        {_case([(c, s) for c, _, s in rules], "'freetext'", "sub_role")}
        FROM ({FACTS_SQL})"""


def _visual_roles_sql():
    w = words
    anywhere = lambda p: f"""regexp_matches(lower("column"), '{p}')"""
    enough = ("n_rows > n_null AND visual_dates >= greatest(least(3, n_rows - n_null), "
              "ceil((n_rows - n_null) * 0.3))")
    rules = [
        (f"{anywhere(w.VISUAL_DATE_NAME)} OR is_dated OR ({enough})", "'time'"),
        (f"{anywhere(w.VISUAL_ID_NAME)} AND (n_unique = n_rows OR n_unique > n_rows * 0.9)",
         "'id'"),
        (f"""lower("column") IN ({_listed(w.GEO_EXACT_NAMES)})
             OR {_name('|'.join(w.GEO_NAME_WORDS), 'strict')}""", "'geographic'"),
        ("n_unique BETWEEN 1 AND 2 AND status_like", "'status'"),
        ("n_unique BETWEEN 1 AND 2 AND boolean_like", "'boolean'"),
        (f"{anywhere(w.VISUAL_STATUS_NAME)} AND (visual_rag OR n_unique <= 10)", "'status'"),
        (f"is_numeric AND {anywhere(w.VISUAL_THRESHOLD_NAME)}", "'threshold'"),
        ("is_numeric", "'measure'"),
        ("n_unique / n_rows < 0.4 OR n_unique <= 100", "'dimension'"),
        ("mean_length > 100", "'text'"),
    ]
    calc = anywhere(w.VISUAL_TABLE_CALC_NAME)
    return f"""SELECT *, CASE WHEN {calc} THEN 'table_calc' END AS sub_role,
        {_case(rules, "'dimension'")} FROM ({FACTS_SQL})"""


def _semantic_roles_sql():
    w = words
    anywhere = lambda p: f"""regexp_matches(lower("column"), '{p}')"""
    enough = ("n_rows > n_null AND semantic_dates >= greatest(least(3, n_rows - n_null), "
              "ceil((n_rows - n_null) * 0.375))")
    rules = [
        (f"is_dated OR {_name(w.SEMANTIC_TIME_NAME, 'strict')} OR ({enough})", "'time'"),
        (_name('|'.join(w.SEMANTIC_GEO_WORDS), 'strict'), "'geo'"),
        (f"is_numeric AND {anywhere(w.SEMANTIC_THRESHOLD_NAME)}", "'threshold'"),
        (f"{_name(w.SEMANTIC_STATUS_NAME, 'strict')} "
         "OR (is_text AND n_unique <= 10 AND semantic_rag)", "'status'"),
        (f"{anywhere(w.SEMANTIC_ID_NAME)} AND n_unique > n_rows * 0.8", "'id'"),
        ("is_numeric", "'measure'"),
        ("n_unique / n_rows < 0.35 OR n_unique <= 50", "'dimension'"),
    ]
    return f"""SELECT source_id, "column", {_case(rules, "'text'")} FROM ({FACTS_SQL})"""


def _catalogue(t):
    tables = {}
    for name in COLUMNS:
        df = t[name]
        tables[name] = df.select(*prof.profiled_columns(df))
    return prof.profile_catalogue(tables)


@query(f"""SELECT source_id, "column", n_rows, n_null, n_unique, min, max,
                  round(mean, 4) AS mean, round(std, 4) AS std, round(sum, 2) AS sum,
                  array_to_string(samples, '|') AS samples
           FROM ({FACTS_SQL})""")
def column_profiles(t):
    return _catalogue(t).select(
        "source_id", "column", "n_rows", "n_null", "n_unique", "min", "max",
        F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        F.round("sum", 2).alias("sum"), F.array_join("samples", "|").alias("samples"))


_NULL_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


@query(" UNION ALL ".join(
    f"""SELECT 'labelled' AS source_id, '{c}' AS "column", count(*) - count({c}) AS n_null,
               round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 1) AS null_pct
        FROM ({LABELLED_SQL})""" for c in _NULL_COLUMNS))
def null_percentages(t):
    return prof.null_percent(prof.profile_columns(labelled_documents(t), "labelled")).select(
        "source_id", "column", "n_null", "null_pct")


@query(f"SELECT source_id, \"column\", role, sub_role FROM ({_profile_roles_sql('strict')})")
def profile_roles(t):
    return roles.profile_roles(_catalogue(t)).select("source_id", "column", "role", "sub_role")


@query(f"SELECT source_id, \"column\", role, sub_role FROM ({_profile_roles_sql('reference')})")
def profile_roles_by_substring(t):
    return roles.profile_roles(_catalogue(t), mode="reference").select(
        "source_id", "column", "role", "sub_role")


@query(f"SELECT source_id, \"column\", role, sub_role FROM ({_visual_roles_sql()})")
def visual_roles(t):
    return roles.visual_roles(_catalogue(t)).select("source_id", "column", "role", "sub_role")


@query(_semantic_roles_sql())
def semantic_roles(t):
    return roles.semantic_roles(_catalogue(t)).select("source_id", "column", "role")


@query(f"""SELECT source_id, bool_or(role = 'time') AS has_time,
                  bool_or(role = 'status') AS has_status,
                  bool_or(role = 'threshold') AS has_threshold, false AS has_variance,
                  bool_or(role = 'geographic') AS has_geo,
                  count(*) FILTER (role = 'measure') >= 2 AS has_multi_measure
           FROM ({_visual_roles_sql()}) GROUP BY 1""")
def capability_flags(t):
    return roles.capability_flags(roles.visual_roles(_catalogue(t)))


@query("""SELECT count(*) AS n_rows, substring(md5(
            '[''o_custkey'', ''o_orderdate'', ''o_orderkey'', ''o_orderpriority'', '
            || '''o_orderstatus'', ''o_totalprice'']' || count(*)), 1, 12) AS fingerprint
          FROM orders""")
def table_fingerprint(t):
    return prof.fingerprint(t["orders"])


def _kinds_sql():
    cases = []
    for kind, signals in words.DASHBOARD_SIGNALS:
        hits = " + ".join(f"contains(text, '{s}')::INT" for s in signals)
        cases.append(f"SELECT source_id, '{kind}' AS kind, {len(signals)} AS size, "
                     f"{len(cases)} AS place, {hits} AS hits FROM texts")
    return f"""
      WITH texts AS (SELECT source_id, string_agg(lower("column") || ' '
                       || lower(array_to_string(samples, ' ')), ' ' ORDER BY position) AS text
                     FROM ({FACTS_SQL}) GROUP BY 1),
      scored AS ({' UNION ALL '.join(cases)}),
      best AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY hits DESC, place) AS n
               FROM scored)
      SELECT source_id, CASE WHEN hits > 0 THEN kind ELSE 'generic' END AS dashboard_type,
             CASE WHEN hits > 0 THEN round(least(1.0, hits::DOUBLE / size), 2)
                  ELSE 0.5 END::DOUBLE AS confidence FROM best WHERE n = 1"""


@query(_kinds_sql())
def dashboard_types(t):
    return structure.dashboard_type(_catalogue(t))


@query("""SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem',
                         'events', 'documents', 'labels', 'conversations', 'pages', 'benchmark',
                         'embeddings']) AS source_id,
                 'Dashboard (' || substring(source_id, 1, 8) || ')' AS source_name""")
def source_names(t):
    return structure.source_display_name(_catalogue(t))


def _shapes_sql():
    unique = lambda role, i: (f"coalesce((list(n_unique ORDER BY position) "
                              f"FILTER (role = '{role}'))[{i}], 0)")
    n = lambda role: f"count(*) FILTER (role = '{role}')"
    shapes = [
        ("map", 0.92, "g >= 2"), ("map", 0.75, "g = 1 AND m >= 1"),
        ("map", 0.60, "g = 0 AND placed"),
        ("kpi_scorecard", 0.88, "s > 0 AND th > 0 AND m >= 1"),
        ("kpi_scorecard", 0.72, "(s > 0 OR th > 0) AND m >= 1"),
        ("kpi_cards", 0.85, "m >= 1 AND d = 0 AND t = 0 AND n_rows <= 20"),
        ("multi_series_time", 0.87, "t >= 1 AND m >= 1 AND d >= 1 AND widest <= 30"),
        ("time_series", 0.85, "t >= 1 AND m >= 1"),
        ("bubble_chart", 0.78, "m >= 3 AND t = 0 AND d <= 3"),
        ("scatter_plot", 0.73, "m >= 2 AND t = 0 AND d <= 3"),
        ("heat_map", 0.70, "d >= 2 AND m >= 1 AND d0 BETWEEN 2 AND 50 AND d1 BETWEEN 2 AND 50"),
        ("heat_map", 0.62,
         "t >= 1 AND d >= 1 AND m >= 1 AND t0 BETWEEN 2 AND 50 AND d0 BETWEEN 2 AND 50"),
        ("treemap", 0.62, "d >= 2 AND m >= 1 AND t = 0 AND widest > 5"),
        ("bar_chart", 0.68, "d >= 1 AND m >= 1 AND widest <= 100"),
        ("pie_chart", 0.55, "d >= 1 AND m >= 1 AND widest <= 15"),
        ("box_plot", 0.45, "m >= 1 AND n_rows > 30 AND d <= 2"),
        ("crosstab", 0.80,
         "d >= 2 AND m >= 1 AND abs(n_rows - d0 * d1) < greatest(5.0, d0 * d1 * 0.15)"),
        ("crosstab", 0.75, """t >= 1 AND d >= 1 AND m >= 1 AND t0 BETWEEN 2 AND 50
          AND d0 BETWEEN 2 AND 50 AND abs(n_rows - t0 * d0) < greatest(4.0, t0 * d0 * 0.15)"""),
        ("waterfall", 0.50, "m >= 1 AND d = 1 AND t = 0 AND lo0 < 0 AND hi0 > 0"),
        ("gantt", 0.55, "t >= 2 AND d >= 1"), ("data_table", 0.25, "true")]
    cases = " UNION ALL ".join(
        f"SELECT source_id, '{name}' AS shape, {conf}::DOUBLE AS confidence, {i} AS place "
        f"FROM src WHERE {cond}" for i, (name, conf, cond) in enumerate(shapes))
    return f"""
      WITH src AS (SELECT source_id, max(n_rows) AS n_rows, {n('time')} AS t,
          {n('dimension')} AS d, {n('measure')} AS m, {n('geographic')} AS g, {n('status')} AS s,
          {n('threshold')} AS th, {unique('dimension', 1)} AS d0, {unique('dimension', 2)} AS d1,
          {unique('time', 1)} AS t0,
          coalesce(max(n_unique) FILTER (role = 'dimension'), 0) AS widest,
          coalesce(bool_or(regexp_matches("column", 'country|state|city|region|province'))
                   FILTER (role = 'dimension'), false) AS placed,
          (list(min ORDER BY position) FILTER (role = 'measure'))[1] AS lo0,
          (list(max ORDER BY position) FILTER (role = 'measure'))[1] AS hi0
        FROM ({_visual_roles_sql()}) GROUP BY 1),
      c AS ({cases}),
      u AS (SELECT *, row_number() OVER (PARTITION BY source_id, shape
                                         ORDER BY confidence DESC, place) AS n FROM c)
      SELECT source_id, row_number() OVER (PARTITION BY source_id
               ORDER BY confidence DESC, place) AS rank, shape, confidence
      FROM u WHERE n = 1"""


@query(_shapes_sql())
def chart_shapes(t):
    found = structure.chart_shapes(roles.visual_roles(_catalogue(t)))
    return found.select("source_id", F.col("rank").cast("long").alias("rank"), "shape",
                        "confidence")


@query(f"""WITH r AS ({_profile_roles_sql('strict')})
           SELECT source_id, source_id || ': ' || replace(format('{{:,}}', max(n_rows)), '.', '')
             || ' rows × ' || count(*) || ' columns.'
             || coalesce(' Dimensions: ' || string_agg("column", ', ' ORDER BY position)
                         FILTER (role = 'dimension') || '.', '')
             || coalesce(' Measures: ' || string_agg("column", ', ' ORDER BY position)
                         FILTER (role = 'measure') || '.', '')
             || coalesce(' Time fields: ' || string_agg("column", ', ' ORDER BY position)
                         FILTER (role = 'time') || '.', '') AS summary_text
           FROM r GROUP BY 1""")
def summary_texts(t):
    return structure.summary_text(roles.profile_roles(_catalogue(t)))


@query(f"""SELECT source_id, count(*) AS n_lines FROM ({FACTS_SQL}) GROUP BY 1""")
def schema_texts(t):
    texts = structure.schema_text(roles.visual_roles(_catalogue(t)))
    lines = F.filter(F.split("schema_text", "\n"), lambda x: x.rlike(r"^  \w+ \[\w+\]: "))
    return texts.select("source_id", F.size(lines).cast("long").alias("n_lines"))


@query("""SELECT 'current_value' AS "column", 'red_threshold' AS threshold_partner,
                 'previous_value' AS previous_partner""")
def partner_columns(t):
    described = roles.profile_roles(prof.profile_columns(monthly_kpis(t), "kpis"))
    return roles.partner_columns(described).where(
        F.col("threshold_partner").isNotNull()).select(
        "column", "threshold_partner", "previous_partner")


@query(f"""SELECT kri_name AS kpi_name, 'current_value' AS value_col,
                  'red_threshold' AS threshold_col, 'previous_value' AS previous_col,
                  'rag_status' AS status_col, false AS is_percentage,
                  count(*) FILTER (current_value < red_threshold) AS below_count,
                  count(*) FILTER (current_value > red_threshold) AS above_count,
                  CASE WHEN count(*) FILTER (current_value < red_threshold) > 0
                       THEN count(*) FILTER (current_value < red_threshold)
                       ELSE count(*) FILTER (current_value > red_threshold) END AS breach_count,
                  count(*) FILTER (current_value <> red_threshold) > 0 AS breach_detected
           FROM ({MONTHLY_SQL}) GROUP BY 1""")
def kpi_patterns(t):
    months = monthly_kpis(t)
    return structure.kpi_patterns(months, roles.table_roles(months, source_id="kpis"))


@query("""WITH p AS (SELECT n_name, r_name, c_mktsegment FROM customer
                     JOIN nation ON c_nationkey = n_nationkey
                     JOIN region ON n_regionkey = r_regionkey)
          SELECT 'r_name' AS parent, 'n_name' AS child
          FROM (SELECT max(a) AS most FROM (SELECT count(DISTINCT r_name) AS a
                                            FROM p GROUP BY n_name)),
               (SELECT max(b) AS many FROM (SELECT count(DISTINCT n_name) AS b
                                            FROM p GROUP BY r_name))
          WHERE most = 1 AND many > 1""")
def dimension_hierarchies(t):
    placed = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(
        t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return structure.hierarchies(placed, ["n_name", "r_name", "c_mktsegment"])
