"""Column roles as rules over profile rows; one job classifies a whole catalogue.

Three vocabularies exist: `profile` (drives questions and KPIs), `visual` (drives
blocks and chart shapes) and `semantic` (drives findings).  `mode="strict"`, the
default, lets the type decide time columns first and asks keywords to begin or end a
token of the name.  `mode="reference"` takes keywords anywhere in the name.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesense.functions import words
from tablesense.functions.text import matches, token_matches
from tablesense.operators.profile import profile_columns, value_flags


def _name() -> Column:
    return F.lower(F.trim("column"))


def _hit(mode: str, pattern: str) -> Column:
    return (matches if mode == "reference" else token_matches)(_name(), pattern)


def _words_hit(mode: str, word_list) -> Column:
    return _hit(mode, "|".join(word_list))


def _ratio() -> Column:
    return F.col("n_unique") / F.greatest(F.col("n_rows"), F.lit(1))


def _mostly(hits: str, share: float) -> Column:
    """Enough date-like values: the share, and three of them when there are three."""
    present = F.col("n_rows") - F.col("n_null")
    return (present > 0) & (
        F.col(hits) >= F.greatest(F.least(F.lit(3), present), F.ceil(present * share)))


def profile_roles(profile: DataFrame, mode="strict") -> DataFrame:
    """Add `role` and `sub_role` of the profile vocabulary."""
    strict = mode == "strict"
    numeric, unique = F.col("is_numeric"), F.col("n_unique")
    time = _hit(mode, words.PROFILE_TIME)
    if strict:
        time = F.col("is_dated") | time
    identity = _hit(mode, words.PROFILE_ID) | (
        ~numeric & (unique == F.col("n_rows")) & (F.col("n_rows") > 10))
    flag = F.col("is_boolean") | (
        (unique <= 2) & (F.col("boolean_like") | F.col("status_like")) if strict
        else unique <= 2)
    rules = [
        (time, "time", F.when(_name().contains("date"), "date").otherwise("period")),
        (identity, "id", F.lit("key")),
        (_hit(mode, words.PROFILE_STATUS), "status", F.lit("rag")),
        (~numeric & F.col("profile_rag") & (unique <= 10), "status", F.lit("rag")),
        (numeric & _hit(mode, words.PROFILE_THRESHOLD), "measure", F.lit("threshold")),
        (numeric & _hit(mode, words.PROFILE_PREVIOUS), "measure", F.lit("previous")),
        (numeric & (_hit(mode, words.PROFILE_CURRENT) | (unique > 10)), "measure",
         F.lit("kpi_value")),
        (numeric, "measure", F.lit("metric")),
        (flag, "status", F.lit("flag")),
        (F.col("mean_length") > 80, "text", F.lit("description")),
        ((_ratio() < 0.3) | (unique <= 50), "dimension", F.lit("category")),
    ]
    return _apply(profile, rules, ("text", F.lit("freetext")))


def visual_roles(profile: DataFrame, mode="strict") -> DataFrame:
    """Add `role` and `sub_role` of the visual vocabulary; the sub-role marks
    calculated columns (running totals, ranks)."""
    numeric, unique = F.col("is_numeric"), F.col("n_unique")
    near_unique = (unique == F.col("n_rows")) | (unique > F.col("n_rows") * 0.9)
    two_valued = (unique <= 2) & (unique > 0)
    calculated = F.when(matches(F.col("column"), words.VISUAL_TABLE_CALC_NAME),
                        F.lit("table_calc"))
    rules = [
        (_name().isin(words.MEASURE_PAIR_NAMES), "measure", calculated),
        (matches(F.col("column"), words.VISUAL_DATE_NAME) | F.col("is_dated")
         | _mostly("visual_dates", 0.3), "time", calculated),
        (matches(_name(), words.VISUAL_ID_NAME) & near_unique, "id", calculated),
        (_name().isin(words.GEO_EXACT_NAMES) | _words_hit(mode, words.GEO_NAME_WORDS),
         "geographic", calculated),
        (matches(F.col("column"), words.VISUAL_BIN_NAME), "bin", calculated),
        (F.col("is_boolean"), "boolean", calculated),
        (two_valued & F.col("status_like"), "status", calculated),
        (two_valued & F.col("boolean_like"), "boolean", calculated),
        (matches(_name(), words.VISUAL_STATUS_NAME)
         & (F.col("visual_rag") | (unique <= 10)), "status", calculated),
        (numeric & matches(_name(), words.VISUAL_THRESHOLD_NAME), "threshold", calculated),
        (numeric, "measure", calculated),
        ((_ratio() < 0.4) | (unique <= 100), "dimension", calculated),
        (F.col("mean_length") > 100, "text", calculated),
    ]
    return _apply(profile, rules, ("dimension", calculated))


def semantic_roles(profile: DataFrame, mode="strict") -> DataFrame:
    """Add `role` of the semantic vocabulary (no sub-roles)."""
    numeric, unique = F.col("is_numeric"), F.col("n_unique")
    none = F.lit(None).cast("string")
    rules = [
        (F.col("is_dated") | _hit(mode, words.SEMANTIC_TIME_NAME)
         | _mostly("semantic_dates", 0.375), "time", none),
        (_words_hit(mode, words.SEMANTIC_GEO_WORDS), "geo", none),
        (numeric & matches(_name(), words.SEMANTIC_THRESHOLD_NAME), "threshold", none),
        (_hit(mode, words.SEMANTIC_STATUS_NAME)
         | (F.col("is_text") & (unique <= 10) & F.col("semantic_rag")), "status", none),
        (matches(_name(), words.SEMANTIC_ID_NAME) & (unique > F.col("n_rows") * 0.8),
         "id", none),
        (numeric, "measure", none),
        ((_ratio() < 0.35) | (unique <= 50), "dimension", none),
    ]
    return _apply(profile, rules, ("text", none))


def _apply(profile: DataFrame, rules, otherwise) -> DataFrame:
    profile = value_flags(profile)
    role, sub = None, None
    for condition, name, detail in rules:
        hit = F.coalesce(condition, F.lit(False))
        role = F.when(hit, name) if role is None else role.when(hit, name)
        sub = F.when(hit, detail) if sub is None else sub.when(hit, detail)
    found = profile.withColumns({
        "sub_role": sub.otherwise(otherwise[1]), "role": role.otherwise(F.lit(otherwise[0]))})
    return found.drop("profile_rag", "visual_rag", "status_like", "boolean_like", "semantic_rag")


VOCABULARIES = {"profile": profile_roles, "visual": visual_roles, "semantic": semantic_roles}


def partner_columns(roles: DataFrame) -> DataFrame:
    """Pair every value column with a threshold and a previous-value column.

    A candidate must hold a partner word; one that shares a four-letter prefix with the
    value column wins, else the first such candidate does.  A source's columns are
    gathered in one array, which its column count bounds.
    """
    source = Window.partitionBy("source_id")

    def candidates(sub_role, partner_words):
        has_word = F.lower("column").rlike("|".join(partner_words))
        entry = F.when((F.col("sub_role") == sub_role) & has_word,
                       F.struct("position", F.col("column").alias("name")))
        return F.sort_array(F.collect_list(entry).over(source))

    value_name = F.lower("column")

    def close(c):
        other = F.lower(c["name"])
        return other.contains(F.substring(value_name, 1, 4)) | value_name.contains(
            F.substring(other, 1, 4))

    def choose(list_name):
        near = F.filter(F.col(list_name), close)
        return F.coalesce(F.get(near, F.lit(0))["name"],
                          F.get(F.col(list_name), F.lit(0))["name"])

    is_value = (F.col("role") == "measure") & F.col("sub_role").isin("kpi_value", "metric")
    return (
        roles
        .withColumn("_thr", candidates("threshold", words.THRESHOLD_PARTNER_WORDS))
        .withColumn("_prev", candidates("previous", words.PREVIOUS_PARTNER_WORDS))
        .withColumn("threshold_partner", F.when(is_value, choose("_thr")))
        .withColumn("previous_partner", F.when(is_value, choose("_prev")))
        .drop("_thr", "_prev")
    )


def capability_flags(roles: DataFrame) -> DataFrame:
    """What each source can be asked: time, status, threshold, variance, geo, measures."""
    is_role = lambda r: F.col("role") == r
    return roles.groupBy("source_id").agg(
        F.bool_or(is_role("time")).alias("has_time"),
        F.bool_or(is_role("status")).alias("has_status"),
        F.bool_or(is_role("threshold") | F.coalesce(F.col("sub_role") == "threshold",
                                                    F.lit(False))).alias("has_threshold"),
        F.bool_or(F.coalesce(F.col("sub_role") == "previous", F.lit(False)))
        .alias("has_variance"),
        F.bool_or(is_role("geographic") | is_role("geo")).alias("has_geo"),
        (F.count_if(is_role("measure")) >= 2).alias("has_multi_measure"),
    )


@dataclass(frozen=True)
class TableRoles:
    """The roles of one table, read back from its profile rows (one per column)."""

    source_id: str
    n_rows: int
    rows: tuple

    def names(self, *roles) -> list[str]:
        return [r["column"] for r in self.rows if r["role"] in roles]

    def row(self, column):
        return next(r for r in self.rows if r["column"] == column)

    def unique(self, column) -> int:
        return self.row(column)["n_unique"]

    @property
    def dimensions(self):
        return self.names("dimension")

    @property
    def measures(self):
        return self.names("measure")

    @property
    def times(self):
        return self.names("time")

    @property
    def statuses(self):
        return self.names("status")

    @property
    def thresholds(self):
        return self.names("threshold")

    @property
    def groupings(self):
        """Dimensions first, then status columns: what a question may group by."""
        return self.dimensions + self.statuses


def read_roles(roles: DataFrame) -> TableRoles:
    """Collect the profile rows of one source; their number is its column count."""
    rows = sorted((r.asDict() for r in roles.collect()), key=lambda r: r["position"])
    return TableRoles(rows[0]["source_id"] if rows else "", rows[0]["n_rows"] if rows else 0,
                      tuple(rows))


def table_roles(df: DataFrame, vocabulary="profile", source_id="table", mode="strict",
                exact=True) -> TableRoles:
    """Profile a table, classify its columns and pair its value columns."""
    roles = VOCABULARIES[vocabulary](profile_columns(df, source_id, exact), mode)
    return read_roles(partner_columns(roles))
