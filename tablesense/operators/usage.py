"""Usage analytics over session, history and audit tables."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesense.functions.numbers import rounded


def _per_session(history: DataFrame) -> DataFrame:
    """History reduced to one row per session before it meets the sessions."""
    return history.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum("response_time_ms").alias("latency_sum"),
        F.count("response_time_ms").alias("latency_n"))


def _usage(grouped, digits=1) -> DataFrame:
    return grouped.agg(
        F.count_distinct("session_id").alias("sessions"),
        F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"),
        F.count_distinct("user_id").alias("users"),
        rounded(F.try_divide(F.sum("latency_sum"), F.sum("latency_n").cast("double")), digits)
        .alias("avg_ms"))


def _joined(sessions: DataFrame, history: DataFrame, since) -> DataFrame:
    recent = sessions if since is None else sessions.where(F.col("created_dt") >= since)
    return recent.join(_per_session(history), "session_id", "left")


def usage_total(sessions: DataFrame, history: DataFrame, since: Column = None) -> DataFrame:
    """Sessions, messages, users and mean latency since a moment."""
    return _usage(_joined(sessions, history, since).groupBy())


def usage_by_scorecard(sessions: DataFrame, history: DataFrame, since: Column = None) -> DataFrame:
    """The same per scorecard, most sessions first."""
    return _usage(_joined(sessions, history, since).groupBy("scorecard_id")).orderBy(
        F.desc("sessions"), "scorecard_id")


def most_queried(sessions: DataFrame, history: DataFrame, since: Column = None) -> DataFrame:
    """The scorecard with the most sessions."""
    return usage_by_scorecard(sessions, history, since).limit(1).select(
        F.col("scorecard_id").alias("most_queried"), "sessions")


def session_history(sessions: DataFrame, history: DataFrame) -> DataFrame:
    """Every session with its messages; sessions without any are kept."""
    return sessions.join(history, "session_id", "left")


def user_sessions(sessions: DataFrame, user_id, scorecard_id=None, n=20) -> DataFrame:
    """A user's sessions, newest activity first."""
    mine = sessions.where(F.col("user_id") == user_id)
    if scorecard_id is not None:
        mine = mine.where(F.col("scorecard_id") == scorecard_id)
    return mine.orderBy(F.desc("last_active_dt"), "session_id").limit(n)


def sessions_per_user(sessions: DataFrame, n=20) -> DataFrame:
    """The n most recently active sessions of every user."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("last_active_dt"), "session_id")
    return sessions.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def transcript(sessions: DataFrame, history: DataFrame, session_id, user_id, n=50) -> DataFrame:
    """One session's first n messages in order, if it belongs to the user."""
    mine = sessions.where((F.col("session_id") == session_id) & (F.col("user_id") == user_id))
    return history.where(F.col("session_id") == session_id).join(
        mine.select("session_id"), "session_id", "left_semi"
    ).orderBy("created_dt", "id").limit(n)


def last_messages(history: DataFrame, n=20, roles=None, session="session_id",
                  order=("created_dt", "id")) -> DataFrame:
    """The newest n messages of every session, in ascending order within it."""
    kept = history if roles is None else history.where(F.col("role").isin(list(roles)))
    newest = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return kept.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def session_activity(history: DataFrame) -> DataFrame:
    """Message count and last activity per session."""
    return history.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("created_dt").alias("last_active_dt"))


def expire_sessions(sessions: DataFrame, now: Column = None, days=7) -> DataFrame:
    """Sessions idle for longer than `days` become EXPIRED."""
    now = F.current_timestamp() if now is None else now
    idle = F.col("last_active_dt") < now - F.make_dt_interval(F.lit(days))
    return sessions.withColumn(
        "status", F.when(idle, F.lit("EXPIRED")).otherwise(F.col("status")))


def retained(audit: DataFrame, now: Column = None, days=90, column="created_dt") -> DataFrame:
    """Audit rows inside the retention period."""
    now = F.current_timestamp() if now is None else now
    return audit.where(F.col(column) >= now - F.make_dt_interval(F.lit(days)))


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule, all rules in one pass; a NULL test passes."""
    counts = df.agg(*[F.count_if(~F.coalesce(test, F.lit(True))).alias(f"r{i}")
                      for i, test in enumerate(rules.values())])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"))
        for i, name in enumerate(rules)])))


def orphan_count(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; keys are counted before they are matched."""
    keys = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(parent_key).alias("_known")).distinct()
    return keys.join(known, keys[key] == known["_known"], "left_anti").agg(
        F.lit(f"{key} exists").alias("rule"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))


def duplicate_count(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).agg(
        F.lit("unique " + ", ".join(keys)).alias("rule"),
        F.count(F.lit(1)).alias("violations"))


def cache_freshness(entries: DataFrame, stored="stored_dt", ttl_seconds=300,
                    now: Column = None) -> DataFrame:
    """Cached entries in all, and those still within their time to live."""
    now = F.current_timestamp() if now is None else now
    fresh = F.col(stored) > now - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return entries.agg(F.count(F.lit(1)).alias("total"), F.count_if(fresh).alias("valid"))
