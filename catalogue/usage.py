"""Usage analytics; the event log stands in for the message history."""

from pyspark.sql import functions as F

from catalogue.tables import query
from tablesense.operators import usage

_HISTORY_SQL = """
  SELECT event_id AS id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS session_id, user_id,
         event_type AS role, ts AS created_dt, value AS response_time_ms FROM events"""
_SESSIONS_SQL = f"""
  SELECT session_id, any_value(user_id) AS user_id,
         arg_min(role, (created_dt, id)) AS scorecard_id, min(created_dt) AS created_dt,
         max(created_dt) AS last_active_dt, 'ACTIVE' AS status
  FROM ({_HISTORY_SQL}) GROUP BY 1"""
_NOW_SQL = "(SELECT max(ts) FROM events)"


def _history(t):
    return t["events"].select(
        F.col("event_id").alias("id"),
        F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        "user_id", F.col("event_type").alias("role"), F.col("ts").alias("created_dt"),
        F.col("value").alias("response_time_ms"))


def _sessions(t):
    """A user's day is a session; the first event's type is its scorecard."""
    return _history(t).groupBy("session_id").agg(
        F.max("user_id").alias("user_id"),
        F.min_by("role", F.struct("created_dt", "id")).alias("scorecard_id"),
        F.min("created_dt").alias("created_dt"), F.max("created_dt").alias("last_active_dt")
    ).withColumn("status", F.lit("ACTIVE"))


def _now(t):
    return t["events"].agg(F.max("ts")).scalar()


_USAGE_SQL = f"""
  SELECT {{key}} count(DISTINCT s.session_id) AS sessions, count(h.id) AS messages,
         count(DISTINCT s.user_id) AS users, round(avg(response_time_ms), 1) AS avg_ms
  FROM ({_SESSIONS_SQL}) s LEFT JOIN ({_HISTORY_SQL}) h ON s.session_id = h.session_id
  WHERE s.created_dt >= {_NOW_SQL} - INTERVAL 10 DAY"""


def _since(t):
    return _now(t) - F.make_dt_interval(F.lit(10))


@query(_USAGE_SQL.format(key=""))
def usage_total(t):
    return usage.usage_total(_sessions(t), _history(t), _since(t))


@query(_USAGE_SQL.format(key="scorecard_id,") + " GROUP BY 1")
def usage_by_scorecard(t):
    return usage.usage_by_scorecard(_sessions(t), _history(t), _since(t))


@query(f"""SELECT scorecard_id AS most_queried, sessions FROM (
             {_USAGE_SQL.format(key='scorecard_id,')} GROUP BY 1)
           ORDER BY sessions DESC, scorecard_id LIMIT 1""")
def most_queried_scorecard(t):
    return usage.most_queried(_sessions(t), _history(t), _since(t))


@query("""SELECT c_custkey AS session_id, o_orderkey AS id
          FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def sessions_with_history(t):
    sessions = t["customer"].select(F.col("c_custkey").alias("session_id"))
    history = t["orders"].select(F.col("o_custkey").alias("session_id"),
                                 F.col("o_orderkey").alias("id"))
    return usage.session_history(sessions, history)


@query(f"""SELECT session_id, scorecard_id, last_active_dt FROM ({_SESSIONS_SQL})
           WHERE user_id = 7 ORDER BY last_active_dt DESC, session_id LIMIT 20""")
def sessions_of_user(t):
    return usage.user_sessions(_sessions(t), 7).select(
        "session_id", "scorecard_id", "last_active_dt")


@query(f"""SELECT user_id, place, session_id FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id
                      ORDER BY last_active_dt DESC, session_id) AS place FROM ({_SESSIONS_SQL}))
           WHERE place <= 3""")
def sessions_per_user(t):
    return usage.sessions_per_user(_sessions(t), 3).select(
        "user_id", F.col("place").cast("long").alias("place"), "session_id")


@query(f"""SELECT id, role, created_dt FROM ({_HISTORY_SQL})
           WHERE session_id = '7/2024-01-02' ORDER BY created_dt, id LIMIT 50""")
def session_transcript(t):
    return usage.transcript(_sessions(t), _history(t), "7/2024-01-02", 7).select(
        "id", "role", "created_dt")


@query("""SELECT conv_id, turn, role FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place
            FROM conversations WHERE role IN ('user', 'assistant')) WHERE place <= 2""")
def last_messages(t):
    return usage.last_messages(t["conversations"], 2, ["user", "assistant"], "conv_id",
                               ["turn"]).select("conv_id", "turn", "role")


@query(f"""SELECT session_id, count(*) AS message_count, max(created_dt) AS last_active_dt
           FROM ({_HISTORY_SQL}) GROUP BY 1""")
def session_activity(t):
    return usage.session_activity(_history(t))


@query(f"""SELECT CASE WHEN last_active_dt < {_NOW_SQL} - INTERVAL 7 DAY THEN 'EXPIRED'
                       ELSE status END AS status, count(*) AS n
           FROM ({_SESSIONS_SQL}) GROUP BY 1""")
def expired_sessions(t):
    return usage.expire_sessions(_sessions(t), _now(t)).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"))


@query(f"""SELECT role, count(*) AS n FROM ({_HISTORY_SQL})
           WHERE created_dt >= {_NOW_SQL} - INTERVAL 20 DAY GROUP BY 1""")
def retained_audit_rows(t):
    return usage.retained(_history(t), _now(t), 20).groupBy("role").agg(
        F.count(F.lit(1)).alias("n"))


@query("""SELECT 'event type is known' AS rule,
                 count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS violations
          FROM events
          UNION ALL SELECT 'value within limits', count(*) FILTER (NOT value BETWEEN 0 AND 50)
          FROM events""")
def rule_violations(t):
    return usage.rule_violations(t["events"], {
        "event type is known": F.col("event_type").isin("click", "view", "purchase"),
        "value within limits": F.col("value").between(0, 50)})


@query("""SELECT 'doc_id exists' AS rule, count(*) AS violations FROM documents
          WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def orphan_keys(t):
    return usage.orphan_count(t["documents"], "doc_id", t["labels"], "doc_id")


@query("""SELECT 'unique source, text' AS rule, count(*) AS violations FROM (
            SELECT 1 FROM documents GROUP BY source, text HAVING count(*) > 1)""")
def duplicate_keys(t):
    return usage.duplicate_count(t["documents"], ["source", "text"])


@query(f"""SELECT count(*) AS total,
                  count(*) FILTER (ts > {_NOW_SQL} - INTERVAL 300 MINUTE) AS valid FROM events""")
def cache_freshness(t):
    return usage.cache_freshness(t["events"], "ts", 300 * 60, _now(t))
