"""Streaming jobs over the event log, run to the end of what is there.

Each writes its append-mode output to files; windows the watermark has not closed are
still open and therefore not in the result, which the SQL states too.
"""

from pyspark.sql import functions as F

from catalogue.tables import query
from tablesense.session import scratch_path
from tablesense.streaming import logs


def _stream(t):
    schema = t["events"].schema
    log = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(
        t.folder)
    return logs.with_event_time(log, "ts")


def _finished(t, stream, name):
    """Run a stream to the end and read back what it wrote."""
    out = scratch_path(t.spark, name)
    job = stream.writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", scratch_path(t.spark, f"{name}-state")
    ).trigger(availableNow=True).start(out)
    job.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


@query("""WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
          SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n,
                 round(sum(value), 4) AS total FROM events
          GROUP BY 1, 2
          HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT mark FROM m)""")
def streamed_window_counts(t):
    out = _finished(t, logs.windowed_counts(_stream(t), "ts", "event_type", "value"), "windows")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (
                       PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END
                       AS starts FROM events),
          s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS k
                FROM e)
          SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
                 count(*) AS n FROM s GROUP BY user_id, k
          HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def streamed_sessions(t):
    out = _finished(t, logs.activity_sessions(_stream(t), "ts", "user_id"), "sessions")
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("user_id", stamp("session_start"), stamp("session_end"), "n")


@query("""SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events""")
def streamed_replays_dropped(t):
    once = _stream(t)
    twice = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = logs.drop_replays(twice, "ts", ["event_id"]).drop("copy")
    return _finished(t, kept, "replays").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query("""WITH m AS (SELECT event_type, avg(value) * 2 AS threshold FROM events GROUP BY 1)
          SELECT event_type, count(*) AS n FROM events JOIN m USING (event_type)
          WHERE value > threshold GROUP BY 1""")
def streamed_breach_alerts(t):
    limits = t["events"].groupBy("event_type").agg((F.avg("value") * 2).alias("threshold"))
    alerts = logs.breach_alerts(_stream(t), "event_type", "value", limits, "threshold", "above")
    return _finished(t, alerts, "alerts").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
