"""Queries on sessions over the event table: the operators of streams, read as one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .sources.corpus import table
from .streaming import sessions


def _us(name: str) -> F.Column:
    return F.unix_micros(F.col(name).cast("timestamp")).alias(name)


_BLOCKS = "b AS (SELECT user_id::VARCHAR AS session_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'clear' ELSE 'block' END AS kind, event_type || '-' || floor(value / 10)::INT AS content FROM events WHERE user_id IS NOT NULL)"


@query(f"""WITH {_BLOCKS}, e AS (SELECT *, count(*) FILTER (kind = 'clear') OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, epoch, content ORDER BY ts, event_id) AS nth FROM e WHERE kind = 'block')
SELECT session_id, event_id, sha256(content) AS hash FROM n WHERE nth = 1""")
def session_first_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that a session has not had since an error made it forget."""
    sessions.keep_state(spark)
    kind = F.when(F.col("event_type") == "error", sessions.CLEAR).otherwise("block")
    content = F.concat("event_type", F.lit("-"), F.floor(F.col("value") / 10).cast("int"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "event_id", "ts", kind.alias("kind"), content.alias("content"))
    return sessions.first_blocks(e)


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id IS NOT NULL) WHERE n <= 20""")
def recent_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty events of each user, as the buffer of a stream holds them."""
    sessions.keep_state(spark)
    return sessions.recent(table(spark, sf_dir, "events"), "user_id", 20).select(F.col("key").alias("user_id"), "event_id")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a user's events without a pause of half an hour."""
    s = sessions.sessions(table(spark, sf_dir, "events"), "user_id")
    return s.select("user_id", _us("start"), _us("end"), "n")


@query("""SELECT r.user_id AS correlation_id, epoch_us(r.ts) AS asked_at, r.event_id AS request_id, epoch_us(c.ts) AS done_at, c.event_id AS completion_id
FROM (SELECT * FROM events WHERE event_type = 'view') r LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') c ON c.user_id = r.user_id AND c.ts >= r.ts AND c.ts <= r.ts + INTERVAL 6 HOUR""")
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases of their user within six hours, or with none."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "correlation_id")
    j = sessions.answered(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "6 hours")
    return j.select("correlation_id", _us("asked_at"), "request_id", _us("done_at"), "completion_id")
