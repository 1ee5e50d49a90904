"""Streams over the access trace (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scale import shared_folder
from ..sources.content import table
from ..streaming import trace as S
from .registry import query


@query("t01_stream_rate", "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY ALL) SELECT epoch_us(s) AS start_us, event_type, n, users FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def t01_stream(spark, d):
    return S.run_available(S.windowed_rate(S.read_trace(spark, d)), shared_folder(spark))


@query(
    "t03_stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS accesses FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def t03_stream(spark, d):
    return S.run_available(S.idle_sessions(S.read_trace(spark, d)), shared_folder(spark))


@query("t04_cache_batch")
def t04(spark, d):
    return S.cache_simulation_batch(table(spark, d, "events"))


@query("t04_cache_stream")
def t04_stream(spark, d):
    out = S.run_available(S.cache_simulation(S.read_trace(spark, d)), shared_folder(spark))
    return out.groupBy("event_type").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
