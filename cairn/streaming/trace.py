"""Access traces as streams: windowed rates, idle sessions, and a cache with custom state.

Each runs as a structured-streaming query over files; batch results over the same rows agree once the
watermark has closed everything.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_trace(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the files named events.* in a folder."""
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events*")
    return reader.parquet(folder).withColumn("t", F.col("ts").cast("timestamp"))


def windowed_rate(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Accesses and mean value by event type and window."""
    w = events.withWatermark("t", late).groupBy(F.window("t", window), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("user_id").alias("users")).select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", "users")


def idle_sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Runs of accesses of a user without a pause of ``gap``: what a cache that evicts idle entries keeps alive."""
    s = events.withWatermark("t", late).groupBy("user_id", F.session_window("t", gap).alias("s"))
    return s.agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("accesses")).select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "accesses")


def lru(keys: list, cache: OrderedDict, size: int) -> tuple[int, int]:
    """Hits and misses of the accesses on a least-recently-used cache, which is updated."""
    hits = 0
    for k in keys:
        if k in cache:
            hits += 1
            cache.move_to_end(k)
        else:
            cache[k] = None
            if len(cache) > size:
                cache.popitem(last=False)
    return hits, len(keys) - hits


def cache_simulation(events: DataFrame, size: int = 16) -> DataFrame:
    """Hits and misses of one cache for each event type, with the cache as state between batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        cache = OrderedDict.fromkeys(state.get[0]) if state.exists else OrderedDict()
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        hits, misses = lru(rows["user_id"].tolist(), cache, size)
        state.update((list(cache),))
        yield pd.DataFrame({"event_type": [key[0]], "hits": [hits], "misses": [misses]})

    return events.groupBy("event_type").applyInPandasWithState(step, "event_type string, hits long, misses long", "cache array<long>", "append", GroupStateTimeout.NoTimeout)


def cache_simulation_batch(events: DataFrame, size: int = 16) -> DataFrame:
    """The same over a table."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hits, misses = lru(rows.sort_values(["ts", "event_id"])["user_id"].tolist(), OrderedDict(), size)
        return pd.DataFrame({"event_type": [rows["event_type"].iloc[0]], "hits": [hits], "misses": [misses]})

    return events.select("event_type", "ts", "event_id", "user_id").groupBy("event_type").applyInPandas(run, "event_type string, hits long, misses long")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there, into Parquet under ``folder``, and read the result."""
    at = f"{folder.rstrip('/')}/cairn-stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")
