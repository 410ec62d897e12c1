"""Structured Streaming forms of the log operators; each gives what its batch form gives on the same rows.

Event-time windows with watermarks over the log's shape go beyond what the batch operators need.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from proselab.operators import logs


def read(spark: SparkSession, path: str, schema, files: int = 1, kind: str = "parquet") -> DataFrame:
    """S-17, ST-08: a folder to which files are added."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Tumbling or sliding counts and means by event type."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions by user: a pause of ``gap`` ends one."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def rate_limited(events: DataFrame, most: int, window: float) -> DataFrame:
    """ST-01 by user_id: the accepted calls of the window are the state."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        out = [(key[0], i, *logs.allow(seen, t, most, window)) for i, t in zip(rows["event_id"], rows["t"])]
        state.update((list(seen),))
        yield pd.DataFrame(out, columns=["key", "ident", "status", "remaining", "retry_after"])

    timed = events.select("user_id", "event_id", (logs.micros(F.col("ts")) / 1e6).alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(run, "key long, ident long, status int, remaining int, retry_after int", "seen array<double>", "append", GroupStateTimeout.NoTimeout)


def last_outputs(events: DataFrame, most: int = 200) -> DataFrame:
    """ST-09, W-09: by event type the number and mean of the last ``most`` values, after each batch."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else (), maxlen=most)
        held.extend(pd.concat(list(batches)).sort_values("event_id")["value"].tolist())
        state.update((list(held),))
        yield pd.DataFrame({"event_type": [key[0]], "n": [len(held)], "mean": [sum(held) / len(held)]})

    return events.select("event_type", "event_id", "value").groupBy("event_type").applyInPandasWithState(run, "event_type string, n int, mean double", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def to_jsonl(stream: DataFrame, path: str, checkpoint: str):
    """S-14, S-17, S-19: rows appended as JSON lines once, with a checkpoint to resume from."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
