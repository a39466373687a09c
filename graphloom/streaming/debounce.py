"""Bursts of events: sessions that end when nothing has come for a while, in batch and as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import normal_path
from graphloom.operators.corpus import CODE, ending
from graphloom.sources.tables import shared_folder

# File endings beside code whose changes are looked at.
WATCHED = ["pdf", "md", "txt", "rst", "html", "tex"]


def watched(path: Column | str) -> Column:
    """Whether a change of this path is looked at: its ending is one of code or text, none of its parts is hidden or the graph's own folder."""
    parts = F.split(normal_path(path), "/")
    own = F.array_contains(parts, "graph-out") | (F.array_contains(parts, "LLM Wiki") & F.array_contains(parts, "_meta"))
    return ending(path).isin(CODE + WATCHED) & ~F.exists(parts, lambda p: p.startswith(".")) & ~own


def sessions(events: DataFrame, keys: Sequence[str], gap: str, at: str = "ts", *more: Column) -> DataFrame:
    """Per key, the bursts of events: begin, until (the last event's time plus the gap), n_events.

    Two events belong together if they are not further apart than the gap.
    Events without a time are in no burst.  On a stream with a watermark the
    same expression is evaluated with bounded state.
    """
    timed = events.filter(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    grouped = timed.groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n_events"), *more)
    return grouped.select(*keys, F.col("w.start").alias("begin"), F.col("w.end").alias("until"), "n_events", *[c for c in grouped.columns if c not in (*keys, "w", "n_events")])


def stream_sessions(spark: SparkSession, events: DataFrame, key: str, gap: str, at: str = "ts") -> DataFrame:
    """The same bursts by Structured Streaming over the events as files arrive.

    A closing event later than all others is appended in a file of its own,
    so the watermark passes every real burst; it is left out of the result.
    State, sink and progress are kept in the shared folder.  Events later
    than the watermark (the gap) are dropped, as everywhere in the engine.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("ts")).filter("ts is not null")
    rows.write.parquet(f"{base}/in")
    last = spark.read.parquet(f"{base}/in").agg(F.max("ts").alias("ts")).filter("ts is not null")
    last.select(F.lit(None).cast("string").alias("key"), (F.col("ts") + F.expr(f"INTERVAL {gap}") * 3).alias("ts")).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{base}/in").withWatermark("ts", gap)
    bursts = stream.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"))
    out = bursts.select("key", F.col("w.start").alias("begin"), F.col("w.end").alias("until"), "n_events")
    run = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").filter("key is not null")


def changed_batches(files: DataFrame, gap: str) -> DataFrame:
    """Bursts of changes per repository: how many paths, and whether any of them is no code, so that a full update is needed."""
    other = F.bool_or(~ending("path").isin(CODE)).alias("needs_update")
    return sessions(files.filter("path is not null"), ["repo"], gap, "committed_at", F.countDistinct("path").alias("n_paths"), other)
