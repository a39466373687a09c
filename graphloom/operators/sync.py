"""Incremental sync by content hash: what changed since the last build, and what of it survives."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(content: Column | str) -> Column:
    """The first 16 hex digits of the content's SHA-256; of null as of empty."""
    content = F.col(content) if isinstance(content, str) else content
    return F.substring(F.sha2(F.coalesce(content, F.lit("")), 256), 1, 16)


def manifest(files: DataFrame) -> DataFrame:
    """path, hash: of each path the content committed last."""
    return files.filter("path is not null").groupBy("path").agg(F.max_by(content_hash("content"), F.struct("committed_at", "ingested_at", content_hash("content"))).alias("hash"))


def difference(current: DataFrame, known: DataFrame) -> DataFrame:
    """Every path of either manifest and its state: confirmed, changed, new or deleted."""
    both = current.select("path", F.col("hash").alias("now")).join(known.select("path", F.col("hash").alias("before")), "path", "full_outer")
    state = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("before"), "confirmed").otherwise("changed")
    return both.select("path", state.alias("state"))


def uncached(current: DataFrame, cache: DataFrame) -> DataFrame:
    """The files whose path and content no extraction is kept for."""
    return current.join(cache.select("path", "hash"), ["path", "hash"], "left_anti")


def retained(rows: DataFrame, states: DataFrame) -> DataFrame:
    """The base rows that survive: those whose source_file is no file of the corpus any more to be extracted again or gone."""
    gone = states.filter("state in ('changed', 'deleted', 'confirmed')").select(F.col("path").alias("source_file"))
    return rows.join(gone, "source_file", "left_anti")


def latest(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table ('nodes', 'edges' or 'manifest') of the graph last stored in a folder, None before the first build."""
    try:
        version = spark.read.schema("version string, at timestamp").json(f"{folder}/versions").agg(F.max(F.struct("at", "version")).alias("v")).first().v
    except AnalysisException:
        return None
    return spark.read.parquet(f"{folder}/{version.version}/{name}") if version else None


def update_graph(spark: SparkSession, folder: str, files: DataFrame, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> dict[str, int | str]:
    """Brings the graph stored in a folder up to date with a corpus, and returns how many paths are in each state, and the action.

    files: path, content, committed_at, ingested_at.  extract: from files to
    nodes and edges, both with source_file.  Only new and changed files are
    extracted; rows of changed and deleted files are dropped, and all others
    stay, those of no file too.  A version is written beside the last and then
    named, so an update that breaks off changes nothing.  Actions: full_build
    (there was none), no_op (no path changed) or incremental.
    """
    current, known = manifest(files), latest(spark, folder, "manifest")
    states = difference(current, known if known is not None else current.limit(0))
    counts = {r.state: r["count"] for r in states.groupBy("state").count().collect()}  # four at most
    if known is not None and not set(counts) - {"confirmed"}:
        return counts | {"action": "no_op"}
    fresh = states.filter("state in ('new', 'changed')").select("path")
    tables = dict(zip(("nodes", "edges"), extract(files.join(fresh, "path", "left_semi"))))
    gone = states.filter("state in ('changed', 'deleted')").select(F.col("path").alias("source_file"))
    version = uuid.uuid4().hex
    for name, rows in tables.items():
        if known is not None:
            rows = latest(spark, folder, name).join(gone, "source_file", "left_anti").unionByName(rows, allowMissingColumns=True)
        rows.write.parquet(f"{folder}/{version}/{name}")
    current.write.parquet(f"{folder}/{version}/manifest")
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(f"{folder}/versions")
    return counts | {"action": "full_build" if known is None else "incremental"}
