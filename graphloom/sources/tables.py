"""The given Parquet tables, and tables written between two steps of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only where the session names none and runs on one machine, as in tests, a
    new local folder is made and set for this session.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-graphloom-")
        context.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: a cut of the lineage that outlives executors.

    A table is written for this run only; its folder's name is new each time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, folder: str, inputs: Sequence[str], name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` derives from some of a folder's tables, written once in a session, and anew when one of the tables is written anew."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}.parquet") for x in inputs]
    times = tuple(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in paths)
    key = (spark.sparkContext.applicationId, folder, name, times)
    if key not in _KEPT:
        _KEPT[key] = written(make(), name)
    return _KEPT[key]
