"""Queries of the text problems on source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import functions, handwritten
from graphloom.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that nobody wrote by hand."""
    return handwritten.kinds(table(spark, folder, "source_files")).filter(handwritten.not_by_hand()).select("file_id")


def p4_repositories(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository, its files by kind."""
    kinds = handwritten.kinds(table(spark, folder, "source_files"))
    return kinds.groupBy("repo").agg(F.count("*").alias("n_files"), F.count_if(handwritten.not_by_hand()).alias("n_not_by_hand"), *(F.count_if(x).alias(f"n_{x}") for x in ("generated", "minified", "data", "vendored")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Functions and methods whose documentation is not trivial."""
    return functions.documented(functions.functions(table(spark, folder, "source_files"))).select("file_id", "start_line").distinct()


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Code and description of every documented function, without repeated descriptions."""
    return functions.pairs(functions.functions(table(spark, folder, "source_files")))


QUERIES = {"p4_found": p4_found, "p4_repositories": p4_repositories, "p5_found": p5_found, "p5_pairs": p5_pairs}
SQL: dict[str, str] = {}
