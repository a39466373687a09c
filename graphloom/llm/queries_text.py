"""Queries of the text problems on graph nodes: look-alike characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import confusables
from graphloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of nodes with a label, norm_label or tag that look the same and differ in characters."""
    return confusables.lookalikes(confusables.cells(table(spark, folder, "nodes")))


def p1_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored spelling of a look-alike class, with its number of nodes."""
    return confusables.variants(confusables.cells(table(spark, folder, "nodes")))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every node's look-alike text with the representative of its class, and how many nodes it looks like."""
    return confusables.classes(confusables.cells(table(spark, folder, "nodes")))


def p1_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes with their texts in one form."""
    return confusables.consistent(table(spark, folder, "nodes"))


QUERIES = {"p1_found": p1_found, "p1_variants": p1_variants, "p1_classes": p1_classes, "p1_consistent": p1_consistent}
SQL: dict[str, str] = {}
