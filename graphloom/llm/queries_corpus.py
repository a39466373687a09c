"""Queries of the text problems on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import abuse, leaks, packing
from graphloom.sources.tables import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a passage of an evaluation item."""
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per evaluation item, how far it leaked."""
    items = table(spark, folder, "eval_items")
    return leaks.report(leaks.leaks(table(spark, folder, "documents"), items), items)


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, for each capacity, with its container."""
    sized = packing.written(packing.sizes(table(spark, folder, "documents")), "document-sizes")
    return packing.pack(packing.pieces(sized, table(spark, folder, "context_budgets")))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per container, its pieces, tokens and unused space."""
    return packing.containers(p6_containers(spark, folder))


def _abuse(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.scores(table(spark, folder, "documents"), table(spark, folder, "moderation_labels"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with abusive, hateful or sexual language."""
    return _abuse(spark, folder).filter("flagged").select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score."""
    return _abuse(spark, folder)


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Per source, the rate of such documents."""
    return abuse.rates(_abuse(spark, folder))


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_scores": p8_scores, "p8_sources": p8_sources}
SQL: dict[str, str] = {}
