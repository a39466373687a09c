"""A built graph as one object: what a user asks of it, on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import analysis, community, graph, traversal
from graphloom.sources.tables import table, written


@dataclass
class PropertyGraph:
    """Nodes, simple edges and groups; every method returns a DataFrame."""

    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame

    @classmethod
    def from_tables(cls, spark: SparkSession, folder: str) -> PropertyGraph:
        """The graph that the tables nodes, shared_nodes, edges and hyperedges of a folder make."""
        nodes = written(graph.live_nodes(table(spark, folder, "nodes"), table(spark, folder, "shared_nodes")), "nodes")
        edges = written(graph.upsert_edges(written(graph.repair_ends(table(spark, folder, "edges"), nodes), "repaired")), "edges")
        return cls(nodes, edges, table(spark, folder, "hyperedges"))

    def views(self, prefix: str = "") -> None:
        """Registers nodes, edges and hyperedges for Spark SQL."""
        for name in ("nodes", "edges", "hyperedges"):
            getattr(self, name).createOrReplaceTempView(prefix + name)

    def _one(self, node: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node).select("id")

    def find_nodes(self, question: str, limit: int = 10) -> DataFrame:
        return traversal.find(self.nodes, question, limit, self.edges).select("id", "label", "file_type", "source_file", (F.col("score") / 10).alias("score"))

    def ask(self, question: str, depth: int = 3, contexts: Sequence[str] = (), seeds: int = 3, budget: int = 2000) -> DataFrame:
        """The answer as lines of text: the best nodes, and what a walk from them reaches by edges of the question's contexts."""
        wanted, _ = traversal.contexts_of(question, contexts)
        edges = traversal.in_contexts(self.edges, wanted)
        reached = traversal.walk(edges, traversal.find(self.nodes, question, seeds).select("id"), depth)
        return traversal.rendered(self.nodes, edges, reached, budget)

    def get_neighbors(self, node: str, depth: int = 1, most: int = 30) -> DataFrame:
        return traversal.neighbours(self.edges, self._one(node), depth, most).join(self.nodes, "id")

    def get_node(self, node: str, most: int = 30) -> DataFrame:
        """A node's own row (depth 0) with its neighbours."""
        return self.get_neighbors(node, 1, most).orderBy("depth", "id")

    def explain(self, name: str, limit: int = 20) -> DataFrame:
        """The successors, by degree, of the node that a name means first: id, label, relation, confidence, degree."""
        first = traversal.matching(self.nodes, name, 1).select(F.col("id").alias("source"))
        after = self.edges.join(first, "source", "left_semi").select(F.col("target").alias("id"), "relation", "confidence")
        return graph.degrees(self.nodes, self.edges).join(after, "id").orderBy(F.desc("degree"), "id").limit(limit).select("id", "label", "relation", "confidence", "degree")

    def shortest_path(self, start: str, goal: str) -> DataFrame:
        return traversal.shortest_path(self.edges, self._one(start), self._one(goal))

    def filter_by_relation(self, relation: str) -> DataFrame:
        return self.edges.filter(F.col("relation") == relation)

    def callees_of(self, node: str) -> DataFrame:
        return self.edges.filter((F.col("source") == node) & (F.col("relation") == "calls")).orderBy(F.desc("weight"), "extracted_at", "edge_id")

    def callers_of(self, node: str) -> DataFrame:
        return self.edges.filter((F.col("target") == node) & (F.col("relation") == "calls")).orderBy(F.desc("weight"), "extracted_at", "edge_id")

    def find_hyperedges_for(self, node: str) -> DataFrame:
        return self.hyperedges.filter(F.array_contains("members", node))

    def list_hyperedges(self, kind: str | None = None) -> DataFrame:
        return self.hyperedges if kind is None else self.hyperedges.filter(F.col("type") == kind)

    def _members(self, key: int) -> DataFrame:
        return self.hyperedges.filter(F.col("hyperedge_key") == key).select(F.explode("members").alias("id")).filter("id is not null").distinct()

    def bridging_nodes(self, a: int, b: int, limit: int = 10) -> DataFrame:
        members = self._members(a).withColumn("side", F.lit("a")).unionByName(self._members(b).withColumn("side", F.lit("b")))
        return analysis.bridging(self.edges, members, limit)

    def centrality_within(self, key: int) -> DataFrame:
        return analysis.centrality_within(self.edges, self._members(key)).orderBy(F.desc("weighted_degree"), F.desc("degree"), "id")

    def god_nodes(self, top: int = 10) -> DataFrame:
        return analysis.gods(self.nodes, self.edges, top)

    def surprising_connections(self, top: int = 5) -> DataFrame:
        return analysis.surprising(self.nodes, self.edges, top)

    def communities(self) -> DataFrame:
        return community.communities(self.nodes, self.edges)
