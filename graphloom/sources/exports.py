"""Graphs as text: node-link JSON, GraphML, Cypher and linked notes; and node-link JSON read back.

Every export is a DataFrame of lines with their order, so it is written by
all executors at once; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NODE = ["id", "label", "file_type", "source_file", "source_location", "community", "description", "tags"]
_GROUP = ["id", "type", "label", "members", "size", "source_file"]
_EDGE = ["source", "target", "relation", "confidence", "weight"]


def node_link(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None = None) -> DataFrame:
    """One JSON object for each node, link and group: part ('nodes', 'links' or 'hyperedges'), key, line.  Nulls are left out."""
    n = nodes.select(F.lit("nodes").alias("part"), F.col("id").alias("key"), F.to_json(F.struct(*_NODE)).alias("line"))
    out = n.unionByName(edges.select(F.lit("links").alias("part"), F.concat_ws("|", "source", "target").alias("key"), F.to_json(F.struct(*_EDGE)).alias("line")))
    if hyperedges is None:
        return out
    one = hyperedges.groupBy("hyperedge_key").agg(*(F.any_value(x).alias(x) for x in _GROUP))
    return out.unionByName(one.select(F.lit("hyperedges").alias("part"), F.col("hyperedge_key").cast("string").alias("key"), F.to_json(F.struct(*_GROUP)).alias("line")))


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of node-link JSON files (links or edges), or of the lines that `node_link` writes with `part=` folders."""
    node = "array<struct<id:string,label:string,file_type:string,source_file:string,source_location:string,community:int,description:string,tags:array<string>>>"
    link = "array<struct<source:string,target:string,relation:string,confidence:string,weight:bigint>>"
    whole = spark.read.option("multiLine", True).schema(f"nodes {node}, links {link}, edges {link}").json(path)
    return whole.select(F.explode("nodes").alias("n")).select("n.*"), whole.select(F.explode(F.coalesce("links", "edges")).alias("e")).select("e.*")


def _xml(column: Column) -> Column:
    out = F.coalesce(column.cast("string"), F.lit(""))
    for sign, stands in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(stands))
    return out


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML elements: part, key, line.  Nulls are left out, lists are JSON."""

    def data(name: str, column: Column) -> Column:
        return F.when(column.isNotNull(), F.concat(F.lit(f'<data key="{name}">'), _xml(column), F.lit("</data>"))).otherwise(F.lit(""))

    n = F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), *[data(x, F.to_json("tags") if x == "tags" else F.col(x)) for x in _NODE[1:]], F.lit("</node>"))
    e = F.concat(F.lit('<edge source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('">'), *[data(x, F.col(x)) for x in _EDGE[2:]], F.lit("</edge>"))
    return nodes.select(F.lit("node").alias("part"), F.col("id").alias("key"), n.alias("line")).unionByName(edges.select(F.lit("edge").alias("part"), F.concat_ws("|", "source", "target").alias("key"), e.alias("line")))


def _quoted(column: Column) -> Column:
    escaped = F.replace(F.replace(F.coalesce(column.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), F.regexp_replace(escaped, r"[\r\n]+", " "), F.lit("'"))


def cypher(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame) -> DataFrame:
    """Cypher statements: step (nodes, relations, groups, members in this order), key, line."""
    n = nodes.select(F.lit(1).alias("step"), F.col("id").alias("key"), F.concat(F.lit("CREATE (:Node {id: "), _quoted(F.col("id")), F.lit(", label: "), _quoted(F.col("label")), F.lit(", file_type: "), _quoted(F.col("file_type")), F.lit("});")).alias("line"))
    kind = F.upper(F.regexp_replace(F.coalesce(F.nullif("relation", F.lit("")), F.lit("related")), "[^A-Za-z0-9]+", "_"))
    e = edges.select(
        F.lit(2).alias("step"), F.concat_ws("|", "source", "target").alias("key"),
        F.concat(F.lit("MATCH (a:Node {id: "), _quoted(F.col("source")), F.lit("}), (b:Node {id: "), _quoted(F.col("target")), F.lit("}) CREATE (a)-[:"), kind, F.lit(" {weight: "), F.col("weight").cast("string"), F.lit("}]->(b);")).alias("line"),
    )
    h = hyperedges.groupBy("hyperedge_key").agg(F.max("label").alias("label"), F.max("members").alias("members"))
    g = h.select(F.lit(3).alias("step"), F.col("hyperedge_key").cast("string").alias("key"), F.concat(F.lit("CREATE (:HyperEdge {id: "), F.col("hyperedge_key").cast("string"), F.lit(", label: "), _quoted(F.col("label")), F.lit("});")).alias("line"))
    m = h.select("hyperedge_key", F.explode("members").alias("m")).filter("m is not null").distinct()
    m = m.select(F.lit(4).alias("step"), F.concat_ws("|", F.col("hyperedge_key").cast("string"), "m").alias("key"), F.concat(F.lit("MATCH (a:Node {id: "), _quoted(F.col("m")), F.lit("}), (h:HyperEdge {id: "), F.col("hyperedge_key").cast("string"), F.lit("}) CREATE (a)-[:MEMBER_OF]->(h);")).alias("line"))
    return n.unionByName(e).unionByName(g).unionByName(m)


def notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of linked notes, one note a node: id, part (0 head, 1 out, 2 in), line.

    Each link is a line of its own, so a hub's note is never one value.
    """
    head = nodes.select("id", F.lit(0).alias("part"), F.concat(F.lit("# "), F.coalesce(F.nullif("label", F.lit("")), "id")).alias("line"))
    out = edges.select(F.col("source").alias("id"), F.lit(1).alias("part"), F.concat(F.lit("- "), F.coalesce("relation", F.lit("")), F.lit(" -> [["), "target", F.lit("]]")).alias("line"))
    back = edges.select(F.col("target").alias("id"), F.lit(2).alias("part"), F.concat(F.lit("- "), F.coalesce("relation", F.lit("")), F.lit(" <- [["), "source", F.lit("]]")).alias("line"))
    return head.unionByName(out).unionByName(back)


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """An export's lines as text files, in order within and over the files."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)
