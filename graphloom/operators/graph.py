"""Building a property graph from rows of nodes and edges: upserts, endpoint repair, validation, patches and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import normal_id, normal_path

#: Attributes of a node that an upsert keeps.
ATTRIBUTES = ["label", "file_type", "source_file", "source_location", "community", "description", "tags", "body", "language"]

# Fixed values of the graph's schema.
FILE_TYPES = ["code", "document", "paper", "image", "rationale", "concept"]
CONFIDENCES = ["EXTRACTED", "INFERRED", "AMBIGUOUS"]


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: every attribute as last written, where null is not written; created_at; deleted_at of the last row.

    Rows with a null id are left out.  The order is updated_at, then ingested_at.
    """
    order = F.struct("updated_at", "ingested_at")
    last = [F.max_by(x, F.when(F.col(x).isNotNull(), order)).alias(x) for x in ATTRIBUTES]
    state = nodes.filter("id is not null").groupBy("id").agg(*last, F.min("created_at").alias("created_at"), F.max_by(F.struct("deleted_at"), order).alias("d"))
    return state.withColumn("source_file", normal_path("source_file")).withColumn("deleted_at", F.col("d.deleted_at")).drop("d")


def live_nodes(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """The nodes that exist: not deleted, and the shared ones, which come first in the order (at, id)."""
    own = upsert_nodes(nodes).filter("deleted_at is null").withColumn("at", F.unix_micros(F.col("created_at").cast("timestamp"))).drop("created_at", "deleted_at")
    return own.unionByName(shared.select("id", "label", "file_type", "source_file", F.lit(0).cast("long").alias("at")), allowMissingColumns=True)


def repair_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are node ids: an end that is none is replaced by the last node of the same normal id; edges still dangling are dropped.

    Redelivered rows (equal edge_id) count once.
    """
    index = nodes.groupBy(normal_id("id").alias("normal")).agg(F.max_by("id", F.struct("at", "id")).alias("last"), F.collect_set("id").alias("ids"))
    rows = edges.filter("source is not null and target is not null").groupBy("edge_id").agg(F.min_by(F.struct(*[c for c in edges.columns if c != "edge_id"]), "ingested_at").alias("e")).select("edge_id", "e.*")
    for end in ("source", "target"):
        hit = index.select(F.col("normal").alias("n"), F.col("last").alias("l"), F.col("ids").alias("i"))
        rows = rows.withColumn("n", normal_id(end)).join(hit, "n").withColumn(end, F.when(F.array_contains("i", F.col(end)), F.col(end)).otherwise(F.col("l"))).drop("n", "l", "i")
    return rows.withColumn("source_file", normal_path("source_file")) if "source_file" in rows.columns else rows


def _last_runs(edges: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with relation r and order o, each pair's last relation with the end of the one before it, and the rows of each pair's last run."""
    pair = ["source", "target"]
    rows = edges.withColumn("r", F.coalesce("relation", F.lit("\x00"))).withColumn("o", F.struct(*order))
    last = rows.groupBy(*pair, "r").agg(F.max("o").alias("o"))  # a pair's relations are few, whatever its rows
    bounds = last.groupBy(*pair).agg(F.sort_array(F.collect_list(F.struct("o", "r")), asc=False).alias("l")).select(*pair, F.col("l")[0]["r"].alias("r"), F.try_element_at("l", F.lit(2))["o"].alias("after"))
    run = rows.join(bounds, [*pair, "r"]).filter(F.col("after").isNull() | (F.col("o") > F.col("after")))
    return rows, bounds, run


def edge_weights(edges: DataFrame, order: Sequence[str] = ("extracted_at", "edge_id")) -> DataFrame:
    """The edges of `upsert_edges` with their weights only."""
    return _last_runs(edges, order)[2].groupBy("source", "target").agg(F.count("*").alias("weight"))


def upsert_edges(edges: DataFrame, order: Sequence[str] = ("extracted_at", "edge_id")) -> DataFrame:
    """One edge for each pair of ends, as the last unbroken run of one relation leaves it.

    relation, confidence, place and context are of the run's first row,
    weight is the run's length.  A null relation is equal to itself.
    call_sites are the distinct places of the rows that repeat a relation, in
    order, behind the place that their relation began at; they outlive the
    run, so that later runs add to them.  Null where no row repeats one.
    Only pairs with several relations are looked at row by row.
    """
    pair = ["source", "target"]
    rows, bounds, run = _last_runs(edges, order)
    first = [F.min_by(x, "o").alias(x) for x in ("relation", "confidence", "source_file", "source_location", "context", *order)]
    out = run.groupBy(*pair).agg(*first, F.count("*").alias("weight"))
    only = run.filter(F.col("after").isNull()).select(*pair, "o", "source_location")
    several = bounds.filter(F.col("after").isNotNull()).select(*pair)
    placed = _ordered_places(only.filter("source_location is not null"), pair)
    left = _ordered_places(_repeats(rows.join(several, pair, "left_semi"), pair), pair)
    plain = out.join(several, pair, "left_anti").join(placed, pair, "left").withColumn("call_sites", F.when(F.col("weight") > 1, F.coalesce("places", F.array().cast("array<string>"))))
    mixed = out.join(several, pair, "left_semi").join(left, pair, "left").withColumnRenamed("places", "call_sites")
    return plain.drop("places").unionByName(mixed)


def _ordered_places(rows: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Each pair's distinct places (o, source_location) in the order of their first row."""
    each = rows.groupBy(*pair, "source_location").agg(F.min("o").alias("o"))
    return each.groupBy(*pair).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "source_location"))), lambda x: x["source_location"]).alias("places"))


def _repeats(rows: DataFrame, pair: Sequence[str]) -> DataFrame:
    """The rows that repeat the relation before them, and ahead of the first of these the place that its relation began at."""
    ordered = Window.partitionBy(*pair).orderBy("o")
    fresh = F.coalesce(F.lag("r").over(ordered) != F.col("r"), F.lit(True))
    marked = rows.withColumn("fresh", fresh).withColumn("began", F.last(F.when(F.col("fresh"), F.col("source_location")), ignorenulls=True).over(ordered))
    again = marked.filter("not fresh and source_location is not null and began is not null")
    ahead = again.groupBy(*pair).agg(F.min(F.struct("o", F.lit(0).alias("n"), "began")).alias("f")).select(*pair, F.struct("f.o", "f.n").alias("o"), F.col("f.began").alias("source_location"))
    return again.select(*pair, F.struct("o", F.lit(1).alias("n")).alias("o"), "source_location").unionByName(ahead)


def relation_edges(edges: DataFrame) -> DataFrame:
    """The lossless view: one edge for each source, target and relation, with its number of rows."""
    return edges.groupBy("source", "target", "relation").agg(F.count("*").alias("weight"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], most: int, slices: int = 32) -> DataFrame:
    """The first `most` rows of each group, with their place from 1.

    Each group is ranked in slices first, so only slices * most rows of a
    large group come together.
    """
    part = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(slices))
    few = df.withColumn("_slice", part).withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))).filter(F.col("_place") <= most)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= most).drop("_slice", "_place")


def relation_edges(edges: DataFrame) -> DataFrame:
    """The lossless view: one edge for each source, target and relation, with its number of rows."""
    return edges.groupBy("source", "target", "relation").agg(F.count("*").alias("weight"))


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """Every edge in both directions: a, b and the kept columns."""
    there = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), *keep)
    return there.unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), *keep))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node's degree, in and out; a loop counts twice, an isolated node has 0."""
    ends = both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def validation(nodes: DataFrame, edges: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows that break the schema: kind, key, message.

    Missing required fields and unknown enumeration values of nodes and
    edges, and edges whose end is no node id.  Key is the node's or edge's.
    """

    def missing(df: DataFrame, kind: str, key: Column, fields: Sequence[str]) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f"missing {f}")) for f in fields]))
        return df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.explode(found).alias("message"))

    def unknown(df: DataFrame, kind: str, key: Column, field: str, values: Sequence[str]) -> DataFrame:
        return df.filter(F.col(field).isNotNull() & (F.col(field) != "") & ~F.col(field).isin(*values)).select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.concat(F.lit(f"unknown {field} "), F.col(field)).alias("message"))

    ids = nodes.select("id").unionByName(shared.select("id")).distinct()
    out = missing(nodes, "node", F.col("id"), ["label", "file_type", "source_file"]).unionByName(unknown(nodes, "node", F.col("id"), "file_type", FILE_TYPES))
    out = out.unionByName(missing(edges, "edge", F.col("edge_id"), ["source", "target", "relation", "confidence", "source_file"])).unionByName(unknown(edges, "edge", F.col("edge_id"), "confidence", CONFIDENCES))
    for end in ("source", "target"):
        orphan = edges.filter(F.coalesce(F.col(end), F.lit("")) != "").join(ids, F.col(end) == F.col("id"), "left_anti")
        out = out.unionByName(orphan.select(F.lit("edge").alias("kind"), F.col("edge_id").cast("string").alias("key"), F.lit(f"{end} is no node").alias("message")))
    return out.distinct()


def _filled(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def tag_union(*columns: Column) -> Column:
    """The distinct tags of several lists, sorted; null lists are empty."""
    out = F.array().cast("array<string>")
    for column in columns:
        out = F.array_union(out, F.coalesce(column, F.array().cast("array<string>")))
    return F.array_sort(out)


def patch_nodes(nodes: DataFrame, patch: DataFrame) -> DataFrame:
    """Nodes after a semantic patch: new ids are inserted; a known node keeps its description if it has one, and gains the patch's tags.

    Both have id, label, file_type, source_file, description and tags, one row for each id.
    """
    p = patch.select(*[F.col(c).alias(f"p_{c}") for c in ("id", "label", "file_type", "source_file", "description", "tags")])
    both = nodes.join(p, F.col("id") == F.col("p_id"), "full_outer")
    known = F.col("id").isNotNull()
    pick = lambda c: F.when(known, F.col(c)).otherwise(F.col(f"p_{c}")).alias(c)
    return both.select(F.coalesce("id", "p_id").alias("id"), pick("label"), pick("file_type"), pick("source_file"), F.coalesce(_filled("description"), F.col("p_description")).alias("description"), tag_union(F.col("tags"), F.col("p_tags")).alias("tags"), (~known).alias("inserted"))


def patch_edges(edges: DataFrame, patch: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges a patch adds: distinct triples without nulls, not known yet, both of whose ends exist."""
    triple = ["source", "target", "relation"]
    new = patch.select(*triple).dropna().distinct().join(edges.select(*triple).distinct(), triple, "left_anti")
    for end in ("source", "target"):
        new = new.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return new


def enrich(nodes: DataFrame, patch: DataFrame) -> DataFrame:
    """Nodes after an enrichment: a given description replaces the old one, tags are united."""
    p = patch.select("id", F.col("description").alias("p_description"), F.col("tags").alias("p_tags"))
    return nodes.join(p, "id", "left").select("id", F.coalesce(_filled("p_description"), F.col("description")).alias("description"), F.when(F.col("p_tags").isNull(), F.array_sort("tags")).otherwise(tag_union(F.col("tags"), F.col("p_tags"))).alias("tags"))


def merge_nodes(graphs: DataFrame) -> DataFrame:
    """Nodes of several graphs (graph: its number, name): the first filled value of each attribute, all tags, all graph names."""
    first = [F.min_by(x, F.when(F.coalesce(F.col(x), F.lit("")) != "", F.col("graph"))).alias(x) for x in ("label", "file_type", "source_file", "description")]
    return graphs.groupBy("id").agg(*first, F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"), F.array_sort(F.collect_set("name")).alias("source_graph"))


def confidence_rank(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column == "EXTRACTED", 3).when(column == "INFERRED", 2).when(column == "AMBIGUOUS", 1).otherwise(0)


def merge_edges(graphs: DataFrame) -> DataFrame:
    """Edges of several graphs: of each triple the row of highest confidence, of equals the one of the first graph."""
    order = F.struct((-confidence_rank("confidence")).alias("r"), "graph", "edge_id")
    return graphs.groupBy("source", "target", "relation").agg(F.min_by("confidence", order).alias("confidence"), F.min_by("graph", order).alias("graph"), F.count("*").alias("n_rows"))
