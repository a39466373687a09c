"""Queries over the graph that the node and edge tables make, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import normal_id
from graphloom.operators import analysis, community, graph, traversal
from graphloom.sources.tables import kept, table, written

QUESTION = "how does the parser index call the graph router"
DEPTH = 3


_NODES, _EDGES = ["nodes", "shared_nodes"], ["nodes", "shared_nodes", "edges"]


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return kept(spark, folder, _NODES, "nodes", lambda: graph.live_nodes(table(spark, folder, "nodes"), table(spark, folder, "shared_nodes")))


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    return kept(spark, folder, _EDGES, "repaired", lambda: graph.repair_ends(table(spark, folder, "edges"), _nodes(spark, folder)))


def _built(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and simple edges, built once in a session, as a question or an analysis reads them several times."""
    return _nodes(spark, folder), kept(spark, folder, _EDGES, "simple-edges", lambda: graph.upsert_edges(_repaired(spark, folder)))


def _weights(spark: SparkSession, folder: str, nodes: DataFrame) -> DataFrame:
    """Ends and weights of the simple edges, without what else an edge keeps."""
    rows = table(spark, folder, "edges").select("edge_id", "source", "target", "relation", "extracted_at", "ingested_at")
    repaired = written(graph.repair_ends(rows, nodes).select("edge_id", "source", "target", "relation", "extracted_at"), "ends")
    return graph.edge_weights(repaired)


def _ways(spark: SparkSession, folder: str) -> DataFrame:
    """The simple edges in both directions, once each."""
    return kept(spark, folder, _EDGES, "ways", lambda: traversal.undirected(_built(spark, folder)[1]))


def _two_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The members of the two largest groups (of equals the ones of least key), as sides a and b."""
    h = table(spark, folder, "hyperedges").groupBy("hyperedge_key").agg(F.max("members").alias("members"))
    two = h.orderBy(F.desc(F.size("members")), "hyperedge_key").limit(2)
    ranked = two.withColumn("side", F.when(F.row_number().over(Window.orderBy(F.desc(F.size("members")), "hyperedge_key")) == 1, "a").otherwise("b"))
    return ranked.select("side", F.explode("members").alias("id")).filter("id is not null").distinct()


def _hub(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return written(analysis.gods(nodes, edges, 1), "hub")


def node_upsert(spark, folder):
    """Every node as last written."""
    state = graph.upsert_nodes(table(spark, folder, "nodes"))
    return state.select("id", "label", "file_type", "source_file", "source_location", "community", "description", F.array_join(F.array_sort("tags"), ",").alias("tags"), F.col("deleted_at").isNotNull().alias("deleted"))


def edge_repair(spark, folder):
    """Edges with repaired ends."""
    return _repaired(spark, folder).select("edge_id", "source", "target", "relation")


def edge_upsert_runs(spark, folder):
    """Simple edges with the weight of their last run of one relation."""
    return graph.upsert_edges(_repaired(spark, folder)).select("source", "target", "relation", "confidence", "source_location", "weight", F.array_join("call_sites", ",").alias("call_sites"))


def relation_edges(spark, folder):
    """The lossless edges by source, target and relation."""
    return graph.relation_edges(_repaired(spark, folder))


def validate_errors(spark, folder):
    """Rows that break the schema."""
    return graph.validation(table(spark, folder, "nodes"), table(spark, folder, "edges"), table(spark, folder, "shared_nodes")).groupBy("kind", "message").agg(F.count("*").alias("n_rows"))


def _patch(spark, folder) -> DataFrame:
    """A patch derived from documents: each titled document describes a node named by its title."""
    d = table(spark, folder, "documents").filter("title is not null and title <> ''")
    one = d.groupBy(normal_id("title").alias("id")).agg(F.min_by("title", "doc_id").alias("label"), F.min_by("source_file", "doc_id").alias("source_file"), F.min_by("source", "doc_id").alias("description"), F.array_sort(F.collect_set(F.coalesce("vault", F.lit("")))).alias("tags"))
    return one.withColumn("file_type", F.lit("document"))


def _patched_base(spark, folder) -> DataFrame:
    """The nodes whose ids a patch may name: those of the graph, and half of the titles, which the graph knows by now."""
    nodes = _nodes(spark, folder).select("id", "label", "file_type", "source_file", "description", "tags")
    old = _patch(spark, folder).filter(F.col("label").substr(1, 1) < "M").select("id", "label", "file_type", "source_file", F.when(F.col("label").substr(1, 1) < "F", F.lit("known")).alias("description"), F.array(F.lit("known")).alias("tags"))
    return nodes.unionByName(old.join(nodes.select("id"), "id", "left_anti"))


def apply_semantic_nodes(spark, folder):
    """Nodes after a semantic patch."""
    out = graph.patch_nodes(_patched_base(spark, folder), _patch(spark, folder))
    return out.select("id", "label", "description", F.array_join("tags", ",").alias("tags"), "inserted")


def apply_semantic_edges(spark, folder):
    """Edges that the snapshots' edges would add to the graph."""
    nodes = _nodes(spark, folder)
    return graph.patch_edges(_repaired(spark, folder), table(spark, folder, "edge_snapshots"), nodes)


def apply_enrichments(spark, folder):
    """Nodes after an enrichment patch."""
    out = graph.enrich(_patched_base(spark, folder), _patch(spark, folder))
    return out.select("id", "description", F.array_join("tags", ",").alias("tags"))


def merge_nodes(spark, folder):
    """The snapshots' nodes merged as graphs of their own."""
    s = table(spark, folder, "node_snapshots")
    one = s.groupBy("snapshot_id", "id").agg(*[F.min(c).alias(c) for c in ("label", "file_type", "description")], F.min(F.replace("source_file", F.lit("\\"), F.lit("/"))).alias("source_file"), F.min(F.array_sort("tags")).alias("tags"))
    out = graph.merge_nodes(one.withColumn("graph", F.col("snapshot_id")).withColumn("name", F.concat(F.lit("s"), "snapshot_id")))
    return out.select("id", "label", "file_type", "source_file", "description", F.array_join("tags", ",").alias("tags"), F.array_join("source_graph", ",").alias("source_graph"))


def merge_edges(spark, folder):
    """The snapshots' edges merged as graphs of their own: the surest confidence wins."""
    s = table(spark, folder, "edge_snapshots").select("source", "target", "relation", "confidence", F.col("snapshot_id").alias("graph")).distinct().withColumn("edge_id", F.lit(0))
    return graph.merge_edges(s).select("source", "target", "relation", "confidence", "graph")


def graph_counts(spark, folder):
    """Nodes and simple edges."""
    nodes, edges = _built(spark, folder)
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight")))


def degree_all(spark, folder):
    nodes, edges = _built(spark, folder)
    return graph.degrees(nodes, edges).select("id", "degree")


def god_nodes(spark, folder):
    return analysis.gods(*_built(spark, folder))


def confidence_distribution(spark, folder):
    return _built(spark, folder)[1].groupBy(F.coalesce("confidence", F.lit("?")).alias("confidence")).agg(F.count("*").alias("n_edges"))


def relation_distribution(spark, folder):
    return _built(spark, folder)[1].groupBy("relation").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))


def surprising_connections(spark, folder):
    return analysis.surprising(*_built(spark, folder))


def community_summary(spark, folder):
    return analysis.communities(_nodes(spark, folder))


def cohesion(spark, folder):
    return analysis.cohesion(*_built(spark, folder))


def weighted_degree_p95(spark, folder):
    return analysis.hub_threshold(*_built(spark, folder))


def isolates(spark, folder):
    nodes, edges = _built(spark, folder)
    return graph.degrees(nodes, edges).filter("degree = 0").select("id")


def class_groups(spark, folder):
    return analysis.class_groups(*_built(spark, folder))


def community_groups(spark, folder):
    return analysis.community_groups(*_built(spark, folder)).select("community", "size", "n_real", "label")


def centrality_within(spark, folder):
    _, edges = _built(spark, folder)
    return analysis.centrality_within(edges, _two_groups(spark, folder).filter("side = 'a'").select("id"))


def bridging_nodes(spark, folder):
    _, edges = _built(spark, folder)
    return analysis.bridging(edges, _two_groups(spark, folder))


def hyperedges_for(spark, folder):
    """For every node, the groups that hold it."""
    h = table(spark, folder, "hyperedges").select("hyperedge_key", "type", F.explode("members").alias("id")).filter("id is not null").distinct()
    return h.groupBy("id").agg(F.count("*").alias("n_groups"), F.min("hyperedge_key").alias("first_group"))


def list_hyperedges(spark, folder):
    """Groups by type."""
    h = table(spark, folder, "hyperedges").groupBy("hyperedge_key", "id", "type", "label").agg(F.max("size").alias("size"))
    return h.filter("type = 'community'").select("hyperedge_key", "id", "label", "size")


def find_nodes(spark, folder):
    return traversal.find(_nodes(spark, folder), QUESTION).select("id", "score")


def find_nodes_short(spark, folder):
    """A question of short words only is looked for as a whole."""
    nodes, edges = _built(spark, folder)
    return traversal.find(nodes, "ce", edges=edges).select("id", "score")


def find_nodes_folded(spark, folder):
    """Scores of all nodes against terms with accents."""
    return traversal.term_scores(_nodes(spark, folder), ["élève", "größe", "modèle"]).select("id", "score")


def infer_context(spark, folder):
    """Which contexts the documents' text hints at."""
    text = F.array_distinct(F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[?,]", " ")), r"\s+"))
    hints = F.array(*[F.struct(F.lit(c).alias("context"), F.array(*map(F.lit, h)).alias("words")) for c, h in traversal.HINTS.items()])
    d = table(spark, folder, "documents").select(F.explode(F.filter(hints, lambda h: F.arrays_overlap(h["words"], text))).alias("h"))
    return d.groupBy("h.context").agg(F.count("*").alias("n_documents"))


def context_filter_edges(spark, folder):
    return traversal.in_contexts(_built(spark, folder)[1], traversal.contexts_of("what calls or returns the parser")[0]).select("source", "target", "context")


def filter_by_relation(spark, folder):
    """Edges of one relation with the labels of their ends."""
    nodes, edges = _built(spark, folder)
    s, t = nodes.select(F.col("id").alias("source"), F.col("label").alias("source_label")), nodes.select(F.col("id").alias("target"), F.col("label").alias("target_label"))
    return edges.filter("relation = 'contains'").join(s, "source").join(t, "target").select("source", "source_label", "target", "target_label")


def filter_by_decorator(spark, folder):
    """Nodes that use a decorator whose name holds a word."""
    nodes, edges = _built(spark, folder)
    named = nodes.filter(F.col("label").startswith("@") & F.lower("label").contains("trace")).select(F.col("id").alias("b"), F.col("label").alias("decorator"))
    near = graph.both_ways(edges.filter("relation = 'uses'")).join(named, "b").select(F.col("a").alias("id"), "decorator").distinct()
    return near.join(nodes.select("id", "label"), "id")


def callers_of(spark, folder):
    """Who calls the node that is called most."""
    edges = _built(spark, folder)[1].filter("relation = 'calls'")
    most = edges.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(1).select("target")
    return edges.join(most, "target", "left_semi").select("source", "target", "weight")


def callees_of(spark, folder):
    """What the node that calls most calls."""
    edges = _built(spark, folder)[1].filter("relation = 'calls'")
    most = edges.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(1).select("source")
    return edges.join(most, "source", "left_semi").select("source", "target", "weight")


def _asked(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _built(spark, folder)
    return nodes, edges, written(traversal.find(nodes, QUESTION, 3).select("id"), "seeds")


def bfs_nodes(spark, folder):
    _, edges, seeds = _asked(spark, folder)
    return traversal.walk(edges, seeds, DEPTH)


def bfs_edges(spark, folder):
    _, edges, seeds = _asked(spark, folder)
    return traversal.walk_edges(edges, traversal.walk(edges, seeds, DEPTH)).select("source", "target", "relation")


def question_query(spark, folder):
    """The nodes a question reaches, with label, distance and degree."""
    nodes, edges, seeds = _asked(spark, folder)
    return graph.degrees(nodes, edges).join(traversal.walk(edges, seeds, DEPTH), "id").select("id", "label", "depth", "degree")


def render_nodes(spark, folder):
    """The answer to the question as text within its budget."""
    nodes, edges, seeds = _asked(spark, folder)
    return traversal.rendered(nodes, edges, traversal.walk(edges, seeds, DEPTH))


def dfs_nodes(spark, folder):
    _, edges, seeds = _asked(spark, folder)
    return traversal.depth_first(edges, seeds, DEPTH)


def khop_neighbors(spark, folder):
    """The nearest nodes of the hub."""
    nodes, edges = _built(spark, folder)
    return traversal.neighbours(edges, _hub(nodes, edges), 2)


def khop_induced_edges(spark, folder):
    nodes, edges = _built(spark, folder)
    near = written(traversal.neighbours(edges, _hub(nodes, edges), 2), "near")
    return traversal.induced(edges, near).select("source", "target", "relation", "weight")


def explain(spark, folder):
    """The successors, by degree, of the node that has most."""
    nodes, edges = _built(spark, folder)
    most = edges.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(1).select("source")
    after = edges.join(most, "source", "left_semi").select(F.col("target").alias("id"), "relation")
    return graph.degrees(nodes, edges).join(after, "id").orderBy(F.desc("degree"), "id").limit(20).select("id", "label", "relation", "degree")


def match_nodes(spark, folder):
    """The nodes that a name means."""
    return traversal.matching(_nodes(spark, folder), "Parser")


def _ends(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _built(spark, folder)
    return edges, written(traversal.find(nodes, "parser", 1).select("id"), "start"), written(traversal.find(nodes, "quartz", 1).select("id"), "goal")


def shortest_path_length(spark, folder):
    _, start, goal = _ends(spark, folder)
    return traversal.distances(_ways(spark, folder), start, goal).join(goal, "id", "left_semi").select("id", F.col("depth").alias("length"))


def shortest_path_nodes(spark, folder):
    edges, start, goal = _ends(spark, folder)
    return traversal.shortest_path(edges, start, goal)


def connected_components(spark, folder):
    nodes, edges = _built(spark, folder)
    return traversal.components(nodes, edges)


def louvain(spark, folder):
    """Communities by synchronous Louvain, the largest first."""
    nodes = _nodes(spark, folder)
    return community.communities(nodes, _weights(spark, folder, nodes))


def _two_snapshots(spark, folder, name: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, folder, name)
    ends = s.agg(F.min(F.struct("snapshot_at", "snapshot_id")).alias("a"), F.max(F.struct("snapshot_at", "snapshot_id")).alias("b")).select(F.col("a.snapshot_id").alias("a"), F.col("b.snapshot_id").alias("b"))
    both = s.crossJoin(F.broadcast(ends))  # one row
    return both.filter("snapshot_id = a"), both.filter("snapshot_id = b")


def _one_sided(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.subtract(new).withColumn("change", F.lit("removed")).unionByName(new.subtract(old).withColumn("change", F.lit("added")))


def evolution_nodes(spark, folder):
    """Node ids only in the first or only in the last snapshot."""
    old, new = _two_snapshots(spark, folder, "node_snapshots")
    return _one_sided(old.select("id"), new.select("id"))


def evolution_edges(spark, folder):
    old, new = _two_snapshots(spark, folder, "edge_snapshots")
    triple = ["source", "target", "relation"]
    return _one_sided(old.select(*triple), new.select(*triple))


def evolution_moves(spark, folder):
    """Nodes that left the community their old one became."""
    old, new = _two_snapshots(spark, folder, "node_snapshots")
    return traversal.drift(old.select("id", "community").distinct(), new.select("id", "community").distinct())


def evolution_totals(spark, folder):
    n, e, m = evolution_nodes(spark, folder), evolution_edges(spark, folder), evolution_moves(spark, folder)
    out = n.groupBy(F.concat(F.lit("nodes "), "change").alias("what")).agg(F.count("*").alias("n")).unionByName(e.groupBy(F.concat(F.lit("edges "), "change").alias("what")).agg(F.count("*").alias("n")))
    return out.unionByName(m.agg(F.lit("nodes moved").alias("what"), F.count("*").alias("n")))


_NORM = "lower(trim(regexp_replace({}, '[^a-zA-Z0-9]+', '_', 'g'), '_'))"
_STATE = r"""state AS (
  SELECT id, {}, min(created_at) AS created_at, arg_max(coalesce(deleted_at, TIMESTAMP '9999-01-01'), (updated_at, ingested_at)) AS gone FROM nodes WHERE id IS NOT NULL GROUP BY id
)""".format(", ".join(f"arg_max({x}, (updated_at, ingested_at)) FILTER ({x} IS NOT NULL) AS {x}" for x in graph.ATTRIBUTES))
_N = (
    "WITH RECURSIVE " + _STATE + r""", n AS MATERIALIZED (
  SELECT id, label, file_type, replace(source_file, '\', '/') AS source_file, source_location, community, description, tags, epoch_us(created_at) AS born FROM state WHERE gone = TIMESTAMP '9999-01-01'
  UNION ALL SELECT id, label, file_type, source_file, NULL, NULL, NULL, NULL, 0 FROM shared_nodes
)"""
)
_R = _N + f""", idx AS (SELECT {_NORM.format("id")} AS k, arg_max(id, (born, id)) AS newest, list(DISTINCT id) AS ids FROM n GROUP BY 1), e0 AS (
  SELECT * FROM edges WHERE source IS NOT NULL AND target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at) = 1
), e1 AS MATERIALIZED (
  SELECT e0.edge_id, CASE WHEN list_contains(i.ids, e0.source) THEN e0.source ELSE i.newest END AS source, CASE WHEN list_contains(j.ids, e0.target) THEN e0.target ELSE j.newest END AS target,
    relation, confidence, source_location, context, extracted_at
  FROM e0 JOIN idx i ON i.k = {_NORM.format("e0.source")} JOIN idx j ON j.k = {_NORM.format("e0.target")}
)"""
_G = _R + r""", f AS (
  SELECT *, CASE WHEN relation IS DISTINCT FROM lag(relation) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM e1 WINDOW w AS (PARTITION BY source, target ORDER BY extracted_at, edge_id)
), r AS (SELECT *, sum(fresh) OVER (PARTITION BY source, target ORDER BY extracted_at, edge_id) AS run FROM f), g AS MATERIALIZED (
  SELECT source, target, arg_min(relation, (extracted_at, edge_id)) FILTER (relation IS NOT NULL) AS relation, first(confidence ORDER BY extracted_at, edge_id) AS confidence, first(source_location ORDER BY extracted_at, edge_id) AS source_location,
    first(context ORDER BY extracted_at, edge_id) AS context, min(extracted_at) AS extracted_at, first(edge_id ORDER BY extracted_at, edge_id) AS edge_id, count(*) AS weight, list(source_location ORDER BY extracted_at, edge_id) AS places
  FROM (SELECT *, max(run) OVER (PARTITION BY source, target) AS top FROM r) WHERE run = top GROUP BY source, target
), ways AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM g UNION ALL SELECT target, source FROM g)),
ends AS (SELECT source AS id, target AS other, weight FROM g UNION ALL SELECT target, source, weight FROM g),
d AS MATERIALIZED (SELECT n.*, coalesce(k, 0) AS degree FROM n LEFT JOIN (SELECT id, count(*) AS k FROM ends GROUP BY id) USING (id))"""  # fmt: skip
_BASE = "regexp_extract(coalesce(source_file, ''), '[^/]*$')"
_FILE = f"(coalesce(label, '') <> '' AND (label = {_BASE} OR (label LIKE '%()' AND degree <= 1)))"
_GODS = f"SELECT id, label, degree FROM d WHERE NOT {_FILE} ORDER BY degree DESC, born, id LIMIT "


def _score_sql(words: list[str], fold: str = "lower({})") -> str:
    parts = []
    label, source, description = fold.format("coalesce(label, '')"), "lower(coalesce(source_file, ''))", fold.format("coalesce(description, '')")
    for w in words:
        parts.append(f"CASE WHEN contains({label}, '{w}') THEN 10 ELSE 0 END + CASE WHEN contains({source}, '{w}') THEN 5 ELSE 0 END + CASE WHEN contains({description}, '{w}') THEN 3 ELSE 0 END + 20 * len(list_filter(coalesce(tags, []), lambda t: contains({fold.format('t')}, '{w}')))")
    some = ", ".join(f"'{w}'" for w in words)
    return " + ".join(parts) + f" + CASE WHEN {label} IN ({some}) OR rtrim({label}, '()') IN ({some}) THEN 1000 ELSE 0 END"


def _find_sql(question: str, limit: int) -> str:
    return f"SELECT id, score FROM (SELECT id, {_score_sql(traversal.terms_of(question))} AS score FROM n) WHERE score > 0 ORDER BY score DESC, id DESC LIMIT {limit}"


def _walk_sql(steps: str, seeds: str, depth: int) -> str:
    return f", seeds AS MATERIALIZED ({seeds}), w AS (SELECT id, 0 AS depth FROM seeds UNION SELECT s.b, w.depth + 1 FROM w JOIN ({steps}) s ON s.a = w.id WHERE w.depth < {depth}), reached AS MATERIALIZED (SELECT id, min(depth) AS depth FROM w GROUP BY id)"


_BFS = _G + _walk_sql("SELECT source AS a, target AS b FROM g", f"SELECT id FROM ({_find_sql(QUESTION, 3)})", DEPTH)
_NEAR = _G + _walk_sql("SELECT * FROM ways", f"SELECT id FROM ({_GODS} 1)", 2) + ", near AS MATERIALIZED (SELECT id, depth FROM reached ORDER BY depth, id LIMIT 30)"
_PATH = _G + _walk_sql("SELECT * FROM ways", f"SELECT id FROM ({_find_sql('parser', 1)})", 8) + f", goal AS (SELECT id FROM ({_find_sql('quartz', 1)}))"
_GROUPS = r""", two AS (SELECT hyperedge_key, any_value(members) AS members FROM hyperedges GROUP BY 1 ORDER BY len(any_value(members)) DESC, 1 LIMIT 2),
m AS MATERIALIZED (SELECT DISTINCT side, id FROM (SELECT CASE WHEN row_number() OVER (ORDER BY len(members) DESC, hyperedge_key) = 1 THEN 'a' ELSE 'b' END AS side, unnest(members) AS id FROM two) WHERE id IS NOT NULL)"""
_PATCH = f"patch AS (SELECT {_NORM.format('title')} AS id, arg_min(title, doc_id) AS label, arg_min(source_file, doc_id) AS source_file, arg_min(source, doc_id) AS description, list_sort(list(DISTINCT coalesce(vault, ''))) AS tags, 'document' AS file_type FROM documents WHERE title <> '' GROUP BY 1)"
_PATCHED = (
    _N + ", " + _PATCH + r""", base AS (
  SELECT id, label, file_type, source_file, description, tags FROM n
  UNION ALL SELECT id, label, file_type, source_file, CASE WHEN label[1] < 'F' THEN 'known' END, ['known'] FROM patch WHERE label[1] < 'M' AND id NOT IN (SELECT id FROM n)
)"""
)
_ENDS_OF = "t AS (SELECT min((snapshot_at, snapshot_id)) AS a, max((snapshot_at, snapshot_id)) AS b FROM {0}), old AS (SELECT {0}.* FROM {0}, t WHERE snapshot_id = a[2]), new AS (SELECT {0}.* FROM {0}, t WHERE snapshot_id = b[2])"
_EVO = "SELECT *, 'removed' AS change FROM (SELECT {0} FROM old EXCEPT SELECT {0} FROM new) UNION ALL SELECT *, 'added' FROM (SELECT {0} FROM new EXCEPT SELECT {0} FROM old)"
_EVO_N = "WITH " + _ENDS_OF.format("node_snapshots") + " " + _EVO.format("id")
_EVO_E = "WITH " + _ENDS_OF.format("edge_snapshots") + " " + _EVO.format("source, target, relation")
_EVO_M = (
    "WITH " + _ENDS_OF.format("node_snapshots") + r""", b AS (SELECT DISTINCT o.id, o.community AS old, w.community AS new FROM old o JOIN new w ON o.id = w.id WHERE o.community IS NOT NULL AND w.community IS NOT NULL),
c AS (SELECT old, new, count(*) AS n FROM b GROUP BY ALL), j AS (SELECT c.*, CAST(n AS double) / (sum(n) OVER (PARTITION BY old) + sum(n) OVER (PARTITION BY new) - n) AS j FROM c),
x AS (SELECT old, arg_max(new, (j, -new)) AS expected FROM j GROUP BY old)
SELECT b.id, b.old, b.new, x.expected FROM b JOIN x ON b.old = x.old WHERE b.new <> x.expected"""
)


def _missing(kind: str, source: str, key: str, fields: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, CAST({key} AS varchar) AS key, 'missing {f}' AS message FROM {source} WHERE coalesce({f}, '') = ''" for f in fields)


_VALID = " UNION ALL ".join([
    _missing("node", "nodes", "id", ["label", "file_type", "source_file"]), _missing("edge", "edges", "edge_id", ["source", "target", "relation", "confidence", "source_file"]),
    f"SELECT 'node', id, 'unknown file_type ' || file_type FROM nodes WHERE file_type <> '' AND file_type NOT IN {tuple(graph.FILE_TYPES)}",
    f"SELECT 'edge', CAST(edge_id AS varchar), 'unknown confidence ' || confidence FROM edges WHERE confidence <> '' AND confidence NOT IN {tuple(graph.CONFIDENCES)}",
    *(f"SELECT 'edge', CAST(edge_id AS varchar), '{x} is no node' FROM edges WHERE {x} <> '' AND {x} NOT IN (SELECT id FROM nodes UNION ALL SELECT id FROM shared_nodes)" for x in ("source", "target")),
])
_TAGS = "array_to_string(list_sort(list_distinct(list_concat(coalesce(b.tags, []), coalesce(p.tags, [])))), ',')"
# Written out here, so that the SQL doesn't repeat a fault of the operator's tables.
_FAMILY = r"""(SELECT any_value(f) FROM (VALUES ('py', 'python'), ('js', 'js'), ('jsx', 'js'), ('mjs', 'js'), ('ejs', 'js'), ('ts', 'js'), ('tsx', 'js'), ('vue', 'js'), ('svelte', 'js'), ('go', 'go'), ('rs', 'rust'), ('java', 'jvm'), ('kt', 'jvm'),
('kts', 'jvm'), ('scala', 'jvm'), ('c', 'c'), ('h', 'c'), ('cpp', 'c'), ('cc', 'c'), ('cxx', 'c'), ('hpp', 'c'), ('rb', 'ruby'), ('swift', 'swift'), ('cs', 'dotnet'), ('php', 'php'), ('r', 'r')) x(e, f) WHERE e = lower(regexp_extract({}, '\.([^./]+)$', 1)))"""
_CATEGORY = r"""CASE WHEN lower({0}) SIMILAR TO '.*\.(py|ts|js|jsx|tsx|mjs|ejs|go|rs|java|cpp|cc|cxx|c|h|hpp|rb|swift|kt|kts|cs|scala|php|lua|toc|zig|ps1|ex|exs|m|mm|jl|vue|svelte|dart|v|sv|sql|r)' THEN 'code'
WHEN lower({0}) LIKE '%.pdf' THEN 'paper' WHEN lower({0}) SIMILAR TO '.*\.(png|jpg|jpeg|gif|webp|svg)' THEN 'image' ELSE 'doc' END"""

QUERIES = {
    f.__name__: f
    for f in (
        node_upsert, edge_repair, edge_upsert_runs, relation_edges, validate_errors, apply_semantic_nodes, apply_semantic_edges, apply_enrichments, merge_nodes, merge_edges, graph_counts, degree_all, god_nodes,
        confidence_distribution, relation_distribution, surprising_connections, community_summary, cohesion, weighted_degree_p95, isolates, class_groups, community_groups, centrality_within, bridging_nodes, hyperedges_for,
        list_hyperedges, find_nodes, find_nodes_short, find_nodes_folded, infer_context, context_filter_edges, filter_by_relation, filter_by_decorator, callers_of, callees_of, bfs_nodes, bfs_edges, question_query, render_nodes, dfs_nodes,
        khop_neighbors, khop_induced_edges, explain, match_nodes, shortest_path_length, shortest_path_nodes, connected_components, louvain, evolution_nodes, evolution_edges, evolution_moves, evolution_totals,
    )
}
SQL = {
    "node_upsert": "WITH " + _STATE + r" SELECT id, label, file_type, replace(source_file, '\', '/') AS source_file, source_location, community, description, array_to_string(list_sort(tags), ',') AS tags, gone < TIMESTAMP '9999-01-01' AS deleted FROM state",
    "edge_repair": _R + " SELECT edge_id, source, target, relation FROM e1",
    "edge_upsert_runs": _G + """, y AS (SELECT source, target, count(DISTINCT coalesce(relation, chr(1))) > 1 AS mixed FROM e1 GROUP BY 1, 2),
z AS (SELECT *, last_value(CASE WHEN fresh = 1 THEN source_location END IGNORE NULLS) OVER (PARTITION BY source, target ORDER BY extracted_at, edge_id) AS began FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY extracted_at, edge_id) AS k FROM z WHERE fresh = 0 AND source_location IS NOT NULL AND began IS NOT NULL),
l AS (SELECT source, target, min(k) AS k, place FROM (SELECT source, target, k, source_location AS place FROM h UNION ALL SELECT source, target, 0, began FROM h WHERE k = 1) GROUP BY source, target, place),
c AS (SELECT source, target, string_agg(place, ',' ORDER BY k) AS call_sites FROM l GROUP BY 1, 2)
SELECT g.source, g.target, relation, confidence, source_location, weight, CASE WHEN mixed THEN c.call_sites WHEN weight > 1 THEN array_to_string(list_filter(places, lambda x, i: x IS NOT NULL AND list_position(places, x) = i), ',') END AS call_sites
FROM g JOIN y ON y.source = g.source AND y.target = g.target LEFT JOIN c ON c.source = g.source AND c.target = g.target""",
    "relation_edges": _R + " SELECT source, target, relation, count(*) AS weight FROM e1 GROUP BY ALL",
    "validate_errors": f"SELECT kind, message, count(*) AS n_rows FROM (SELECT DISTINCT * FROM ({_VALID})) GROUP BY ALL",
    "apply_semantic_nodes": _PATCHED + f" SELECT coalesce(b.id, p.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.label ELSE p.label END AS label, coalesce(nullif(b.description, ''), p.description) AS description, {_TAGS} AS tags, b.id IS NULL AS inserted FROM base b FULL JOIN patch p ON b.id = p.id",
    "apply_semantic_edges": _R + " SELECT DISTINCT source, target, relation FROM edge_snapshots s WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) AND relation IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e1 WHERE e1.source = s.source AND e1.target = s.target AND e1.relation = s.relation)",
    "apply_enrichments": _PATCHED + f" SELECT b.id, coalesce(nullif(p.description, ''), b.description) AS description, CASE WHEN p.id IS NULL THEN array_to_string(list_sort(b.tags), ',') ELSE {_TAGS} END AS tags FROM base b LEFT JOIN patch p ON b.id = p.id",
    "merge_nodes": r"""WITH s AS (SELECT snapshot_id, id, min(label) AS label, min(file_type) AS file_type, min(description) AS description, min(replace(source_file, '\', '/')) AS source_file, min(list_sort(tags)) AS tags FROM node_snapshots GROUP BY 1, 2)
SELECT id, """ + ", ".join(f"arg_min({x}, snapshot_id) FILTER (coalesce({x}, '') <> '') AS {x}" for x in ("label", "file_type", "source_file", "description")) + """, array_to_string(list_sort(list_distinct(flatten(list(coalesce(tags, []))))), ',') AS tags,
array_to_string(list_sort(list(DISTINCT 's' || snapshot_id)), ',') AS source_graph FROM s GROUP BY id""",
    "merge_edges": "SELECT source, target, relation, confidence, snapshot_id AS graph FROM edge_snapshots QUALIFY row_number() OVER (PARTITION BY source, target, relation ORDER BY CASE confidence WHEN 'EXTRACTED' THEN 3 WHEN 'INFERRED' THEN 2 WHEN 'AMBIGUOUS' THEN 1 ELSE 0 END DESC, snapshot_id) = 1",
    "graph_counts": _G + " SELECT (SELECT count(*) FROM n) AS n_nodes, count(*) AS n_edges, CAST(sum(weight) AS bigint) AS weight FROM g",
    "degree_all": _G + " SELECT id, degree FROM d",
    "god_nodes": _G + " " + _GODS + "10",
    "confidence_distribution": _G + " SELECT coalesce(confidence, '?') AS confidence, count(*) AS n_edges FROM g GROUP BY 1",
    "relation_distribution": _G + " SELECT relation, count(*) AS n_edges, CAST(sum(weight) AS bigint) AS weight FROM g GROUP BY 1",
    "surprising_connections": _G + f""", v AS (SELECT id, coalesce(label, id) AS label, source_file, community FROM d WHERE NOT {_FILE} AND coalesce(file_type, '') <> 'concept' AND coalesce(source_file, '') <> ''),
p AS (SELECT g.*, s.label AS source_label, t.label AS target_label, s.source_file AS sf, t.source_file AS tf, s.community AS sc, t.community AS tc FROM g JOIN v s ON s.id = g.source JOIN v t ON t.id = g.target WHERE g.source <> g.target AND s.source_file <> t.source_file),
q AS (SELECT *, {_FAMILY.format("sf")} AS fs, {_FAMILY.format("tf")} AS ft, {_CATEGORY.format("sf")} AS cs, {_CATEGORY.format("tf")} AS ct, split_part(sf, '/', 1) <> split_part(tf, '/', 1) AS far FROM p)
SELECT source, source_label, target, target_label, relation, confidence, CASE WHEN relation = 'calls' AND confidence = 'INFERRED' AND fs <> ft THEN 0 WHEN confidence = 'AMBIGUOUS' THEN 3 WHEN confidence = 'INFERRED' THEN 2 ELSE 1 END
+ CASE WHEN cs <> ct THEN 2 ELSE 0 END + CASE WHEN far THEN 2 ELSE 0 END + CASE WHEN sc <> tc THEN 1 ELSE 0 END AS score,
concat_ws('; ', CASE confidence WHEN 'AMBIGUOUS' THEN 'ambiguous connection' WHEN 'INFERRED' THEN 'inferred connection' END, CASE WHEN cs <> ct THEN 'crosses file types (' || cs || ' ↔ ' || ct || ')' END,
  CASE WHEN far THEN 'connects across different directories' END, CASE WHEN sc <> tc THEN 'crosses Leiden communities' END) AS reasons
FROM q ORDER BY score DESC, extracted_at, edge_id LIMIT 5""",
    "community_summary": _N + " SELECT community, count(*) AS size, array_to_string(list(coalesce(label, '') ORDER BY id)[1:5], ' | ') AS labels FROM n WHERE community IS NOT NULL GROUP BY community",
    "cohesion": _G + """, s AS (SELECT community, count(*) AS size FROM n WHERE community IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM g WHERE source <> target),
k AS (SELECT x.community, count(*) AS n_pairs FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE x.community = y.community GROUP BY 1)
SELECT community, size, coalesce(n_pairs, 0) AS n_pairs, CASE WHEN size <= 1 THEN 100 ELSE (200 * coalesce(n_pairs, 0)) // (size * (size - 1)) END AS percent FROM s LEFT JOIN k USING (community)""",
    "weighted_degree_p95": _G + ", w AS (SELECT n.id, coalesce(sum(weight), 0) AS wd FROM n LEFT JOIN ends ON ends.id = n.id GROUP BY n.id), o AS (SELECT list_sort(list(wd)) AS l FROM w) SELECT len(l) AS n_nodes, CAST(greatest(5, l[1 + CAST(floor(len(l) * 95 / 100) AS int)]) AS bigint) AS threshold FROM o",
    "isolates": _G + " SELECT id FROM d WHERE degree = 0",
    "class_groups": _G + """, o AS (SELECT id FROM n WHERE file_type = 'code' AND coalesce(label, '') <> '' AND label NOT LIKE '%()' AND label NOT LIKE '@%'),
k AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY extracted_at, edge_id) AS place FROM g WHERE relation = 'contains' AND source IN (SELECT id FROM o)), l AS (SELECT *, count(*) OVER (PARTITION BY source) AS c FROM k WHERE place <= 30)
SELECT source AS "group", CAST(place AS int) AS place, target AS member FROM l WHERE c >= 2 UNION ALL SELECT DISTINCT source, 0, source FROM l WHERE c >= 2""",
    "community_groups": _G + """ SELECT community, count(*) AS size, count(*) FILTER (coalesce(file_type, '') <> 'concept' AND coalesce(label, '') NOT LIKE '%.py') AS n_real, array_to_string(list(substr(coalesce(label, ''), 1, 30) ORDER BY degree DESC, born, id)[1:3], ', ') AS label
FROM d WHERE community IS NOT NULL GROUP BY community HAVING size >= 3 AND n_real >= 2""",
    "centrality_within": _G + _GROUPS + """, x AS (SELECT id FROM m WHERE side = 'a'), i AS (SELECT * FROM g WHERE source IN (SELECT id FROM x) AND target IN (SELECT id FROM x))
SELECT id, (SELECT count(*) FROM i WHERE source = x.id) + (SELECT count(*) FROM i WHERE target = x.id) AS degree, CAST(coalesce((SELECT sum(weight) FROM i WHERE source = x.id), 0) AS bigint) AS weighted_degree FROM x""",
    "bridging_nodes": _G + _GROUPS + """, c AS (SELECT ends.id, count(*) FILTER (side = 'a') AS ta, count(*) FILTER (side = 'b') AS tb FROM ends JOIN m ON m.id = ends.other WHERE ends.id <> ends.other GROUP BY 1),
z AS (SELECT id FROM m GROUP BY id HAVING count(*) = 2), s AS (SELECT count(*) FILTER (side = 'a') AS sa, count(*) FILTER (side = 'b') AS sb FROM m),
o AS (SELECT coalesce(c.id, z.id) AS id, CASE WHEN z.id IS NOT NULL THEN sb ELSE ta END AS edges_to_a, CASE WHEN z.id IS NOT NULL THEN sa ELSE tb END AS edges_to_b, z.id IS NOT NULL AS in_both FROM c FULL JOIN z ON c.id = z.id, s)
SELECT id, edges_to_a, edges_to_b, in_both, edges_to_a + edges_to_b AS strength FROM o WHERE edges_to_a > 0 AND edges_to_b > 0 ORDER BY strength DESC, id LIMIT 10""",
    "hyperedges_for": "SELECT id, count(*) AS n_groups, min(hyperedge_key) AS first_group FROM (SELECT DISTINCT hyperedge_key, unnest(members) AS id FROM hyperedges) WHERE id IS NOT NULL GROUP BY id",
    "list_hyperedges": "SELECT hyperedge_key, id, label, max(size) AS size FROM hyperedges WHERE type = 'community' GROUP BY ALL",
    "find_nodes": _N + " " + _find_sql(QUESTION, 10),
    "find_nodes_short": _G + " SELECT id, 10 AS score FROM d WHERE contains(lower(coalesce(label, '')), 'ce') OR contains(lower(id), 'ce') ORDER BY degree DESC, born, id LIMIT 10",
    "infer_context": "WITH h(context, words) AS (VALUES " + ", ".join(f"('{c}', {h})" for c, h in traversal.HINTS.items()) + r"), t AS (SELECT doc_id, regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '[?,]', ' ', 'g')), '\s+') AS words FROM documents) SELECT context, count(*) AS n_documents FROM h, t WHERE list_has_any(h.words, t.words) GROUP BY context",
    "context_filter_edges": _G + " SELECT source, target, context FROM g WHERE context IN ('call', 'return_type')",
    "filter_by_relation": _G + " SELECT source, s.label AS source_label, target, t.label AS target_label FROM g JOIN n s ON s.id = source JOIN n t ON t.id = target WHERE relation = 'contains'",
    "filter_by_decorator": _G + ", k AS (SELECT id, label FROM n WHERE label LIKE '@%' AND contains(lower(label), 'trace')), u AS (SELECT source AS a, target AS b FROM g WHERE relation = 'uses' UNION ALL SELECT target, source FROM g WHERE relation = 'uses') SELECT DISTINCT n.id, k.label AS decorator, n.label FROM u JOIN k ON k.id = u.b JOIN n ON n.id = u.a",
    "callers_of": _G + " SELECT source, target, weight FROM g WHERE relation = 'calls' AND target = (SELECT target FROM g WHERE relation = 'calls' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "callees_of": _G + " SELECT source, target, weight FROM g WHERE relation = 'calls' AND source = (SELECT source FROM g WHERE relation = 'calls' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "bfs_nodes": _BFS + " SELECT id, depth FROM reached",
    "bfs_edges": _BFS + " SELECT source, target, relation FROM g JOIN reached a ON a.id = source JOIN reached b ON b.id = target WHERE b.depth = a.depth + 1",
    "question_query": _BFS + " SELECT id, label, depth, degree FROM d JOIN reached USING (id)",
    "khop_neighbors": _NEAR + " SELECT id, depth FROM near",
    "khop_induced_edges": _NEAR + " SELECT source, target, relation, weight FROM g WHERE source IN (SELECT id FROM near) AND target IN (SELECT id FROM near)",
    "explain": _G + f" SELECT d.id, d.label, g.relation, d.degree FROM g JOIN d ON d.id = g.target WHERE g.source = (SELECT source FROM g GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ORDER BY d.degree DESC, d.id LIMIT 20",
    "match_nodes": _N + """, k AS (SELECT *, lower(strip_accents(coalesce(label, ''))) AS l, lower(id) AS i FROM n), o AS (SELECT *, i = 'parser' OR l = 'parser' AS exact FROM k WHERE contains(i, 'parser') OR contains(l, 'parser'))
SELECT id, label, exact FROM o ORDER BY exact DESC, CASE WHEN exact THEN -born ELSE born END, id LIMIT 10""",
    "shortest_path_length": _PATH + " SELECT id, depth AS length FROM reached WHERE id IN (SELECT id FROM goal)",
    "shortest_path_nodes": _PATH + ", p AS (SELECT depth AS hop, id FROM reached WHERE id IN (SELECT id FROM goal) UNION ALL SELECT hop, id FROM (SELECT p.hop - 1 AS hop, min(reached.id) AS id FROM p JOIN ways ON ways.b = p.id JOIN reached ON reached.id = ways.a AND reached.depth = p.hop - 1 WHERE p.hop > 0 GROUP BY p.hop)) SELECT hop, id FROM p",
    "connected_components": _G + ", c0 AS MATERIALIZED (SELECT id, id AS c FROM n)" + "".join(
        f", m{k} AS (SELECT b AS id, min(c) AS m FROM ways JOIN c{k} ON c{k}.id = a GROUP BY b), c{k + 1} AS MATERIALIZED (SELECT c{k}.id, least(c, coalesce(m, c)) AS c FROM c{k} LEFT JOIN m{k} USING (id))" for k in range(14)
    ) + " SELECT id, c AS component FROM c14",  # the least name goes 14 edges far, further than any node of the test tables is from another
    "find_nodes_folded": _N + " SELECT id, score FROM (SELECT id, " + _score_sql(["eleve", "große", "modele"], "lower(strip_accents({}))") + " AS score FROM n) WHERE score > 0",
    "evolution_nodes": _EVO_N,
    "evolution_edges": _EVO_E,
    "evolution_moves": _EVO_M,
    "evolution_totals": f"SELECT 'nodes ' || change AS what, count(*) AS n FROM ({_EVO_N}) GROUP BY 1 UNION ALL SELECT 'edges ' || change, count(*) FROM ({_EVO_E}) GROUP BY 1 UNION ALL SELECT 'nodes moved', count(*) FROM ({_EVO_M})",
}
