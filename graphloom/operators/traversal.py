"""Questions to a graph: term scores, bounded walks, neighbourhoods, shortest paths and rendering."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.operators.graph import both_ways, degrees
from graphloom.sources.tables import written

# Weights of a term's hits, in tenths.
LABEL, SOURCE, TAG, DESCRIPTION, EXACT = 10, 5, 20, 3, 1000
# Words of a question that hint at a context of edges.
HINTS = {
    "call": ["call", "calls", "called", "invoke", "invokes", "invoked"],
    "import": ["import", "imports", "imported", "module", "modules"],
    "field": ["field", "fields", "member", "members", "property", "properties"],
    "parameter_type": ["parameter", "parameters", "param", "params", "argument", "arguments"],
    "return_type": ["return", "returns", "returned"],
    "generic_arg": ["generic", "generics", "template", "templates"],
}


def folded_text(text: str) -> str:
    """Lower case, without accents, compatibility forms unified."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@F.pandas_udf(StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.map(lambda x: folded_text(x) if x is not None else None)


def folded(column: Column) -> Column:
    """A folded text column; ASCII never leaves the JVM."""
    ascii_only = column.rlike(r"^\p{ASCII}*\z")
    return F.when(ascii_only, F.lower(column)).otherwise(_fold(F.when(~ascii_only, column)))


def clean_label(column: Column | str, most: int = 256) -> Column:
    """A label without control characters, cut to a length."""
    return F.substring(F.regexp_replace(F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit("")), r"[\x00-\x1f\x7f]", ""), 1, most)


def terms_of(question: str) -> list[str]:
    """The terms of a question: words of three characters and more, each as often as it occurs."""
    return [t for t in question.lower().split() if len(t) > 2]


def contexts_of(question: str, explicit: Sequence[str] = ()) -> tuple[list[str], str | None]:
    """The contexts a question asks for, and how they were found: given explicitly, or by hint words."""
    given = list(dict.fromkeys(k for x in explicit if (k := folded_text(str(x)).strip())))
    if given:
        return given, "explicit"
    words = {folded_text(t) for t in question.replace("?", " ").replace(",", " ").split()}
    hinted = [c for c, hints in HINTS.items() if words & set(hints)]
    return hinted, "heuristic" if hinted else None


def in_contexts(edges: DataFrame, contexts: Sequence[str]) -> DataFrame:
    """The edges of the given contexts; all edges if none is given."""
    return edges.filter(F.col("context").isin(*contexts)) if contexts else edges


def term_scores(nodes: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Nodes with a hit, and their score in tenths: label 10, source file 5, each tag 20, description 3, an exact label 1000 once."""
    words = [folded_text(t) for t in terms]
    n = nodes.withColumn("_label", folded(F.coalesce("label", F.lit("")))).withColumn("_description", folded(F.coalesce("description", F.lit("")))).withColumn("_tags", folded(F.coalesce(F.array_join("tags", "\x1f"), F.lit(""))))
    source, tags = F.lower(F.coalesce("source_file", F.lit(""))), F.split("_tags", "\x1f")
    score = F.lit(0)
    for word in words:
        hit = lambda c: c.contains(word).cast("int")  # noqa: B023, E731
        score = score + hit(F.col("_label")) * LABEL + hit(source) * SOURCE + hit(F.col("_description")) * DESCRIPTION + F.size(F.filter(tags, lambda t: t.contains(word))) * TAG  # noqa: B023
    bare = F.rtrim(F.col("_label"), F.lit("()"))
    score = score + F.when(F.col("_label").isin(*words) | bare.isin(*words), EXACT).otherwise(0) if words else score
    return n.withColumn("score", score).filter("score > 0").drop("_label", "_description", "_tags")


def find(nodes: DataFrame, question: str, limit: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """The nodes that best answer a question: by score, equal ones by id downwards.

    A question without a term long enough is looked for as a whole in labels
    and ids; these nodes come by degree where edges are given, else and of
    equals those created first.
    """
    terms = terms_of(question)
    if terms:
        return term_scores(nodes, terms).orderBy(F.desc("score"), F.desc("id")).limit(limit)
    whole = question.lower()
    hit = F.lower(F.coalesce("label", F.lit(""))).contains(whole) | F.lower("id").contains(whole)
    found = degrees(nodes, edges) if edges is not None else nodes.withColumn("degree", F.lit(0))
    return found.filter(hit).withColumn("score", F.lit(LABEL)).orderBy(F.desc("degree"), "at", "id").limit(limit).drop("degree")


def matching(nodes: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """The nodes that a name means: id, label, exact; those whose id or label it is before those that hold it, of exact ones the last created first."""
    word = folded_text(name)
    label, node = folded(F.coalesce("label", F.lit(""))), F.lower("id")
    found = nodes.withColumn("exact", (node == word) | (label == word)).filter(F.col("exact") | node.contains(word) | label.contains(word))
    return found.orderBy(F.desc("exact"), F.when(F.col("exact"), -F.col("at")).otherwise(F.col("at")), "id").limit(limit).select("id", "label", "exact")


def walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Breadth-first from the seeds (id) along edges (source, target): every node reached within depth, and its distance.

    Each step joins the newest nodes only, and is written to the shared
    folder, so neither plan nor state grows with the walk's length.
    """
    steps = edges.select("source", "target").filter("source <> target")
    seen = written(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "walk")
    frontier = seen
    for step in range(1, depth + 1):
        reached = steps.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        frontier = written(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(step)), "walk")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def walk_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges by which a breadth-first walk found its nodes: from a node to one of the next distance."""
    a, b = reached.select(F.col("id").alias("source"), F.col("depth").alias("da")), reached.select(F.col("id").alias("target"), F.col("depth").alias("db"))
    return edges.join(a, "source").join(b, "target").filter("db = da + 1").drop("da", "db")


def undirected(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()


def neighbours(edges: DataFrame, centre: DataFrame, depth: int = 1, most: int = 30) -> DataFrame:
    """Nodes within depth edges of the centre in either direction, the nearest `most` of them, of equals the least id."""
    return walk(undirected(edges), centre, depth).orderBy("depth", "id").limit(most)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges whose both ends are among the ids."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def distances(ways: DataFrame, start: DataFrame, goal: DataFrame) -> DataFrame:
    """Breadth-first along undirected ways, to any depth: every node no further than the goal, and its distance: id, depth.

    ways: each in both directions, as `undirected` gives them.  Ends with the step that reaches the goal, or when a step finds no new
    node.  What is seen is one table, written anew now and then, so that the
    plan doesn't grow with the path's length.
    """
    steps = ways.select("source", "target").filter("source <> target")
    seen = written(start.select("id").distinct().withColumn("depth", F.lit(0)), "walk")
    frontier, step = seen, 0
    while not frontier.isEmpty() and frontier.join(goal.select("id"), "id", "left_semi").isEmpty():
        step += 1
        reached = steps.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        # a neighbour of the frontier is new, in the frontier or one step before it
        last = seen.filter(F.col("depth") >= step - 2).select("id")
        frontier = written(reached.join(last, "id", "left_anti").withColumn("depth", F.lit(step)), "walk")
        seen = seen.unionByName(frontier)
        if step % 8 == 0:
            seen = written(seen, "walk")
    return seen


def shortest_path(edges: DataFrame, start: DataFrame, goal: DataFrame) -> DataFrame:
    """One shortest undirected path from start to goal (one id each): hop, id.  Of equal paths, at every hop from the goal the least id.

    Empty if there is none.
    """
    ways = written(undirected(edges), "ways")
    far = distances(ways, start, goal)
    here = written(far.join(goal.select("id"), "id", "left_semi"), "path")
    path = here
    hops = here.agg(F.max("depth")).first()[0]
    for hop in range((hops or 0) - 1, -1, -1):
        back = ways.join(here.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct()
        here = written(far.filter(F.col("depth") == hop).join(back, "id", "left_semi").agg(F.min("id").alias("id")).withColumn("depth", F.lit(hop)), "path")
        path = path.unionByName(here)
        if hop % 8 == 0:
            path = written(path, "path")
    return path.select(F.col("depth").alias("hop"), "id")


def depth_first(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """The order in which a depth-capped depth-first walk from each seed visits nodes, the last edge of a node first: seed, visit, id, depth, parent.

    A node is visited by the least path, edge by edge, of those over visited
    nodes.  So paths are settled by rounds: each round takes for every node the
    least of its predecessors' paths and one edge more, and rounds end when no
    path changes.  A node's path is right a few rounds after those of all
    nodes visited before it; where many nodes are reached by ever shorter
    detours, rounds are many.
    """
    at = F.unix_micros(F.col("extracted_at").cast("timestamp"))
    steps = edges.filter("source <> target").select("source", "target", F.struct((-F.coalesce(at, F.lit(-(2**62)))).alias("at"), (-F.col("edge_id")).alias("edge")).alias("step"))
    start = seeds.select(F.col("id").alias("seed"), "id").distinct().select("seed", "id", F.array().cast("array<struct<at:bigint,edge:bigint>>").alias("path"), F.lit(None).cast("string").alias("parent"))
    paths = start = written(start, "seeds")
    steps = written(steps.join(walk(edges, seeds, depth - 1).select(F.col("id").alias("source")), "source", "left_semi"), "steps") if depth > 0 else steps.limit(0)
    while True:
        longer = paths.filter(F.size("path") < depth).join(steps, F.col("id") == F.col("source")).select("seed", F.col("target").alias("id"), F.concat("path", F.array("step")).alias("path"), F.col("id").alias("parent"))
        least = start.unionByName(longer).groupBy("seed", "id").agg(F.min(F.struct("path", "parent")).alias("p"))
        before, paths = paths, written(least.select("seed", "id", "p.path", "p.parent"), "paths")
        both = paths.alias("a").join(before.alias("b"), ["seed", "id"], "full_outer")
        if both.filter(~F.col("a.path").eqNullSafe(F.col("b.path"))).isEmpty():
            break
    order = Window.partitionBy("seed").orderBy("path")
    return paths.select("seed", (F.row_number().over(order) - 1).alias("visit"), "id", F.size("path").alias("depth"), "parent")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The connected component of every node, named by its least id: id, component.

    Each round takes the least name among the neighbours, then jumps to that
    name's own name; a round's table is written, and rounds end when none
    changes.
    """
    ways = written(undirected(edges), "ways")
    name = written(nodes.select("id", F.col("id").alias("component")), "component")
    while True:
        near = ways.join(name.select(F.col("id").alias("source"), "component"), "source").groupBy(F.col("target").alias("id")).agg(F.min("component").alias("n"))
        lower = name.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("n", "component")).alias("component"))
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        step = written(lower.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "component")
        name = step.select("id", "component")
        if step.filter("was <> component").isEmpty():
            return name


def rendered(nodes: DataFrame, edges: DataFrame, reached: DataFrame, budget: int = 2000) -> DataFrame:
    """The walk as lines of text within a budget of tokens (three characters each): line number, text.

    Nodes come first, seeds before others, then by degree; edges follow.
    The running length is over the lines of one answer, which the budget
    bounds, as no more lines than its characters are taken.
    """
    d = degrees(nodes, edges).join(reached, "id")
    line = F.concat(F.lit("NODE "), clean_label(F.coalesce("label", "id")), F.lit(" [src="), F.coalesce("source_file", F.lit("")), F.lit(" loc="), F.coalesce("source_location", F.lit("")), F.lit("]"))
    first = d.select(F.when(F.col("depth") == 0, 0).otherwise(1).alias("kind"), (-F.col("degree")).alias("weight"), F.col("id").alias("key"), line.alias("text"))
    label = nodes.select("id", clean_label(F.coalesce("label", "id")).alias("l"))
    e = walk_edges(edges, reached).join(label.select(F.col("id").alias("source"), F.col("l").alias("sl")), "source").join(label.select(F.col("id").alias("target"), F.col("l").alias("tl")), "target")
    text = F.concat(F.lit("EDGE "), "sl", F.lit(" --"), F.coalesce("relation", F.lit("")), F.lit("--> "), "tl")
    second = e.select(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("weight"), F.concat_ws("|", "source", "target").alias("key"), text.alias("text"))
    few = first.unionByName(second).orderBy("kind", "weight", "key").limit(3 * budget)
    by = Window.orderBy("kind", "weight", "key")
    placed = few.withColumn("line", F.row_number().over(by)).withColumn("until", F.sum(F.length("text") + 1).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.filter(F.col("until") <= 3 * budget).select("line", "text")


def drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """Nodes that left the community most like their old one: id, old, new, expected.

    Each old community goes on as the new one of greatest Jaccard likeness
    over nodes in both; of equals the least number.  before, now: id,
    community; nodes without a community are left out.
    """
    a, b = before.dropna().select("id", F.col("community").alias("old")), now.dropna().select("id", F.col("community").alias("new"))
    both = a.join(b, "id")
    overlap = both.groupBy("old", "new").agg(F.count("*").alias("n"))
    olds, news = both.groupBy("old").agg(F.count("*").alias("no")), both.groupBy("new").agg(F.count("*").alias("nn"))
    like = overlap.join(olds, "old").join(news, "new").withColumn("union", F.col("no") + F.col("nn") - F.col("n"))
    best = like.groupBy("old").agg(F.max_by("new", F.struct((F.col("n") / F.col("union")).alias("j"), (-F.col("new")).alias("m"))).alias("expected"))
    return both.join(best, "old").filter("new <> expected").select("id", "old", "new", "expected")
