"""Communities of a graph by synchronous Louvain, with rules that split what comes out too large or too loose.

Up to NODES nodes are numbered and moved over arrays (moves.py); larger graphs are moved by joins until a level leaves so few.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from itertools import count
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import moves
from graphloom.operators.moves import GAIN, LEVELS, MOST_PARTS, PARTS
from graphloom.sources.tables import written

# The part of all nodes, and the size, beyond which a community is split; cohesion and size of a loose one.
FRACTION, SPLIT_SIZE, LOOSE, LOOSE_SIZE = 0.25, 10, 0.05, 50
#: Nodes up to which the driver holds a number for each.
NODES = 2**22

log = logging.getLogger(__name__)


def pair_weights(edges: DataFrame) -> DataFrame:
    """Undirected weights: a, b, w, each pair in both directions; loops once with their whole weight."""
    one = edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max("weight").cast("double").alias("w"))
    return one.unionByName(one.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def modularity(pairs: DataFrame, names: DataFrame) -> float:
    """The modularity of a partition (id, c) of weighted pairs; 0 for a graph without edges."""
    both = pairs.join(names.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(names.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    row = both.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0)).alias("inside"), F.sum("w").alias("all")).agg(F.sum("inside").alias("i"), F.sum(F.col("all") * F.col("all")).alias("s"), F.sum("all").alias("m")).first()
    return 0.0 if not row.m else row.i / row.m - row.s / row.m**2


def _moved(pairs: DataFrame, names: DataFrame, strength: DataFrame, total: float, moves: Column) -> DataFrame:
    """The nodes that may move go to the neighbouring community of greatest gain, of equals the greatest name, and stay where none gains: id, c."""
    held = names.join(strength, "id").groupBy("c").agg(F.sum("k").alias("held"))
    into = pairs.filter("a <> b").join(names.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("w"))
    own = names.select("id", "c", F.lit(0.0).alias("w"))
    options = into.unionByName(own).filter(moves).groupBy("id", "c").agg(F.sum("w").alias("w")).join(held, "c").join(strength, "id").join(names.select("id", F.col("c").alias("now")), "id")
    gain = F.col("w") - F.col("k") * (F.col("held") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0)) / F.lit(total)
    choice = options.withColumn("gain", F.round(gain, 9)).groupBy("id").agg(F.max_by("c", F.struct("gain", (F.col("c") == F.col("now")).alias("stay"), "c")).alias("c"))
    return choice.unionByName(names.filter(~moves))


def _level(pairs: DataFrame, start: float) -> tuple[DataFrame, float]:
    """One level of moves: id, c, and the modularity reached from `start`, that of every node alone.

    In a round every node may move once.  The nodes of a part, by a hash that
    changes each round, look at once, so two nodes don't swap for ever.  A
    round that loses by it is undone and tried in more parts; the level ends
    with a round that gains less than GAIN.
    """
    strength = written(pairs.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")), "strength")
    total = strength.agg(F.sum("k")).first()[0] or 0.0
    names, reached, parts = written(strength.select("id", F.col("id").alias("c")), "names"), start, PARTS
    for turn in count():
        after = names
        for part in range(parts):
            after = written(_moved(pairs, after, strength, total, F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(parts)) == part), "names")
        gain = modularity(pairs, after) - reached
        if gain > 0:
            names, reached = after, reached + gain
        if gain < GAIN:
            if gain >= 0 or parts >= MOST_PARTS:
                return names, reached
            parts *= 2


def _labelled(index: DataFrame, c: np.ndarray, name: str) -> DataFrame:
    """The rows of an index (id, n) with what an array holds at their numbers: id and the named column."""
    sent = index.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value[batch.column(1).to_numpy()], pa.int32())], names=["id", name])

    return index.select("id", "n").mapInArrow(run, f"id string, {name} int")


def _pairs_of(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of ids as pairs of numbers."""
    a, b = index.select(F.col("id").alias("a"), F.col("n").alias("na")), index.select(F.col("id").alias("b"), F.col("n").alias("nb"))
    return pairs.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "w")


def _few(pairs: DataFrame, graphs: DataFrame, levels: int) -> DataFrame:
    """Communities of at most NODES nodes: id, c (a node's id); each graph (id, graph) is partitioned by itself, by pairs within it."""
    index = written(numbered(graphs, "n", "id"), "index")
    rows = index.select("n", "graph").toArrow()
    _, g = np.unique(np.asarray(rows["graph"].combine_chunks().dictionary_encode().indices), return_inverse=True) if rows.num_rows else (None, np.zeros(0, "i8"))
    graph = np.empty(len(g), "i4")
    graph[rows["n"].to_numpy()] = g
    c = moves.partition(moves.Neighbours.of(_pairs_of(index, pairs)), graph, np.ones(int(g.max(initial=-1)) + 1, bool), levels)
    return _labelled(index, c, "n").join(index.select("n", F.col("id").alias("c")), "n").select("id", "c")


def partition(edges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Communities of the nodes that have edges: id, c (the name of one of its nodes)."""
    pairs = written(pair_weights(edges.filter("source <> target")), "pairs")
    names = written(pairs.select(F.col("a").alias("id"), F.col("a").alias("c")).distinct(), "names")
    reached = None
    for left in range(levels, 0, -1):
        now = written(names.select(F.col("c").alias("id"), F.lit(0).alias("graph")).distinct(), "level")
        if now.count() <= NODES:
            level = _few(pairs, now, left)
            return written(names.withColumnRenamed("c", "was").join(level.withColumnRenamed("id", "was"), "was").select("id", "c"), "names")
        reached = modularity(pairs, now.select("id", F.col("id").alias("c"))) if reached is None else reached
        level, after = _level(pairs, reached)
        names = written(names.withColumnRenamed("c", "was").join(level.withColumnRenamed("id", "was"), "was").select("id", "c"), "names")
        gain, reached = after - reached, after
        if gain < GAIN:
            return names
        a, b = level.select(F.col("id").alias("a"), F.col("c").alias("ca")), level.select(F.col("id").alias("b"), F.col("c").alias("cb"))
        pairs = written(pairs.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "pairs")
    log.warning("Louvain: %d levels done, the last gained %g", levels, gain)
    return names


def _inside(edges: DataFrame, names: DataFrame) -> DataFrame:
    s, t = names.select(F.col("id").alias("source"), F.col("c").alias("cs")), names.select(F.col("id").alias("target"), F.col("c").alias("ct"))
    return edges.join(s, "source").join(t, "target").filter("cs = ct")


def _split(names: DataFrame, edges: DataFrame, which: DataFrame) -> DataFrame:
    """The named communities (c) are partitioned once more, each by its own edges; nodes without one are communities of their own.

    Communities are taken together as far as their nodes are about NODES.
    """
    which = written(which, "split")
    if which.isEmpty():
        return names
    chosen = written(names.join(which, "c", "left_semi"), "chosen")
    own = written(_inside(edges, chosen).select("source", "target", "weight", F.col("cs").alias("c")), "own")
    sizes = written(chosen.groupBy("c").agg(F.count("*").alias("size")), "sizes")
    large = [r.c for r in sizes.filter(F.col("size") > NODES // 2).collect()]  # few, as each has so many nodes
    turns = ceil((sizes.filter(F.col("size") <= NODES // 2).agg(F.sum("size")).first()[0] or 0) / max(1, NODES // 2))
    again = [partition(own.filter(F.col("c") == c)) for c in large]
    turn = F.when(F.col("c").isin(large), -1).otherwise(F.pmod(F.xxhash64("c"), F.lit(max(1, turns))))
    for t in range(turns):
        again.append(_few(pair_weights(own.filter(turn == t)), chosen.filter(turn == t).select("id", F.col("c").alias("graph")), LEVELS))
    parts = again[0]
    for more in again[1:]:
        parts = parts.unionByName(more)
    apart = chosen.select("id").join(parts, "id", "left").select("id", F.coalesce("c", "id").alias("c"))
    return written(names.join(which, "c", "left_anti").select("id", "c").unionByName(apart), "named")


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """The rows with their number in an order, from 0, without bringing them together: sorted by ranges, counted, and shifted."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", inside), "numbered")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each range
    shift = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    return ranged.join(shift, "_part").withColumn(name, (F.col("_shift") + F.col("_at")).cast("int")).drop("_part", "_at", "_shift")


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node's community: id, community, numbered from the largest (0) on, of equals by their least member.

    Nodes without edges are communities of their own.  A community larger
    than a quarter of all nodes (and than 10) is partitioned once more by its
    own edges; then so is one of 50 and more whose cohesion is below 0.05.
    """
    simple = edges.select("source", "target", "weight").filter("source <> target")
    index = numbered(nodes.select("id").filter("id is not null").distinct(), "n", "id")
    n = index.count()
    if n > NODES:
        return _by_joins(index.select("id"), simple, n)
    one = _pairs_of(index, simple.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("weight").cast("double").alias("w")))
    one = one.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"))
    ways = one.select(F.explode(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))).alias("p")).select("p.*")
    near = moves.Neighbours.of(ways)

    def split(c: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The communities that `which` marks by name are partitioned once more."""
        if not which.any():
            return c
        g = np.zeros(len(which), "i4")
        g[which] = np.arange(1, which.sum() + 1)  # a graph each; the rest is graph 0
        return np.where(which[c], moves.partition(near, g[c], np.arange(g.max() + 1) > 0), c)

    c = moves.partition(near, np.zeros(n, "i4"), np.ones(1, bool))
    c = split(c, np.bincount(c, minlength=n) > max(SPLIT_SIZE, int(FRACTION * n)))
    size = np.bincount(c, minlength=n)
    name, _, twice = near.ask(moves.links, c)
    cohesion = np.bincount(name, twice, n) / np.maximum(1.0, size * (size - 1.0))
    c = split(c, (size >= LOOSE_SIZE) & (cohesion < LOOSE))
    size = np.bincount(c, minlength=n)
    place = np.empty(n, "i4")
    place[np.argsort(-size, kind="stable")] = np.arange(n)  # a community's name is its least member
    return _labelled(index, place[c], "community")


def _by_joins(nodes: DataFrame, simple: DataFrame, n: int) -> DataFrame:
    """Communities of n nodes, more than the driver holds numbers for."""
    names = written(nodes.join(partition(simple), "id", "left").select("id", F.coalesce("c", "id").alias("c")), "named")
    most = max(SPLIT_SIZE, int(FRACTION * n))
    names = _split(names, simple, names.groupBy("c").agg(F.count("*").alias("size")).filter(F.col("size") > most).select("c"))
    size = names.groupBy("c").agg(F.count("*").alias("size")).filter(F.col("size") >= LOOSE_SIZE)
    pairs = _inside(simple, names).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.col("cs").alias("c")).distinct().groupBy("c").agg(F.count("*").alias("pairs"))
    loose = F.coalesce("pairs", F.lit(0)) * 2 / (F.col("size") * (F.col("size") - 1)) < LOOSE
    names = _split(names, simple, size.join(pairs, "c", "left").filter(loose).select("c"))
    ranked = names.groupBy("c").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    return names.join(numbered(ranked, "community", F.desc("size"), "first").select("c", "community"), "c").select("id", "community")
