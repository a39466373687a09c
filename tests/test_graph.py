"""Golden micro-graphs: upserts, walks, groups, and the operators SQL can't check."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import analysis, community, corpus, graph, moves, orphans, resolve, snapshots, sync, traversal
from graphloom.sources.tables import written

EDGE = "edge_id long, source string, target string, relation string, confidence string, source_file string, source_location string, context string, extracted_at timestamp"


def edges_of(spark, rows):
    at = "2025-01-01 00:00:00"
    return spark.createDataFrame([(i, s, t, r, "EXTRACTED", "a.py", p, None, None) for i, (s, t, r, p) in enumerate(rows)], EDGE).withColumn("extracted_at", F.lit(at).cast("timestamp"))


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        (["calls@L1"], ("calls", "L1", 1, None)),
        (["calls@L1", "calls@L5", "calls@L5"], ("calls", "L1", 3, ["L1", "L5"])),
        (["calls@L1", "calls@L1"], ("calls", "L1", 2, ["L1"])),
        (["calls@L1", "uses@L2"], ("uses", "L2", 1, None)),
        (["calls@L1", "uses@L2", "calls@L3"], ("calls", "L3", 1, None)),
        (["calls@L1", "calls@L5", "uses@L7"], ("uses", "L7", 1, ["L1", "L5"])),
        (["calls@L1", "calls@L5", "uses@L7", "uses@L9"], ("uses", "L7", 2, ["L1", "L5", "L9"])),
    ],
)
def test_edge_upsert(spark, rows, want):
    out = graph.upsert_edges(edges_of(spark, [("x", "y", *r.split("@")) for r in rows])).collect()
    assert [(r.relation, r.source_location, r.weight, r.call_sites) for r in out] == [want]


WALK = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "a")]


@pytest.fixture(scope="module")
def walk_edges(spark):
    return edges_of(spark, [(s, t, "calls", f"L{i}") for i, (s, t) in enumerate(WALK)]).withColumn("weight", F.lit(1))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_breadth_first(spark, walk_edges):
    out = {r.id: r.depth for r in traversal.walk(walk_edges, ids(spark, "a"), 2).collect()}
    assert out == {"a": 0, "b": 1, "c": 1, "d": 2}
    found = traversal.walk_edges(walk_edges, traversal.walk(walk_edges, ids(spark, "a"), 2))
    assert {(r.source, r.target) for r in found.collect()} == {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")}


def test_depth_first(spark, walk_edges):
    out = traversal.depth_first(walk_edges, ids(spark, "a"), 3).orderBy("visit").collect()
    assert [r.id for r in out] == ["a", "c", "d", "e", "b"]


def test_depth_first_by_brute_force(spark):
    rng = random.Random(8)
    pairs = sorted({(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(90)})
    rng.shuffle(pairs)
    after = defaultdict(list)
    for s, t in pairs:
        after[s].append(t)
    want, stack = [], [("n00", 0)]
    while stack:
        node, far = stack.pop()
        if node not in {x for x, _ in want}:
            want.append((node, far))
            stack += [(t, far + 1) for t in after[node]] if far < 3 else []
    out = traversal.depth_first(edges_of(spark, [(s, t, "calls", "1") for s, t in pairs]), ids(spark, "n00"), 3).orderBy("visit").collect()
    assert [(r.id, r.depth) for r in out] == want


def test_numbers_without_one_task(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert all(r.k == 999 - r.n for r in community.numbered(rows, "n", F.desc("k")).collect())


def test_ignore_globs(spark):
    paths = ["vendor/a.py", "src/vendor/x.py", "vendor", "x.min.js", "a/x.min.js", "x.min.js/a.py", "docs/a.txt", "docs/a.md", "b/docs/c.txt", "tmp/a.py", "x/tmp/a.py"]
    left = spark.createDataFrame([(p,) for p in paths], "path string").filter(corpus.not_ignored("path", ["vendor/", "*.min.js", "docs/*", "!docs/*.md", "tmp", "# no"]))
    assert {r.path for r in left.collect()} == {"src/vendor/x.py", "x.min.js/a.py", "docs/a.md", "b/docs/c.txt"}


def test_neighbours_and_path(spark, walk_edges):
    assert {(r.id, r.depth) for r in traversal.neighbours(walk_edges, ids(spark, "a")).collect()} == {("a", 0), ("b", 1), ("c", 1), ("x", 1)}
    path = traversal.shortest_path(walk_edges, ids(spark, "x"), ids(spark, "e")).orderBy("hop").collect()
    assert [r.id for r in path] == ["x", "a", "b", "d", "e"]
    assert traversal.shortest_path(walk_edges, ids(spark, "x"), ids(spark, "nowhere")).count() == 0


def test_path_of_any_length(spark):
    chain = edges_of(spark, [(f"n{i:02}", f"n{i + 1:02}", "calls", f"L{i}") for i in range(19)] + [("n00", "a", "calls", "L30"), ("z", "y", "calls", "L31")])
    path = traversal.shortest_path(chain, ids(spark, "n19"), ids(spark, "n00")).orderBy("hop").collect()
    assert [(r.hop, r.id) for r in path] == [(i, f"n{19 - i:02}") for i in range(20)]
    assert traversal.shortest_path(chain, ids(spark, "n19"), ids(spark, "z")).count() == 0


def test_bridging(spark):
    e = edges_of(spark, [("p", "m", "calls", "1"), ("m", "r", "calls", "1"), ("r", "m", "calls", "1"), ("p", "s", "calls", "1")])
    members = spark.createDataFrame([("p", "a"), ("q", "a"), ("q", "b"), ("r", "b"), ("s", "b")], "id string, side string")
    out = {r.id: (r.edges_to_a, r.edges_to_b, r.strength) for r in analysis.bridging(e, members).collect()}
    assert out == {"q": (3, 2, 5), "m": (1, 2, 3)}


def test_components_by_brute_force(spark):
    rng = random.Random(3)
    names = [f"n{i:02d}" for i in range(40)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(30)]
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    out = {r.id: r.component for r in traversal.components(ids(spark, *names), edges_of(spark, [(a, b, "calls", "1") for a, b in pairs])).collect()}
    assert out == {n: root(n) for n in names}


def test_louvain_separates_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(i)]
    pairs = clique("a") + clique("b") + [("a0", "b0")]
    e = graph.upsert_edges(edges_of(spark, [(s, t, "calls", "1") for s, t in pairs]))
    out = defaultdict(set)
    nodes = ids(spark, *{x for p in pairs for x in p}, "alone")
    for r in community.communities(nodes, e).collect():
        out[r.community].add(r.id)
    assert sorted(map(len, out.values()), reverse=True) == [5, 5, 1]
    assert sorted(out) == [0, 1, 2]


def test_louvain_goes_on_while_it_gains(spark):
    ring = [(f"n{i:03}", f"n{(i + 1) % 120:03}", "calls", "1") for i in range(120)]
    e = graph.upsert_edges(edges_of(spark, ring))
    assert community.modularity(community.pair_weights(e), community.partition(e)) > 0.75


def _random_pairs(n, m, seed=7):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):03}", f"n{min(rng.randrange(n), rng.randrange(n)):03}", "calls", "1") for _ in range(m)]


def test_louvain_runs_few_jobs(spark):
    e = written(graph.upsert_edges(edges_of(spark, _random_pairs(200, 500))), "edges")
    nodes = written(ids(spark, *{x for p in _random_pairs(200, 500) for x in p[:2]}), "nodes")
    spark.sparkContext.setJobGroup("louvain", "louvain")
    try:
        community.communities(nodes, e).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("louvain"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert jobs < 60  # looks of a small graph are no jobs


def test_louvain_is_the_same_in_tasks(spark, monkeypatch):
    pairs = _random_pairs(60, 150)
    e = written(graph.upsert_edges(edges_of(spark, pairs)), "edges")
    nodes = ids(spark, *{x for p in pairs for x in p[:2]})
    here = {(r.id, r.community) for r in community.communities(nodes, e).collect()}
    monkeypatch.setattr(moves, "SMALL", 20)
    assert {(r.id, r.community) for r in community.communities(nodes, e).collect()} == here


def test_louvain_by_joins(spark, monkeypatch):
    pairs = _random_pairs(60, 120)
    e = written(graph.upsert_edges(edges_of(spark, pairs)), "edges")
    nodes = ids(spark, *{x for p in pairs for x in p[:2]}, "alone")
    few = community.modularity(community.pair_weights(e.filter("source <> target")), community.partition(e))
    monkeypatch.setattr(community, "NODES", 30)
    names = community.partition(e)
    assert abs(community.modularity(community.pair_weights(e.filter("source <> target")), names) - few) < 0.05
    out = community.communities(nodes, e).collect()
    assert sorted(r.id for r in out) == sorted(r.id for r in nodes.collect())
    sizes = [n for _, n in sorted(Counter(r.community for r in out).items())]
    assert sizes == sorted(sizes, reverse=True) and min(r.community for r in out) == 0


def test_louvain_splits_each_community_by_itself(spark):
    """Three rings: each is partitioned as if it were the whole graph."""
    g = np.repeat(np.arange(3, dtype="i4"), 40)
    pairs = [(40 * r + i, 40 * r + (i + 1) % 40) for r in range(3) for i in range(40)]
    near = moves.Neighbours.of(spark.createDataFrame([x for a, b in pairs for x in ((a, b, 1.0), (b, a, 1.0))], "a int, b int, w double"))
    together = moves.partition(near, g, np.ones(3, bool))
    for r in range(3):
        alone = moves.partition(near, g, np.arange(3) == r)
        assert (together[g == r] == alone[g == r]).all() and len(set(together[g == r])) > 4


def test_edge_weights(spark):
    e = edges_of(spark, [("a", "b", "calls", "1"), ("a", "b", "uses", "2"), ("a", "b", "uses", "3"), ("b", "c", None, "4"), ("b", "c", None, "5")])
    assert sorted(graph.edge_weights(e).collect()) == sorted(graph.upsert_edges(e).select("source", "target", "weight").collect())


def test_scores(spark):
    nodes = spark.createDataFrame(
        [("n1", "lookup()", "index.py", None, None), ("n2", "Index", "index.py", None, None), ("n3", "score()", "ranker.py", ["index"], "calls Lookup"), ("n4", "other()", "a.py", None, None)],
        "id string, label string, source_file string, tags array<string>, description string",
    )
    out = [(r.id, r.score) for r in traversal.find(nodes, "lookup index").collect()]
    assert out == [("n2", 1015), ("n1", 1015), ("n3", 23)]


@pytest.mark.parametrize(("question", "explicit", "want"), [("what calls Index?", (), (["call"], "heuristic")), ("imported module fields", (), (["import", "field"], "heuristic")), ("x", (" Call ", "call"), (["call"], "explicit")), ("where is lookup", (), ([], None))])
def test_contexts(question, explicit, want):
    assert traversal.contexts_of(question, explicit) == want


def test_headings(spark):
    text = "# A\n### A\n## A\n## B\n```\n# no\n```\n# C"
    out = corpus.headings(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r.level, r.anchor, r.parent) for r in out] == [(1, "a", None), (3, "a_1", "a"), (2, "a_2", "a"), (2, "b", "a"), (1, "c", None)]


def test_manifest(spark):
    now, before = (spark.createDataFrame(x, "path string, hash string") for x in ([("a", "1"), ("b", "9"), ("d", "4")], [("a", "1"), ("b", "2"), ("c", "3")]))
    assert {r.path: r.state for r in sync.difference(now, before).collect()} == {"a": "confirmed", "b": "changed", "c": "deleted", "d": "new"}


def test_resolution_tiers(spark):
    definitions = spark.createDataFrame([("m_write", "write", "x/m.py", 1), ("m__go", "_go", "x/m.py", 2), ("n_load", "load", "x/n.py", 3), ("o_load", "load", "y/o.py", 4), ("p_stop_all", "stop_all", "y/p.py", 5), ("q_stop_all", "stop_all", "z/q.py", 6)], "id string, bare string, source_file string, ord long")
    calls = spark.createDataFrame(
        [(1, "c", "c_write", "x/c.py", "write"), (2, "c", "c_go", "x/c.py", "go"), (3, "c", "c_load", "x/c.py", "load"), (4, "c", "c_stop_all", "w/c.py", "stop_all"), (5, "c", "c_none", "x/c.py", "none"), (6, "c", "m_write", "x/c.py", "write"), (7, "c", "c_rn", "x/c.py", "rn")],
        "call_id long, source string, target string, source_file string, name string",
    )
    aliases = spark.createDataFrame([("x/c.py", "rn", "stop_all")], "source_file string, alias string, real string")
    out = {r.call_id: (r.resolved, r.confidence) for r in resolve.resolve(calls, definitions, aliases).collect()}
    assert out == {1: ("m_write", "AMBIGUOUS"), 2: ("m__go", "INFERRED"), 3: ("n_load", "AMBIGUOUS"), 4: ("p_stop_all", "AMBIGUOUS"), 7: ("p_stop_all", "AMBIGUOUS")}


def test_resolution_of_alias_chains_and_standard_names(spark):
    definitions = spark.createDataFrame([("m_slug", "slugify", "m.py", 1), ("m_strip", "strip", "m.py", 2), ("m_parse", "parse", "m.py", 3)], "id string, bare string, source_file string, ord long")
    calls = spark.createDataFrame([(i, "c", f"c_{n}", "c.py", n) for i, n in enumerate(["aa", "strip", "parse", "loop"])], "call_id int, source string, target string, source_file string, name string")
    aliases = spark.createDataFrame([("c.py", "aa", "bb"), ("c.py", "bb", "cc"), ("c.py", "cc", "slugify"), ("c.py", "loop", "pool"), ("c.py", "pool", "loop")], "source_file string, alias string, real string")
    out = {r.call_id: (r.resolved, r.confidence) for r in resolve.resolve(calls, definitions, aliases).collect()}
    assert out == {0: ("m_slug", "INFERRED"), 1: ("m_strip", "AMBIGUOUS"), 2: ("m_parse", "INFERRED")}


SNAP = "snapshot_id int, snapshot_at timestamp, id string, label string, file_type string, source_file string, source_location string, community int, description string, tags array<string>"


def snapshot_rows(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(s, datetime(2025, 1, s), *r) for s, *r in rows], SNAP)


def test_snapshot_changes(spark):
    node = lambda i, label="l", c=1, tags=None, path="a/b.py": (i, label, "code", path, "L1", c, None, tags)
    rows = [
        *[(1, *node(x)) for x in "abcd"], (1, *node("gone")), (1, *node("a")),
        *[(2, *node(x, c=7)) for x in "abc"], (2, *node("d", c=8)), (2, *node("new", c=7)),
        *[(4, *node(x, c=3, tags=["y", "x"] if x == "a" else None)) for x in "ab"], (4, *node("c", c=3, label="other")), (4, *node("d", c=None, path="a\\b.py")), (4, *node("new", c=3)),
    ]
    nodes = snapshot_rows(spark, rows)
    edges = spark.createDataFrame([], "snapshot_id int, snapshot_at timestamp, source string, target string, relation string, confidence string, weight int, call_sites array<string>")
    got = {(r.record_key, r.snapshot_id, r.change) for r in snapshots.changes(snapshots.graph_records(nodes, edges), chunk_keys=2).collect()}
    assert got == {("gone", 2, "removed"), ("new", 2, "added"), ("d", 2, "changed"), ("a", 4, "changed"), ("c", 4, "changed"), ("d", 4, "changed")}
    assert snapshots.changes(snapshots.graph_records(nodes.limit(0), edges)).count() == 0


def test_orphans(spark):
    at = "timestamp"
    keys = spark.createDataFrame([(f"k_{i}", 10 * i, None if i % 2 else 1000) for i in range(50)], "id string, b long, g long").select(
        F.xxhash64("id").alias("k1"), F.xxhash64("id", F.lit(1)).alias("k2"), "b", "g").select("k1", "k2", F.col("b").alias("born"), F.coalesce("g", F.lit(2**62)).alias("gone"))
    refs = spark.createDataFrame([("t", 1, "f", "K-7", 100), ("t", 2, "f", "k_7", 10), ("t", 3, "f", "k 8", 2000), ("t", 4, "f", "nothing", 5), ("t", 5, "f", "k_8", None)] + [("t", 100 + i, "f", "hot", 1) for i in range(500)], "ref_table string, ref_key long, field string, node_ref string, us long")
    refs = refs.withColumn("at", F.timestamp_micros("us").cast(at)).drop("us")
    got = {(r.ref_key, r.reason) for r in orphans.orphans(refs, keys, range_keys=8, slice_references=20).collect()}
    assert got == {(2, "late"), (3, "deleted"), (4, "missing")} | {(100 + i, "missing") for i in range(500)}
    assert orphans.orphans(refs.limit(0), keys).count() == 0
    assert orphans.orphans(refs, keys.limit(0)).count() == refs.count()


def test_clashing_columns_and_nulls(spark):
    nodes = spark.createDataFrame([("a", None, None), ("a", "x", None), (None, "y", None)], "id string, label string, k1 string").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("file_type", "string"), ("source_file", "string"), ("source_location", "string"), ("community", "int"), ("description", "string"), ("tags", "array<string>"), ("body", "string"), ("language", "string"), ("updated_at", "timestamp"), ("ingested_at", "timestamp"), ("created_at", "timestamp"), ("deleted_at", "timestamp"))])
    assert [(r.id, r.label) for r in graph.upsert_nodes(nodes).collect()] == [("a", "x")]
    assert orphans.parents(nodes, spark.createDataFrame([("s",)], "id string")).count() == 2
