"""Every registered query of the core against its SQL on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from graphloom.plans import registry

@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(str(row[i]) for i in order) for row in values)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, db, folder, name):
    df = registry.QUERIES[name](spark, folder)
    cursor = db.execute(registry.SQL[name])
    assert sorted(df.columns) == sorted(x[0] for x in cursor.description)
    assert rows(df.columns, df.collect()) == rows([x[0] for x in cursor.description], cursor.fetchall())


def test_depth_first_query(spark, folder):
    rows = registry.QUERIES["dfs_nodes"](spark, folder).collect()
    for seed in {r.seed for r in rows}:
        own = sorted((r for r in rows if r.seed == seed), key=lambda r: r.visit)
        assert [r.visit for r in own] == list(range(len(own))) and len({r.id for r in own}) == len(own)
        at = {r.id: r for r in own}
        assert all(r.parent is None if r.depth == 0 else (at[r.parent].depth == r.depth - 1 and at[r.parent].visit < r.visit) for r in own)
        assert max(r.depth for r in own) <= 3


def test_rendered_query(spark, folder):
    rows = registry.QUERIES["render_nodes"](spark, folder).orderBy("line").collect()
    assert [r.line for r in rows] == list(range(1, len(rows) + 1)) and sum(len(r.text) + 1 for r in rows) <= 6000
    assert all(r.text.startswith(("NODE ", "EDGE ")) for r in rows)


def test_resolved_calls_query(spark, folder):
    rows = registry.QUERIES["resolve_calls"](spark, folder).collect()
    known = {r.id for r in registry.QUERIES["node_upsert"](spark, folder).collect()} | {r.id for r in spark.read.parquet(f"{folder}/shared_nodes.parquet").collect()}
    assert rows and all(r.resolved in known and r.confidence in ("INFERRED", "AMBIGUOUS") for r in rows)
    assert len({r.call_id for r in rows}) == len(rows)


def test_all_queries_without_sql_are_tested():
    assert set(registry.QUERIES) - set(registry.SQL) == {"dfs_nodes", "render_nodes", "resolve_calls", "louvain"}  # louvain: tests/test_graph.py
