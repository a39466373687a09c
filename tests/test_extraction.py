"""Extraction of a graph from source files, typed calls, and updates of a stored graph, on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import extraction, resolve, sync
from graphloom.streaming import debounce

CODE = """import os.path as op
from shop import Basket as Cart, Till
take = Till

@trace("x")
class Shop(Base):
    '''Sells many things to people.'''
    def __init__(self):
        self.cart = Cart()
        self.till: Till = Till (3)

    @property
    async def total(self):
        \"\"\"Adds up
        all prices.\"\"\"
        def inner(x):
            return x
        if (self.cart.add(1)):
            # self.no(1)
            print(inner(2))
        return self.till.sum()

def run():
    Shop().total()
"""
FILE = "file_id long, path string, content string"


def test_extraction(spark):
    rows = [(1, "a\\\\shop front.py", CODE.replace("\n", "\r\n")), (2, "b/x.go", "func X() {}"), (3, None, "def f(): pass"), (4, "c.py", None), (5, "d.py", "")]
    files = spark.createDataFrame(rows, FILE)
    assert {(r.file_id, r.id, r.label) for r in extraction.hubs(files).collect()} == {(1, "shop_front", "shop front.py"), (2, "x", "x.go"), (4, "c", "c.py"), (5, "d", "d.py")}
    found = {(r.name, r.line, r.owner, r.relation, r.id) for r in extraction.definitions(files).collect()}
    assert found == {
        ("Shop", 6, "shop_front", "defines", "shop_front_shop"), ("__init__", 8, "shop_front_shop", "contains", "shop_front_shop_init"),
        ("total", 13, "shop_front_shop", "contains", "shop_front_shop_total"), ("run", 23, "shop_front", "defines", "shop_front_run"),
    }
    assert {(r.label, r.target, r.target_line) for r in extraction.decorators(files).collect()} == {('@trace("x")', "Shop", 6), ("@property", "total", 13)}
    calls = {(r.caller, r.receiver, r.callee, r.line) for r in extraction.calls(files).collect()}
    assert {("__init__", None, "Cart", 9), ("inner", None, "print", 20), ("run", None, "Shop", 24)} <= calls and not any(c[2] in ("if", "no") for c in calls)
    assert {(r.alias, r.real) for r in extraction.aliases(files).collect()} == {("op", "path"), ("Cart", "Basket"), ("take", "Till")}
    assert {(r.owner, r.line, r.label) for r in extraction.docstrings(files).collect()} == {("Shop", 6, "Sells many things to people."), ("total", 13, "Adds up")}
    assert {(r["class"], r.attribute, r.type) for r in extraction.receiver_types(files).collect()} == {("shop", "cart", "cart"), ("shop", "till", "till")}
    assert all(f(files.limit(0)).count() == 0 for f in (extraction.hubs, extraction.definitions, extraction.decorators, extraction.calls, extraction.aliases, extraction.docstrings, extraction.receiver_types))


def test_receivers_decide(spark):
    definitions = spark.createDataFrame([("m_cart_put", "put", "m.py", 1), ("n_till_put", "put", "n.py", 2)], "id string, bare string, source_file string, ord long")
    owners = spark.createDataFrame([("m_cart_put", "put", "cart"), ("n_till_put", "put", "till"), ("s_shop_go", "go", "shop")], "id string, bare string, class string")
    types = spark.createDataFrame([("shop", "box", "till")], "class string, attribute string, type string")
    calls = spark.createDataFrame([(1, "s_shop_go", "s_put", "s.py", "put", "box"), (2, "s_shop_go", "s_put", "s.py", "put", None), (3, "s_shop_go", "s_put", "s.py", "put", "other")], "call_id long, source string, target string, source_file string, name string, receiver string")
    typed = extraction.typed_calls(calls.withColumn("bare", F.lower("name")), owners, types)
    aliases = spark.createDataFrame([], "source_file string, alias string, real string")
    out = {r.call_id: (r.resolved, r.confidence) for r in resolve.resolve(calls, definitions, aliases, typed).collect()}
    assert out == {1: ("n_till_put", "INFERRED"), 2: ("m_cart_put", "AMBIGUOUS"), 3: ("m_cart_put", "AMBIGUOUS")}


def test_update_of_a_stored_graph(spark, tmp_path):
    def extract(files):
        lines = files.select(F.col("path").alias("source_file"), F.explode(F.split("content", " ")).alias("id"))
        return lines, lines.select("source_file", F.col("id").alias("source"), F.lit("x").alias("target"))

    def corpus(**files):
        return spark.createDataFrame([(f"{k}.py", v) for k, v in files.items()], "path string, content string").withColumn("committed_at", F.lit(1)).withColumn("ingested_at", F.lit(1))

    out = str(tmp_path / "graph")
    assert sync.update_graph(spark, out, corpus(a="one two", b="three", c="four"), extract) == {"new": 3, "action": "full_build"}
    assert sync.update_graph(spark, out, corpus(a="one two", b="three", c="four"), extract) == {"confirmed": 3, "action": "no_op"}
    asked = []
    seen = lambda files: asked.extend(r.path for r in files.collect()) or extract(files)
    assert sync.update_graph(spark, out, corpus(a="one two", b="five", d="six"), seen) == {"confirmed": 1, "changed": 1, "deleted": 1, "new": 1, "action": "incremental"}
    assert sorted(asked) == ["b.py", "d.py"]
    assert {(r.source_file, r.id) for r in sync.latest(spark, out, "nodes").collect()} == {("a.py", "one"), ("a.py", "two"), ("b.py", "five"), ("d.py", "six")}
    assert sync.latest(spark, out, "edges").count() == 4


def test_watched_paths(spark):
    paths = ["a/b.py", "a/.git/b.py", "graph-out/x.md", "LLM Wiki/_meta/x.md", "LLM Wiki/x.md", "x.png", ".env.py", "n.txt"]
    left = spark.createDataFrame([(p,) for p in paths], "path string").filter(debounce.watched("path"))
    assert {r.path for r in left.collect()} == {"a/b.py", "LLM Wiki/x.md", "n.txt"}
