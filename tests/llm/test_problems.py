"""The text operators on small fixtures and against brute force."""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import abuse, confusables, functions, gll, handwritten, leaks, packing, registry, winnow
from graphloom.llm.tokens import plain

FILE = "file_id long, path string, repo string, language string, content string"


# Look-alikes


@pytest.mark.parametrize(("a", "b"), [("fоlder", "folder"), ("ｆｏｌｄｅｒ", "folder"), ("café", "café"), ("a b", "a b"), ("a‑b", "a-b"), ("so­ft​", "soft"), ("ﬁle", "file"), ("ｲﾝﾃﾞｯｸｽ", "インデックス"), ("각", "각")])
def test_same_skeleton(a, b):
    assert confusables.skeleton(a) == confusables.skeleton(b)


@pytest.mark.parametrize(("a", "b"), [("Folder", "folder"), ("c0lumn", "column"), ("sllver", "silver"), ("cafe", "café"), ("rn", "m"), ("ab", "a b"), ("a_b", "a-b")])
def test_other_skeleton(a, b):
    assert confusables.skeleton(a) != confusables.skeleton(b)


@pytest.mark.parametrize("sign", ["\ufe0f", "\U000e0001", "\U000e0041", "\U000e007f", "\U000e0100", "\U000e01ef"])
def test_invisible_signs_leave_no_trace(sign):
    assert confusables.skeleton(f"par{sign}ser") == "parser"
    assert confusables.readable(f"par{sign}ser") == "parser"
    assert winnow.comparable(f"Par{sign}ser") == "parser"


def test_tags_of_any_length():
    assert winnow.comparable(f'one <a href="x" title="{"word " * 200}">two</a>').split() == ["one", "two"]
    passage = "where x <y holds, we go on. " + "Many words follow. " * 20 + "\n> quoted"
    assert winnow.comparable(passage).split() == passage.lower().split()
    assert winnow.comparable("a <b c " * 3).split() == ["a", "<b", "c"] * 3


def test_lookalike_pairs(spark):
    schema = "id string, label string, norm_label string, tags array<string>, updated_at timestamp, ingested_at timestamp, label_x string"
    from datetime import datetime

    at = lambda d: datetime(2025, 1, d)
    rows = [
        ("a", "fоlder", None, ["x y", "x y"], at(1), at(1), ""), ("a", "fоlder", "", ["x y", None], at(2), at(2), ""), ("b", "folder", None, ["x y"], at(1), at(1), ""), ("c", "folder", None, [], at(1), at(1), ""),
        ("d", "Folder", None, None, at(1), at(1), ""), (None, "folder", None, None, at(1), at(1), ""),
    ]
    nodes = spark.createDataFrame(rows, schema)
    got = {(r.field, r.id_a, r.id_b) for r in confusables.lookalikes(confusables.cells(nodes)).collect()}
    assert got == {("label", "a", "b"), ("label", "a", "c"), ("tags", "a", "b")}
    assert confusables.lookalikes(confusables.cells(nodes.limit(0))).count() == 0
    links = {(r.field, r.id): r.n_links for r in confusables.classes(confusables.cells(nodes)).collect()}
    assert links == {("label", "a"): 2, ("label", "b"): 1, ("label", "c"): 1, ("tags", "a"): 1, ("tags", "b"): 1}
    assert {r.id: r.label for r in confusables.consistent(nodes).collect()}["a"] == "folder"


# Winnowing and leaks


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(0, 2**60, 11).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**60, rng.integers(0, 30)).astype(np.uint64), shared, rng.integers(0, 2**60, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(2))
        prints = [set(g[winnow.winnowed(g, 7)]) for g in (winnow.gram_hashes(np.zeros(len(x), int), x, 5) for x in (a, b))]
        assert prints[0] & prints[1]


def test_word_hashes_of_long_and_short_texts(monkeypatch):
    texts = ["one two three", "", "two " * 50, "ein größe café"]
    want = winnow.word_hashes(texts)
    monkeypatch.setattr(winnow, "CHARS", 40)
    winnow._powers.cache_clear()
    got = winnow.word_hashes(texts)
    winnow._powers.cache_clear()
    assert (got[0] == want[0]).all() and (got[1][:3] == want[1][:3]).all()


def test_leaks_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 11, 30])))) for i in range(25)]
    documents = [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80)))) for i in range(60)]
    for i in range(40):
        words = items[i % 25][1].split()
        start = rng.randrange(len(words))
        part = words[start : start + rng.choice([6, 11, 12, 20])] if i % 3 else words
        documents.append((300 + i, "Vor. " + "  ".join(f"**{w.upper()}**" if rng.random() < 0.2 else f"<b>{w}</b>," for w in part) + " nach"))
    documents += [(500, None), (501, "")]
    found = re.compile(r"[^\W_]+")
    want = set()
    for key, text in documents:
        words = found.findall(re.sub("<[^>]*>", " ", (text or "").lower()))
        for item, passage in items:
            p = passage.split()
            n = min(12, len(p))
            spans = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)}
            if any(tuple(words[i : i + n]) in spans for i in range(len(words) - n + 1)):
                want.add((key, item))
    d, t = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(d, t).collect()} == want
    assert leaks.leaks(d.limit(0), t).count() == 0


# Source files


def test_kinds_of_files(spark):
    code = "import os\n\ndef walk_tree(root, depth):\n    for name in os.listdir(root):\n        print(name, depth)\n        if depth > 3:\n            break\n    return root, depth\n" * 2
    rows = [
        (1, "a/hand.py", "r1", "python", code.replace("walk", "stroll")), (2, "vendor/x/tree.py", "r1", "python", code), (3, "b/tree.py", "r2", "python", "﻿" + code.replace("\n", "\r\n")), (4, "c/__generated__/x.py", "r1", "python", "x = 1"),
        (5, "c/x.go", "r1", "go", "package x\n\n// Code generated by y. DO NOT EDIT.\nfunc X() {}\n"), (6, "c/gen.py", "r1", "python", "BANNER = '# Code generated by %s. DO NOT EDIT.'\n" + code.replace("walk", "write")), (7, "d.js", "r1", None, "function a(b,c){return b?c.d:a(b-1,c)}" * 40),
        (8, "t.py", "r1", "python", "T = [\n" + "    0.5, 1.25, 3.75,\n" * 60 + "]\n"), (9, None, None, None, None), (10, "vendor_invoices/x.py", "r1", "python", ""), (11, "d.py", "r1", "python", "B = '" + "Qx9/" * 300 + "'\n"),
    ]
    files = spark.createDataFrame(rows, FILE)
    got = {r.file_id for r in handwritten.kinds(files).filter(handwritten.not_by_hand()).collect()}
    assert got == {2, 3, 4, 5, 7, 8, 11}
    assert handwritten.kinds(files.limit(0)).count() == 0


def test_files_that_repeat_themselves(spark):
    made = "".join(f"function make{w}Record{i}(msg) {{\n  return build('{w}', {i}, msg);\n}}\n" for i, w in enumerate(["Fox", "Owl", "Elk"] * 4))
    few = "".join(f"function make{w}(msg) {{\n  return build('{w}', msg);\n}}\n" for w in ("Fox", "Owl"))
    rng = random.Random(1)
    own = "".join(f"function step{i}({', '.join('abc'[: i % 3 + 1])}) {{\n" + "".join(rng.choice(["  if (a) { return b; }\n", "  let c = f(a, 1);\n", "  for (const x of a) g(x);\n", "  a.sort();\n"]) for _ in range(5)) + "}\n" for i in range(9))
    rows = [(1, "lib/a.js", "r", "javascript", made), (2, "lib/b.js", "r", "javascript", few), (3, "lib/c.js", "r", "javascript", own)]
    assert [(r.file_id, r.generated) for r in handwritten.kinds(spark.createDataFrame(rows, FILE)).orderBy("file_id").collect()] == [(1, True), (2, False), (3, False)]


def test_library_in_twenty_repositories(spark):
    library = [f"def part_{i}(root, depth):\n    'Part {i}.'\n    left = root.walk_{i}(depth + {i})\n    return join_{i}(left, key_{i * 7}, depth)\n" for i in range(60)]
    rows = [(n, f"src/m{n}.py", f"r{n}", "python", "".join(f if i != n else f"def own_{n}(x):\n    return x.local_{n}(x, x)\n" for i, f in enumerate(library))) for n in range(20)]
    rows += [(100 + n, f"src/own{n}.py", f"r{n}", "python", "".join(f"def f{n}_{j}(a{n}, b):\n    c{j} = a{n}.g{n}_{j}(b, {j})\n    return h{n}(c{j}, b)\n" for j in range(3)) + f"class C{n}(B{n}):\n    x{n} = [y{n} for y{n} in z{n}() if y{n}]\n") for n in range(20)]
    found = {r.file_id for r in handwritten.kinds(spark.createDataFrame(rows, FILE)).filter("vendored").collect()}
    assert found == set(range(20))


def test_copies_that_no_repository_marks(spark):
    origin = "".join(f"def part_{i}(root, depth):\n    return root.walk_{i}(depth + {i}, key_{i * 7})\n" for i in range(20))
    idiom = "try:\n    import json_fast as json\nexcept ImportError:\n    import json\nlog = logging.getLogger(__name__)\n"
    rows = [(i, f"lib/tool_{i}.py", f"r{i}", "python", idiom + origin.replace(f"walk_{i}(", f"local_{i}(")) for i in range(6)]
    rows += [(10 + i, f"lib/own_{i}.py", f"r{i}", "python", idiom + "".join(f"class C{i}_{j}:\n    size_{i} = {j}\n    def m{i}_{j}(self, x{j}):\n        return self.n{i}[x{j}]\n" for j in range(9))) for i in range(6)]
    short = "int f(int a) { return a + 1; }\n"  # below TOKENS
    rows += [(20, "vendor/f/f.java", "r1", "java", short), (21, "src/f.java", "r2", "java", "\ufeff" + short.replace("\n", "\r\n")), (22, "src/g.java", "r2", "java", short.replace("f", "g")), (23, "vendor/e.py", "r1", "python", ""), (24, "e.py", "r2", "python", "\n")]
    found = handwritten.kinds(spark.createDataFrame(rows, FILE)).filter(handwritten.not_by_hand()).select("file_id").collect()
    assert {r.file_id for r in found} == {0, 1, 2, 3, 4, 5, 20, 21, 23}


def test_recognises_ambiguous_grammar():
    rules = gll.grammar("S = a | S S | _")
    assert gll.ends(rules, "S", ["a", "a", "b"], 0, lambda t, x: t == x) == {0, 1, 2}


PYTHON = '''
# def commented(x): "no"
@deco(1)
async def first_name(
    a,
) -> dict[str, int]:
    # note
    r"""Reads the whole table at once."""
    def inner(x): "Says four words here."
    s = "def no(): pass"
    return s

class A:
    def trivial(self):
        """Trivial trivial trivial trivial method."""
    def format(self):
        "not a doc %s" % 1

def broken(a, b:
    """This one never closes its brackets."""

def after(a):
    """Still found after the broken one."""
    return a
'''
SCRIPT = """
/** Loads every row of the table. */
// a line
@Deco({a: 1})
export async function loadRows<T>(x: Map<string, T>): Promise<T[]> {
  const text = '/** no */ function nope() {}';
  if (x) { return call(x); }
}
/** Belongs to the number, not to the function. */
const N = 7;
function bare() { return `${N} /** x */`; }
class A {
  /**
   * Counts all the open boxes.
   * @param a these words do not count at all
   */
  static async count(a) { return a; }
  /**
   * @returns only tag lines here and nothing more
   */
  size() { return 1; }
}
/** Adds one to its only argument. */
export const addOne = (x: number): number => x + 1;
/* Not a documentation block at all. */
function plainBlock() {}
function cut(a) {
"""
JAVA = """
class A {
  /** Returns the names of all. */
  @Override
  public Map<String, List<int[]>> names(int a) throws IOException { return new Foo() { }; }
  int x = foo(1);
}
"""
GO = """
package x
// Opens the file for reading only.
func (f *File) Open(a map[string]int) (int, error) { return 0, nil }

// Not directly above the next function.

func Close() {}
// Close2 close2 does it.
func Close2() {}
"""


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [("a.py", PYTHON, {("first_name", 4), ("inner", 9), ("after", 22)}), ("a.ts", SCRIPT, {("loadRows", 5), ("count", 17), ("addOne", 24)}), ("A.java", JAVA, {("names", 5)}), ("a.go", GO, {("Open", 4)})],
)
def test_documented_functions(path, text, want):
    got = {(f[0], f[2]) for f in functions.defined(text.replace("\n", "\r\n"), path, None) if f[4] is not None and f[5] >= functions.WORDS}
    assert got == want


def test_functions_against_pythons_own_parser(spark, folder):
    import ast

    rows = spark.read.parquet(f"{folder}/source_files.parquet").filter("path like '%.py'").collect()
    for r in rows:
        tree = ast.parse(plain(r.content))
        want = {(n.lineno, n.name) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)}
        assert {(f[2], f[0]) for f in functions.defined(r.content, r.path, r.language)} == want


def test_heads_cost_their_own_length():
    body = "".join(f"\ta{i} := f{i}(x, y{i}) + z{i}.b\n" for i in range(400))
    go = "package p\n\n" + "".join(f"// F{i} walks over all of the given parts once.\nfunc (s *S) F{i}(x int) (map[string]struct{{ a int }}, interface{{}}) {{\n{body}}}\n" for i in range(9)) + "func stub(x int) int\nfunc (s *S) Last() {\n}\n"
    assert [f[:1] + f[2:4] for f in functions.defined(go, "a.go", None)] == [(f"F{i}", 4 + 403 * i, 405 + 403 * i) for i in range(9)] + [("Last", 3631, 3632)]
    lines = "".join(f"  const v{i} = g{i}({{ a: x }}, [y]);\n" for i in range(400))
    heads = ["function a(x: number): string | { b: number }[] {", "function c(x: T): x is { d: string } {", "function e<K extends keyof T>(x: K): T extends U ? { f: A } : B[K] {", "function g(x: T): (y: { h: T }) => Promise<{ i: T }> {"]
    text = "".join(f"{head}\n{lines}}}\n" for head in heads)
    assert [f[:1] + f[2:4] for f in functions.defined(text, "a.ts", None)] == [(name, 1 + 402 * i, 402 * (i + 1)) for i, name in enumerate("aceg")]


@pytest.mark.parametrize("n", [10, 200, 2000])
def test_functions_of_many_parameters(n):
    names = [f"parameter{i}" for i in range(n)]
    python = "def f(" + ", ".join(f"{x}: dict[str, int] = {{}}" for x in names) + "):\n    'Says four words here.'\n    return 1\n"
    script = "/** Says four words here. */\nfunction f(" + ", ".join(f"{x}: Map<string, (a: number) => void> = [{{}}]" for x in names) + "): void { return; }\n"
    plain_script = "/** Says four words here. */\nfunction f(" + ", ".join(f"{x} = {{ a: [1] }}" for x in names) + ") { return; }\n"
    java = "class A {\n/** Says four words here. */\npublic void f(" + ", ".join(f"final Map<String, List<int[]>> {x}" for x in names) + ") { }\n}\n"
    go = "package p\n// Says four words here.\nfunc f(" + ", ".join(f"{x} map[string]func(int) (int, error)" for x in names) + ") (int, error) { return 0, nil }\n"
    for path, text in (("a.py", python), ("a.ts", script), ("a.js", plain_script), ("A.java", java), ("a.go", go)):
        assert [f[0] for f in functions.defined(text, path, None) if f[5] >= functions.WORDS] == ["f"], path


def test_many_open_brackets():
    text = "function f() {\n" + "if (a) {\n" * 60 + "}\n" * 60 + "return 1;\n}\n/** Says four words here. */\nfunction g() { return [" + "(" * 50 + "1" + ")" * 50 + "]; }\n"
    assert [(f[0], f[2], f[3]) for f in functions.defined(text, "a.js", None)] == [("f", 1, 123), ("g", 125, 125)]


def test_templates_are_dropped(spark):
    make = lambda name, said: f"def {name}(x):\n    '{said}'\n    return x\n"
    template = "".join(make(f"get_{w}", f"Returns the value of field {i} of the record.") for i, w in enumerate("abcde"))
    own = make("walk", "Goes down the tree and yields each leaf.") + make("sort_all", "Puts the rows in order of their time.")
    rows = [(1, "a.py", "r", "python", template + own), (2, "b.py", "s", "python", own), (3, "c.py", "t", "python", own)]  # copies of a function are no template
    found = functions.functions(spark.createDataFrame(rows, FILE))
    assert functions.documented(found).count() == 11
    assert sorted(r.name for r in functions.pairs(found).collect()) == ["sort_all"] * 3 + ["walk"] * 3


def test_functions_of_no_files(spark):
    files = spark.createDataFrame([(1, "a.py", "r", None, None), (2, None, None, None, ""), (3, "x", None, "python", "def f(:")], FILE)
    assert functions.functions(files).count() == 0
    assert functions.pairs(functions.functions(files.limit(0))).count() == 0


# Packing


def test_packing(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), rng.choice(["a", "b", None])) for i in range(300)] + [(900, "omega " * 700, "a"), (901, None, "a"), (902, "", "b")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    budgets = spark.createDataFrame([(1, "s", 64), (2, "m", 500)], "budget_id int, name string, capacity_tokens int")
    sized = packing.sizes(documents)
    placed = packing.pack(packing.pieces(sized, budgets), slice_items=100)
    totals = {(r.budget_id, r.doc_id): r.n for r in placed.groupBy("budget_id", "doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    want = {(b, r.doc_id): r.n_tokens for r in sized.collect() if r.n_tokens for b in (1, 2)}
    assert totals == want
    full = packing.containers(placed).collect()
    assert all(r.unused >= 0 for r in full)
    cut = {r.doc_id for r in placed.filter("budget_id = 2 and piece > 0").collect()}
    assert cut == {k for (b, k), n in want.items() if b == 2 and n > 500}
    used = sum(r.n_tokens for r in full if r.budget_id == 2) / (500 * sum(r.budget_id == 2 for r in full))
    assert used > 0.9
    assert packing.pack(packing.pieces(sized.limit(0), budgets)).count() == 0


@pytest.mark.parametrize("target", [None, {"a": 0.2, "b": 0.2, "c": 0.3, "d": 0.3}])
def test_containers_keep_the_mixture(spark, target):
    rng = random.Random(4)
    weights = {"a": 40, "b": 30, "c": 20, "d": 10}
    sized = [(i, source, int(rng.lognormvariate(5, 0.6)) + 1) for i, source in enumerate(s for s, n in weights.items() for _ in range(60 * n))]
    items = packing.pieces(spark.createDataFrame(sized, "doc_id long, source string, n_tokens long"), spark.createDataFrame([(1, "m", 5000)], "budget_id int, name string, capacity_tokens int"))
    placed = packing.pack(items, slice_items=1500, target=target)
    assert placed.count() == len(sized)
    full = packing.containers(placed, target).collect()
    assert sum(r.unused for r in full) <= 0.02 * 5000 * len(full)
    distances = sorted(r.distance for r in full)
    if target is None:  # all sources last to the end
        assert sum(distances) / len(full) <= 0.1
    else:  # half of what is asked for lasts for a good part of the containers
        assert distances[len(full) // 4] <= 0.1


def test_long_texts_are_sized_whole(monkeypatch):
    encoding = packing._encoding(packing.TOKENIZER)
    rng = random.Random(6)
    text = "".join(rng.choice(["word", "  ", " ", "\n", "\n\n  ", "자동", "12", "..,", "it's", "\t"]) for _ in range(5000)) + "x" * 700
    monkeypatch.setattr(packing, "LONG", 300)
    assert packing._count(encoding, text) == len(encoding.encode_ordinary(text))


# Abuse


def test_disguises_leave_the_score(spark):
    clean = ["The index keeps two parcels of the {0} table open.", "Please sort the {0} before you load the second list.", "kill the child process when the {0} hangs."]
    bad = ["you are a stupid moron and so is your {0}.", "shut up you worthless {0} idiot."]
    nouns = ["river", "cedar", "token", "bridge", "lantern", "willow", "socket", "harbor"]
    texts, labels = [], []
    for i in range(160):
        lines = [c.format(nouns[(i + j) % 8]) for j, c in enumerate(clean)]
        if i % 4 == 0:
            lines.insert(1, bad[i // 4 % 2].format(nouns[i // 8 % 8]))
        texts.append("\n".join(lines))
        labels.append(i % 4 == 0)
    weights, bias = abuse.train(spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(zip(texts, labels))], "doc_id long, text string, bad boolean"))
    value = lambda t: abuse._document_scores([abuse.undisguised(t)], weights, bias)[0]
    assert value("The index keeps two parcels of the saffron table open.") < 0 < value("you are a stupid moron and so is your saffron.")
    assert value("you are a stuuuupid m.o.r.o.n and so is your saffron.") > 0 and value("yоu аre a stup1d m0ron and so is your saffron.") > 0
    d = spark.createDataFrame([(i, "wiki", t) for i, t in enumerate(texts)] + [(900, "wiki", None), (901, None, "")], "doc_id long, source string, text string")
    judged = spark.createDataFrame([(i, "abusive" if b else "clean") for i, b in enumerate(labels)] + [(3, "abusive"), (5, None)], "doc_id long, label string")
    out = {r.doc_id: r for r in abuse.scores(d, judged).collect()}
    assert len(out) == 162 and out[900].score == 0 and not out[901].flagged
    right = sum((out[i].score > 0.12) == b for i, b in enumerate(labels))
    assert right > 150
    assert abuse.scores(d.limit(0), judged.limit(0)).count() == 0


def test_pieces_of_long_sentences():
    run = "the old index " * 60 + "you are a stupid moron " + "keeps the table " * 60
    sentences = abuse.Sentences(["Short one. " + run, "Another."])
    assert [p for p in map(str.strip, sentences.pieces()) if p and len(p) < 20] == ["Short one.", "Another."]
    assert max(sentences.sizes) == abuse.SENTENCE and set(sentences.text_of) == {0, 1}
    assert any("you are a stupid moron" in p for p in sentences.pieces())
    weights = np.random.default_rng(0).normal(size=abuse.PLACES).astype(np.float32)
    again = abuse.Sentences.of(sentences.pieces()).scores(weights, 0.0)
    whole = [i for i, n in enumerate(sentences.sizes) if 4 < n < 20]
    assert len(whole) == 2 and np.allclose(sentences.scores(weights, 0.0)[whole], again[whole], atol=1e-3)


def test_held_out_accuracy(spark):
    large = Path("/root/testdata/check_l")
    folder = large if large.exists() else Path("/root/testdata/sf0.1")
    labels = spark.read.parquet(f"{folder}/moderation_labels.parquet")
    d = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id").distinct(), "doc_id")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    judged = labels.filter("label is not null").groupBy("doc_id").agg(F.avg((F.col("label") != "clean").cast("int")).alias("share"), F.count("*").alias("n")).filter("share in (0, 1) and n > 1").filter(part == 0)  # two reviewers agree
    scored = abuse.scores(d, labels.filter(part != 0)).join(judged, "doc_id").collect()
    hit = sum(r.flagged and r.share == 1 for r in scored)
    assert hit >= 0.9 * sum(r.share == 1 for r in scored)
    assert sum(not r.flagged for r in scored if r.share == 0) >= 0.98 * sum(r.share == 0 for r in scored)


FOUND = {"p1_found": ["field", "id_a", "id_b"], "p4_found": ["file_id"], "p5_found": ["file_id", "start_line"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_runs(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    rows = df.collect()
    if name in FOUND:
        assert df.columns == FOUND[name] and len(set(rows)) == len(rows)
    else:
        assert rows
