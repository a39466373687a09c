"""Round trips of exports, office files, and the graph object."""

from __future__ import annotations

import json
import zipfile
from xml.etree import ElementTree

from pyspark.sql import functions as F

from graphloom.api import PropertyGraph
from graphloom.sources import exports
from graphloom.sources.office import office_facts


def test_node_link_round_trip(spark, folder, tmp_path):
    g = PropertyGraph.from_tables(spark, folder)
    lines = exports.node_link(g.nodes, g.edges).collect()
    whole = {"nodes": [json.loads(r.line) for r in lines if r.part == "nodes"], "links": [json.loads(r.line) for r in lines if r.part == "links"]}
    (tmp_path / "graph.json").write_text(json.dumps(whole))
    nodes, edges = exports.read_node_link(spark, str(tmp_path / "graph.json"))
    key = ["id", "label", "file_type", "source_file", "description", "tags"]
    assert nodes.select(key).exceptAll(g.nodes.select(key)).count() == 0 and nodes.count() == g.nodes.count()
    key = ["source", "target", "relation", "confidence", "weight"]
    assert edges.select(key).exceptAll(g.edges.select(key)).count() == 0 and edges.count() == g.edges.count()


def test_graphml_is_xml(spark):
    nodes = spark.createDataFrame([('a"<&>', "l", None, "", None, 1, None, ["x"])], "id string, label string, file_type string, source_file string, source_location string, community int, description string, tags array<string>")
    edges = spark.createDataFrame([("a", "b", "calls", None, 2)], "source string, target string, relation string, confidence string, weight long")
    for row in exports.graphml(nodes, edges).collect():
        element = ElementTree.fromstring(row.line)
        assert element.tag in ("node", "edge")
        if element.tag == "node":
            assert element.get("id") == 'a"<&>'


def test_graph_object(spark, folder):
    g = PropertyGraph.from_tables(spark, folder)
    top = g.god_nodes(1).first().id
    near = {r.id for r in g.get_neighbors(top, 1, 5).collect()}
    assert top in near and len(near) <= 5
    other = next(iter(near - {top}))
    assert [r.id for r in g.shortest_path(top, other).orderBy("hop").collect()] == [top, other]
    assert sum(len(r.text) + 1 for r in g.ask("parser index", budget=100).collect()) <= 300
    g.views("t_")
    assert spark.sql("select count(*) from t_nodes").first()[0] == g.nodes.count()
    assert g.callers_of(top).columns and g.find_hyperedges_for(top).columns


def test_office(spark, tmp_path):
    w, s = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc></w:tr><w:tr/></w:tbl></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s}><sheets><sheet name="A"/><sheet name="B"/></sheets><definedNames><definedName name="n">A!$A$1</definedName></definedNames></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1"><f>B!A1+B!A2</f></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {s}><sheetData/></worksheet>")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    rows = office_facts(spark, str(tmp_path)).orderBy(F.substring_index("path", "/", -1), "pos").collect()
    assert [(r.kind, r.label, r.level, r.n_rows, r.reference) for r in rows[:2]] == [("heading", "Top", 2, None, None), ("table", "k", None, 2, None)]
    assert {(r.kind, r.label, r.reference) for r in rows if r.path.endswith("xlsx")} == {("sheet", "A", None), ("sheet", "B", None), ("reference", "A", "B"), ("name", "n", "A!$A$1")}
    assert [r.kind for r in rows if r.path.endswith("c.docx")] == ["error"]
