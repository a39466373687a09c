"""Facts of office files, read as binary files by all executors: headings and tables of .docx, sheets of .xlsx.

Both are zipped XML.  A file that can't be read gives one row with its error
and none of its facts; nothing is raised.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_FACTS = "path string, pos int, kind string, label string, level int, n_rows int, n_columns int, reference string, error string"


def _docx(content: bytes) -> Iterator[dict]:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_WORD}body")
    for item in body:
        text = "".join(t.text or "" for t in item.iter(f"{_WORD}t")).strip()
        if item.tag == f"{_WORD}p":
            style = item.find(f"{_WORD}pPr/{_WORD}pStyle")
            level = re.fullmatch(r"Heading ?([1-9])", style.get(f"{_WORD}val", "") if style is not None else "")
            if level and text:
                yield {"kind": "heading", "label": text, "level": int(level[1])}
        elif item.tag == f"{_WORD}tbl":
            rows = item.findall(f"{_WORD}tr")
            first = [" ".join(t.text or "" for t in cell.iter(f"{_WORD}t")) for cell in rows[0].findall(f"{_WORD}tc")] if rows else []
            yield {"kind": "table", "label": " | ".join(first)[:80], "n_rows": len(rows), "n_columns": len(first)}


def _xlsx(content: bytes) -> Iterator[dict]:
    files = zipfile.ZipFile(io.BytesIO(content))
    book = ElementTree.fromstring(files.read("xl/workbook.xml"))
    names = [s.get("name") for s in book.iter(f"{_SHEET}sheet")]
    for number, name in enumerate(names, 1):
        cells = [c for c in ElementTree.fromstring(files.read(f"xl/worksheets/sheet{number}.xml")).iter(f"{_SHEET}c")]
        at = [re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", "")) for c in cells]
        yield {"kind": "sheet", "label": name, "n_rows": len({m[2] for m in at if m}), "n_columns": len({m[1] for m in at if m})}
        seen = set()
        for cell in cells:
            formula = cell.find(f"{_SHEET}f")
            for quoted, bare in re.findall(r"'([^']+)'!|\b(\w+)!", (formula.text or "") if formula is not None else ""):
                other = quoted or bare
                if other in names and other != name and other not in seen:
                    seen.add(other)
                    yield {"kind": "reference", "label": name, "reference": other}
    for defined in book.iter(f"{_SHEET}definedName"):
        yield {"kind": "name", "label": defined.get("name"), "reference": defined.text}


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FACTS.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            try:
                found = list((_docx if path.lower().endswith(".docx") else _xlsx)(content))
            except Exception as e:  # noqa: BLE001
                found = [{"kind": "error", "error": f"{type(e).__name__}: {e}"[:200]}]
            rows += [{"path": path, "pos": i} | fact for i, fact in enumerate(found)]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)


def office_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Headings, tables, sheets, references between sheets and defined names of the .docx and .xlsx files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,xlsx}").load(folder)
    return files.select("path", "content").mapInArrow(_facts, _FACTS)
