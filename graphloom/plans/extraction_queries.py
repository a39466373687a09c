"""Queries that extract a graph from source files, each with its SQL."""

from __future__ import annotations

from graphloom.operators import extraction
from graphloom.plans.corpus_queries import _FILES, _files


def file_hubs(spark, folder):
    """A node for each file."""
    return extraction.hubs(_files(spark, folder))


def extract_definitions(spark, folder):
    """Classes, functions and methods with what they belong to."""
    return extraction.definitions(_files(spark, folder))


def extract_decorators(spark, folder):
    """Decorators with what they decorate."""
    return extraction.decorators(_files(spark, folder))


def extract_calls(spark, folder):
    """Calls within functions."""
    return extraction.calls(_files(spark, folder))


def extract_aliases(spark, folder):
    """Other names of imports and module-level values."""
    return extraction.aliases(_files(spark, folder))


def extract_docstrings(spark, folder):
    """Documentation of definitions."""
    return extraction.docstrings(_files(spark, folder))


def receiver_types(spark, folder):
    """The classes that attributes hold."""
    return extraction.receiver_types(_files(spark, folder))


_STEM = "regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')"
_ID = "lower(trim(regexp_replace({}, '[^a-zA-Z0-9]+', '_', 'g'), '_'))"
_BODY = r"regexp_replace(coalesce(content, ''), '\r\n?', chr(10), 'g')"
_PY = "WITH " + _FILES + f""", y AS (SELECT file_id, {_STEM} AS stem, {_BODY} AS body FROM f WHERE lower(path) LIKE '%.py'),
x AS (SELECT file_id, stem, unnest(string_split(body, chr(10))) AS s, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM y),
l AS (SELECT file_id, stem, CAST(line AS int) AS line, s, least(length(replace(regexp_extract(s, '^([ \\t]*)', 1), chr(9), '    ')) // 4, 6) AS depth,
  nullif(regexp_extract(s, '^[ \\t]*(?:async\\s+)?(def|class)\\s+\\w+', 1), '') AS kind, nullif(regexp_extract(s, '^[ \\t]*(?:async\\s+)?(?:def|class)\\s+(\\w+)', 1), '') AS name FROM x)"""  # fmt: skip
_UP = "(SELECT max({{'line': b.line, 'kind': b.kind, 'name': b.name}}) FROM d b WHERE b.file_id = {0}.file_id AND b.line < {0}.line AND b.depth < {0}.depth)".format("a")

QUERIES = {f.__name__: f for f in (file_hubs, extract_definitions, extract_decorators, extract_calls, extract_aliases, extract_docstrings, receiver_types)}
SQL = {
    "file_hubs": "WITH " + _FILES + f" SELECT file_id, {_ID.format(_STEM)} AS id, regexp_extract(path, '[^/]*$') AS label, path AS source_file FROM f WHERE path IS NOT NULL",
    "extract_definitions": _PY + f""", d AS (SELECT * FROM l WHERE kind IS NOT NULL), e AS (SELECT a.*, {_UP.replace('{{', '{').replace('}}', '}')} AS up FROM d a), o AS (SELECT *, up IS NOT NULL AND kind = 'def' AS inside FROM e WHERE up IS NULL OR up.kind = 'class')
SELECT file_id, line, kind, name, CASE WHEN inside THEN {_ID.format("stem || '_' || up.name || '_' || name")} ELSE {_ID.format("stem || '_' || name")} END AS id,
CASE WHEN inside THEN {_ID.format("stem || '_' || up.name")} ELSE {_ID.format("stem")} END AS owner, CASE WHEN inside THEN 'contains' ELSE 'defines' END AS relation FROM o""",
    "extract_decorators": _PY + f""", m AS (SELECT *, nullif(trim(regexp_extract(s, '^\\s*@(\\S.*)$', 1)), '') AS mark FROM l), d AS (SELECT * FROM l WHERE kind IS NOT NULL)
SELECT m.file_id, m.line, {_ID.format("'decorator_' || substr(mark, 1, 40)")} AS id, '@' || substr(mark, 1, 60) AS label, d.line AS target_line, d.name AS target
FROM m ASOF JOIN d ON m.file_id = d.file_id AND m.line < d.line WHERE mark IS NOT NULL AND m.depth = d.depth""",
    "extract_calls": _PY + f""", d AS (SELECT * FROM l WHERE kind IS NOT NULL), i AS (SELECT l.*, d.name AS caller FROM l ASOF JOIN d ON l.file_id = d.file_id AND l.line >= d.line WHERE l.kind IS NULL AND d.kind = 'def' AND d.depth < l.depth),
c AS (SELECT file_id, stem, line, caller, string_split(unnest(regexp_extract_all(regexp_replace(s, '^\\s*[#@].*$', ''), '([A-Za-z_][\\w.]*)\\(', 1)), '.') AS p FROM i)
SELECT file_id, line, caller, CASE WHEN len(p) > 1 THEN p[-2] END AS receiver, p[-1] AS callee, {_ID.format("stem || '_' || p[-1]")} AS target FROM c
WHERE p[-1] NOT IN ('', caller, 'and', 'or', 'not', 'in', 'is', 'if', 'elif', 'while', 'for', 'return', 'lambda', 'yield', 'assert', 'with', 'except', 'del', 'raise', 'await', 'def', 'class')""",
    "extract_aliases": _PY + r""", i AS (SELECT file_id, unnest(regexp_extract_all(s, '[\w.]+\s+as\s+\w+')) AS m FROM l WHERE regexp_matches(s, '^\s*(?:from\s+\S+\s+)?import\s')),
a AS (SELECT file_id, regexp_extract(m, '(\w+)$', 1) AS alias, regexp_extract(m, '(\w+)\s+as\s', 1) AS real FROM i UNION SELECT file_id, regexp_extract(s, '^([A-Za-z_]\w*)\s*=\s*([A-Za-z_]\w*)\s*$', 1), regexp_extract(s, '^([A-Za-z_]\w*)\s*=\s*([A-Za-z_]\w*)\s*$', 2)
FROM l WHERE regexp_matches(s, '^([A-Za-z_]\w*)\s*=\s*([A-Za-z_]\w*)\s*$')) SELECT * FROM a WHERE alias <> real""",
    "extract_docstrings": _PY + r""", g AS (SELECT file_id, body, regexp_extract_all(body, '(?s)(?:def\s+\w+|class\s+\w+)[^\n]*\n\s*(?:\"\"\".*?\"\"\"|''''''.*?'''''')') AS ms FROM y),
k AS (SELECT file_id, body, ms, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM g),
p AS (SELECT file_id, m, i, string_split_regex(body, '(?s)(?:def\s+\w+|class\s+\w+)[^\n]*\n\s*(?:\"\"\".*?\"\"\"|''''''.*?'''''')')[1:i] AS ps, ms[1:i-1] AS before FROM k),
b AS (SELECT file_id, CAST(1 + len(string_split(array_to_string(list_concat(ps, before), ''), chr(10))) - 1 AS int) AS line, regexp_extract(m, '^(?:def|class)\s+(\w+)', 1) AS owner,
  trim(regexp_extract(m, '(?s)^[^\n]*\n\s*(?:\"\"\"|'''''')(.*?)(?:\"\"\"|'''''')$', 1), ' ' || chr(10) || chr(9)) AS body FROM p)
SELECT file_id, line, owner, substr(trim(string_split(body, chr(10))[1]), 1, 120) AS label, substr(body, 1, 1000) AS body FROM b WHERE length(body) >= 8""",
    "receiver_types": _PY + r""", d AS (SELECT * FROM l WHERE kind = 'class'), i AS (SELECT l.file_id, l.line, lower(d.name) AS class, regexp_extract(l.s, 'self\.(\w+)\s*(?::\s*[\w\[\], ]+\s*)?=\s*([A-Z]\w*)\s*\(', 1) AS attribute,
  lower(regexp_extract(l.s, 'self\.(\w+)\s*(?::\s*[\w\[\], ]+\s*)?=\s*([A-Z]\w*)\s*\(', 2)) AS type FROM l ASOF JOIN d ON l.file_id = d.file_id AND l.line >= d.line WHERE d.depth < l.depth)
SELECT class, attribute, arg_max(type, (file_id, line)) AS type FROM i WHERE attribute <> '' GROUP BY ALL""",
}
