"""Queries over the files and documents behind the graph, sync, streams and exports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import base_name, normal_path
from graphloom.operators import corpus, resolve, sync
from graphloom.plans.graph_queries import _G, _N, _built, _nodes
from graphloom.sources import exports
from graphloom.sources.tables import table
from graphloom.streaming import debounce

GLOBS = ["vendor/", "node_modules/", "*.min.js", "dist/", "docs/*", "!docs/*.md", "# comment", ""]
SPLIT = "2025-05-01"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Each file once, as delivered last."""
    f = table(spark, folder, "source_files")
    return f.groupBy("file_id").agg(F.max_by(F.struct("path", "repo", "language", "content", "committed_at"), "ingested_at").alias("f")).select("file_id", "f.*")


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of code and documents with their texts."""
    files = _files(spark, folder).select(normal_path("path").alias("path"), F.col("content").alias("text"))
    return files.unionByName(table(spark, folder, "documents").select(F.col("source_file").alias("path"), "text")).filter("path is not null")


def classify_files(spark, folder):
    """Files by kind."""
    return _paths(spark, folder).groupBy(F.coalesce(corpus.file_type("path", "text"), F.lit("none")).alias("file_type")).agg(F.count("*").alias("n_files"))


def corpus_stats(spark, folder):
    """Files and words by kind."""
    p = _paths(spark, folder).withColumn("file_type", corpus.file_type("path", "text")).filter("file_type is not null")
    return p.groupBy("file_type").agg(F.count("*").alias("n_files"), F.sum(F.when(F.col("file_type").isin("code", "document"), corpus.words("text")).otherwise(0)).alias("n_words"))


def sensitive_files(spark, folder):
    """Paths that may hold secrets, of files and nodes."""
    paths = _paths(spark, folder).select("path").unionByName(table(spark, folder, "nodes").select(normal_path("source_file").alias("path"))).distinct()
    return paths.filter(corpus.is_sensitive("path"))


def paper_signals(spark, folder):
    """Documents that read like papers, and their weak signs."""
    d = table(spark, folder, "documents")
    return d.filter(corpus.is_paper("text")).select("doc_id", corpus.weak_signs("text").alias("weak"))


def read_paths(spark, folder):
    """Paths in no hidden or ignored folder, by top folder."""
    return _paths(spark, folder).filter(corpus.is_read("path")).groupBy(F.substring_index("path", "/", 1).alias("top")).agg(F.count("*").alias("n_files"))


def ignore_globs(spark, folder):
    """Paths that the globs of an ignore file leave."""
    return _paths(spark, folder).select("path").distinct().filter(corpus.not_ignored("path", GLOBS))


def md_headings(spark, folder):
    return corpus.headings(table(spark, folder, "documents"))


def md_links(spark, folder):
    return corpus.links(table(spark, folder, "documents"))


def md_codeblocks(spark, folder):
    return corpus.code_blocks(table(spark, folder, "documents"))


def md_titles(spark, folder):
    """Titles from front matter."""
    return corpus.front_matter(table(spark, folder, "documents")).filter("title is not null")


def nearest_def(spark, folder):
    """Marked comments with the definition before them."""
    return corpus.rationales(_files(spark, folder))


def file_imports(spark, folder):
    return corpus.imports(_files(spark, folder))


def file_definitions(spark, folder):
    return corpus.definitions(_files(spark, folder))


def tree_rollup(spark, folder):
    """Nodes below each folder."""
    n = _nodes(spark, folder).filter("source_file <> ''").groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("n"))
    return corpus.tree(n)


def _calls(spark, folder) -> DataFrame:
    """Calls between nodes, as extraction leaves them: the target named under the caller's own file."""
    nodes = _nodes(spark, folder)
    e = table(spark, folder, "edges").filter("relation = 'calls' and source is not null and target is not null").groupBy("edge_id").agg(F.min_by(F.struct("source", "target", "source_file"), "ingested_at").alias("e")).select("edge_id", "e.*")
    bare = nodes.filter("file_type = 'code'").select(F.col("id").alias("target"), F.trim(F.regexp_replace("label", r"\(\)$", "")).alias("bare"))
    stem = F.regexp_replace(base_name(normal_path("source_file")), r"\.[^.]*$", "")
    asked = e.join(bare, "target").select(F.col("edge_id").alias("call_id"), "source", normal_path("source_file").alias("source_file"), stem.alias("own"), "bare")
    return asked.select("call_id", "source", "source_file", F.concat("own", F.lit("_"), "bare").alias("target"))


def resolve_calls(spark, folder):
    """Calls resolved over all files by name."""
    nodes = _nodes(spark, folder)
    code = nodes.filter("file_type = 'code' and label <> ''")
    definitions = code.select("id", F.lower(F.trim(F.regexp_replace("label", r"\(\)$", ""))).alias("bare"), "source_file", F.col("at").alias("ord"))
    stems = code.select(F.regexp_replace(base_name("source_file"), r"\.[^.]*$", "").alias("stem")).filter("stem <> ''")
    calls = resolve.call_table(resolve.known_stems(_calls(spark, folder), stems))
    aliases = code.filter("label like '\\_%'").select("source_file", F.regexp_replace("label", r"^_|\(\)$", "").alias("alias"), F.regexp_replace("label", r"\(\)$", "").alias("real")).distinct()
    return resolve.resolve(calls, definitions, aliases).select("call_id", "resolved", "confidence")


def _manifests(spark, folder) -> tuple[DataFrame, DataFrame]:
    f = table(spark, folder, "source_files").withColumn("path", normal_path("path"))
    return sync.manifest(f), sync.manifest(f.filter(F.col("committed_at") < F.lit(SPLIT).cast("timestamp_ntz")))


def manifest_diff(spark, folder):
    """Paths by state, against the manifest of an earlier day."""
    return sync.difference(*_manifests(spark, folder)).groupBy("state").agg(F.count("*").alias("n_paths"))


def uncached_files(spark, folder):
    """Files to be extracted anew."""
    now, before = _manifests(spark, folder)
    return sync.uncached(now, before)


def retention(spark, folder):
    """Nodes that survive a sync, by kind."""
    rows = _nodes(spark, folder).select("id", "file_type", F.coalesce("source_file", F.lit("")).alias("source_file"))
    return sync.retained(rows, sync.difference(*_manifests(spark, folder))).groupBy("file_type").agg(F.count("*").alias("n_nodes"))


def debounce_sessions(spark, folder):
    """Bursts of events of each user."""
    return debounce.sessions(table(spark, folder, "events"), ["user_id"], "6 hours").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n_events").alias("longest"))


def debounce_stream(spark, folder):
    """The same bursts by a stream."""
    s = debounce.stream_sessions(spark, table(spark, folder, "events"), "user_id", "6 hours")
    return s.groupBy(F.col("key").cast("bigint").alias("user_id")).agg(F.count("*").alias("n_sessions"), F.max("n_events").alias("longest"))


def changed_batches(spark, folder):
    """Bursts of commits of each repository."""
    b = debounce.changed_batches(_files(spark, folder), "1 days")
    return b.groupBy("repo").agg(F.count("*").alias("n_batches"), F.sum("n_paths").alias("n_paths"), F.count_if("needs_update").alias("n_updates"))


def watched_files(spark, folder):
    """Paths whose changes are looked at, of files, documents and nodes."""
    paths = _paths(spark, folder).select("path").unionByName(table(spark, folder, "nodes").select(normal_path("source_file").alias("path"))).distinct()
    return paths.filter(debounce.watched("path"))


def export_node_link(spark, folder):
    nodes, edges = _built(spark, folder)
    return exports.node_link(nodes, edges, table(spark, folder, "hyperedges"))


def export_graphml(spark, folder):
    nodes, edges = _built(spark, folder)
    return exports.graphml(nodes, edges)


def export_cypher(spark, folder):
    nodes, edges = _built(spark, folder)
    return exports.cypher(nodes, edges, table(spark, folder, "hyperedges"))


def export_notes(spark, folder):
    nodes, edges = _built(spark, folder)
    return exports.notes(nodes, edges)


def _any(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


def _in(xs: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


_FILES = r"f AS (SELECT * REPLACE (replace(path, '\', '/') AS path) FROM source_files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) = 1)"
_PATHS = "WITH " + _FILES + ", p AS (SELECT path, content AS text FROM f WHERE path IS NOT NULL UNION ALL SELECT source_file, text FROM documents WHERE source_file IS NOT NULL)"
_NAME = "regexp_extract(path, '[^/]*$')"
_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"
_TEXT_HEAD = "substr(coalesce(text, ''), 1, 3000)"
_WEAK = " + ".join(f"CAST(regexp_matches({_TEXT_HEAD}, '{p}') AS int)" for p in corpus.WEAK)
_PAPER = f"({_any(_TEXT_HEAD, corpus.STRONG)} OR {_WEAK} >= 3)"
_TYPE = f"CASE WHEN {_any(_NAME, corpus.SENSITIVE)} THEN NULL WHEN {_EXT} IN {_in(corpus.CODE)} THEN 'code' WHEN {_EXT} IN ('pdf') THEN 'paper' WHEN {_EXT} IN {_in(corpus.IMAGE)} THEN 'image' WHEN {_EXT} IN {_in(corpus.VIDEO)} THEN 'video' WHEN {_EXT} IN {_in(corpus.PROSE)} AND {_PAPER} THEN 'paper' WHEN {_EXT} IN {_in(corpus.DOCUMENT)} THEN 'document' END"
_LINES = r"l AS (SELECT file_id, unnest(string_split(regexp_replace(coalesce(content, ''), '\r\n?', chr(10), 'g'), chr(10))) AS s, generate_subscripts(string_split(regexp_replace(coalesce(content, ''), '\r\n?', chr(10), 'g'), chr(10)), 1) AS line FROM f)"
_BURSTS = "{0}, s AS (SELECT *, CASE WHEN {1} - lag({1}) OVER w <= INTERVAL {2} THEN 0 ELSE 1 END AS fresh FROM {3} WINDOW w AS (PARTITION BY {4} ORDER BY {1})), b AS (SELECT *, sum(fresh) OVER (PARTITION BY {4} ORDER BY {1} RANGE UNBOUNDED PRECEDING) AS burst FROM s)"
_EVENTS = _BURSTS.format("WITH x AS (SELECT * FROM events)", "ts", "6 hours", "x", "user_id") + ", c AS (SELECT user_id, burst, count(*) AS n FROM b GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY user_id"
_MANIFEST = r"""WITH m AS (SELECT replace(path, '\', '/') AS path, substr(sha256(coalesce(content, '')), 1, 16) AS hash, committed_at, ingested_at FROM source_files WHERE path IS NOT NULL),
now AS (SELECT path, arg_max(hash, (committed_at, ingested_at, hash)) AS hash FROM m GROUP BY 1), bef AS (SELECT path, arg_max(hash, (committed_at, ingested_at, hash)) AS hash FROM m WHERE committed_at < TIMESTAMP '""" + SPLIT + r"""' GROUP BY 1),
st AS (SELECT coalesce(n.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN n.hash = b.hash THEN 'confirmed' ELSE 'changed' END AS state FROM now n FULL JOIN bef b ON n.path = b.path)"""  # fmt: skip



def _json(fields: list[str]) -> str:
    """An object of the fields that aren't null, as text."""
    return "'{' || array_to_string(list_filter([" + ", ".join(f"""'"{x}":' || CAST(to_json({x}) AS varchar)""" for x in fields) + "], lambda x: x IS NOT NULL), ',') || '}'"


def _xml(value: str) -> str:
    return f"""replace(replace(replace(replace(coalesce(CAST({value} AS varchar), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


def _data(name: str, value: str) -> str:
    return f"""CASE WHEN {name} IS NULL THEN '' ELSE '<data key="{name}">' || {_xml(value)} || '</data>' END"""


def _quoted(value: str) -> str:
    return f"chr(39) || regexp_replace(replace(replace(coalesce({value}, ''), chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)), '[\\r\\n]+', ' ', 'g') || chr(39)"


QUERIES = {
    f.__name__: f
    for f in (
        classify_files, corpus_stats, sensitive_files, paper_signals, read_paths, ignore_globs, md_headings, md_links, md_codeblocks, md_titles, nearest_def, file_imports, file_definitions, tree_rollup, resolve_calls,
        manifest_diff, uncached_files, retention, debounce_sessions, debounce_stream, changed_batches, watched_files, export_node_link, export_graphml, export_cypher, export_notes,
    )
}
SQL = {
    "classify_files": _PATHS + f" SELECT coalesce({_TYPE}, 'none') AS file_type, count(*) AS n_files FROM p GROUP BY 1",
    "corpus_stats": _PATHS + rf", t AS (SELECT *, {_TYPE} AS file_type FROM p) SELECT file_type, count(*) AS n_files, CAST(sum(CASE WHEN file_type IN ('code', 'document') THEN len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) ELSE 0 END) AS bigint) AS n_words FROM t WHERE file_type IS NOT NULL GROUP BY 1",
    "sensitive_files": _PATHS + rf", q AS (SELECT path FROM p UNION SELECT replace(source_file, '\', '/') FROM nodes) SELECT path FROM q WHERE {_any(_NAME, corpus.SENSITIVE)}",
    "paper_signals": f"SELECT doc_id, {_WEAK} AS weak FROM documents WHERE {_PAPER}",
    "read_paths": _PATHS + f" SELECT split_part(path, '/', 1) AS top, count(*) AS n_files FROM p WHERE NOT regexp_matches(path, '(^|/)\\.[^/]+/') AND NOT list_has_any(string_split(path, '/'), {corpus.IGNORED}) GROUP BY 1",
    "ignore_globs": _PATHS + " SELECT DISTINCT path FROM p WHERE NOT (split_part(path, '/', 1) IN ('vendor', 'node_modules', 'dist') OR path LIKE '%.min.js' OR path LIKE 'docs/%') OR path LIKE 'docs/%.md'",
    "md_headings": r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '(?ms)^```.*?^```[^\n]*$', '', 'g'), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS int) AS pos FROM t), h AS (SELECT doc_id, pos, length(regexp_extract(line, '^(#{1,6})\s+\S', 1)) AS level, trim(regexp_extract(line, '^#{1,6}\s+(.+?)\s*$', 1)) AS title FROM l),
g AS (SELECT *, substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_'), 1, 60) AS slug FROM h WHERE level > 0),
a AS (SELECT *, slug || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || (row_number() OVER w - 1) END AS anchor FROM g WINDOW w AS (PARTITION BY doc_id, slug ORDER BY pos))
SELECT doc_id, pos, CAST(level AS int) AS level, title, anchor, (SELECT arg_max(b.anchor, b.pos) FROM a b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level) AS parent FROM a""",
    "md_links": r"WITH e AS (SELECT doc_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '(?:^|[^!])(\[[^\]]+\]\(https?://[^)\s]+\))', 1) AS ms FROM documents)), q AS (SELECT doc_id, k, regexp_extract(m, '^\[([^\]]+)\]', 1) AS label, regexp_extract(m, '\((https?://[^)\s]+)\)$', 1) AS url FROM e) SELECT doc_id, url, arg_min(label, k) AS label FROM q GROUP BY 1, 2",
    "md_codeblocks": r"WITH e AS (SELECT doc_id, unnest(ms) AS m, CAST(generate_subscripts(ms, 1) AS int) AS n FROM (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '(?s)(```\w*\n.*?```)', 1) AS ms FROM documents)) SELECT doc_id, n, regexp_extract(m, '^```(\w*)\n', 1) AS language, substr(regexp_extract(m, '(?s)^```\w*\n(.*?)```$', 1), 1, 1000) AS body FROM e",
    "md_titles": r"""WITH t AS (SELECT doc_id, nullif(trim(regexp_replace(regexp_extract(regexp_extract(coalesce(text, ''), '(?s)\A---\n(.*?)\n---', 1), '(?m)^title:\s*(.+?)\s*$', 1), '^"|"$', '', 'g')), '') AS title FROM documents) SELECT * FROM t WHERE title IS NOT NULL""",
    "nearest_def": "WITH " + _FILES + ", " + _LINES + r""", m AS (SELECT file_id, line, regexp_extract(s, '^\s*(?:#|//)\s*(NOTE|WHY|HACK|TODO|FIXME|XXX|IMPORTANT):\s*(.*)$', 1) AS marker, substr(trim(regexp_extract(s, '^\s*(?:#|//)\s*(NOTE|WHY|HACK|TODO|FIXME|XXX|IMPORTANT):\s*(.*)$', 2)), 1, 120) AS text FROM l),
d AS (SELECT file_id, line, regexp_extract(s, '^\s*(?:async\s+)?(?:def|class|func|function)\s+(\w+)', 1) AS name FROM l)
SELECT m.file_id, CAST(m.line AS int) AS line, marker, text, d.name AS definition, CAST(d.line AS int) AS definition_line FROM (SELECT * FROM m WHERE marker <> '' AND text <> '') m ASOF LEFT JOIN (SELECT * FROM d WHERE name <> '') d ON d.file_id = m.file_id AND d.line <= m.line""",
    "file_definitions": "WITH " + _FILES + ", " + _LINES + r""", d AS (SELECT l.file_id, CAST(line AS int) AS line, regexp_extract(s, '^(?:export\s+)?(?:async\s+)?(?:def|class|func|function|type)\s+(\w+)', 1) AS name, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS stem FROM l JOIN f USING (file_id))
SELECT file_id, line, name, lower(trim(regexp_replace(stem || '_' || name, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS id FROM d WHERE name <> ''""",
    "file_imports": "WITH " + _FILES + ", " + _LINES + r""", d AS (SELECT file_id, trim(coalesce(nullif(regexp_extract(s, '^from\s+([\w.]+)\s+import\b', 1), ''), nullif(regexp_extract(s, '^import\s.*\bfrom\s+[''"]([^''"]+)[''"]', 1), ''), nullif(regexp_extract(s, '^import\s+(?:static\s+)?["'']?([\w./]+)["'']?;?\s*$', 1), '')), './') AS module FROM l) SELECT DISTINCT file_id, module FROM d WHERE module <> ''""",
    "tree_rollup": _N + r""", p AS (SELECT string_split('./' || regexp_replace(source_file, '^/+', ''), '/') AS ps, count(*) AS k FROM n WHERE source_file <> '' GROUP BY 1), a AS (SELECT ps, k, unnest(generate_series(1, len(ps))) AS i FROM p)
SELECT array_to_string(ps[1:i], '/') AS path, CASE WHEN i > 1 THEN array_to_string(ps[1:i-1], '/') END AS parent, CAST(i - 1 AS int) AS depth, CAST(sum(k) AS bigint) AS total_count FROM a GROUP BY 1, 2, 3""",
    "manifest_diff": _MANIFEST + " SELECT state, count(*) AS n_paths FROM st GROUP BY 1",
    "uncached_files": _MANIFEST + " SELECT path, hash FROM now WHERE NOT EXISTS (SELECT 1 FROM bef WHERE bef.path = now.path AND bef.hash = now.hash)",
    "retention": _MANIFEST + _N.replace("WITH RECURSIVE ", ", ") + " SELECT file_type, count(*) AS n_nodes FROM n WHERE coalesce(source_file, '') NOT IN (SELECT path FROM st WHERE state <> 'new') GROUP BY 1",
    "debounce_sessions": _EVENTS,
    "debounce_stream": _EVENTS,
    "changed_batches": _BURSTS.format("WITH " + _FILES + ", x AS (SELECT *, path AS name FROM f WHERE path IS NOT NULL AND committed_at IS NOT NULL)", "committed_at", "1 day", "x", "repo") + f", c AS (SELECT repo, burst, count(DISTINCT path) AS k, bool_or({_EXT} NOT IN {_in(corpus.CODE)}) AS u FROM b GROUP BY 1, 2) SELECT repo, count(*) AS n_batches, CAST(sum(k) AS bigint) AS n_paths, count(*) FILTER (u) AS n_updates FROM c GROUP BY 1",
    "watched_files": _PATHS + r""", q AS (SELECT path FROM p UNION SELECT replace(source_file, '\', '/') FROM nodes)
SELECT path FROM q WHERE regexp_matches(lower(path), '\.(py|ts|js|jsx|tsx|mjs|ejs|go|rs|java|cpp|cc|cxx|c|h|hpp|rb|swift|kt|kts|cs|scala|php|lua|toc|zig|ps1|ex|exs|m|mm|jl|vue|svelte|dart|v|sv|sql|r|pdf|md|txt|rst|html|tex)$')
AND NOT regexp_matches(path, '(^|/)\.') AND NOT list_contains(string_split(path, '/'), 'graph-out') AND NOT (list_contains(string_split(path, '/'), 'LLM Wiki') AND list_contains(string_split(path, '/'), '_meta'))""",
    "export_node_link": _G + f" SELECT 'nodes' AS part, id AS key, {_json(['id', 'label', 'file_type', 'source_file', 'source_location', 'community', 'description', 'tags'])} AS line FROM n UNION ALL SELECT 'links', source || '|' || target, {_json(['source', 'target', 'relation', 'confidence', 'weight'])} FROM g UNION ALL SELECT 'hyperedges', CAST(hyperedge_key AS varchar), {_json(['id', 'type', 'label', 'members', 'size', 'source_file'])} FROM (SELECT hyperedge_key, any_value(id) AS id, any_value(type) AS type, any_value(label) AS label, any_value(members) AS members, any_value(size) AS size, any_value(source_file) AS source_file FROM hyperedges GROUP BY 1)",
    "export_graphml": _G + " SELECT 'node' AS part, id AS key, '<node id=\"' || " + _xml("id") + " || '\">' || " + " || ".join(_data(x, "to_json(tags)" if x == "tags" else x) for x in ("label", "file_type", "source_file", "source_location", "community", "description", "tags")) + " || '</node>' AS line FROM n UNION ALL SELECT 'edge', source || '|' || target, '<edge source=\"' || " + _xml("source") + " || '\" target=\"' || " + _xml("target") + " || '\">' || " + " || ".join(_data(x, x) for x in ("relation", "confidence", "weight")) + " || '</edge>' FROM g",
    "export_cypher": _G + f""", h AS (SELECT hyperedge_key, max(label) AS label, max(members) AS members FROM hyperedges GROUP BY 1), m AS (SELECT DISTINCT hyperedge_key, unnest(members) AS m FROM h)
SELECT 1 AS step, id AS key, 'CREATE (:Node {{id: ' || {_quoted("id")} || ', label: ' || {_quoted("label")} || ', file_type: ' || {_quoted("file_type")} || '}});' AS line FROM n
UNION ALL SELECT 2, source || '|' || target, 'MATCH (a:Node {{id: ' || {_quoted("source")} || '}}), (b:Node {{id: ' || {_quoted("target")} || '}}) CREATE (a)-[:' || upper(regexp_replace(coalesce(nullif(relation, ''), 'related'), '[^A-Za-z0-9]+', '_', 'g')) || ' {{weight: ' || weight || '}}]->(b);' FROM g
UNION ALL SELECT 3, CAST(hyperedge_key AS varchar), 'CREATE (:HyperEdge {{id: ' || hyperedge_key || ', label: ' || {_quoted("label")} || '}});' FROM h
UNION ALL SELECT 4, hyperedge_key || '|' || m, 'MATCH (a:Node {{id: ' || {_quoted("m")} || '}}), (h:HyperEdge {{id: ' || hyperedge_key || '}}) CREATE (a)-[:MEMBER_OF]->(h);' FROM m WHERE m IS NOT NULL""",
    "export_notes": _G + " SELECT id, 0 AS part, '# ' || coalesce(nullif(label, ''), id) AS line FROM n UNION ALL SELECT source, 1, '- ' || coalesce(relation, '') || ' -> [[' || target || ']]' FROM g UNION ALL SELECT target, 2, '- ' || coalesce(relation, '') || ' <- [[' || source || ']]' FROM g",
}
