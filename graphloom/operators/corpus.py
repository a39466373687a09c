"""Facts from a corpus of files: what to read, what kind it is, and what markdown, web pages and source text say."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import base_name, make_id, normal_path

# Folders never read, and file endings by kind.
IGNORED = [".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", "target", ".pytest_cache", ".mypy_cache", "graph-out", "_meta"]
CODE = [
    "py", "ts", "js", "jsx", "tsx", "mjs", "ejs", "go", "rs", "java", "cpp", "cc", "cxx", "c", "h", "hpp", "rb", "swift", "kt", "kts", "cs", "scala",
    "php", "lua", "toc", "zig", "ps1", "ex", "exs", "m", "mm", "jl", "vue", "svelte", "dart", "v", "sv", "sql", "r",
]
DOCUMENT = ["md", "mdx", "txt", "rst", "html", "yaml", "yml", "docx", "xlsx"]
PROSE = ["md", "mdx", "txt", "rst"]
PAPER = ["pdf"]
IMAGE = ["png", "jpg", "jpeg", "gif", "webp", "svg"]
VIDEO = ["mp4", "mov", "webm", "mkv", "avi", "m4v", "mp3", "wav", "m4a", "ogg"]

# Names of files that hold secrets.
SENSITIVE = [
    r"(?i)(^|[\\/])\.(env|envrc)(\.|$)", r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$", r"(?i)(credential|secret|passwd|password|token|private_key)",
    r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$", r"(?i)(\.netrc|\.pgpass|\.htpasswd)$", r"(?i)(aws_credentials|gcloud_credentials|service.account)",
]
# Signs that a text is a paper; one strong sign, or three weak ones, in its first 3000 characters.
STRONG = [r"(?mi)^arxiv_id\s*:", r"(?mi)^type\s*:\s*paper\b", r"(?i)arxiv\.org/(abs|pdf)/\d{4}\.\d{4,5}", r"(?mi)^paper_authors\s*:"]
WEAK = [r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{", r"\[\d+\]", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b"]
HEAD, WEAK_SIGNS = 3000, 3


def ending(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def is_read(path: Column | str) -> Column:
    """A path none of whose folders is hidden and none of whose parts is an ignored folder."""
    parts = F.split(normal_path(path), "/")
    hidden = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.startswith(".") & (F.length(p) > 1))
    return ~hidden & ~F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED)))


def is_sensitive(path: Column | str) -> Column:
    name = base_name(normal_path(path))
    return reduce(lambda a, b: a | b, [name.rlike(p) for p in SENSITIVE])


def weak_signs(text: Column | str) -> Column:
    head = F.substring(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 1, HEAD)
    return reduce(lambda a, b: a + b, [head.rlike(p).cast("int") for p in WEAK])


def is_paper(text: Column | str) -> Column:
    head = F.substring(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 1, HEAD)
    return reduce(lambda a, b: a | b, [head.rlike(p) for p in STRONG]) | (weak_signs(text) >= WEAK_SIGNS)


def file_type(path: Column | str, text: Column | str) -> Column:
    """code, paper, image, video or document; null for a file that isn't read."""
    e = ending(path)
    return (
        F.when(is_sensitive(path), F.lit(None)).when(e.isin(CODE), "code").when(e.isin(PAPER), "paper").when(e.isin(IMAGE), "image").when(e.isin(VIDEO), "video")
        .when(e.isin(PROSE) & is_paper(text), "paper").when(e.isin(DOCUMENT), "document")
    )


def words(text: Column | str) -> Column:
    """Number of words between blanks; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\s+"), lambda x: x != ""))


def matches_glob(path: Column, glob: str) -> Column:
    """Whether a path matches a glob of an ignore file.

    A trailing `/` is a folder at the top and all below it; else the whole
    path matches, where `*` crosses folders, or a part of it equals the glob.
    """
    bare = glob.rstrip("/")
    if glob.endswith("/"):
        return (path == bare) | path.startswith(f"{bare}/")
    return path.rlike("^" + fnmatch.translate(bare).replace("\\Z", "\\z")) | F.array_contains(F.split(path, "/"), bare)


def not_ignored(path: Column | str, globs: list[str]) -> Column:
    """Paths that no glob excludes, or that a `!` glob takes back; comments and blanks are no globs."""
    path = normal_path(path)
    lines = [g.strip() for g in globs if g.strip() and not g.strip().startswith("#")]
    out = [matches_glob(path, g) for g in lines if not g.startswith("!")]
    back = [matches_glob(path, g[1:].strip()) for g in lines if g.startswith("!")]
    any_of = lambda xs: reduce(lambda a, b: a | b, xs, F.lit(False))
    return ~any_of(out) | any_of(back)


def slug(column: Column, most: int = 60) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "_"), F.lit("_")), 1, most)


def prose_lines(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The lines of each text outside fenced code: key, pos, line."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), r"(?ms)^```.*?^```[^\n]*$", "")
    return documents.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def headings(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Markdown headings with level, anchor and parent: the nearest heading before that is of a higher rank, null for the text itself.

    Equal anchors of a text are numbered from the second on.  For each rank
    the last heading before is carried along the text, so no heading is
    joined with all others.
    """
    found = prose_lines(documents, key).withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))).filter("level > 0")
    h = found.select(key, "pos", "level", F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*$", 1)).alias("title"))
    h = h.withColumn("slug", slug(F.col("title")))
    n = F.row_number().over(Window.partitionBy(key, "slug").orderBy("pos")) - 1
    h = h.withColumn("anchor", F.when(n == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), n.cast("string"))))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ranks = [F.last(F.when(F.col("level") == rank, F.struct("pos", "anchor")), ignorenulls=True).over(before).alias(f"l{rank}") for rank in range(1, 6)]
    h = h.select("*", *ranks)
    parent = F.greatest(*[F.when(F.col("level") > rank, F.col(f"l{rank}")) for rank in range(1, 6)], F.lit(None).cast("struct<pos:int,anchor:string>"))
    return h.select(key, "pos", "level", "title", "anchor", parent["anchor"].alias("parent"))


def links(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """External markdown links, pictures excepted, the first of each address in a text: key, label, url."""
    each = documents.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(r"(?<!!)(\[[^\]]+\]\(https?://[^)\s]+\))"), 1)).alias("at", "m"))
    parts = each.select(key, "at", F.regexp_extract("m", r"^\[([^\]]+)\]", 1).alias("label"), F.regexp_extract("m", r"\((https?://[^)\s]+)\)$", 1).alias("url"))
    return parts.groupBy(key, "url").agg(F.min_by("label", "at").alias("label"))


def code_blocks(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fenced code: key, n (from 1), language, body of 1000 characters at most."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    each = documents.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"(?s)(```\w*\n.*?```)"), 1)).alias("n", "m"))
    return each.select(key, (F.col("n") + 1).alias("n"), F.regexp_extract("m", r"^```(\w*)\n", 1).alias("language"), F.substring(F.regexp_extract("m", r"(?s)^```\w*\n(.*?)```$", 1), 1, 1000).alias("body"))


def front_matter(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """A text's title from its front matter, else null."""
    head = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?s)\A---\n(.*?)\n---", 1)
    return documents.select(key, F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, r"(?m)^title:\s*(.+?)\s*$", 1), '^"|"$', ""), F.lit(" ")), F.lit("")).alias("title"))


def rationales(files: DataFrame) -> DataFrame:
    """Marked comments (`# NOTE: text`) and the definition before each: file_id, line, marker, text, definition, definition_line.

    The nearest definition is carried along the file's lines (an as-of join
    without a join); a comment before any definition belongs to none.
    """
    lines = files.select("file_id", F.posexplode(F.split(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n"), "\n")).alias("n", "s")).withColumn("line", F.col("n") + 1)
    mark = r"^\s*(?:#|//)\s*(NOTE|WHY|HACK|TODO|FIXME|XXX|IMPORTANT):\s*(.*)$"
    defined = F.nullif(F.regexp_extract("s", r"^\s*(?:async\s+)?(?:def|class|func|function)\s+(\w+)", 1), F.lit(""))
    some = lines.withColumn("marker", F.nullif(F.regexp_extract("s", mark, 1), F.lit(""))).withColumn("name", defined).filter("marker is not null or name is not null")
    upto = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(F.col("name").isNotNull(), F.struct("name", "line")), ignorenulls=True).over(upto)
    out = some.withColumn("near", near).filter("marker is not null").withColumn("text", F.substring(F.trim(F.regexp_extract("s", mark, 2)), 1, 120)).filter("text <> ''")
    return out.select("file_id", "line", "marker", "text", F.col("near.name").alias("definition"), F.col("near.line").alias("definition_line"))


def imports(files: DataFrame) -> DataFrame:
    """Modules each file imports: file_id, module, once."""
    line = F.explode(F.split(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n"), "\n"))
    lines = files.select("file_id", line.alias("s"))
    python, script, plain = r"^from\s+([\w.]+)\s+import\b", r"""^import\s.*\bfrom\s+['"]([^'"]+)['"]""", r"""^import\s+(?:static\s+)?["']?([\w./]+)["']?;?\s*$"""
    name = F.coalesce(*[F.nullif(F.regexp_extract("s", p, 1), F.lit("")) for p in (python, script, plain)])
    return lines.select("file_id", F.trim(name, F.lit("./")).alias("module")).filter("module <> ''").distinct()


def definitions(files: DataFrame) -> DataFrame:
    """Definitions at the start of a line, by language-wide patterns: file_id, line, name, id (file stem and name)."""
    stem = F.regexp_replace(base_name(normal_path("path")), r"\.[^.]*$", "")
    lines = files.select("file_id", stem.alias("stem"), F.posexplode(F.split(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n"), "\n")).alias("n", "s"))
    name = F.regexp_extract("s", r"^(?:export\s+)?(?:async\s+)?(?:def|class|func|function|type)\s+(\w+)", 1)
    return lines.select("file_id", (F.col("n") + 1).alias("line"), name.alias("name"), make_id("stem", name).alias("id")).filter("name <> ''")


def tree(paths: DataFrame) -> DataFrame:
    """Totals over folders: every ancestor of a path, with its parent, depth, and the sum of n below it.

    paths: path, n.  Each path gives one row for each ancestor, summed before
    the shuffle.
    """
    parts = F.split(F.concat(F.lit("./"), F.regexp_replace(normal_path("path"), "^/+", "")), "/")
    up = paths.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("path"), F.when(i > 1, F.array_join(F.slice(parts, 1, i - 1), "/")).alias("parent")))).alias("a"))
    return up.groupBy("a.path", "a.parent", (F.col("a.depth") - 1).alias("depth")).agg(F.sum("n").alias("total_count"))
