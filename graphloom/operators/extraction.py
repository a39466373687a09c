"""A graph from source files: files, definitions, decorators, calls, aliases, docstrings and receiver types, by column expressions over lines.

Lines of a file are told apart by patterns; what a line belongs to is carried
along the file by windows, so no line is joined with all others.  Definitions
and what depends on them are of Python files; files of any language are nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import base_name, make_id, normal_path

#: Depths of indentation that are told apart, of four characters each; deeper definitions count as of the last.
DEPTHS = 6
# Words before a bracket that call nothing.
NO_CALL = ["and", "or", "not", "in", "is", "if", "elif", "while", "for", "return", "lambda", "yield", "assert", "with", "except", "del", "raise", "await", "def", "class"]
# Fixed value: a definition with the documentation that begins its body.
DOCSTRING = r'''(?s)(?:def\s+\w+|class\s+\w+)[^\n]*\n\s*(?:""".*?"""|\'\'\'.*?\'\'\')'''


def stem(path: Column | str = "path") -> Column:
    """The name of a path's file without its last ending."""
    return F.regexp_replace(base_name(normal_path(path)), r"\.[^.]*$", "")


def _text() -> Column:
    return F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n")


def _python(files: DataFrame) -> DataFrame:
    return files.filter(F.lower(base_name(normal_path("path"))).endswith(".py"))


def hubs(files: DataFrame) -> DataFrame:
    """A node for each file: file_id, id, label, source_file.  Files without a path are none."""
    return files.filter("path is not null").select("file_id", make_id(stem()).alias("id"), base_name(normal_path("path")).alias("label"), normal_path("path").alias("source_file"))


def _lines(files: DataFrame) -> DataFrame:
    """The lines of Python files with what they define: file_id, stem, line, s, depth, kind ('class', 'def' or null), name."""
    lines = _python(files).select("file_id", stem().alias("stem"), F.posexplode(F.split(_text(), "\n")).alias("n", "s"))
    parts = r"^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)"
    depth = F.least(F.floor(F.length(F.replace(F.regexp_extract("s", r"^([ \t]*)", 1), F.lit("\t"), F.lit("    "))) / 4), F.lit(DEPTHS)).cast("int")
    filled = lambda i: F.nullif(F.regexp_extract("s", parts, i), F.lit(""))
    return lines.select("file_id", "stem", (F.col("n") + 1).alias("line"), "s", depth.alias("depth"), filled(2).alias("kind"), filled(3).alias("name"))


def definitions(files: DataFrame) -> DataFrame:
    """Classes, functions and methods: file_id, line, kind, name, id, owner (id of the class or file), relation ('contains' or 'defines').

    A definition belongs to the nearest one before it that is indented less;
    what a function defines within itself is left out.
    """
    found = _lines(files).filter("kind is not null")
    before = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.col("depth") > d, F.last(F.when(F.col("depth") == d, F.struct("line", "kind", "name")), ignorenulls=True).over(before)) for d in range(DEPTHS)]
    placed = found.withColumn("above", F.greatest(*above)).filter("above is null or above.kind = 'class'")
    hub, cls = make_id("stem"), make_id("stem", F.col("above.name"))
    inside = F.col("above").isNotNull() & (F.col("kind") == "def")
    return placed.select("file_id", "line", "kind", "name", F.when(inside, make_id(cls, "name")).otherwise(make_id("stem", "name")).alias("id"), F.when(inside, cls).otherwise(hub).alias("owner"), F.when(inside, "contains").otherwise("defines").alias("relation"))


def decorators(files: DataFrame) -> DataFrame:
    """Decorators of definitions: file_id, line, id and label of the decorator, target line and name of what it decorates."""
    marks = _lines(files).withColumn("mark", F.nullif(F.trim(F.regexp_extract("s", r"^\s*@(\S.*)$", 1)), F.lit(""))).filter("kind is not null or mark is not null")
    after = Window.partitionBy("file_id").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    near = marks.withColumn("next", F.first(F.when(F.col("kind").isNotNull(), F.struct("line", "name", "depth")), ignorenulls=True).over(after)).filter("mark is not null and next.depth = depth")
    return near.select("file_id", "line", make_id(F.lit("decorator"), F.substring("mark", 1, 40)).alias("id"), F.concat(F.lit("@"), F.substring("mark", 1, 60)).alias("label"), F.col("next.line").alias("target_line"), F.col("next.name").alias("target"))


def calls(files: DataFrame) -> DataFrame:
    """Calls within functions: file_id, line, caller (its name), receiver, callee, target (the callee under the file's own stem).

    The caller is the function that begins last before the line, and less
    indented; receiver is the part before the callee, null if there is none.
    """
    lines = _lines(files)
    upto = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = lines.withColumn("def", F.last(F.when(F.col("kind").isNotNull(), F.struct("kind", "name", "depth")), ignorenulls=True).over(upto)).filter("kind is null and def.kind = 'def' and def.depth < depth")
    code = F.regexp_replace("s", r"^\s*[#@].*$", "")
    each = inside.select("file_id", "stem", "line", F.col("def.name").alias("caller"), F.explode(F.regexp_extract_all(code, F.lit(r"([A-Za-z_][\w.]*)\("), 1)).alias("called"))
    names = F.split("called", r"\.")
    out = each.select("file_id", "stem", "line", "caller", F.try_element_at(names, F.lit(-1)).alias("callee"), F.when(F.size(names) > 1, F.try_element_at(names, F.lit(-2))).alias("receiver"))
    return out.filter(~F.col("callee").isin(NO_CALL) & (F.col("callee") != "") & (F.col("callee") != F.col("caller"))).select("file_id", "line", "caller", "receiver", "callee", make_id("stem", "callee").alias("target"))


def aliases(files: DataFrame) -> DataFrame:
    """Other names of a file's imports and of what it names anew at the top: file_id, alias, real, once each."""
    lines = _lines(files)
    many = lines.filter(F.col("s").rlike(r"^\s*(?:from\s+\S+\s+)?import\s")).select("file_id", F.explode(F.regexp_extract_all("s", F.lit(r"([\w.]+\s+as\s+\w+)"), 1)).alias("m"))
    imported = many.select("file_id", F.regexp_extract("m", r"(\w+)$", 1).alias("alias"), F.regexp_extract("m", r"(\w+)\s+as\s", 1).alias("real"))
    again = r"^([A-Za-z_]\w*)\s*=\s*([A-Za-z_]\w*)\s*$"
    renamed = lines.filter(F.col("s").rlike(again)).select("file_id", F.regexp_extract("s", again, 1).alias("alias"), F.regexp_extract("s", again, 2).alias("real"))
    return imported.unionByName(renamed).filter("alias <> real").distinct()


def docstrings(files: DataFrame) -> DataFrame:
    """Documentation that begins the body of a definition: file_id, line, owner, label (its first line), body; of 8 characters and more."""
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    found = _python(files).select("file_id", F.regexp_extract_all(_text(), F.lit(DOCSTRING), 0).alias("ms"), F.split(_text(), DOCSTRING, -1).alias("ps")).filter(F.size("ms") > 0)
    sizes = found.select("file_id", "ms", F.transform("ms", breaks).alias("mn"), F.transform("ps", breaks).alias("pn")).select("file_id", F.posexplode("ms").alias("i", "m"), "mn", "pn")
    total = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, b: a + b)
    body = F.trim(F.regexp_extract("m", r"""(?s)^[^\n]*\n\s*(?:\"\"\"|''')(.*?)(?:\"\"\"|''')$""", 1), F.lit(" \n\t"))
    out = sizes.select("file_id", (F.lit(1) + total("pn", F.col("i") + 1) + total("mn", F.col("i"))).alias("line"), F.regexp_extract("m", r"^(?:def|class)\s+(\w+)", 1).alias("owner"), body.alias("body"))
    return out.filter(F.length("body") >= 8).select("file_id", "line", "owner", F.substring(F.trim(F.substring_index("body", "\n", 1)), 1, 120).alias("label"), F.substring("body", 1, 1000).alias("body"))


def receiver_types(files: DataFrame) -> DataFrame:
    """What class an attribute of a class holds, by `self.attribute = Class(`: class, attribute, type in lower case; the last file and line wins."""
    upto = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = _lines(files).withColumn("class", F.last(F.when(F.col("kind") == "class", F.struct("name", "depth")), ignorenulls=True).over(upto)).filter("class.depth < depth")
    pattern = r"self\.(\w+)\s*(?::\s*[\w\[\], ]+\s*)?=\s*([A-Z]\w*)\s*\("
    named = inside.select("file_id", "line", F.lower("class.name").alias("class"), F.regexp_extract("s", pattern, 1).alias("attribute"), F.lower(F.regexp_extract("s", pattern, 2)).alias("type")).filter("attribute <> ''")
    return named.groupBy("class", "attribute").agg(F.max_by("type", F.struct("file_id", "line")).alias("type"))


def typed_calls(calls: DataFrame, owners: DataFrame, types: DataFrame) -> DataFrame:
    """Calls by a receiver whose class is known and has exactly one method of the name: call_id, resolved.

    calls: call_id, source, receiver, bare.  owners: id, bare (a method and its
    name in lower case), class (in lower case).  types: as `receiver_types`.
    """
    of = calls.filter("receiver is not null").join(owners.select(F.col("id").alias("source"), "class"), "source").join(types.withColumnRenamed("attribute", "receiver"), ["class", "receiver"])
    hit = of.select("call_id", "bare", F.col("type").alias("class")).join(owners, ["bare", "class"])
    return hit.groupBy("call_id").agg(F.count("*").alias("n"), F.min("id").alias("resolved")).filter("n = 1").select("call_id", "resolved")
