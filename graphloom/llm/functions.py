"""Functions and methods of source files, paired with their documentation.

A file is scanned once into tokens.  Wherever a definition may begin, a
generalised LL recogniser reads its head by an island grammar of the
language: parameters, types and what else is between the name and the body.
A head that doesn't parse defines nothing, and reading goes on at the next
token, so the valid functions of a broken file come out.  Code inside strings
and comments is one token there and defines nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.gll import ends, grammar, islands
from graphloom.llm.tokens import HASH_LANGUAGES, language_of, opens_line, plain, scanned
from graphloom.sources.tables import written

#: Words that a documentation must have beside the function's own name.
WORDS = 4
#: A description, without names and numbers, is a template that says nothing about any function if so many functions of different names have it, and so large a part of all documented ones.
REPEATED, SHARE = 3, 0.0005

# Sequences recur at their left, so each place of one is visited once.  A curly bracket is a type only where a type must
# follow (or after Go's struct and interface), so no type takes in a body.
_GRAMMARS = {
    "python": grammar("""
Part = name | text | number | . | * | pipe | [] | ()
Type = Part | Type Part
Generic = _ | []
Result = _ | -> Type
Function = Generic () Result :
"""),
    "javascript": grammar("""
One = name | text | number | [] | () | {} | import () | () => Operand | <> () => Operand
Before = pipe | & | ? | - | keyof | typeof | readonly | unique | infer | asserts | abstract | new
Operand = One | Before Operand
Joint = pipe | & | is | extends | ? | :
Type = Operand | Type Joint Operand | Type . name | Type [] | Type <>
Generic = _ | <>
Result = _ | : Type
Function = Generic () Result {
Async = _ | async
Star = _ | *
Name = _ | name
Arrow = Result = Async Generic () Result => | Result = Async name => | Result = Async function Star Name Generic () Result {
"""),
    "java": grammar("""
Part = name | . | , | @ | <> | []
Type = Part | Type Part
Throws = _ | throws Type
Dims = _ | Dims []
Function = () Dims Throws {
"""),
    "go": grammar("""
Part = word | . | * | <- | , | < | - | [] | () | func () | struct {} | interface {}
Type = Part | Type Part
Generic = _ | []
Result = _ | Type
Function = Generic () Result {
"""),
}
_GRAMMARS["typescript"] = _GRAMMARS["javascript"]

# Words of the languages that are no names of functions, and words that may stand before a definition.
_NO_NAME = {"if", "for", "while", "switch", "catch", "with", "function", "return", "await", "typeof", "new", "else", "do", "super", "import", "void", "delete", "in", "of", "instanceof", "throw", "case", "yield", "synchronized", "try", "assert", "this"}
_BEFORE_JS = {"function", "*", "async", "export", "default", "static", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor", "#"}
_NO_TYPE = {"return", "new", "else", "throw", "case", "do", "assert", "yield", "package", "import", "instanceof"}

_FOUND = "file_id long, name string, language string, start_line int, end_line int, documentation string, n_words int, code string"

# Words of Go that begin a type and are no types themselves.
_GO_TYPES = {"func", "struct", "interface"}


def _fits(terminal: str, token: str) -> bool:
    if terminal == "name":
        return token[0].isalpha() or token[0] in "_$"
    if terminal == "text":
        return token[0] in "'\"`" or token[-1] in "'\"`"
    if terminal == "number":
        return token[0].isdigit()
    if terminal == "word":
        return _fits("name", token) and token not in _GO_TYPES
    if terminal == "pipe":
        return token == "|"
    return token == terminal


class _File:
    """The significant tokens of a file, with their lines, brackets, and the comments before each."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.python = text, language in HASH_LANGUAGES
        kinds, tokens, starts = scanned(text, self.python)
        breaks = [m.start() for m in re.finditer("\n", text)]
        code = [i for i, kind in enumerate(kinds) if kind != "comment"]
        self.tokens, self.kinds, self.starts = [tokens[i] for i in code], [kinds[i] for i in code], [starts[i] for i in code]
        self.comments: dict[int, list[tuple[str, int, bool]]] = {}
        for n, i in enumerate([i for i, kind in enumerate(kinds) if kind == "comment"]):
            self.comments.setdefault(i - n, []).append((tokens[i], bisect_left(breaks, starts[i]) + 1, opens_line(text, starts[i])))
        self.lines: list[int] = (np.searchsorted(breaks, self.starts) + 1).tolist()
        self.indents: list[int] = []
        if self.python:
            begins = [0, *(x + 1 for x in breaks)]
            line, indent = 0, 0
            for start, at in zip(self.starts, self.lines):
                if at != line:
                    line, before = at, text[begins[at - 1] : start]
                    indent = len(before.expandtabs()) if not before.strip() else indent  # after a text of several lines: that of its first
                self.indents.append(indent)
        self.match: dict[int, int] = {}
        opened: list[int] = []
        pairs = {")": "(", "]": "[", "}": "{"}
        open_of = dict.fromkeys("([{", 0)
        for i in [i for i, token in enumerate(self.tokens) if token in "()[]{}"]:
            token = self.tokens[i]
            if token in open_of:
                opened.append(i)
                open_of[token] += 1
            elif token in pairs and open_of[pairs[token]]:
                begin = opened.pop()
                while self.tokens[begin] != pairs[token]:
                    open_of[self.tokens[begin]] -= 1  # an opened bracket that nothing closes
                    begin = opened.pop()
                open_of[self.tokens[begin]] -= 1
                self.match[i], self.match[begin] = begin, i
        self.whole = islands(self.tokens)

    def before(self, first: int, name: int) -> list[tuple[str, int, bool]]:
        """The comments before a definition and between its first token and its name."""
        return [x for i in range(first, name + 1) for x in self.comments.get(i, [])]


def _block_before(file: _File, first: int, name: int) -> str | None:
    """The `/** */` block before a definition, with nothing but `//` lines between."""
    for comment, _, _ in reversed(file.before(first, name)):
        if comment.startswith("//"):
            continue
        return comment if comment.startswith("/**") and len(comment) > 4 and comment.endswith("*/") else None
    return None


def _lines_above(file: _File, first: int) -> str | None:
    """The `//` lines directly above a definition."""
    out, line = [], file.lines[first]
    for comment, at, own in reversed(file.comments.get(first, [])):
        if at != line - 1 or not own or not comment.startswith("//"):
            break
        out.append(comment)
        line = at
    return "\n".join(reversed(out)) or None


def _marks(file: _File, first: int) -> int:
    """The first of the annotations or decorators before a token."""
    tokens = file.tokens
    while first > 0:
        at = first - 1
        if tokens[at] == ")" and at in file.match:
            at = file.match[at] - 1
        while at >= 2 and file.kinds[at] == "name" and tokens[at - 1] == ".":
            at -= 2
        if at < 1 or file.kinds[at] != "name" or tokens[at - 1] != "@":
            break
        first = at - 1
    return first


def _may_follow(file: _File, at: int, signs: tuple[str, ...]) -> bool:
    """Whether one of the signs comes after a whole bracket; only then is a head looked for, as most brackets are calls."""
    if file.tokens[at] != "(":
        return True
    end = file.whole.get(at, -1) + 1
    return 0 < end < len(file.tokens) and file.tokens[end] in signs


def _javascript(file: _File, rules: dict, i: int) -> tuple[int, int] | None:
    tokens, kinds = file.tokens, file.kinds
    before = tokens[i - 1] if i else ""
    if before == "const" and i + 1 < len(tokens) and tokens[i + 1] in ("=", ":"):
        if not (after := ends(rules, "Arrow", file.tokens, i + 1, _fits, file.whole)):
            return None
        first = i - 1
        while first > 0 and tokens[first - 1] in ("export", "default", "declare"):
            first -= 1
        return first, max(after) - 1
    if i + 1 >= len(tokens) or tokens[i + 1] not in ("(", "<") or tokens[i] in _NO_NAME or not _may_follow(file, i + 1, ("{", ":")):
        return None
    first = i
    while first > 0 and tokens[first - 1] in _BEFORE_JS and (tokens[first - 1] != "*" or first > 1 and (tokens[first - 2] in ("function", "async", "static") or file.lines[first - 2] < file.lines[first - 1])):
        first -= 1
    first = _marks(file, first)
    if first and "function" not in tokens[first:i] and tokens[first - 1] not in ("{", "}", ";", ",") and (file.lines[first - 1] == file.lines[first] or kinds[first - 1] == "sign" and tokens[first - 1] not in (")", "]")):
        return None
    if not (after := ends(rules, "Function", file.tokens, i + 1, _fits, file.whole)):
        return None
    return first, max(after) - 1


def _java(file: _File, rules: dict, i: int) -> tuple[int, int] | None:
    tokens, kinds = file.tokens, file.kinds
    if i + 1 >= len(tokens) or tokens[i + 1] != "(" or tokens[i] in _NO_NAME or not _may_follow(file, i + 1, ("{", "throws", "[")) or not i or not (kinds[i - 1] == "name" or tokens[i - 1] in (">", "]")):
        return None
    first = i
    while first > 0:
        marked = _marks(file, first)
        if marked < first:
            first = marked
        elif kinds[first - 1] == "name" and tokens[first - 1] not in _NO_TYPE or tokens[first - 1] in (".", ",", "<", ">", "[", "]", "?", "&"):
            first -= 1
        else:
            break
    if first and tokens[first - 1] not in ("{", "}", ";"):
        return None
    after = ends(rules, "Function", file.tokens, i + 1, _fits, file.whole)
    return (first, max(after) - 1) if after else None


def _go(file: _File, rules: dict, i: int) -> tuple[int, int] | None:
    first = i - 1
    if file.tokens[first : first + 1] == [")"] and first in file.match:
        first = file.match[first] - 1
    if first < 0 or file.tokens[first] != "func":
        return None
    after = {x for x in ends(rules, "Function", file.tokens, i + 1, _fits, file.whole) if _one_line(file, i, x - 1)}
    return (first, max(after) - 1) if after else None


def _one_line(file: _File, first: int, last: int) -> bool:
    """Whether no line ends between two tokens but within brackets: a line end ends Go's heads."""
    at = first
    while at < last:
        end = file.whole.get(at, at) if file.tokens[at] != "<" else at
        if file.lines[end] + file.tokens[end].count("\n") < file.lines[end + 1]:
            return False
        at = end + 1
    return True


def _python(file: _File, rules: dict, i: int) -> tuple[int, int] | None:
    if not i or file.tokens[i - 1] != "def":
        return None
    first = i - 2 if i > 1 and file.tokens[i - 2] == "async" and file.lines[i - 2] == file.lines[i - 1] else i - 1
    after = ends(rules, "Function", file.tokens, i + 1, _fits, file.whole)
    return (first, min(after) - 1) if after else None


_HEADS = {"python": _python, "javascript": _javascript, "typescript": _javascript, "java": _java, "go": _go}
_PREFIX = re.compile(r"^([a-zA-Z]*)('''|\"\"\"|'|\")")


def _docstring(file: _File, first: int, colon: int) -> tuple[str | None, int] | None:
    """Of a Python function: its docstring, if any, and its last token; None if it has no body."""
    tokens, lines, indents = file.tokens, file.lines, file.indents
    start = colon + 1
    if start >= len(tokens) or lines[start] > lines[colon] and indents[start] <= indents[first]:
        return None
    end = start
    if lines[start] == lines[colon]:
        while end + 1 < len(tokens) and lines[end + 1] == lines[start]:
            end += 1
    else:
        while end + 1 < len(tokens) and (lines[end + 1] == lines[end] or indents[end + 1] > indents[first] or end + 1 in file.match and file.match[end + 1] <= end):
            end += 1
    parts, at = [], start
    while at < len(tokens) and file.kinds[at] == "text":
        m = _PREFIX.match(tokens[at])
        if not m or m[1].lower() not in ("", "r", "u"):
            return None, end
        body = tokens[at][m.end() :]
        parts.append(body[: -len(m[2])] if body.endswith(m[2]) else body)
        at += 1
        if at < len(tokens) and lines[at] > lines[at - 1] + tokens[at - 1].count("\n"):
            break
    alone = at >= len(tokens) or tokens[at] == ";" or lines[at] > lines[at - 1] + tokens[at - 1].count("\n")
    return ("".join(parts) if parts and alone else None), end


_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+|//+!?)?\s*|\s*\*+/\s*$")
_TAG = re.compile(r"^\s*(?:@\w|:[\w \t*.,\[\]|-]+:)")
_WORD = re.compile(r"[^\W_]+")
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^A-Z\W_]+|[^\W_]")


def said(documentation: str, name: str) -> list[str]:
    """The words of a documentation without comment marks, tag lines and the words of the function's own name."""
    own = {x.lower() for x in _PIECE.findall(name)}
    own.add("".join(x.lower() for x in _WORD.findall(name)))
    out = []
    for line in documentation.split("\n"):
        line = _MARKS.sub("", line)
        if not _TAG.match(line):
            out += [x for x in _WORD.findall(line) if x.lower() not in own and any(p.lower() not in own for p in _PIECE.findall(x))]
    return out


def defined(content: str, path: str | None, language: str | None) -> list[tuple]:
    """The functions of one file: name, language, first and last line, documentation or None, words it says, code."""
    text = plain(content)
    language = language_of(path, language, text)
    file, rules, head = _File(text, language), _GRAMMARS[language], _HEADS[language]
    out = []
    for i, kind in enumerate(file.kinds):
        if kind != "name" or not (found := head(file, rules, i)):
            continue
        first, opening = found
        name = file.tokens[i]
        if language == "python":
            body = _docstring(file, first, opening)
            if body is None:
                continue
            documentation, last = body
        elif file.tokens[opening] == "{":
            if opening not in file.match:
                continue  # cut off
            last = file.match[opening]
            documentation = _lines_above(file, first) if language == "go" else _block_before(file, first, i)
        else:
            last = file.match.get(opening + 1, opening + 1 if opening + 1 < len(file.tokens) else opening)
            documentation = _block_before(file, first, i)
        words = said(documentation, name) if documentation else []
        code = text[file.starts[first] : file.starts[last] + len(file.tokens[last])]
        out.append((name, language, file.lines[i], file.lines[last] + file.tokens[last].count("\n"), documentation, len(words), code))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file_id", pa.int64()), ("name", pa.string()), ("language", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("documentation", pa.string()), ("n_words", pa.int32()), ("code", pa.string())])
    for batch in batches:
        columns = [batch.column(x).to_pylist() for x in ("file_id", "content", "path", "language")]
        rows = [(key, *f) for key, content, path, language in zip(*columns) if content for f in defined(content, path, language)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def functions(files: DataFrame) -> DataFrame:
    """Every function and method defined in the files, one row each.

    files: file_id, path, language, content.  Returns file_id, name,
    language, start_line (of the name), end_line, documentation (null if
    there is none), n_words (that it says beside the function's own name)
    and code.  Rows that repeat a file_id give their functions once.  Null
    and empty contents define nothing; a file that breaks off gives the
    functions that are whole.
    """
    one = files.filter("file_id is not null").groupBy("file_id").agg(F.max(F.struct("ingested_at", "path", "language", "content")).alias("f")) if "ingested_at" in files.columns else files.dropDuplicates(["file_id"]).select("file_id", F.struct("path", "language", "content").alias("f"))
    return one.select("file_id", "f.path", "f.language", "f.content").mapInArrow(_rows, _FOUND)


def documented(defined: DataFrame, words: int = WORDS) -> DataFrame:
    """The functions whose documentation is neither empty nor trivial."""
    return defined.filter(F.col("documentation").isNotNull() & (F.col("n_words") >= words))


def pairs(defined: DataFrame, words: int = WORDS, repeated: int = REPEATED, share: float = SHARE) -> DataFrame:
    """Code and description of each documented function, without descriptions that the corpus repeats.

    Descriptions are compared by the hash of their text without marks, case,
    numbers and the function's name.  A template is a description that
    `repeated` functions of different names have, and a part `share` of all
    documented functions: copies of one function don't make its description a
    template, and what is one doesn't depend on the corpus's size.
    """
    shape = F.regexp_replace(F.regexp_replace(F.lower(F.replace("documentation", F.col("name"), F.lit(""))), r"[\d]+", "0"), r"[^\p{L}0]+", " ")
    told = written(documented(defined, words).withColumn("shape", F.xxhash64(shape)), "documented")
    each = told.groupBy("shape", F.xxhash64("name").alias("name")).agg(F.count("*").alias("n")).groupBy("shape").agg(F.count("*").alias("names"), F.sum("n").alias("n"))
    every = each.agg(F.sum("n").alias("every"))  # one row
    often = each.filter(F.col("names") >= repeated).crossJoin(F.broadcast(every)).filter(F.col("names") >= share * F.col("every"))
    return told.join(often, "shape", "left_anti").select("file_id", "name", "language", "start_line", "end_line", F.col("documentation").alias("description"), "code")
