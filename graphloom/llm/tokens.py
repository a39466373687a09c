"""Tokens of source files in the languages of the corpus: one small scanner for all of them."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate, compress

# The languages that comment with `#`; the others comment as C does.
HASH_LANGUAGES = {"python", "py", "ruby", "bash", "sh"}

_COMMON = r"""
  \s+
| [^\W\d][\w$]*|\$[\w$]*
| (?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]+)?(?:[eE][+-]?\d+)?)[a-zA-Z]?
| =>|->|:=|.
"""
_PYTHON = r"""
  [rRbBuUfF]{0,2}(?:'''(?:[^\\]|\\.)*?(?:'''|\Z)|\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)|\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|\Z))
| \#[^\n]*
|"""
_C_LIKE = r"""
  //[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|(?<![^\n])\#![^\n]*
| `(?:[^`\\]|\\.)*(?:`|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)|\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|\Z)
|"""


@lru_cache(maxsize=2)
def _scanner(hashes: bool) -> re.Pattern:
    """The pattern of one token or run of blanks; an unclosed string ends with its line, an unclosed comment with the file."""
    return re.compile((_PYTHON if hashes else _C_LIKE) + _COMMON, re.X | re.S)


def _kind(token: str, hashes: bool) -> str:
    first = token[0]
    if first.isalpha() or first in "_$":
        return "text" if hashes and ("'" in token or '"' in token) else "name"
    if first.isspace():
        return "blank"
    if first in "'\"" or first == "`" and not hashes:
        return "text"
    if first.isdigit():
        return "number"
    return "comment" if (first == "#" and (hashes or token[:2] == "#!")) or not hashes and token[:2] in ("//", "/*") else "sign"


def scanned(text: str, hashes: bool) -> tuple[list[str], list[str], list[int]]:
    """The tokens of a text: their kinds, themselves, and where they begin.  Blanks and line ends are none."""
    tokens = _scanner(hashes).findall(text)
    kinds = {token: _kind(token, hashes) for token in set(tokens)}
    kept = [kinds[token] != "blank" for token in tokens]
    starts = list(compress(accumulate(map(len, tokens), initial=0), kept))
    tokens = list(compress(tokens, kept))
    return [kinds[token] for token in tokens], tokens, starts


def opens_line(text: str, start: int) -> bool:
    """Whether nothing but blanks comes before a place on its line."""
    return not text[text.rfind("\n", 0, start) + 1 : start].strip()


def plain(content: str) -> str:
    """A file's text without byte-order mark and with `\\n` line ends only."""
    return content.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")


# File name endings of the languages.
_ENDINGS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "go": "go", "java": "java"}


def language_of(path: str | None, language: str | None, content: str) -> str:
    """The language of a file: by its name, else as stated, else by what it holds."""
    ending = (path or "").rsplit(".", 1)[-1].lower()
    if ending in _ENDINGS:
        return _ENDINGS[ending]
    if (language or "").lower() in set(_ENDINGS.values()):
        return language.lower()
    if re.search(r"^\s*(?:async\s+)?def \w+|^from \w[\w.]* import |^import \w[\w.]*$", content, re.M):
        return "python"
    if re.search(r"^package \w+\s*$", content, re.M) and re.search(r"^func ", content, re.M):
        return "go"
    if re.search(r"^package [\w.]+;|^\s*(?:public|private|protected) (?:static )?(?:class|\w+ \w+\()", content, re.M):
        return "java"
    return "typescript" if re.search(r"\w\s*:\s*(?:string|number|boolean)\b", content) else "javascript"
