"""Words of many texts as hashes, and their winnowed fingerprints, in vectorised batches."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

from graphloom.llm.confusables import readable, settled

#: Characters hashed at once; bounds a task's memory whatever the batch holds.
CHARS = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
NONE = np.uint64(2**64 - 1)
# A tag of any length by its attributes; a short one whatever it holds.  A long text between two signs is no tag.
_TAG = re.compile(r"""</?[a-zA-Z](?:[^<>]{0,200}|[\w:.-]*+(?:\s++[\w:@-]++(?:\.[\w-]++)*+(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=`]++))?+)*+\s*+/?)>""")
_EMPHASIS = str.maketrans("", "", "*~`")


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    """Which code points belong to words: letters, digits and the marks on them."""
    table = np.zeros(0x110000, bool)
    for point in range(0x323B0):
        char = chr(point)
        table[point] = char.isalnum() or unicodedata.category(char)[0] == "M"
    return table


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    out = []
    for base in (_BASE, inverse):
        steps = np.full(CHARS + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def comparable(text: str) -> str:
    """A text without what doesn't count: tags, emphasis, case, and how look-alike characters are coded."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = text.translate(_EMPHASIS) if "*" in text or "~" in text or "`" in text else text
    return text.lower() if settled(text) else readable(text).lower()


def blocks(texts: Sequence[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of at most CHARS characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size + len(text) + 1 > CHARS and i > start:
            yield start, list(texts[start:i])
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, list(texts[start:])


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of comparable texts: the text's index and the hash of every word, in order."""
    owner, hashed = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    table, (power, inverse) = _word_characters(), _powers()
    for start, block in blocks(texts):
        codes = np.frombuffer("\n".join(block).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.concatenate([[False], table[codes], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, end = edge[0::2], edge[1::2]
        if len(codes) > CHARS:  # one text longer than a run: hashed word by word, over its own characters
            value = np.array([_one(codes[a:b]) for a, b in zip(first, end)], np.uint64)
        else:
            total = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], dtype=np.uint64, out=total[1:])
            value = (total[end] - total[first]) * inverse[first]
        borders = np.cumsum([len(x) + 1 for x in block])
        owner.append(start + np.searchsorted(borders, first, side="right"))
        hashed.append(mix(value + (end - first).astype(np.uint64)))
    return np.concatenate(owner), np.concatenate(hashed)


def _one(codes: np.ndarray) -> np.uint64:
    return np.sum((codes.astype(np.uint64) + np.uint64(1)) * _powers()[0][np.arange(len(codes)) % CHARS], dtype=np.uint64)


def gram_hashes(owner: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words from each word on; NONE where the text ends before."""
    n = len(words) - size + 1
    out = np.full(len(words), NONE)
    if n > 0:
        total = np.zeros(n, np.uint64)
        for i in range(size):
            total = total * _STEP + words[i : i + n]
        out[:n] = np.where(owner[:n] == owner[size - 1 :], np.minimum(mix(total), NONE - np.uint64(1)), NONE)
    return out


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least gram of every window, and of its equals.

    Any two sequences that share `window` grams in a row share a position.
    """
    if window == 1 or len(grams) < window:
        picked = np.arange(len(grams))
    else:
        n = len(grams) - window + 1
        least, reach = grams, 1
        while reach < window:  # the least of ever longer windows
            step = min(reach, window - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        chosen = np.zeros(len(grams), bool)
        for i in range(window):
            chosen[i : i + n] |= grams[i : i + n] == least
        picked = np.flatnonzero(chosen)
    return picked[grams[picked] != NONE]
