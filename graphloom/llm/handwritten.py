"""Which source files nobody wrote by hand: tool output, minified code, copies of third-party code, and data saved as code.

Each file is scanned once.  Tool output is told by its mark (a comment line
of its own, or the name of the file or folder), or by repeating itself: the
fingerprints of its tokens without names and values recur within the file.
Minified code and data are told by what the file is made of.  Copies are found by winnowing the normalised
token stream: a fingerprint counts for third-party code where a good part of
the repositories that have it keep it in a file marked as third-party; files
whose own fingerprints are largely such ones are copies, as are files with
the same token stream as a file that is told otherwise.  Without any marks, a
file is a copy if most of its fingerprints recur together, in the same group
of files over several repositories; idioms recur too, but not together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tokens import HASH_LANGUAGES, language_of, opens_line, plain, scanned
from graphloom.llm.winnow import NONE, gram_hashes, winnowed
from graphloom.sources.tables import written

#: Tokens of a gram, and grams of a window: 21 tokens in a row leave a fingerprint.
GRAM, WINDOW = 12, 10
#: The part of a file's own fingerprints that must be third-party ones.
COPIED = 0.8
#: A fingerprint in at least so many repositories is third-party where at least this part of them marks it so; else it is common.
REPOSITORIES, MARKED = 2, 0.25
#: The same token stream in so many repositories is a copied file even if none marks it.
UNMARKED_REPOSITORIES = 5
#: The part of a file's fingerprints that must recur together in so many repositories if none marks them, and their number at least.
TOGETHER, PRINTS = 0.6, 3
#: Groups that a file whose fingerprints recur takes part in: the least of its recurring fingerprints under so many hashes.
GROUPS = 16
#: The part of distinct grams, without names and values, below which a file of so many tokens and more repeats itself as only a tool does.
REPEATS, REPEATING = 0.2, 60
#: Tokens below which two equal token streams say nothing; such files are compared by their text.
TOKENS = 30

# Comment lines by which tools mark their output.
_GENERATED = re.compile(
    r"""
    @generated\b | <auto-?generated\b | \bcode\ generated\ (?:by|from)\b | \bauto-?generated\s+(?:file|code|by|from)\b | \bautomatically\ (?:created|generated|produced)\b
  | \bgenerated\ (?:by|from|with|using)\b.*\b(?:do\ not|don't|never)\s+(?:edit|modify|change|touch)\b | \bproduced\ by\b.*\bedits?\b.*\b(?:overwritten|lost)\b
  | \bthis\ (?:file|code)\ (?:is|was|has\ been)\ (?:auto-?|automatically\ |machine[- ])?(?:generated|created\ by)\b | \b(?:changes|edits)\b.*\bwill\ be\ (?:lost|overwritten)\b
  | 자동(?:으로)?\ ?생성 | \bautomatisch\ (?:generiert|erzeugt|erstellt)\b | \bgénérée?\ automatiquement\b | \b(?:generado|creado)\ automáticamente\b
    """,
    re.X | re.I,
)
# Comment lines by which copies of third-party code are marked.
_VENDORED = re.compile(
    r"\bvendored (?:from|copy)\b|\blocal copy\b.*\bupstream\b|\bimported from the \S+ project\b|\bsend fixes upstream\b|\bunmodified copy of\b|\bcopied (?:verbatim )?from https?://|\bupstream revision\b", re.I
)
# Folders and file names of tool output, and folders of third-party code.
_GENERATED_PATH = re.compile(r"(?:^|/)(?:gen|autogen|generated|__generated__|auto_generated|generated[-_]sources?)/|\.(?:gen|generated|g|pb|designer)\.\w+$|_pb2(?:_grpc)?\.pyi?$|(?:^|/)zz_generated[^/]*$|_(?:gen|generated)\.\w+$", re.I)
_VENDORED_PATH = re.compile(r"(?:^|/)(?:vendor|vendored|third[-_]party|3rd[-_]?party|node_modules|bower_components|site-packages|dist-packages|extern|externals?|bundled|deps|_deps|godeps|pods)/", re.I)

_FEATURES = "file_id long, repo string, generated boolean, minified boolean, data boolean, marked boolean, n_tokens int, digest long, prints array<long>"


def _scan(content: str, path: str | None, language: str | None, known: dict[str, int]) -> tuple:
    """What one file is made of, its token stream as hashes, and the stream without names and values."""
    text = plain(content)
    place = (path or "").replace("\\", "/")
    hashes = language_of(path, language, text) in HASH_LANGUAGES
    generated, marked = bool(_GENERATED_PATH.search(place)), bool(_VENDORED_PATH.search(place))
    kinds, tokens, starts = scanned(text, hashes)
    header = True  # as long as nothing but comments and a module's docstring has come
    for kind, token, start in zip(kinds, tokens, starts):
        if kind == "comment":
            if opens_line(text, start):
                lines = token.split("\n")
                generated = generated or any(map(_GENERATED.search, lines))
                marked = marked or header and any(map(_VENDORED.search, lines))
        elif header:
            if header := kind == "text" and opens_line(text, start):
                generated = generated or hashes and len(token) > 6 and any(map(_GENERATED.search, token.split("\n")))
    times = Counter(tokens)
    kind_of = dict(zip(tokens, kinds))
    of = {kind: [x for x in times if kind_of[x] == kind] for kind in ("name", "number", "text", "comment", "sign")}
    long = lambda kind: sum(len(x) * times[x] for x in of[kind])
    names, literals = long("name"), sum(times[x] for x in of["text"] + of["number"])
    packed = sum(len(x) * times[x] for x in of["text"] if len(x) > 40 and not any(map(str.isspace, x)))
    size = len(text) - long("comment")
    blanks = size - names - long("number") - long("text") - long("sign")

    def hashed(shape: str) -> int:
        if shape not in known:
            known[shape] = int.from_bytes(blake2b(shape.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return known[shape]

    code = [token for kind, token in zip(kinds, tokens) if kind != "comment"] if of["comment"] else tokens
    value = {token: hashed("0" if kind == "number" else token) for token, kind in kind_of.items() if kind != "comment"}
    shape = {token: hashed(token if kind == "sign" else kind) for token, kind in kind_of.items() if kind != "comment"}
    stream, frame = [value[token] for token in code], [shape[token] for token in code]
    lines = text.count("\n") + 1
    minified = size >= 200 and blanks < 0.1 * size and names > 0.15 * size and size / lines > 80
    data = size >= 200 and names < 0.03 * size and (literals >= 20 or packed >= 200)
    return generated, minified, data, marked, stream, text.strip(), frame


def _digest(content: bytes) -> int | None:
    return int.from_bytes(blake2b(content, digest_size=8).digest(), "little", signed=True) if content else None


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        columns = [batch.column(x).to_pylist() for x in ("content", "path", "language")]
        rows = [_scan(content or "", path, language, known) for content, path, language in zip(*columns)]
        streams = [np.array(r[4], np.uint64) for r in rows]
        sizes = np.array([len(x) for x in streams], np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        frames = gram_hashes(owner, np.concatenate([*(np.array(r[6], np.uint64) for r in rows), np.zeros(0, np.uint64)]), GRAM)
        full = np.bincount(owner[frames != NONE], minlength=len(rows))
        place = np.lexsort((frames, owner))
        fresh = np.append(True, (frames[place][1:] != frames[place][:-1]) | (owner[place][1:] != owner[place][:-1]))[: len(place)] & (frames[place] != NONE)
        repeats = (sizes >= REPEATING) & (np.bincount(owner[place][fresh], minlength=len(rows)) < REPEATS * full)
        grams = gram_hashes(owner, np.concatenate([*streams, np.zeros(0, np.uint64)]), GRAM)
        at = winnowed(grams, WINDOW)
        prints = [np.unique(x).view(np.int64) for x in np.split(grams[at], np.searchsorted(owner[at], np.arange(1, len(rows))))]
        digests = [_digest(x.tobytes() if len(x) >= TOKENS else r[5].encode("utf-8", "replace")) for x, r in zip(streams, rows)]
        if len(known) > 200_000:
            known.clear()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("file_id"), batch.column("repo"), pa.array(np.array([bool(r[0]) for r in rows], bool) | repeats), *(pa.array([bool(r[i]) for r in rows]) for i in range(1, 4)),
                pa.array(sizes.astype(np.int32)), pa.array(digests, pa.int64()), pa.array([x.tolist() for x in prints], pa.list_(pa.int64())),
            ],
            names=["file_id", "repo", "generated", "minified", "data", "marked", "n_tokens", "digest", "prints"],
        )


def kinds(files: DataFrame) -> DataFrame:
    """Every file, told whether somebody wrote it: file_id, repo, generated, minified, data, vendored (true or false).

    files: file_id, repo, path, language, content.  Rows that repeat a
    file_id count as one file, which is what any of them is.  A null or
    empty content is hand-written unless its path says otherwise; a null
    repo counts as one repository.  No two files are ever compared: a
    fingerprint is counted per repository, then handed back to its files.
    """
    scanned = files.select("file_id", F.coalesce("repo", F.lit("")).alias("repo"), "path", "language", "content").filter("file_id is not null").mapInArrow(_features, _FEATURES)
    one = scanned.groupBy("file_id").agg(
        F.first("repo").alias("repo"), *(F.bool_or(x).alias(x) for x in ("generated", "minified", "data", "marked")), F.max("n_tokens").alias("n_tokens"), F.first("digest").alias("digest"), F.first("prints").alias("prints")
    )
    one = written(one, "files")
    prints = one.select("file_id", "repo", "marked", F.explode("prints").alias("print"))
    held = prints.groupBy("print", "repo").agg(F.max("marked").alias("marked")).groupBy("print").agg(F.count("*").alias("repos"), F.count_if("marked").alias("marked_in"))
    shared = held.filter(F.col("repos") >= REPOSITORIES).select(
        "print", (F.col("marked_in") >= MARKED * F.col("repos")).alias("foreign"), (F.col("repos") >= 2 * REPOSITORIES).alias("often"), (F.col("repos") >= UNMARKED_REPOSITORIES).alias("wide")
    )
    told = prints.select("file_id", "print").join(shared, "print", "left").groupBy("file_id").agg(
        F.count_if(F.coalesce("foreign", F.lit(False))).alias("foreign"), F.count_if(~F.coalesce(~F.col("foreign") & F.col("often"), F.lit(False))).alias("own"),
        F.count("*").alias("n_prints"), F.collect_list(F.when(F.col("wide"), F.col("print"))).alias("wide"),
    )
    near = written(one.drop("prints").join(told, "file_id", "left").withColumn(
        "vendored", F.col("marked") | F.coalesce((F.col("foreign") >= 3) & (F.col("foreign") >= COPIED * F.col("own")), F.lit(False))
    ).withColumn("wide", F.when((F.size("wide") >= PRINTS) & (F.size("wide") >= TOGETHER * F.col("n_prints")), F.col("wide"))), "files")
    near = near.join(_together(near.filter("wide is not null")).withColumn("recurs", F.lit(True)), "file_id", "left")
    near = near.withColumn("vendored", F.col("vendored") | F.coalesce("recurs", F.lit(False))).drop("wide", "recurs")
    near = written(near, "files")
    alike = near.filter("digest is not null")
    same = alike.groupBy("digest", "repo").agg(F.max("n_tokens").alias("n_tokens"), *(F.bool_or(x).alias(x) for x in ("vendored", "generated", "minified", "data"))).groupBy("digest").agg(
        *(F.bool_or(x).alias(f"same_{x}") for x in ("vendored", "generated", "minified", "data")), ((F.count("*") >= UNMARKED_REPOSITORIES) & (F.max("n_tokens") >= TOKENS)).alias("everywhere")
    )
    same = same.filter("same_vendored or same_generated or same_minified or same_data or everywhere")
    out = near.join(same, "digest", "left")
    either = lambda x: (F.col(x) | F.coalesce(F.col(f"same_{x}"), F.lit(False))).alias(x)
    return out.select("file_id", "repo", either("generated"), either("minified"), either("data"), (F.col("vendored") | F.coalesce(F.col("same_vendored") | F.col("everywhere"), F.lit(False))).alias("vendored"))


def _together(files: DataFrame) -> DataFrame:
    """The files most of whose fingerprints recur together: file_id.

    files: file_id, repo, n_prints, wide (its fingerprints that occur in
    several repositories).  Files with the same least fingerprint under one
    of GROUPS hashes are a group; what counts are the fingerprints that
    several repositories of the same group have.
    """
    least = F.transform(F.sequence(F.lit(1), F.lit(GROUPS)), lambda i: F.struct(i.alias("i"), F.array_min(F.transform("wide", lambda x: F.xxhash64(x, i))).alias("least")))
    members = files.select("file_id", "repo", "n_prints", "wide", F.explode(least).alias("group"))
    several = members.select("group", "repo").distinct().groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") >= UNMARKED_REPOSITORIES)
    each = members.join(several, "group", "left_semi").select("group", "file_id", "repo", "n_prints", F.explode("wide").alias("print"))
    core = each.select("group", "print", "repo").distinct().groupBy("group", "print").agg(F.count("*").alias("n")).filter(F.col("n") >= UNMARKED_REPOSITORIES)
    count = each.join(core, ["group", "print"], "left_semi").groupBy("group", "file_id", "n_prints").agg(F.count("*").alias("n"))
    return count.filter((F.col("n") >= PRINTS) & (F.col("n") >= TOGETHER * F.col("n_prints"))).select("file_id").distinct()


def not_by_hand() -> Column:
    """Whether a file of `kinds` is no hand-written one."""
    return F.col("generated") | F.col("minified") | F.col("data") | F.col("vendored")
