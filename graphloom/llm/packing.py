"""Documents packed into containers of fixed capacity, each filled to target proportions of its sources.

Documents are sized in tokens of a public tokenizer and queued by source.
Deficit round-robin serves the queues: for each container a source's deficit
grows by its target share of the capacity, the source of deepest deficit is
served next, and what it overdraws or leaves is carried to the next container.
The stream is dealt into bounded slices that run in parallel; where a slice's
queues run dry its pieces are dealt again, in fewer slices, and the deficits go
with them.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping
from functools import lru_cache, reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.sources.tables import written

#: The tokenizer's file, as the public tokenizers' package names it, or a path.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Pieces in a slice, on average; the part of a container that must be filled to close it before the last turn; the part of the
#: capacity from which a piece is large, and goes first.
SLICE, FULL, LARGE = 20_000, 0.98, 0.25
#: Characters from which a text is tokenized in parts, cut where its words end for the tokenizer.
LONG = 200_000

_PLACED = "container string, doc_id long, source string, piece int, start_token long, n_tokens long, capacity_tokens int, budget_id int"


# Fixed value: how the tokenizer's vocabulary expects a text to be cut into words, before those are cut into tokens.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(name: str):
    import tiktoken

    if "/" in name:
        path = name
    else:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The size of every document: doc_id, source, n_tokens.  Null and empty texts have none; texts are sized whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            n = [_count(encoding, x) if x else 0 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").mapInArrow(run, "doc_id long, source string, n_tokens long")


def _count(encoding, text: str) -> int:
    """Tokens of a text.  A very long one is counted in parts that end where one of the tokenizer's words does, so the sum is exact."""
    if len(text) <= LONG:
        return len(encoding.encode_ordinary(text))
    cuts, last = [0], 0
    for word in regex.finditer(WORDS, text):
        if word.end() - last >= LONG // 2:
            cuts.append(last := word.end())
    return sum(len(encoding.encode_ordinary(text[a:b])) for a, b in pairwise([*cuts, len(text)]))


def pieces(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each capacity, what is to be packed: whole documents, and a longer one than the capacity cut into full pieces and a rest."""
    capacities = budgets.filter("capacity_tokens > 0").select("budget_id", "capacity_tokens").distinct().orderBy("budget_id").collect()  # a fixed table of a few rows
    if not capacities:
        return sized.limit(0).select(F.lit(0).alias("budget_id"), F.lit(0).alias("capacity_tokens"), "doc_id", "source", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("size"))
    each = sized.filter("n_tokens > 0").withColumn("b", F.explode(F.array(*[F.struct(F.lit(r.budget_id).alias("budget_id"), F.lit(r.capacity_tokens).alias("capacity_tokens")) for r in capacities]))).select("doc_id", "source", "n_tokens", "b.*")
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / F.col("capacity_tokens"))))
    piece = each.withColumn("piece", cuts).withColumn("start_token", F.col("piece") * F.col("capacity_tokens"))
    return piece.select("budget_id", "capacity_tokens", "doc_id", "source", F.col("piece").cast("int").alias("piece"), "start_token", F.least("capacity_tokens", F.col("n_tokens") - F.col("start_token")).alias("size"))


def fill(sizes: dict[str, list[tuple[int, int]]], capacity: int, share: dict[str, float], deficit: dict[str, float]) -> Iterator[tuple[list[int], bool]]:
    """The rows of each container, in order, and whether all sources still had pieces when it was begun.

    sizes: of each source its pieces as (size, row), sorted; they are taken
    out.  deficit is carried from window to window and changed in place.

    In each window every source that has pieces left gains its share of the
    capacity.  Large pieces go first, as they need a window that is empty.
    Then the source of deepest deficit is served, with its largest piece that
    neither its deficit nor the space is too small for.  Where no piece is
    within its source's deficit, the one that exceeds the deepest deficit
    least is taken, at last the largest of any source that fits.
    """
    live = [s for s, queue in sizes.items() if queue]
    whole, sources = sum(share.get(s, 0.0) for s in live), len(live)
    while live:
        space, rows, begun = capacity, [], len(live) == sources
        gain = sum(share.get(s, 0.0) for s in live) or whole or 1.0
        for source in live:
            deficit[source] = deficit.get(source, 0.0) + capacity * share.get(source, 0.0) / gain

        def upto(source: str, size: float) -> int:
            """The place of the largest piece of a source up to a size, -1 if there is none."""
            return bisect_right(sizes[source], (int(size), 1 << 62)) - 1

        def owed() -> list[str]:
            return sorted((s for s in live if deficit[s] > 0 and sizes[s]), key=lambda s: (-deficit[s], s))

        def give(source: str, place: int) -> None:
            nonlocal space
            size, row = sizes[source].pop(place)
            rows.append(row)
            space -= size
            deficit[source] -= size

        def large() -> tuple[str, int] | None:
            for source in owed():
                place = upto(source, space)
                if place >= 0 and sizes[source][place][0] >= LARGE * capacity:
                    return source, place
            return None

        def within() -> tuple[str, int] | None:
            return next(((s, place) for s in owed() if (place := upto(s, min(space, deficit[s]))) >= 0), None)

        def beyond() -> tuple[str, int] | None:
            for source in owed():
                if (place := upto(source, space)) >= 0:
                    return source, min(place, bisect_left(sizes[source], (int(deficit[source]) + 1, -1)))
            return None

        def any_of() -> tuple[str, int] | None:
            fits = [(sizes[s][place][0], deficit[s], s, place) for s in live if (place := upto(s, space)) >= 0]
            return max(fits)[2:] if fits else None

        for choose in (large, within, beyond, any_of):
            while space and (chosen := choose()):
                give(*chosen)
        yield rows, begun
        live = [s for s in live if sizes[s]]


def _slice(turn: int, last: bool, full: float):
    """A function that packs one slice.

    Containers filled well, of all sources, are closed; the other pieces come
    back without one, and so do the deficits.  If these are more than half of
    the pieces, another turn wouldn't mend that, and all are closed.
    """

    def run(key: tuple, table: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["source", "size", "doc_id", "piece"], ignore_index=True)
        capacity, sizes = int(table["capacity_tokens"].max() if len(table) else 0), table["size"].to_numpy()
        deficit = dict(zip(shares["source"], shares["deficit"]))
        queues = {source: [(int(sizes[r]), int(r)) for r in rows] for source, rows in table.groupby("source", sort=True).indices.items()}
        windows = list(fill(queues, capacity, dict(zip(shares["source"], shares["share"])), deficit))
        open_ = [rows for rows, begun in windows if not begun or sizes[rows].sum() < full * capacity]
        close = last or 2 * sum(map(len, open_)) > len(table)
        name = np.full(len(table), None, object)
        for i, (rows, begun) in enumerate(windows):
            if close or begun and sizes[rows].sum() >= full * capacity:
                name[rows] = f"{key[0]}-{turn}-{key[1]}-{i}"
            else:
                for row in rows:
                    deficit[table["source"][row]] += sizes[row]
        out = table.assign(container=name, n_tokens=sizes, budget_id=key[0])
        owed = pd.DataFrame({"container": "owed", "source": list(deficit), "n_tokens": [int(x) for x in deficit.values()], "piece": -1, "doc_id": 0, "start_token": 0, "capacity_tokens": capacity, "budget_id": key[0]})
        return (pd.concat([out, owed]) if len(out) else owed)[[c.split()[0] for c in _PLACED.split(", ")]]

    return run


def pack(items: DataFrame, slice_items: int = SLICE, full: float = FULL, target: Mapping[str, float] | None = None) -> DataFrame:
    """Every piece with its container: budget_id, container, doc_id, source, piece, start_token, n_tokens, capacity_tokens.

    items: as `pieces` gives them.  target: the share of tokens each source
    is to have in every container, as far as its documents last; else the
    shares that the sources have of all tokens.  A source that has run out
    leaves its share to the others.  The sizes in a container add up to its
    capacity at most.  A piece as large as the capacity is a container of its
    own and takes no part in the mixture.  Slices hold a bounded number of
    pieces whatever the data.  What a slice can't close well is dealt anew
    with the same of other slices, with the deficits; at least half of the
    pieces are closed in each turn, and turns end when one slice is left.  An
    empty input gives no containers.
    """
    alone = F.col("size") >= F.col("capacity_tokens")
    single = items.filter(alone).select(F.concat_ws("-", "budget_id", F.lit("one"), "doc_id", "piece").alias("container"), "doc_id", "source", "piece", "start_token", F.col("size").alias("n_tokens"), "capacity_tokens", "budget_id")
    todo = items.filter(~alone)
    by = Window.partitionBy("budget_id")
    shares = todo.groupBy("budget_id", "source").agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
    share = F.col("tokens") / F.sum("tokens").over(by)
    if target is not None:
        share = reduce(lambda out, item: F.when(F.col("source") == item[0], F.lit(float(item[1]))).otherwise(out), target.items(), F.lit(0.0))
    shares = written(shares.select("budget_id", "source", share.alias("share"), F.sum("n").over(by).alias("n")), "packing-shares")
    counts = {r.budget_id: r.n for r in shares.groupBy("budget_id").agg(F.max("n").alias("n")).collect()}  # a row for each capacity
    current, out, turn = shares.withColumn("deficit", F.lit(0.0)), single, 0
    while counts:
        slices = {b: -(-n // slice_items) for b, n in counts.items()}
        last = all(n == 1 for n in slices.values())
        number = reduce(lambda out, item: F.when(F.col("budget_id") == item[0], item[1]).otherwise(out), slices.items(), F.lit(1))
        dealt = todo.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), number).cast("int"))
        mix = current.withColumn("deficit", F.col("deficit") / number).withColumn("slice", F.explode(F.sequence(F.lit(0), number - 1)))
        placed = written(dealt.groupBy("budget_id", "slice").cogroup(mix.groupBy("budget_id", "slice")).applyInPandas(_slice(turn, last, full), _PLACED), "packing-turn")
        out = out.unionByName(placed.filter("container is not null and piece >= 0"))
        todo = placed.filter("container is null").withColumnRenamed("n_tokens", "size").select(*items.columns)
        counts = {} if last else {r.budget_id: r["count"] for r in todo.groupBy("budget_id").count().collect()}
        owed = placed.filter("piece < 0").groupBy("budget_id", "source").agg(F.sum("n_tokens").cast("double").alias("deficit"))
        current = shares.join(owed, ["budget_id", "source"], "left").fillna(0.0, ["deficit"])
        turn += 1
    return out


def containers(placed: DataFrame, target: Mapping[str, float] | None = None) -> DataFrame:
    """Per container, what it holds, how much space is left, and how far its mixture of sources is from the target.

    distance: half the sum of the differences between the sources' shares in
    the container and the target (total variation); the target is given, or
    the sources' shares of the pieces that don't fill a container alone.
    """
    several = placed.filter("n_tokens < capacity_tokens").groupBy("budget_id", "source").agg(F.sum("n_tokens").alias("t"))
    aim = F.col("t") / F.sum("t").over(Window.partitionBy("budget_id"))
    if target is not None:
        aim = reduce(lambda out, item: F.when(F.col("source") == item[0], F.lit(float(item[1]))).otherwise(out), target.items(), F.lit(0.0))
    part = placed.groupBy("budget_id", "container", "source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("n_tokens"), F.max("capacity_tokens").alias("capacity"))
    part = part.withColumn("share", F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy("budget_id", "container")))
    part = part.join(several.select("budget_id", "source", aim.alias("aim")), ["budget_id", "source"], "left")
    over = F.sum(F.greatest(F.col("share") - F.coalesce("aim", F.lit(0.0)), F.lit(0.0)))  # what some have too much, the others have too little
    return part.groupBy("budget_id", "container").agg(F.sum("n").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"), (F.max("capacity") - F.sum("n_tokens")).alias("unused"), F.count("*").alias("n_sources"), F.round(over, 6).alias("distance"))
