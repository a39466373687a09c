"""Louvain's moves over numbered nodes: the driver keeps a number for each node, tasks look at the nodes' neighbours."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import written

#: The gain of modularity below which a round or a level is the last.
GAIN = 1e-4
#: Levels of contraction after which moves stop whatever is left; that is logged.
LEVELS = 10
#: Parts of the nodes that move one after the other in a round, at first and at most.
PARTS, MOST_PARTS = 2, 16
#: Pairs up to which the driver looks itself, as a job that spreads a look over tasks costs more (1.8 million pairs: 0.3 s here, 0.46 s in tasks on 6 cores).
SMALL = 2**21

log = logging.getLogger(__name__)

COLUMNS, TYPES = ("ids", "lengths", "others", "weights"), ("i4", "i4", "i4", "f8")

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Rows:
    """Pairs of nodes: each node's are together, in both directions; a loop once with its whole weight."""

    ids: np.ndarray
    at: np.ndarray  # of a pair: the place of its first node in ids
    others: np.ndarray
    weights: np.ndarray


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of neighbours (a, others, weights) as a row of bytes for each batch, so a look copies them only."""
    for batch in batches:
        ids, others, weights = batch.columns
        parts = [ids.to_numpy(), np.diff(others.offsets.to_numpy()), others.flatten().to_numpy(), weights.flatten().to_numpy()]
        yield pa.RecordBatch.from_arrays([*[pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(parts, TYPES, strict=True)], pa.array([len(parts[2])], pa.int64())], names=[*COLUMNS, "size"])


def _rows(table: pa.RecordBatch | pa.Table) -> Rows:
    ids, lengths, others, weights = (np.concatenate([np.frombuffer(x, t) for x in table.column(name).to_pylist()] or [np.zeros(0, t)]) for name, t in zip(COLUMNS, TYPES, strict=True))
    return Rows(ids, np.repeat(np.arange(len(ids)), lengths), others, weights)


def _summed(key: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's weights."""
    if not len(key):
        return key, weights
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(weights[order], first)


def _within(rows: Rows, g: np.ndarray, live: np.ndarray) -> np.ndarray:
    """The pairs both of whose nodes are of one graph (g), and that of the live ones."""
    own = g[rows.ids][rows.at]
    return (own == g[rows.others]) & live[own]


def strengths(rows: Rows, g: np.ndarray, live: np.ndarray) -> Found:
    """The sum of each node's weights within its graph."""
    w = np.bincount(rows.at, rows.weights * _within(rows, g, live), len(rows.ids))
    return rows.ids, np.zeros(len(rows.ids), "i4"), w


def links(rows: Rows, c: np.ndarray) -> Found:
    """For each community the number of its pairs of two nodes, in both directions."""
    own = c[rows.ids][rows.at]
    inside = own[(own == c[rows.others]) & (rows.others != rows.ids[rows.at])]
    name, n = np.unique(inside, return_counts=True)
    return name, np.zeros(len(name), "i4"), n.astype("f8")


def contracted(rows: Rows, g: np.ndarray, live: np.ndarray, c: np.ndarray, count: int) -> Found:
    """The pairs of the live graphs between communities c, which are `count` in all."""
    use = _within(rows, g, live)
    key, w = _summed(c[rows.ids].astype("i8")[rows.at[use]] * count + c[rows.others[use]], rows.weights[use])
    return (key // count).astype("i4"), (key % count).astype("i4"), w


def _of(rows: Rows, which: np.ndarray) -> Rows:
    """The rows of some nodes."""
    if which.all():
        return rows
    pairs = which[rows.at]
    return Rows(rows.ids[which], (np.cumsum(which) - 1)[rows.at[pairs]], rows.others[pairs], rows.weights[pairs])


def looked(rows: Rows, g: np.ndarray, live: np.ndarray, k: np.ndarray, total: np.ndarray, c: np.ndarray, held: np.ndarray, move: np.ndarray, weigh: bool) -> Found:
    """The nodes that change, of those that may move, with their new communities; if asked, for each graph (c: -1) the weight inside its communities.

    A node goes to the neighbouring community of greatest gain, of equals the
    one of greatest number, and stays where none gains.
    """
    inside_of, inside = np.zeros(0, "i4"), np.zeros(0)
    if weigh:
        rows = _of(rows, live[g[rows.ids]])
        graph = g[rows.ids][rows.at]
        same = (c[rows.ids][rows.at] == c[rows.others]) & (graph == g[rows.others])
        sums = np.bincount(graph[same], rows.weights[same], len(live))
        inside_of = np.flatnonzero(sums)
        inside = sums[inside_of]
    rows = _of(rows, move[rows.ids])
    use = _within(rows, g, live) & (rows.others != rows.ids[rows.at])
    own = c[rows.ids]
    key, w = _summed(rows.at[use].astype("i8") * len(c) + c[rows.others[use]], rows.weights[use])
    at, to = key // max(1, len(c)), (key % max(1, len(c))).astype("i4")
    node = rows.ids[at]
    part = k[node] / total[g[node]]
    home = to == own[at]
    gain = np.round(w - part * (held[to] - np.where(home, k[node], 0)), 9)
    everyone = k[rows.ids]
    stay = np.round(np.bincount(at[home], w[home], len(own)) - everyone / total[g[rows.ids]] * (held[own] - everyone), 9)
    best = np.full(len(own), -np.inf)
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        best[at[first]] = np.maximum.reduceat(gain, first)
    top = gain == best[at]
    goal = own.copy()
    goal[at[top]] = to[top]  # of equals the last, which is the greatest
    gone = np.flatnonzero(best > stay)
    return np.r_[rows.ids[gone], inside_of].astype("i4"), np.r_[goal[gone], np.full(len(inside), -1)].astype("i4"), np.r_[np.zeros(len(gone)), inside]


class Neighbours:
    """Every node's neighbours and their weights: a table of which tasks look at parts, or the rows of a small one."""

    def __init__(self, frame: DataFrame):
        self.spark, self.frame, self.rows = frame.sparkSession, frame, None
        if (frame.agg(F.sum("size")).first()[0] or 0) <= SMALL:
            self.frame, self.rows = None, _rows(frame.toArrow())

    @staticmethod
    def of(pairs: DataFrame) -> Neighbours:
        """Of pairs a, b, w in both directions, each once."""
        lists = pairs.groupBy("a").agg(F.collect_list(F.struct("b", "w")).alias("l")).select("a", F.col("l.b").alias("others"), F.col("l.w").alias("weights"))
        return Neighbours(written(lists.mapInArrow(_packed, "ids binary, lengths binary, others binary, weights binary, size long"), "neighbours"))

    def _spread(self, f: Callable[..., Found], state: tuple) -> tuple[DataFrame, object]:
        sent = self.spark.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(f(_rows(batch.slice(at, 1)), *sent.value), (pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["a", "b", "w"])

        return self.frame.mapInArrow(run, "a int, b int, w double"), sent

    def ask(self, f: Callable[..., Found], *state) -> Found:
        """What f finds in all rows."""
        if self.rows is not None:
            return f(self.rows, *state)
        frame, sent = self._spread(f, state)
        out = frame.toArrow()
        sent.destroy()
        return tuple(x.to_numpy() for x in out.columns)

    def contract(self, *state) -> Neighbours:
        """The neighbours of communities."""
        if self.rows is not None:
            out = object.__new__(Neighbours)
            a, b, w = contracted(self.rows, *state)
            ids, at = np.unique(a, return_inverse=True)
            out.spark, out.frame, out.rows = self.spark, None, Rows(ids, at, b, w)
            return out
        frame, sent = self._spread(contracted, state)
        out = Neighbours.of(frame.repartition("a").groupBy("a", "b").agg(F.sum("w").alias("w")))
        sent.destroy()
        return out


def _mixed(names: np.ndarray, turn: int) -> np.ndarray:
    """A number for each name that is another one each turn."""
    x = (names.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn * 0xD1B54A32D192ED03 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(8)


def _level(near: Neighbours, names: np.ndarray, g: np.ndarray, live: np.ndarray, k: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of moves: each node's community, and what each graph gained.

    In a round every node may move once.  The nodes of a part, by a hash that
    changes each round, look at once, so two nodes don't swap for ever.  A
    round that loses by it is undone and tried in more parts; the level ends
    with a round that gains less than GAIN.  Graphs go on each by itself.
    """
    n, most = len(k), len(live)
    c = best = np.arange(n, dtype="i4")
    on, parts = live.copy(), np.full(most, PARTS)
    start = reached = np.zeros(most)

    def look(move: np.ndarray, weigh: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = np.bincount(c, k, n)
        who, to, w = near.ask(looked, g, on, k, total, c, held, move, weigh)
        moved, inside = to >= 0, to < 0
        q = np.bincount(who[inside], w[inside], most) / total - np.bincount(g, held * held, most) / total**2
        return who[moved], to[moved], q

    def part(at: int) -> np.ndarray:
        return on[g] & (at < parts[g]) & (mixed % parts[g].astype("u8") == at)

    turn = 0
    while True:
        mixed = _mixed(names, turn)
        who, to, q = look(part(0), True)
        if turn == 0:
            start = reached = q
        else:
            gain = q - reached
            better, worse = on & (gain > 0), on & (gain < 0)
            c = best = np.where(better[g], c, best)
            reached = np.where(better, q, reached)
            on = on & ~((gain < GAIN) & (~worse | (parts >= MOST_PARTS)))
            if not on.any():
                return best, reached - start
            parts = np.where(on & worse, parts * 2, parts)
            if (on & worse).any():
                who, to, _ = look(part(0))
        for at in range(parts[on].max()):
            if at:
                who, to, _ = look(part(at))
            stays = ~on[g[who]]
            c = c.copy()
            c[who[~stays]] = to[~stays]
        turn += 1


def partition(near: Neighbours, g: np.ndarray, live: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Communities of numbered nodes: for each node the least number in its one.

    g is each node's graph; the live graphs are partitioned each by itself,
    by the pairs within it.  The other nodes, and those without such a pair,
    are alone.
    """
    n = len(g)
    ids, _, w = near.ask(strengths, g, live)
    k = np.zeros(n)
    k[ids] = w
    total = np.bincount(g, k, len(live))
    live = live & (total > 0)
    total = np.where(total > 0, total, 1.0)
    where, names, gain = np.arange(n), np.arange(n), np.zeros(len(live))
    for left in range(levels, 0, -1):
        if not live.any():
            break
        c, gain = _level(near, names, g, live, k, total)
        label, first, inverse = np.unique(c, return_index=True, return_inverse=True)
        where, names, inverse = inverse[where], names[label], inverse.astype("i4")
        live = live & (gain >= GAIN)
        if left > 1 and live.any():
            near = near.contract(g, live, inverse, len(first))
            k, g = np.bincount(inverse, k, len(first)), g[first]
    if live.any():
        log.warning("Louvain: %d levels done, the last gained %g", levels, gain[live].max())
    _, first, inverse = np.unique(where, return_index=True, return_inverse=True)
    return first[inverse].astype("i4")
