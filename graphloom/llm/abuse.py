"""Abusive, hateful or sexual language: a score for every document.

A support vector machine on a gap-tolerant string kernel.  The kernel of two
sentences compares all subsequences of LETTERS characters that lie within
SPAN characters, each weighed by how far it is stretched, so masked letters
and inserted characters cost little.  The kernel is approximated from landmark
sentences (Nyström); because the subsequences are hashed into a fixed number of
places, the trained machine becomes one weight for each place, and scoring is
a sum over a sentence's subsequences.  Labels are of documents, so training
finds out which sentences of a bad document are the bad ones: the machine is
fitted to all of them first, then again and again to those that it takes for
bad itself, until these stay the same.

Training is spread over tasks: sentences are rows, their kernel with the
landmarks is computed where they are, and each Newton step sums normal
equations of the landmarks' size, all that the driver ever sees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from graphloom.llm.confusables import readable, settled
from graphloom.sources.tables import written

#: Characters of a subsequence, the characters it may lie within, and the weight of each character of stretch.
LETTERS, SPAN, DECAY = 4, 6, 0.8
#: Hash places, landmark sentences, ridge of the machine.
PLACES, LANDMARKS, RIDGE = 2**13, 500, 0.3
#: The machine's value from which a sentence counts.
MARGIN = 0.4
#: Labelled bad documents that training looks at, at most, and as many again and once more clean ones, chosen by the hash of their number.
SAMPLE = 2500
#: Sentences of bad documents, of clean ones, and of clean ones that came out worst, that a fit takes in at most.
POOL, CLEAN, HARD = 8000, 10000, 3000
#: Times that the machine is fitted anew to what it takes for bad, and Newton steps in a fit, after which they stop however much still changes.
FITS, STEPS = 3, 20
#: The change of the weights, against the largest of them, that ends a fit.
TOLERANCE = 0.05
#: The part of a sentence's documents that must be bad, as reviewers err; its least characters; tasks of a fit.
PART, LEAST, TASKS = 0.6, 8, 8
#: Characters of a piece of a run without sentence ends; pieces overlap by half.
SENTENCE = 240
#: Characters scored at once.
CHARS = 400_000

_OFFSETS = [(0, *c) for c in combinations(range(1, SPAN), LETTERS - 1)]
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
# Signs and digits that stand for a letter inside a word, and the letters.
_STANDS, _FOR = "@4310$57!", "aaeiossti"
_SPEAKER = re.compile(r"^\[[\d: -]{4,20}\] ?[^:\n]{1,40}: ", re.M)


def undisguised(text: str) -> str:
    """A text in lower case, look-alike characters unified, without the times and speakers of a chat."""
    text = text.lower() if settled(text) else readable(text.replace("\n", "\ue000")).replace("\ue000", "\n").lower()
    return _SPEAKER.sub("", text) if "] " in text else text


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """What a code point counts as: letters as they are, any digit as `0`, blanks as one, other signs as `.`."""
    table = np.full(0x110000, ord("."), np.uint32)
    for point in range(0x323B0):
        char = chr(point)
        if char.isalpha() or char == "*":
            table[point] = point
        elif char.isdigit():
            table[point] = ord("0")
        elif char.isspace():
            table[point] = ord(" ")
    return table


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for point in range(0x323B0):
        table[point] = chr(point).isalpha()
    return table


@lru_cache(maxsize=1)
def _stands() -> np.ndarray:
    table = _alphabet().copy()
    for sign, letter in zip(_STANDS, _FOR):
        table[ord(sign)] = ord(letter)
    return table


class Sentences:
    """Sentences of many texts as one array of characters, with their subsequences.

    A sentence longer than SENTENCE is looked at in pieces that overlap by half.
    """

    def __init__(self, texts: Sequence[str]) -> None:
        raw = np.frombuffer(("\n\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate([[0], np.cumsum([len(x) + 2 for x in texts])[:-1]])
        ends = (raw == 10) | np.isin(raw, (33, 46, 63, 0x3002)) & np.isin(np.append(raw[1:], 10), (10, 32))
        first = np.zeros(len(raw), bool)
        first[begins] = True
        first[np.flatnonzero(ends[:-1]) + 1] = True
        codes, letter = _alphabet()[raw], _letters()[raw]
        left, right = np.append(False, letter[:-1]), np.append(letter[1:], False)
        inside = np.flatnonzero(left & right & ~letter)
        codes[inside] = _stands()[raw[inside]]  # a sign or digit that stands for a letter within a word
        single = letter & ~left & ~right
        drop = np.append(False, single[:-1]) & np.append(single[1:], False) & np.isin(raw, (32, 45, 46, 95))  # between letters spread out
        drop[2:] |= letter[2:] & (codes[2:] == codes[1:-1]) & (codes[2:] == codes[:-2])  # letters repeated three times and more
        drop[1:-1] |= drop[2:] & letter[1:-1] & (codes[2:] == codes[1:-1])
        drop &= ~first
        text_of = np.zeros(len(raw), np.int32)
        text_of[begins[1:]] = 1
        self._cut(codes[~drop], np.flatnonzero(first[~drop]), np.cumsum(text_of)[~drop])

    @classmethod
    def of(cls, pieces: Sequence[str]) -> Sentences:
        """Pieces that were made before, each a text of its own."""
        out = cls.__new__(cls)
        sizes = np.array([len(x) for x in pieces])
        out._cut(np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(pieces)), sizes))
        return out

    def _cut(self, codes: np.ndarray, starts: np.ndarray, text_of: np.ndarray) -> None:
        size = np.diff(np.append(starts, len(codes)))
        self.number = np.repeat(np.arange(len(starts), dtype=np.int32), size)
        ends, long = starts + size, np.flatnonzero(size > SENTENCE)
        if len(long):
            inner = [np.arange(starts[i] + SENTENCE // 2, ends[i] - SENTENCE // 2, SENTENCE // 2) for i in long]
            ends[long] = starts[long] + SENTENCE
            more = np.concatenate(inner)
            upto = np.minimum(more + SENTENCE, np.repeat(starts[long] + size[long], [len(x) for x in inner]))
            order = np.argsort(np.concatenate([starts, more]), kind="stable")
            starts, ends = np.concatenate([starts, more])[order], np.concatenate([ends, upto])[order]
        self.codes, self.starts, self.text_of, self.sizes = codes, starts, text_of[starts], ends - starts

    def pieces(self) -> list[str]:
        whole = self.codes.tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[a : a + n] for a, n in zip(self.starts, self.sizes)]

    def subsequences(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each way to leave gaps: where the subsequences begin, their places, and their weight."""
        parts = [self.codes * f for f in _FACTORS]
        for offsets in _OFFSETS:
            n = len(self.codes) - offsets[-1]
            if n <= 0:
                continue
            total = parts[0][:n].copy()
            for part, offset in zip(parts[1:], offsets[1:]):
                total += part[offset : offset + n]
            total ^= total >> np.uint32(15)
            total *= np.uint32(0x2C1B3C6D)
            total >>= np.uint32(32 - PLACES.bit_length() + 1)
            yield np.flatnonzero(self.number[:n] == self.number[offsets[-1] :]), total, DECAY ** (offsets[-1] + 1 - LETTERS)

    def scale(self) -> np.ndarray:
        return 1 / np.sqrt(np.maximum(self.sizes, 12))

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """The machine's value for each sentence; the bias alone, at most -1, for one without a subsequence."""
        total = np.zeros(len(self.codes), np.float32)
        for at, place, weight in self.subsequences():
            gain = weights[place]
            gain[self.number[: len(place)] != self.number[len(self.codes) - len(place) :]] = 0
            total[: len(place)] += np.float32(weight) * gain
        upto = np.append(0.0, np.cumsum(total, dtype=np.float64))
        values = (upto[self.starts + self.sizes] - upto[self.starts]) * self.scale() + bias
        return np.where(self.sizes >= LETTERS + 1, values, min(bias, -1.0))

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces made before: each subsequence's piece, place and weight, by piece."""
        rows, places, weights = [], [], []
        for at, place, weight in self.subsequences():
            rows.append(self.number[at])
            places.append(place[at])
            weights.append(np.full(len(at), weight, np.float32))
        row, place, weight = map(np.concatenate, (rows, places, weights)) if rows else (np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.float32))
        order = np.argsort(row, kind="stable")
        return row[order].astype(np.int64), place[order].astype(np.int64), weight[order]

    def counts(self) -> Iterator[np.ndarray]:
        """Of pieces made before, two hundred at a time: the weight of their subsequences in each place, scaled."""
        row, place, weight = self.places()
        scale = self.scale().astype(np.float32)
        for a in range(0, len(self.starts), 200):
            b = min(a + 200, len(self.starts))
            i, j = np.searchsorted(row, [a, b])
            count = np.bincount((row[i:j] - a) * PLACES + place[i:j], weight[i:j], minlength=(b - a) * PLACES)
            yield count.reshape(b - a, PLACES).astype(np.float32) * scale[a:b, None]


class _Landmarks:
    """Landmark sentences as their subsequences by place, and the map from kernel values to features."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        spread = self.spread()
        value, vector = np.linalg.eigh((spread @ spread.T).astype(np.float64))
        good = value > 1e-6 * value[-1]
        self.root = vector[:, good] / np.sqrt(value[good])

    def spread(self) -> np.ndarray:
        return np.concatenate(list(Sentences.of(self.pieces).counts()))

    def machine(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        """The weights of the features as one weight for each place, and the bias."""
        return ((self.root @ w[:-1]) @ self.spread()).astype(np.float32), float(w[-1])

    def features(self, pool: DataFrame) -> DataFrame:
        """The pool's rows (sentence, bad, n) with their features: bad, n, x."""
        pieces, root = self.pieces, self.root.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            onto = np.concatenate(list(Sentences.of(pieces).counts())).T @ root
            for batch in batches:
                if batch.num_rows:
                    x = np.concatenate([count @ onto for count in Sentences.of(batch.column("sentence").to_pylist()).counts()])
                    yield pa.RecordBatch.from_arrays([batch.column("bad"), batch.column("n"), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["bad", "n", "x"])

        return written(pool.repartition(TASKS).mapInArrow(run, "bad boolean, n long, x binary"), "abuse-features")


def _equations(w: np.ndarray, labels: np.ndarray | None):
    """A function over batches of features: the sums of the rows that a Newton step from w is active on, as one row of bytes.

    labels: the weights of the fit before, by which the sentences of bad
    documents are bad ones where its value is above 0, and take no part
    elsewhere; clean ones above 1 are taken for errors of reviewers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((len(w), len(w))), np.zeros(len(w))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float16).reshape(batch.num_rows, -1)
            x = np.hstack([x.astype(np.float32), np.ones((len(x), 1), np.float32)])
            bad = batch.column("bad").to_numpy(zero_copy_only=False)
            y, n = np.where(bad, 1.0, -1.0), batch.column("n").to_numpy().astype(np.float64)
            use = np.ones(len(x), bool)
            if labels is not None:
                before = x @ labels
                use = np.where(bad, before > 0, before < 1)
            use &= y * (x @ w) < 1
            rows = x[use]
            weighed = rows * n[use, None].astype(np.float32)
            left += weighed.T @ rows
            right += weighed.T @ y[use].astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["left", "right"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of all: the sums of the tasks' equations, of which there are TASKS."""
    rows = [r for batch in batches for r in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([sum(np.frombuffer(x, np.float64) for x in part).tobytes()], pa.binary()) for part in zip(*rows)], names=["left", "right"])


def _fit(features: DataFrame, size: int, labels: np.ndarray | None) -> np.ndarray:
    """Weights of a squared-hinge support vector machine, by Newton steps."""
    ridge = np.full(size + 1, RIDGE)
    ridge[-1] = 1e-3
    w = np.zeros(size + 1)
    for _ in range(STEPS):
        each = features.mapInArrow(_equations(w, labels), "left binary, right binary")
        found: Row = each.repartition(1).mapInArrow(_summed, "left binary, right binary").collect()[0]  # of the landmarks' size, whatever the data
        left, right = (np.frombuffer(found[name], np.float64) for name in ("left", "right"))
        before, w = w, np.linalg.solve(left.reshape(size + 1, -1) + np.diag(ridge), right)
        if np.abs(w - before).max() <= TOLERANCE * np.abs(w).max():
            break
    return w


def _machine(pool: DataFrame, marks: list[str], again: bool) -> tuple[np.ndarray, float]:
    """A machine fitted to a pool of sentences; again: and once more to those of its bad ones that it takes for bad."""
    landmarks = _Landmarks(marks)
    features, size = landmarks.features(pool), landmarks.root.shape[1]
    w = _fit(features, size, None)
    return landmarks.machine(_fit(features, size, w) if again else w)


_CLEAN_MACHINE = np.zeros(PLACES, np.float32), -1.0


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sentences = Sentences([undisguised(x) for x in batch.column("text").to_pylist()])
            of, pieces = pa.array(sentences.text_of), pa.array(sentences.pieces())
            out = pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("bad").take(of), pieces], names=["doc_id", "bad", "sentence"])
            yield out.filter(pa.array(sentences.sizes >= LEAST))


def sentences(judged: DataFrame) -> DataFrame:
    """The distinct sentences of labelled documents (doc_id, text, bad): sentence, n (its documents), bad (whether most of them are)."""
    each = judged.mapInArrow(_pieces, "doc_id long, bad boolean, sentence string").distinct()
    return each.groupBy("sentence").agg(F.count("*").alias("n"), (F.avg(F.col("bad").cast("int")) > PART).alias("bad"))


def train(judged: DataFrame) -> tuple[np.ndarray, float]:
    """Place weights and bias of the machine trained on labelled documents: doc_id, text, bad.

    Without documents of both kinds nothing can be learned, and the machine
    takes every sentence for clean.
    """
    told = written(sentences(judged), "abuse-sentences")
    order = F.xxhash64("sentence", F.lit(3))
    often = told.filter("bad").orderBy(F.desc("n"), order, "sentence").limit(POOL)
    clean = written(told.filter("not bad").orderBy(order, "sentence").limit(CLEAN), "abuse-clean")
    first = lambda df, n, *by: [r.sentence for r in df.orderBy(*by, "sentence").limit(n).collect()]  # noqa: E731  # landmarks: a bounded number
    marks = [first(told.filter("bad"), LANDMARKS // 2, order), first(told.filter("not bad"), LANDMARKS // 2, order)]
    if not all(marks):
        return _CLEAN_MACHINE
    machine = _machine(often.unionByName(clean), [*marks[0], *marks[1]], False)
    for turn in range(FITS):  # anew, on the sentences that the machine takes for bad, and the clean ones it is wrong about
        valued = written(told.repartition(TASKS).mapInArrow(_valued(*machine), "sentence string, n long, bad boolean, value double"), "abuse-values")
        found = valued.filter("bad and value > 0").orderBy(F.desc("value"), "sentence").limit(POOL)
        hard = valued.filter("not bad and value < 1").orderBy(F.desc("value"), "sentence").limit(HARD)
        near = [first(valued.filter("bad and value > 0"), LANDMARKS // 2, order), first(hard, LANDMARKS // 4, F.desc("value")), marks[1][: LANDMARKS // 4]]
        if not near[0]:
            return _CLEAN_MACHINE
        right = valued.filter("not bad and value < 1").join(clean.select("sentence"), "sentence", "left_semi")  # the others are taken for errors of reviewers
        machine = _machine(found.unionByName(hard).unionByName(right).select("sentence", "n", "bad").distinct(), sorted(set().union(*near)), turn == FITS - 1)
    return machine


def _valued(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                value = Sentences.of(batch.column("sentence").to_pylist()).scores(weights, bias)
                yield pa.RecordBatch.from_arrays([batch.column("sentence"), batch.column("n"), batch.column("bad"), pa.array(value, pa.float64())], names=["sentence", "n", "bad", "value"])

    return run


def _document_scores(texts: Sequence[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Of each text the value of its worst sentence."""
    out = np.full(len(texts), min(bias, -1.0))
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= CHARS):
            size += len(texts[end]) + 2
            end += 1
        sentences = Sentences(texts[start:end])
        np.maximum.at(out, start + sentences.text_of, sentences.scores(weights, bias))
        start = end
    return out


def labelled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Up to `sample` documents labelled bad and twice as many labelled clean: doc_id, text, bad.  Those on which reviewers disagree, or without a label, are left out."""
    judged = labels.filter(F.col("label").isNotNull()).groupBy("doc_id").agg(F.avg((F.col("label") != "clean").cast("int")).alias("share"))
    sure = judged.filter(F.col("share").isin(0.0, 1.0)).select("doc_id", (F.col("share") == 1).alias("bad"))
    order = F.xxhash64("doc_id", F.lit(3))
    few = sure.filter("bad").orderBy(order, "doc_id").limit(sample).unionByName(sure.filter("not bad").orderBy(order, "doc_id").limit(2 * sample))
    return documents.select("doc_id", "text").filter(F.coalesce("text", F.lit("")) != "").join(few, "doc_id")


def scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every document with its score: doc_id, source, score (0 to 1), flagged.

    The machine is trained on a sample of labelled documents of bounded
    number, whole texts; every document is then scored over its whole text.
    Null and empty texts have score 0.  flagged: the score is above a half.
    """
    weights, bias = train(labelled(documents, labels, sample))
    shared = documents.sparkSession.sparkContext.broadcast(weights.tobytes())  # PLACES numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = np.frombuffer(shared.value, np.float32)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            value = _document_scores([undisguised(x) if x else "" for x in texts], machine, bias)
            score = np.where([bool(x) for x in texts], 1 / (1 + np.exp(-4 * (value - MARGIN))), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(score), pa.array(score > 0.5)], names=["doc_id", "source", "score", "flagged"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, score double, flagged boolean")


def rates(scored: DataFrame) -> DataFrame:
    """Per source: its documents, how many are flagged, and their rate."""
    return scored.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("flagged").alias("n_flagged"), F.avg(F.col("flagged").cast("int")).alias("rate"), F.avg("score").alias("mean_score"))
