"""Passages of evaluation items that occur in a training corpus.

Corpus and items are winnowed: of every window of word k-grams the one with
the least hash is kept, so any shared span of k + window - 1 words leaves an
equal fingerprint on both sides.  The fingerprints are joined, and each hit is
extended along its diagonal to the whole shared run, on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.winnow import NONE, comparable, gram_hashes, winnowed, word_hashes
from graphloom.sources.tables import written

#: Words in a row that make a passage; the words of a gram.
SPAN, GRAM = 12, 5
#: Items of fewer words are looked up whole, by a gram of their own length.
SHORT = 8
#: Groups of documents by the hash of their number; those that hold no candidate are left out before texts are shuffled.
GROUPS = 2**20


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [comparable(x) if x else "" for x in batch.column(name).to_pylist()]


def _fingerprints(key: str, gram: int, window: int, short: list[int], whole: bool):
    """A function over batches of (key, text): rows of kind, hash, key and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            owner, words = word_hashes(_texts(batch, "text"))
            starts = np.searchsorted(owner, np.arange(len(keys)))
            sizes = np.bincount(owner, minlength=len(keys))
            for kind in [0, *short]:
                grams = gram_hashes(owner, words, kind or gram)
                if whole:  # items: the short ones by their whole text, the others by windows
                    grams = np.where(sizes[owner] == kind if kind else sizes[owner] >= SHORT, grams, NONE)
                at = winnowed(grams, 1 if kind else window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), kind, np.int32)), pa.array(grams[at].view(np.int64)), pa.array(keys[owner[at]]), pa.array((at - starts[owner[at]]).astype(np.int32))],
                    names=["kind", "hash", key, f"{key}_at"],
                )

    return run


def _extended(span: int):
    """A function over batches of candidates: their longest shared run of words, where that is a passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d_owner, d_words = word_hashes(_texts(batch, "text"))
            i_owner, i_words = word_hashes(_texts(batch, "item_text"))
            rows = np.arange(batch.num_rows + 1)
            d_from, i_from = np.searchsorted(d_owner, rows), np.searchsorted(i_owner, rows)
            best, place = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for row, shifts in enumerate(batch.column("shifts").to_pylist()):
                doc, item = d_words[d_from[row] : d_from[row + 1]], i_words[i_from[row] : i_from[row + 1]]
                for shift in shifts:
                    a = max(0, shift)
                    b = min(len(doc), len(item) + shift)
                    if b <= a:
                        continue
                    equal = np.concatenate([[False], doc[a:b] == item[a - shift : b - shift], [False]])
                    edge = np.flatnonzero(equal[1:] != equal[:-1])
                    runs = edge[1::2] - edge[0::2]
                    if len(runs) and runs.max() > best[row]:
                        best[row], place[row] = runs.max(), a + edge[0::2][runs.argmax()]
            need = np.minimum(span, np.diff(i_from))
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(best), pa.array(place)], names=["doc_id", "item_id", "n_words", "at_word"])
            yield out.filter(pa.array((best >= need) & (need > 0)))

    return run


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """Documents that hold a passage of an item: doc_id, item_id, n_words and at_word of the longest shared run.

    documents: doc_id (unique), text.  items: item_id (unique), text.  A
    passage is `span` words in a row, or the whole of an item that has fewer.
    Null and empty texts hold nothing, and an item without words leaks
    nowhere.  A text's length is not limited.  Texts are shuffled for
    documents with a candidate only, and few others.
    """
    sizes = items.select("text").mapInPandas(_sizes, "n int").distinct().filter("n > 0")
    # Word counts of items: at most SHORT + span different values matter.
    counted = [r.n for r in sizes.select(F.least("n", F.lit(span)).alias("n")).distinct().collect()]
    short = sorted(n for n in counted if n < SHORT)
    sure = min([span, *(n for n in counted if n >= SHORT)])
    gram = min(GRAM, sure)
    window = sure - gram + 1

    def prints(df: DataFrame, key: str, whole: bool) -> DataFrame:
        return df.select(key, "text").filter("text is not null").mapInArrow(_fingerprints(key, gram, window, short, whole), f"kind int, hash long, {key} long, {key}_at int")

    hits = prints(documents, "doc_id", False).join(prints(items, "item_id", True), ["kind", "hash"])
    candidates = written(hits.groupBy("doc_id", "item_id").agg(F.collect_set(F.col("doc_id_at") - F.col("item_id_at")).alias("shifts")), "leak-candidates")
    group = F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)).alias("group")
    wanted = F.broadcast(candidates.select(group).distinct())  # GROUPS numbers at most
    near = documents.select("doc_id", "text", group).join(wanted, "group", "left_semi").drop("group")
    texts = candidates.join(items.select("item_id", F.col("text").alias("item_text")), "item_id").join(near, "doc_id")
    return texts.select("doc_id", "item_id", "text", "item_text", "shifts").mapInArrow(_extended(span), "doc_id long, item_id long, n_words int, at_word int")


def _sizes(batches):
    import pandas as pd

    for batch in batches:
        owner, _ = word_hashes([comparable(x) if x else "" for x in batch["text"]])
        yield pd.DataFrame({"n": np.bincount(owner, minlength=len(batch)).astype(np.int32)})


def report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: its split and task, in how many documents it leaked, and its longest leaked run; unleaked items have 0."""
    per = found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_words").alias("longest_run"))
    return items.select("item_id", "split", "task").join(per, "item_id", "left").select("item_id", "split", "task", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"))
