"""References to records that don't exist.

The keys of the referenced tables are hashed to 128 bits and cut into ranges;
each range holds its keys as one sorted array.  The references of a range are
looked up there by binary search, in vectorised batches, and only the misses
come back.  A range with many references, as one hot key makes it, is cut into
slices, and its array, which is of bounded size, goes to each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import micros, normal_id
from graphloom.sources.tables import written

#: Parents in a range, and references in a slice of a range, on average.
RANGE_KEYS, SLICE_REFERENCES = 20_000, 100_000
#: Slices that one task looks up, on average, and tasks from which it looks up more.
TASK_SLICES, MOST_TASKS = 2, 50_000

_FOUND = "ref_table string, ref_key long, field string, node_ref string, at timestamp, reason string"
_ALWAYS, _NEVER = -(2**63), 2**63 - 1


def parents(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """The referenced keys: key (two hashes), born and gone in microseconds.

    nodes: id, created_at, updated_at, deleted_at, ingested_at; a node's
    state is its row with the greatest updated_at.  shared: id; these exist
    at all times.  Null ids are no keys.
    """
    state = nodes.select(normal_id("id").alias("id"), F.struct(micros("updated_at").alias("u"), micros("ingested_at").alias("i"), micros("created_at").alias("born"), micros("deleted_at").alias("gone")).alias("s"))
    always = shared.select(normal_id("id").alias("id"), F.struct(F.lit(_NEVER).alias("u"), F.lit(_NEVER).alias("i"), F.lit(_ALWAYS).alias("born"), F.lit(None).cast("long").alias("gone")).alias("s"))
    keyed = state.unionByName(always).filter(F.col("id").isNotNull()).select(F.xxhash64("id").alias("k1"), F.xxhash64("id", F.lit(1)).alias("k2"), "s")
    last = keyed.groupBy("k1", "k2").agg(F.max("s").alias("s"))
    return last.select("k1", "k2", F.coalesce("s.born", F.lit(_ALWAYS)).alias("born"), F.coalesce("s.gone", F.lit(_NEVER)).alias("gone"))


def references(edges: DataFrame, hyperedges: DataFrame) -> DataFrame:
    """Every reference to a node: ref_table, ref_key, field, node_ref, at.  Null and empty are no references."""
    ends = edges.select(
        F.lit("edges").alias("ref_table"), F.col("edge_id").alias("ref_key"), F.col("extracted_at").cast("timestamp").alias("at"),
        F.explode(F.array(F.struct(F.lit("source").alias("field"), F.col("source").alias("node_ref")), F.struct(F.lit("target").alias("field"), F.col("target").alias("node_ref")))).alias("r"),
    ).select("ref_table", "ref_key", "r.field", "r.node_ref", "at")
    members = hyperedges.select(
        F.lit("hyperedges").alias("ref_table"), F.col("hyperedge_key").alias("ref_key"), F.lit("members").alias("field"),
        F.explode("members").alias("node_ref"), F.col("derived_at").cast("timestamp").alias("at"),
    )
    return ends.unionByName(members).filter(F.coalesce(F.col("node_ref"), F.lit("")) != "")


def _probe(key: tuple, refs: pa.Table, keys: pa.Table) -> pa.Table:
    """The references of one slice that miss: looked up in the sorted array of their range."""

    def column(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy().astype(np.int64)

    k1, k2, born, gone = (column(keys, x) for x in ("k1", "k2", "born", "gone"))
    order = np.lexsort((k2, k1))
    k1, k2, born, gone = k1[order], k2[order], born[order], gone[order]
    r1, r2, at = column(refs, "k1"), column(refs, "k2"), column(refs, "at_us")
    place = np.searchsorted(k1, r1)
    found, rows = np.full(len(r1), -1), np.arange(len(r1))
    while len(rows):  # more than once only where two first hashes are equal
        live = place[rows] < len(k1)
        rows = rows[live]
        rows = rows[k1[place[rows]] == r1[rows]]
        hit = k2[place[rows]] == r2[rows]
        found[rows[hit]] = place[rows[hit]]
        rows = rows[~hit]
        place[rows] += 1
    known, timed = found >= 0, refs.column("at").is_valid().to_numpy()
    where = np.where(known, found, 0)
    late = known & timed & (born[where] > at if len(k1) else False)
    deleted = known & timed & (gone[where] <= at if len(k1) else False)
    out = []
    for reason, mask in (("missing", ~known), ("late", late), ("deleted", deleted & ~late)):
        part = refs.filter(pa.array(mask)).select(["ref_table", "ref_key", "field", "node_ref", "at"])
        out.append(part.append_column("reason", pa.array([reason] * part.num_rows, pa.string())))
    return pa.concat_tables(out)


def orphans(refs: DataFrame, keys: DataFrame, range_keys: int = RANGE_KEYS, slice_references: int = SLICE_REFERENCES) -> DataFrame:
    """The references that no key answers: ref_table, ref_key, field, node_ref, at, reason; one row per distinct miss.

    reason: 'missing' (no such key), 'late' (the key was born after the
    reference), 'deleted' (it was gone at the reference's time or before).
    A reference without a time can only be missing.  References and ids are
    the same if equal after the id convention.  With no references the
    result is empty; with no keys every reference is missing.
    """
    keys = written(keys, "parents")
    bits = max(1, math.ceil(math.log2(max(1, keys.count()) / range_keys + 1)))
    in_range = F.shiftrightunsigned("k1", 64 - bits).cast("int").alias("range")
    keyed = refs.withColumn("id", normal_id("node_ref")).select("ref_table", "ref_key", "field", "node_ref", "at", micros("at").alias("at_us"), F.xxhash64("id").alias("k1"), F.xxhash64("id", F.lit(1)).alias("k2"))
    keyed = keyed.withColumn("at_us", F.coalesce("at_us", F.lit(0))).select("*", in_range)
    slices = written(keyed.groupBy("range").agg(F.ceil(F.count("*") / slice_references).cast("int").alias("slices")), "slices")
    left = keyed.join(slices, "range").withColumn("slice", F.pmod(F.xxhash64("ref_key", "field", "node_ref"), "slices").cast("int")).drop("slices")
    right = keys.select("*", in_range).join(slices, "range").select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).drop("slices")
    # a cogroup's partitions aren't split at run time, so their number follows the data: some slices each
    total = slices.agg(F.sum("slices")).first()[0] or 1
    partitions = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-total // TASK_SLICES)))
    left, right = (x.repartition(partitions, "range", "slice") for x in (left, right))
    return left.groupBy("range", "slice").cogroup(right.groupBy("range", "slice")).applyInArrow(_probe, _FOUND).distinct()


def report(found: DataFrame) -> DataFrame:
    """Orphans per referring table, field, month and reason."""
    return found.groupBy("ref_table", "field", F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n_references"), F.countDistinct("ref_key").alias("n_records"))
