"""What changed between full snapshots of a table.

All snapshots are sorted by key into the same ranges and cut into
content-defined chunks: a chunk ends where the hash of a key says so, so an
insertion moves no other border.  Two consecutive snapshots whose chunks have
equal digests are equal there, and only the rows of the other chunks are
joined by key and classified.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import written

#: Keys in a chunk, on average: where one record in twenty changes, two chunks of three stay as they are.
CHUNK_KEYS = 8
#: Rows of all snapshots that one task sorts, on average.
RANGE_ROWS = 1_000_000

_CHUNKED = "record_type string, key string, turn int, body long, grp int, part int, chunk int, earlier_grp int, paired boolean"


def text(column: str) -> Column:
    """A text in which null and empty are the same."""
    return F.coalesce(F.col(column), F.lit(""))


def bag(column: str) -> Column:
    """A list in which the order doesn't count, and null and empty are the same."""
    return F.coalesce(F.concat_ws("\x1f", F.array_sort(F.col(column))), F.lit(""))


def records(df: DataFrame, record_type: str, key: Column, fields: Sequence[Column], group: Column | None = None) -> DataFrame:
    """The rows of one snapshot table in the form that `changes` compares.

    Columns: record_type, key, snapshot_id, snapshot_at, body (hash of the
    key and the compared fields), grp (a number drawn anew in each snapshot,
    or null).  Rows whose key is null are left out, for they name no record.
    """
    return df.select(
        F.lit(record_type).alias("record_type"), key.alias("key"), "snapshot_id", "snapshot_at",
        F.xxhash64(key, *fields).alias("body"), (F.lit(None).cast("int") if group is None else group.cast("int")).alias("grp"),
    ).filter(F.col("key").isNotNull())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key and turn: drops repeated rows, numbers the chunks, and tells each row its record's group of the turn before."""
    part = TaskContext.get().partitionId()
    chunk, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, key = batch.column("record_type"), batch.column("key")
        turn = batch.column("turn").to_numpy(zero_copy_only=False)
        group, border = batch.column("grp"), batch.column("border").to_numpy(zero_copy_only=False)
        same = np.zeros(len(turn), bool)
        same[1:] = pc.and_(pc.equal(key[1:], key[:-1]), pc.equal(kind[1:], kind[:-1])).to_numpy(zero_copy_only=False)
        before_turn, before_group = np.roll(turn, 1), pa.concat_arrays([pa.array([None if last is None else last[3]], group.type), group[:-1]])
        if last is not None:
            same[0] = (kind[0].as_py(), key[0].as_py()) == last[:2]
            before_turn[0] = last[2]
        keep = ~(same & (turn == before_turn))
        number = chunk + np.cumsum(border & ~same)
        paired = same & (turn == before_turn + 1)
        last, chunk = (kind[-1].as_py(), key[-1].as_py(), int(turn[-1]), group[-1].as_py()), int(number[-1])
        out = pa.RecordBatch.from_arrays(
            [kind, key, batch.column("turn"), batch.column("body"), group, pa.array(np.full(len(turn), part, np.int32)), pa.array(number.astype(np.int32)), before_group, pa.array(paired)],
            names=["record_type", "key", "turn", "body", "grp", "part", "chunk", "earlier_grp", "paired"],
        )
        yield out.filter(pa.array(keep))


def _unmatched(coded: DataFrame, turns: DataFrame) -> DataFrame:
    """The chunks, by the later turn, whose digests in two consecutive snapshots differ: record_type, turn, part, chunk.

    A digest is the number of rows and two sums by exclusive or of their codes.
    """
    place = ["record_type", "turn", "part", "chunk"]
    digest = lambda code, name: [F.bit_xor(code).alias(f"{name}_one"), F.bit_xor(F.xxhash64(code, F.lit(5))).alias(f"{name}_two")]
    chunks = coded.groupBy(*place).agg(F.count("*").alias("n"), *digest("later", "l"), *digest("earlier", "e"))
    now = chunks.select(*place, F.struct("n", "l_one", "l_two").alias("now")).filter("turn > 1")
    last = turns.groupBy("record_type").agg(F.max("turn").alias("last"))
    before = chunks.join(last, "record_type").filter("turn < last").select("record_type", (F.col("turn") + 1).alias("turn"), "part", "chunk", F.struct("n", "e_one", "e_two").alias("before"))
    return now.join(before, place, "full_outer").filter(~F.col("now").eqNullSafe(F.col("before"))).select(*place)


def changes(rows: DataFrame, chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """The records added, removed or changed from each snapshot to the next.

    rows: as `records` gives them, of any number of record types.
    Returns record_type, key, snapshot_id (the later of the two) and change.

    Snapshots follow each other by snapshot_at, then snapshot_id, per record
    type; the first yields nothing.  A repeated row counts once; of rows of
    one record that differ within a snapshot, the one with the least body
    hash counts.  A group continues as the later group that holds more than
    half of its records present in both; a record is changed if its fields
    differ or its later group isn't the continuation of its earlier one
    (null continues as null).  An empty table gives no rows.
    """
    kinds = written(rows.groupBy("record_type", "snapshot_id").agg(F.min("snapshot_at").alias("at"), F.count("*").alias("rows")), "snapshots")
    order = Window.partitionBy("record_type").orderBy("at", "snapshot_id")
    turns = kinds.select("record_type", "snapshot_id", F.row_number().over(order).alias("turn"), F.count("*").over(Window.partitionBy("record_type")).alias("turns"))
    spark = rows.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(kinds.agg(F.sum("rows")).first()[0] or 0) // RANGE_ROWS))
    ordered = (
        rows.join(turns.select("record_type", "snapshot_id", "turn"), ["record_type", "snapshot_id"])
        .withColumn("border", F.pmod(F.xxhash64("key", F.lit(17)), F.lit(chunk_keys)) == 0)
        .select("record_type", "key", "turn", "body", "grp", "border")
        .repartitionByRange(partitions, "record_type", "key")
        .sortWithinPartitions("record_type", "key", "turn", "body")
    )
    chunked = written(ordered.mapInArrow(_chunks, _CHUNKED), "snapshot-chunks")

    overlap = chunked.filter(F.col("paired") & F.col("earlier_grp").isNotNull()).groupBy("record_type", "turn", "earlier_grp", "grp").agg(F.count("*").alias("n"))
    share = overlap.withColumn("total", F.sum("n").over(Window.partitionBy("record_type", "turn", "earlier_grp")))
    goes_on = share.filter((F.col("n") * 2 > F.col("total")) & F.col("grp").isNotNull()).select(
        "record_type", (F.col("turn") - 1).alias("turn"), F.col("earlier_grp").alias("grp"), F.col("grp").alias("next_grp")
    )
    turns = written(turns, "snapshot-turns")
    # each row as the later and as the earlier of two; a group that goes on is compared under its later number
    later = F.xxhash64("body", F.col("grp").isNull().cast("int"), F.coalesce("grp", F.lit(0)))
    earlier = F.xxhash64("body", F.when(F.col("grp").isNull(), 1).when(F.col("next_grp").isNull(), 2).otherwise(0), F.coalesce("next_grp", F.lit(0)))
    coded = chunked.join(goes_on, ["record_type", "turn", "grp"], "left").select("record_type", "key", "turn", "part", "chunk", later.alias("later"), earlier.alias("earlier"))
    place = ["record_type", "turn", "part", "chunk"]
    unmatched = written(_unmatched(coded, turns), "snapshot-unmatched")
    sides = coded.join(unmatched, place, "left_semi").select(*place, "key", F.col("later").alias("now"), F.lit(None).cast("long").alias("before")).unionByName(
        coded.withColumn("turn", F.col("turn") + 1).join(unmatched, place, "left_semi").select(*place, "key", F.lit(None).cast("long").alias("now"), F.col("earlier").alias("before"))
    )
    compared = sides.groupBy(*place, "key").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed")
    return (
        compared.withColumn("change", change).filter(F.col("change").isNotNull())
        .join(turns.select("record_type", "turn", "snapshot_id"), ["record_type", "turn"])
        .select("record_type", F.col("key").alias("record_key"), "snapshot_id", "change")
    )


def graph_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The node and edge snapshots of a graph, in the form that `changes` compares."""
    node = records(
        nodes, "node", F.col("id"),
        [text("label"), text("file_type"), F.replace(text("source_file"), F.lit("\\"), F.lit("/")), text("source_location"), text("description"), bag("tags")],
        F.col("community"),
    )
    edge = records(
        edges, "edge", F.concat(text("source"), F.lit("|"), text("target"), F.lit("|"), text("relation")),
        [text("confidence"), F.coalesce(F.col("weight").cast("string"), F.lit("")), bag("call_sites")],
    )
    return node.unionByName(edge)
