"""Greedy clustering in order of length, batch by batch.

The sequential rule - take the longest record that is left as a centre and give it all that it accepts - says that a
record is a centre if no earlier centre accepts it, and else belongs to the earliest centre that does. Equal strings have
one owner, so the rule is followed for different ones; they are numbered in that order once (by ranges), and taken in
batches of the first ones that are left. One task settles a batch, whose size and letters are bounded, by walking its
trie against itself; then the batch's centres recruit from all that is left, in many tasks, so that members have gone
before they are ever compared with each other. There are as many rounds as batches, however long the chains of records
are that decide about each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tries
from ..functions.distance import allowed
from ..functions.tables import forget, in_order, kept
from . import recruit

#: Records of a batch, how many of them are settled as acceptors at a time in its task, and letters of a batch.
BATCH, ACCEPTORS, LETTERS = 8_192, 1_024, 4 << 20


def numbered(records: DataFrame) -> DataFrame:
    """Stored: sequence, id (the largest that has it) and seq_id (the place in cluster order, from 1: longest first, then the larger string) of each different sequence that isn't empty."""
    own = records.where(F.length("sequence") > 0).groupBy("sequence").agg(F.max("seq_id").alias("id"))
    return kept(in_order(own, [F.desc(F.length("sequence")), F.desc("sequence")], "seq_id"), "numbered")


def _first(asking: DataFrame, among: DataFrame, similarity: float, mismatches: int | None, times: int, made: list) -> DataFrame:
    """seq_id, first and cost: of the records among which it asks, the first in order that accepts it."""
    near = recruit.accepted(asking, among, similarity, mismatches, times=times, made=made)
    return near.groupBy(F.col("target").alias("seq_id")).agg(F.min(F.struct("centre", "cost")).alias("f")).select("seq_id", F.col("f.centre").alias("first"), F.col("f.cost").alias("cost"))


def settled(batch: DataFrame, similarity: float, mismatches: int | None = None, times: int = 1) -> DataFrame:
    """seq_id, first and cost of a batch (seq_id: places in order; sequence) that no earlier record accepts: the centre that accepts a record first; null for centres. One task has the batch."""
    step = ACCEPTORS

    def each(batches):
        import pyarrow as pa

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        whole = pa.Table.from_batches(rows)
        places = whole["seq_id"].to_numpy()
        first, cost = tries.first_acceptors(whole["sequence"].to_pylist(), whole["radius"].to_numpy().astype(np.int64), step)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(places[first], mask=first < 0), pa.array(cost, mask=first < 0)], names=["seq_id", "first", "cost"])

    near = recruit._radius(F.length("sequence"), similarity, mismatches, times)
    own = batch.select("seq_id", "sequence", near.alias("radius")).repartition(1).sortWithinPartitions("seq_id")
    return own.mapInArrow(each, "seq_id long, first long, cost long")


def _owners(records: DataFrame, similarity: float, mismatches: int | None, times: int, most: int) -> DataFrame:
    """seq_id, first and cost of every stored record (places in order): its first acceptor among the centres, null for centres."""
    left, out, used = records, None, False
    while True:
        row = left.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("sequence")).alias("longest")).first()
        if not row.n:
            break
        size = max(1, min(most, LETTERS // row.longest))
        last = None if row.n <= size else left.approxQuantile("seq_id", [size / row.n], 0.1 * size / row.n)[0]
        batch = left if last is None else left.where(F.col("seq_id") <= last)
        own = kept(settled(batch, similarity, mismatches, times), "settled")
        out = own if out is None else out.unionByName(own)
        if last is None:
            break
        centres = kept(batch.join(own.where("first is null").select("seq_id"), "seq_id", "left_semi"), "centres")
        others, made = left.where(F.col("seq_id") > last), []
        taken = kept(_first(others, centres, similarity, mismatches, times, made), "taken")
        rest = kept(others.join(taken.select("seq_id"), "seq_id", "left_anti"), "left")
        out = out.unionByName(taken)
        forget(centres, *made, *[left] * used)
        left, used = rest, True
    return out if out is not None else records.select("seq_id", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("cost"))


def _named(records: DataFrame, similarity: float, mismatches: int | None, times: int, batch: int) -> DataFrame:
    """seq_id, n (letters), centroid, m (its letters) and cost of every record that isn't empty: the first centre that accepts it, itself and 0 for centres."""
    own = numbered(records)
    owners = _owners(own.select("seq_id", "sequence"), similarity, mismatches, times, batch).select("seq_id", F.coalesce("first", "seq_id").alias("first"), F.coalesce("cost", F.lit(0)).alias("cost"))
    named = owners.join(own.select("seq_id", "sequence"), "seq_id").join(own.select(F.col("seq_id").alias("first"), F.col("id").alias("centroid"), F.length("sequence").alias("m")), "first")
    return records.select("seq_id", "sequence").join(named.select("sequence", "centroid", "m", "cost"), "sequence").select("seq_id", F.length("sequence").alias("n"), "centroid", "m", "cost")


def clustered(records: DataFrame, similarity: float, mismatches: int | None = None, batch: int = BATCH) -> DataFrame:
    """seq_id and centroid of every record (seq_id, sequence); empty sequences are centres of their own."""
    empty = records.where(F.length("sequence") == 0).select("seq_id", F.col("seq_id").alias("centroid"))
    return empty.unionByName(_named(records, similarity, mismatches, 1, batch).select("seq_id", "centroid"))


def apart_clustered(records: DataFrame, similarity: float, batch: int = BATCH) -> DataFrame:
    """seq_id and centroid where balls don't overlap: a centre shuts out records up to twice its radius (the lesser one of both lengths), and takes those nearer than the radius. Those that are shut out and not taken are in no cluster."""
    empty = records.where(F.length("sequence") == 0).select("seq_id", F.col("seq_id").alias("centroid"))
    near = (F.col("seq_id") == F.col("centroid")) | (F.col("cost") < allowed(F.col("n"), F.col("m"), similarity))
    return empty.unionByName(_named(records, similarity, None, 2, batch).where(near).select("seq_id", "centroid"))
