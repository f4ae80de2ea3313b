"""Operators on sequence records: exact duplicates, samples, id sets, orders and letters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import reverse_complement, uniform
from ..functions.tables import in_order
from ..functions.tries import coded, cut_up
from .cells import celled


def deduplicated(records: DataFrame, canonical_strand: bool = False) -> DataFrame:
    """One row for each distinct sequence: the first record's seq_id (by ord) and how many records have it. canonical_strand: a sequence and its reverse complement are one; the first record's is given."""
    own = F.least("sequence", reverse_complement(F.col("sequence"))) if canonical_strand else F.col("sequence")
    found = records.groupBy(own.alias("_own")).agg(F.min_by(F.struct("seq_id", *["sequence"] * canonical_strand), "ord").alias("f"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("count"))
    return found.select(F.col("f.sequence" if canonical_strand else "_own").alias("sequence"), "f.seq_id", "ord", "count")


def with_counts(records: DataFrame, counts: DataFrame) -> DataFrame:
    """records with the multiplicity that counts (seq_id, count) gives them, one where it says nothing."""
    return records.join(counts.select("seq_id", "count"), "seq_id", "left").withColumn("count", F.coalesce("count", F.lit(1)))


def sampled(records: DataFrame, rate: float, seed: int | str) -> DataFrame:
    """Each record with probability `rate`, decided by seed and seq_id alone."""
    return records.where(uniform(seed, F.col("seq_id")) < rate)


def included(records: DataFrame, ids: DataFrame, key: str = "seq_id") -> DataFrame:
    return records.join(ids.select(key), key, "left_semi")


def excluded(records: DataFrame, ids: DataFrame, key: str = "seq_id") -> DataFrame:
    return records.join(ids.select(key), key, "left_anti")


def cluster_order(column: str = "sequence", key: str = "seq_id") -> list:
    """Longest first, then the larger string, then the larger id."""
    return [F.desc(F.length(column)), F.desc(column), F.desc(key)]


def by_length(records: DataFrame) -> DataFrame:
    """Longest first, then the later record."""
    return records.orderBy(F.desc(F.length("sequence")), F.desc("ord"))


def length_places(records: DataFrame) -> DataFrame:
    """records with place: their number, from 1, in the order of by_length."""
    return in_order(records, [F.desc(F.length("sequence")), F.desc("ord")])


def shuffled_places(records: DataFrame, seed: int | str) -> DataFrame:
    """records with place: their number, from 1, in the order of shuffled."""
    return in_order(records, [uniform(seed, F.col("seq_id")), F.col("seq_id")])


def shuffled(records: DataFrame, seed: int | str) -> DataFrame:
    return records.orderBy(uniform(seed, F.col("seq_id")), "seq_id")


def selected(records: DataFrame, members: DataFrame, mode: str) -> DataFrame:
    """Records by their part in clusters (centroid, seq_id): "centres", "rest" (all but centres) or "members" (with their centroid)."""
    if mode == "centres":
        return included(records, members.select(F.col("centroid").alias("seq_id")).distinct())
    if mode == "rest":
        return excluded(records, members.select(F.col("centroid").alias("seq_id")).distinct())
    if mode == "members":
        return members.select("centroid", "seq_id").join(records, "seq_id")
    raise ValueError(f"no such mode: {mode}")


def kmers(records: DataFrame, k: int) -> DataFrame:
    """seq_id, kmer and n: how often each run of k letters occurs in each sequence."""
    runs = F.when(F.length("sequence") >= k, F.transform(F.sequence(F.lit(1), F.length("sequence") - k + 1), lambda i: F.substr("sequence", i, F.lit(k))))
    return records.select("seq_id", F.explode(runs).alias("kmer")).groupBy("seq_id", "kmer").agg(F.count(F.lit(1)).alias("n"))


def rolled_up(spectra: DataFrame, k: int) -> DataFrame:
    """Counts of the first k letters of longer runs."""
    return spectra.groupBy("seq_id", F.substring("kmer", 1, k).alias("kmer")).agg(F.sum("n").alias("n"))


def filter_length(records: DataFrame) -> DataFrame:
    """k: the whole part of the logarithm to base 4 of the upper median length, one at least."""
    sizes = records.select(F.length("sequence").alias("n")).where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    return upper_median(sizes).select(F.greatest(F.lit(1), F.floor(F.log(4.0, F.col("median")) + 1e-12)).cast("long").alias("k"))


def upper_median(sizes: DataFrame) -> DataFrame:
    """median: of a table of values n and how often they occur c, the value at place (count div 2) from zero. Only distinct values meet in one place."""
    from pyspark.sql import Window

    up_to = F.sum("c").over(Window.orderBy("n"))
    all_ = F.sum("c").over(Window.partitionBy())
    return sizes.select("n", up_to.alias("up_to"), all_.alias("total")).where(F.col("up_to") > F.floor(F.col("total") / 2)).agg(F.min("n").alias("median"))


def kmer_excess(targets: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """target, centre and how many runs of k letters the target has beyond the centre's; pairs with no run in common are left out. Both tables, a row for each seq_id, are compared block by block: what is written are the pairs, runs aren't shuffled."""
    own = targets.where(F.length("sequence") >= k).select(F.col("seq_id").alias("target"), F.col("sequence").alias("text"))
    theirs = centres.where(F.length("sequence") >= k).select(F.col("seq_id").alias("centre"), F.col("sequence").alias("text"))
    types = {f.name: f.dataType.simpleString() for f in [*own.schema, *theirs.schema]}

    def each(t, q):
        import pyarrow as pa

        for a, b, common, runs in common_runs(t["text"].to_pylist(), q["text"].to_pylist(), k):
            yield pa.RecordBatch.from_arrays([t["target"].take(pa.array(a)).combine_chunks(), q["centre"].take(pa.array(b)).combine_chunks(), pa.array(runs - common)], names=["target", "centre", "excess"])

    return celled(own, theirs, each, f"target {types['target']}, centre {types['centre']}, excess long", sides=(4_096, 1_024))


#: Numbers that the table of a block's runs, and the sums of a portion of targets, may hold.
RUNS, SUMS = 64 << 20, 16 << 20


def common_runs(targets: list[str], centres: list[str], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Numbers of a target and a centre, how many runs of k letters they have in common (with how often they occur), and the target's runs, of all pairs with one at least; a portion at a time."""
    sides, width = coded(targets, centres), 1
    base = 1 + max(int(letters.max(initial=0)) for letters, _ in sides)
    rows, place = zip(*[np.nonzero(np.arange(letters.shape[1]) < (n - k + 1)[:, None]) for letters, n in sides], strict=True)
    cut = len(rows[0])
    run = np.zeros(cut + len(rows[1]), np.int64)
    for j in range(k):
        if width > (1 << 62) // base:
            run, width = np.unique(run, return_inverse=True)[1].astype(np.int64), len(run)
        run, width = run * base + np.concatenate([letters[r, p + j] for (letters, _), r, p in zip(sides, rows, place, strict=True)]), width * base
    run = np.unique(run, return_inverse=True)[1].astype(np.int64)

    def numbered(row: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and runs in order, and the how manieth of its kind each is in its row."""
        order = np.lexsort((run, row))
        row, run = row[order], run[order]
        head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (run[1:] != run[:-1])])) if len(row) else np.zeros(0, np.int64)
        return row, run, np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))

    (t_row, t_run, t_nth), (q_row, q_run, q_nth) = numbered(rows[0], run[:cut]), numbered(rows[1], run[cut:])
    many = 1 + int(max(t_nth.max(initial=0), q_nth.max(initial=0)))
    t_kind, q_kind = t_run * many + t_nth, q_run * many + q_nth
    runs, start = np.maximum(sides[0][1] - k + 1, 0), 0
    while start < len(centres):
        # as many centres as a table with a row for each of their runs has room for
        begin = np.searchsorted(q_row, start)
        ends = np.searchsorted(q_row, np.arange(start + 1, len(centres) + 1))
        room = np.flatnonzero((ends - begin) * np.arange(1, len(ends) + 1) <= RUNS)
        stop = start + max(1, len(room))
        known, kind = np.unique(q_kind[begin : ends[stop - start - 1]], return_inverse=True)
        table = np.zeros((len(known), stop - start), np.uint8)
        table[kind, q_row[begin : ends[stop - start - 1]] - start] = 1
        at = np.minimum(np.searchsorted(known, t_kind), max(0, len(known) - 1))
        met = np.flatnonzero(known[at] == t_kind) if len(known) else np.zeros(0, np.int64)
        row, at = t_row[met], at[met]
        own, heads, n = np.unique(row, return_index=True, return_counts=True)
        for piece in cut_up(n, max(1, SUMS // (stop - start))):
            some = own[piece]
            common = np.zeros((len(some), stop - start), np.int32)
            for x in range(int(n[piece].max())):  # the x-th run that each target shares with the block
                has = np.flatnonzero(n[piece] > x)
                common[has] += table[at[heads[piece][has] + x]]
            a, b = np.nonzero(common)
            for part in range(0, len(a), 1 << 18):
                x, y = a[part : part + (1 << 18)], b[part : part + (1 << 18)]
                yield some[x], start + y, common[x, y].astype(np.int64), runs[some[x]]
        start = stop
