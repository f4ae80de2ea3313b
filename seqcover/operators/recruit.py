"""Similarity join of sequences to centres: candidates by rare shared segments, then the distance.

A target of radius r is cut into segments of a power of two, at least half as many again as r + 1. An accepting centre
has all but r of them unchanged, moved by r places at most (in substring mode: anywhere), so it has one at least of any
r + 1, and EXTRA more of as many more: those are taken that the fewest centres have. Segments are whole numbers (a hash of size, number and letters), and
pairs are formed by equality on them alone; a segment that many targets and centres share is dealt out to several
tasks, by how many pairs it makes. Each pair goes on once, as two ids; the strings are fetched then, and batches of pairs
are compared in order of centre and target, so that targets that begin alike share the table of their common letters.
Targets no longer than their radius match any centre that is long enough, with no segment in common; they share an
empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aligned, tries
from ..functions.distance import allowed
from ..functions.scalars import radius, uniform
from ..functions.tables import kept
from .cells import celled

#: Segments that a target has looked up beyond r + 1, where it has so many.
EXTRA = 2
#: Centres that a target meets by its segments from which on it is walked down the tries instead.
MANY = 64
#: Pairs of one segment that a task forms, how many partitions there are for each of the session's, and rows of a batch.
PAIRS, SPREAD, BATCH = 250_000, 4, 4096


def _radius(length: Column, similarity: float, mismatches: int | None, times: int = 1) -> Column:
    return times * radius(length, similarity) if mismatches is None else F.lit(times * mismatches).cast("int")


def _range(first: Column, last: Column) -> Column:
    """The whole numbers from first to last; none if it is the other way round."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _cut(targets: DataFrame, similarity: float, mismatches: int | None, times: int) -> DataFrame:
    """target, n (letters), r (radius) and g (letters of a segment, a power of two; 0 where the radius is the length or more) beside t."""
    own = targets.select("target", "t", F.length("t").alias("n")).withColumn("r", _radius(F.col("n"), similarity, mismatches, times))
    enough = F.floor((3 * (F.col("r") + 1) + 1) / 2)
    size = F.greatest(F.lit(1), F.expr("shiftleft(1, greatest(0, cast(floor(log2(n / enough)) as int)))"))
    return own.withColumn("enough", enough).withColumn("g", F.when(F.col("r") >= F.col("n"), 0).otherwise(size).cast("int")).drop("enough")


def _segments(cut: DataFrame, anywhere: bool) -> DataFrame:
    """target, n, r and key of each segment of a target."""
    g, number = F.col("g"), (lambda k: F.lit(-1)) if anywhere else (lambda k: k)
    keys = F.transform(F.sequence(F.lit(0), (F.col("n") / F.greatest(g, F.lit(1))).cast("int") - 1), lambda k: F.xxhash64(g, number(k), F.substr("t", k * g + 1, g)))
    return cut.select("target", "n", "r", F.explode(F.when(g > 0, keys).otherwise(F.array(F.xxhash64(F.lit(0))))).alias("key"))


def _places(centres: DataFrame, sizes: list, similarity: float, mismatches: int | None, times: int, anywhere: bool) -> DataFrame:
    """centre, m (letters) and key of each segment that a target could share with a centre. sizes: g, and the largest radius and segment number of targets with it."""
    m, own = F.length("q"), _radius(F.length("q"), similarity, mismatches, times)
    found = [F.array(F.xxhash64(F.lit(0)))] * any(row.g == 0 for row in sizes)
    for row in (row for row in sizes if row.g > 0):
        g, shift = row.g, F.least(F.lit(row.r), own)
        letters = lambda p, k, g=g: F.xxhash64(F.lit(g), k, F.substr("q", p + 1, F.lit(g)))
        starts = _range(F.lit(0), m - g)
        if anywhere:
            found.append(F.transform(starts, lambda p: letters(p, F.lit(-1))))
        else:
            numbers = lambda p, g=g, shift=shift, row=row: _range(F.greatest(F.lit(0), F.ceil((p - shift) / g).cast("int")), F.least(F.lit(row.k), F.floor((p + shift) / g).cast("int")))
            found.append(F.flatten(F.transform(starts, lambda p: F.transform(numbers(p), lambda k: letters(p, k)))))
    return centres.select("centre", m.alias("m"), F.explode(F.array_distinct(F.concat(*found))).alias("key"))


def looked_up(targets: DataFrame, held: DataFrame, cut: DataFrame, anywhere: bool) -> DataFrame:
    """Stored, a row for each target that shares a segment with a centre: target, n, r, least (segments that an accepting centre shares with it), met (pairs that it makes) and seen (those that it looks up: key and number of centres)."""
    known = held.groupBy("key").agg(F.count(F.lit(1)).alias("n_centres"))
    asked = _segments(cut, anywhere).join(known, "key", "left").groupBy("target", "n", "r").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n_centres", F.lit(0)).alias("c"), "key"))).alias("all"))
    asked = asked.withColumn("all", F.slice("all", F.lit(1), F.col("r") + 1 + EXTRA))
    met = F.aggregate("all", F.lit(0).cast("long"), lambda total, s: total + s["c"])
    return kept(asked.select("target", "n", "r", (F.size("all") - F.col("r")).alias("least"), met.alias("met"), F.filter("all", lambda s: s["c"] > 0).alias("seen")).where("met > 0"), "looked")


def candidates(looked: DataFrame, held: DataFrame, made: list) -> DataFrame:
    """target and centre of each pair that may match, once, by the segments that targets look up. made: gets the stored tables that the pairs are read from."""
    rare = looked.select("target", "n", "r", "least", F.explode("seen").alias("s")).groupBy("target", "n", "r", "least", F.col("s.key").alias("key"), F.col("s.c").alias("c")).agg(F.count(F.lit(1)).alias("times"))
    hot = rare.groupBy("key").agg((F.count(F.lit(1)) * F.max("c")).alias("pairs"), F.count(F.lit(1)).alias("n_targets")).where(F.col("pairs") > PAIRS)
    hot = kept(hot.select("key", F.least("n_targets", F.ceil(F.col("pairs") / PAIRS)).cast("int").alias("parts")), "hot")
    made.append(hot)
    left, right = rare.withColumn("part", F.lit(0)), held.withColumn("part", F.lit(0))
    if not hot.isEmpty():
        left = rare.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("target"), F.coalesce("parts", F.lit(1))).cast("int"))
        right = held.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    # few bytes make many pairs here, so the number of tasks is set by hand
    tasks = SPREAD * int(looked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(tasks, "key", "part").join(right.repartition(tasks, "key", "part"), ["key", "part"]).where("m >= n - r")
    return pairs.groupBy("target", "centre", "least").agg(F.sum("times").alias("shared")).where("shared >= least").select("target", "centre")


def compared(pairs: DataFrame, similarity: float, mismatches: int | None = None, anywhere: bool = False, times: int = 1) -> DataFrame:
    """Of those pairs (target, t, centre, q, and what else they have) whose centre accepts the target: cost, and the rest without the strings."""
    most = times * allowed(F.length("t"), F.length("q"), similarity, mismatches)
    rest = [f for f in pairs.schema if f.name not in ("t", "q")]

    def each(batches):
        import pyarrow as pa

        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                b = whole.slice(k, BATCH)
                costs = (aligned.substring_costs if anywhere else aligned.prefix_costs)(b["t"].to_pylist(), b["q"].to_pylist(), b["most"].to_numpy().astype(np.int64))
                found = pa.array(np.flatnonzero(costs >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(costs).take(found), *[b[f.name].take(found) for f in rest]], names=["cost", *[f.name for f in rest]])

    own = pairs.withColumn("most", most).sortWithinPartitions("centre", "t")
    return own.mapInArrow(each, ", ".join(["cost long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rest]]))


def walked(targets: DataFrame, centres: DataFrame, similarities: list[float], mismatches: int | None = None, times: int = 1, first: bool = False) -> DataFrame:
    """target, centre, cost and the centre's other columns of each pair (once) whose centre accepts the target, by walking the tries of both. targets: target, t; centres: centre, q and others, ord if first is asked for; stored tables. first: similarity, target, centre and ord, of the first centre by ord that accepts a target of a block at each similarity, among those of a block; else there is one similarity."""
    near = F.array(*[_radius(F.length("text"), s, mismatches, times) for s in similarities])
    own = targets.select("target", F.col("t").alias("text")).withColumn("radius", near)
    others = centres.withColumnRenamed("q", "text").withColumn("radius", near)
    types = {f.name: f.dataType.simpleString() for f in [*targets.schema, *centres.schema]}
    kept_columns = ["centre", "ord"] if first else [c for c in centres.columns if c != "q"]
    schema = [("similarity", "double")] * first + [("target", types["target"])] + [("cost", "long")] * (not first) + [(c, types[c]) for c in kept_columns]

    def each(t, q):
        import pyarrow as pa

        def radii(side):
            return np.array(side["radius"].combine_chunks().flatten(), np.int64).reshape(side.num_rows, -1)

        near, far, names = radii(t), radii(q), [name for name, _ in schema]
        found = tries.near_pairs(t["text"].to_pylist(), q["text"].to_pylist(), near.max(1), far.max(1))
        give = lambda arrays: pa.table([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays], names=names).to_batches()
        if not first:
            for a, b, c in found:
                yield from give([t["target"].take(pa.array(a)), pa.array(c), *[q[x].take(pa.array(b)) for x in kept_columns]])
            return
        best = np.full((len(similarities), t.num_rows), q.num_rows)
        for a, b, c in found:
            for own, ok in zip(best, (c <= np.minimum(near[a, k], far[b, k]) for k in range(len(similarities))), strict=True):
                np.minimum.at(own, a[ok], b[ok])
        for s, own in zip(similarities, best, strict=True):
            hit = np.flatnonzero(own < q.num_rows)
            yield from give([pa.array(np.full(len(hit), s)), t["target"].take(pa.array(hit)), *[q[x].take(pa.array(own[hit])) for x in kept_columns]])

    reach = _radius(F.length("text"), min(similarities), mismatches, times)
    return celled(own, others, each, ", ".join(f"`{name}` {kind}" for name, kind in schema), reach, F.col("ord") if first else None)


def _sides(targets: DataFrame, centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = targets.where(F.length("sequence") > 0).select(F.col("seq_id").alias("target"), F.col("sequence").alias("t"))
    others = [c for c in centres.columns if c not in ("seq_id", "sequence")]
    return t, centres.where(F.length("sequence") > 0).select(F.col("seq_id").alias("centre"), F.col("sequence").alias("q"), *others)


def _split(t: DataFrame, q: DataFrame, similarity: float, mismatches: int | None, anywhere: bool, times: int, made: list) -> tuple[DataFrame | None, DataFrame | None]:
    """The candidate pairs of targets that meet few centres by their segments, and the targets that meet many; None if there are none."""
    cut = _cut(t, similarity, mismatches, times)
    sizes = cut.groupBy("g").agg(F.max("r").alias("r"), F.max((F.col("n") / F.greatest("g", F.lit(1))).cast("int") - 1).alias("k")).collect()  # a row for each power of two
    if not sizes:
        return None, None
    held = _places(q, sizes, similarity, mismatches, times, anywhere)
    looked = looked_up(t, held, cut, anywhere)
    made.append(looked)
    if anywhere:
        return candidates(looked, held, made), None
    counts = {row.many: row["count"] for row in looked.groupBy((F.col("met") > MANY).alias("many")).count().collect()}
    few = candidates(looked.where(F.col("met") <= MANY), held, made) if counts.get(False) else None
    return few, t.join(looked.where(F.col("met") > MANY).select("target"), "target", "left_semi") if counts.get(True) else None


def accepted(targets: DataFrame, centres: DataFrame, similarity: float, mismatches: int | None = None, anywhere: bool = False, times: int = 1, made: list | None = None) -> DataFrame:
    """target, centre, cost and the centre's other columns of each pair (once) whose centre accepts the target. targets and centres: seq_id and sequence, in stored tables. times: of the radius; made: gets the stored tables that the pairs are read from, for callers who store the pairs."""
    t, q = _sides(targets, centres)
    few, many = _split(t, q, similarity, mismatches, anywhere, times, [] if made is None else made)
    columns = ["target", "cost", *[c for c in q.columns if c != "q"]]
    found = [compared(few.join(t, "target").join(q, "centre"), similarity, mismatches, anywhere, times)] if few is not None else []
    found += [walked(many, q, [similarity], mismatches, times)] if many is not None else []
    if not found:
        return t.join(q.limit(0)).select("target", F.lit(0).cast("long").alias("cost"), *columns[2:]).limit(0)
    return found[0].select(*columns) if len(found) == 1 else found[0].select(*columns).unionByName(found[1].select(*columns))


def first_accepted(targets: DataFrame, centres: DataFrame, similarities: list[float], mismatches: int | None = None, made: list | None = None) -> DataFrame:
    """similarity, target and centre: at each similarity, the first centre by ord that accepts the target; targets that none accepts are left out. Blocks give one centre a target, so few rows are shuffled however many accept it."""
    t, q = _sides(targets, centres.select("seq_id", "sequence", "ord"))
    few, many = _split(t, q, min(similarities), mismatches, False, 1, [] if made is None else made)
    found = []
    if few is not None:
        priced = compared(few.join(t.withColumn("n", F.length("t")), "target").join(q.withColumn("m", F.length("q")), "centre"), min(similarities), mismatches)
        each = F.array(*[F.when(F.col("cost") <= allowed(F.col("n"), F.col("m"), s, mismatches), F.lit(s)) for s in similarities])
        found.append(priced.select(F.explode(each).alias("similarity"), "target", "centre", "ord").where("similarity is not null"))
    if many is not None:
        found.append(walked(many, q, similarities, mismatches, first=True))
    if not found:
        return t.join(q.limit(0)).select(F.lit(0.0).alias("similarity"), "target", "centre").limit(0)
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return rows.groupBy("similarity", "target").agg(F.min_by("centre", "ord").alias("centre"))


def edges(targets: DataFrame, centres: DataFrame, similarity: float, mismatches: int | None = None, cost: bool = False, anywhere: bool = False) -> DataFrame:
    """target, centre, ord (and cost) of each pair whose centre accepts the target, by its best prefix or (anywhere) its best substring. centres: seq_id, sequence, ord. Empty sequences match nothing."""
    found = accepted(targets, centres.select("seq_id", "sequence", "ord"), similarity, mismatches, anywhere)
    return found.select("target", "centre", "ord", *["cost"] * cost)


def recruited(targets: DataFrame, centres: DataFrame, similarity: float, mismatches: int | None = None) -> DataFrame:
    """seq_id and centroid: each target that a centre accepts, with the first such centre by ord."""
    return first_accepted(targets, centres, [similarity], mismatches).select(F.col("target").alias("seq_id"), F.col("centre").alias("centroid"))


def swept(targets: DataFrame, centres: DataFrame, similarities: list[float]) -> DataFrame:
    """similarity, n_recruited and n_centroids for each similarity: the pairs at the lowest one are formed once, and every other similarity is a filter on them."""
    best = first_accepted(targets, centres, similarities)
    return best.groupBy("similarity").agg(F.count(F.lit(1)).alias("n_recruited"), F.countDistinct("centre").alias("n_centroids"))


def nonambiguous_weights(pairs: DataFrame) -> DataFrame:
    """centre and weight: one more than the targets that only this centre accepts. Pairs (each once) are counted where they are; a row for each target and centre of a task is shuffled."""
    none = lambda name: F.lit(None).cast(pairs.schema[name].dataType)
    of_target = F.struct(F.col("target").alias("t"), none("centre").alias("c"), F.col("centre").alias("by"))
    of_centre = F.struct(none("target").alias("t"), F.col("centre").alias("c"), none("centre").alias("by"))
    told = pairs.select(F.explode(F.array(of_target, of_centre)).alias("x")).groupBy("x.t", "x.c").agg(F.count(F.lit(1)).alias("n"), F.min("x.by").alias("by"))
    # each centre once for itself, and once for each target that has no other
    named = told.select(F.coalesce("c", F.when(F.col("n") == 1, F.col("by"))).alias("centre")).where("centre is not null")
    return named.groupBy("centre").agg(F.count(F.lit(1)).alias("weight"))


def ambiguous_assigned(pairs: DataFrame, seed: int | str) -> DataFrame:
    """seq_id and centroid: of the centres that accept a target, one drawn with a chance in proportion to its weight. Pairs are stored once; weights, a row for each centre, are sent to them."""
    pairs = kept(pairs.select("target", "centre"), "pairs")
    w = pairs.join(F.broadcast(nonambiguous_weights(pairs)), "centre")
    late = -F.log(1 - uniform(seed, F.col("target"), F.col("centre"))) / F.col("weight")
    return w.groupBy(F.col("target").alias("seq_id")).agg(F.min_by("centre", F.struct(late, "centre")).alias("centroid"))
