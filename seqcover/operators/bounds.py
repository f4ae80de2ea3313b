"""Which cluster sizes are exhausted: discovery probabilities, the freeze test and its bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import log_choose, miss_probability, uniform
from ..functions.tables import kept

#: Terms or clusters of a row before they are told apart; standard deviations of a tail that are summed.
BLOCK, DEVIATIONS = 4096, 40
FRONTIER = "size long, n long, frozen boolean, upper boolean, mass double, bound long"


def expected_sizes(histogram: DataFrame, total: float | Column, rate: float) -> DataFrame:
    """size, obs, n (clusters of the size that should exist) and found (the chance that a sample meets one twice) from (size, n, share)."""
    total = total if isinstance(total, Column) else F.lit(float(total))
    n = F.greatest(F.col("n").cast("double"), F.col("share") * total / F.col("size"))
    rest = [c for c in histogram.columns if c not in ("size", "n", "share")]
    return histogram.select("size", F.col("n").alias("obs"), F.floor(n).cast("long").alias("n"), (1 - miss_probability(F.col("size"), F.floor(rate * total).cast("double"), total)).alias("found"), *rest)


def upper_tails(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, which name a row; n, found, obs) with chance: P(X >= obs) for X binomial (n, found), as a sum of terms.

    The sum is taken over the side of obs that the mean isn't on, as far as DEVIATIONS standard deviations and that many
    terms more; what lies beyond is under 1e-16 of one. Terms come from logarithms of factorials, a block of them a row.
    """
    n, p, least = F.col("n"), F.col("found"), F.col("obs")
    known = F.when(least <= 0, 1.0).when((least > n) | (p <= 0), 0.0).when(p >= 1, 1.0)
    own = rows.withColumn("_known", known).withColumn("_up", least > n * p).withColumn("_span", (DEVIATIONS * (F.sqrt(n * p * (1 - p)) + 1)).cast("long"))
    first, last = F.when(F.col("_up"), least).otherwise(F.greatest(F.lit(0), least - 1 - F.col("_span"))), F.when(F.col("_up"), F.least(n, least + F.col("_span"))).otherwise(least - 1)
    blocks = own.where("_known is null").select(*keys, "n", "found", first.cast("long").alias("_a"), last.cast("long").alias("_z")).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_z") - F.col("_a")) / BLOCK))))
    k = F.col("_k")
    terms = blocks.select(*keys, "n", "found", F.explode(F.sequence(F.col("_a") + F.col("_b") * BLOCK, F.least(F.col("_z"), F.col("_a") + (F.col("_b") + 1) * BLOCK - 1))).alias("_k"))
    sums = terms.groupBy(*keys).agg(F.sum(F.exp(log_choose(n, k) + k * F.log(p) + (n - k) * F.log1p(-p))).alias("_sum"))
    chance = F.coalesce("_known", F.when(F.col("_up"), F.least(F.lit(1.0), "_sum")).otherwise(F.greatest(F.lit(0.0), 1 - F.col("_sum"))))
    return own.join(sums, keys, "left").select(*rows.columns, chance.alias("chance"))


def frozen_sizes(histogram: DataFrame, total: float | Column, rate: float, confidence: float) -> DataFrame:
    """size, obs, n, found, chance and frozen: whether at least as many clusters as observed are found with the given confidence. One row for each distinct size."""
    return upper_tails(expected_sizes(histogram, total, rate), ["size"]).withColumn("frozen", F.col("chance") >= confidence)


def simulated(histogram: DataFrame, total: float, rate: float, runs: int, seed: int | str) -> DataFrame:
    """size, k and share: how often k of the clusters of a size were found in `runs` simulations of discovery."""
    e = expected_sizes(histogram, total, rate)
    draws = e.select("size", "found", "n", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")).where("n > 0")
    # clusters are numbered in blocks, so that no row holds more than one block of them
    blocks = draws.select("size", "found", "run", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("block"))
    draws = blocks.select("size", "found", "run", F.explode(F.sequence(F.col("block") * BLOCK + 1, F.least((F.col("block") + 1) * BLOCK, F.col("n")))).alias("i"))
    hits = draws.groupBy("size", "run").agg(F.count(F.when(uniform(seed, F.col("size"), F.col("run"), F.col("i")) >= 1 - F.col("found"), 1)).alias("k"))
    return hits.groupBy("size", "k").agg((F.count(F.lit(1)) / runs).alias("share"))


def frontier_start(spark: SparkSession, total: float) -> DataFrame:
    """Stored: no size in the pool, the whole mass, no bound."""
    return kept(spark.createDataFrame([(None, None, False, False, total, 0)], FRONTIER), "frontier")


def frontier_step(before: DataFrame, histogram: DataFrame, rate: float, confidence: float) -> DataFrame:
    """Stored: the frontier after an iteration that found clusters of these sizes (size, n), one row a size of the pool, or one without a size.

    Sizes that weren't frozen before are joined by the new ones. Those whose clusters are all found with the confidence
    are frozen and leave the pool; those of them not below the largest open size give their mass back and set the bound,
    which stays as it was where there are none. Mass and bound stand on each row.
    """
    pool = before.where("size is not null and not frozen").select("size", "n").unionByName(histogram.select("size", "n")).groupBy("size").agg(F.sum("n").alias("n"))
    world = before.groupBy().agg(F.max("mass").alias("mass"), F.max("bound").alias("bound"))
    sized = pool.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).join(F.broadcast(world))
    judged = frozen_sizes(sized, F.col("mass"), rate, confidence).select("size", F.col("obs").alias("n"), (F.col("frozen") & (F.col("mass") > 0)).alias("frozen"), "mass", "bound")
    all_ = Window.partitionBy()
    most = F.coalesce(F.max(F.when(~F.col("frozen"), F.col("size"))).over(all_), F.lit(0))
    marked = judged.withColumn("upper", F.col("frozen") & (F.col("size") >= most))
    given = F.coalesce(F.sum(F.when(F.col("upper"), F.col("size") * F.col("n"))).over(all_), F.lit(0))
    least = F.min(F.when(F.col("upper"), F.col("size"))).over(all_)
    after = marked.select("size", "n", "frozen", "upper", (F.col("mass") - given).alias("mass"), F.coalesce(least, F.col("bound")).cast("long").alias("bound"))
    # with an empty pool the mass and the bound need a row of their own
    alone = world.join(pool.groupBy().agg(F.count(F.lit(1)).alias("c"))).where("c = 0").selectExpr("CAST(NULL AS long) AS size", "CAST(NULL AS long) AS n", "false AS frozen", "false AS upper", "mass", "bound")
    return kept(after.unionByName(alone), "frontier")


def frontier_rows(histograms: DataFrame, iterations: list, total: float, rate: float, confidence: float) -> DataFrame:
    """iteration, size, n, frozen, upper, mass and bound after each iteration, from histograms (iteration, size, n) in this order of iterations."""
    state, out = frontier_start(histograms.sparkSession, total), None
    for k in iterations:
        state = frontier_step(state, histograms.where(F.col("iteration") == k), rate, confidence)
        row = state.select(F.lit(k).alias("iteration"), "*")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else state.limit(0).select(F.lit(None).cast("int").alias("iteration"), "*")
