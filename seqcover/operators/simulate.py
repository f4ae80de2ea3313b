"""Simulations of sampling: size generators, discovery rounds and the closed forms they should meet."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import log_choose, uniform


def drawn_sizes(spark: SparkSession, kind: str, total: int, singletons: float, seed: int | str, **parameters: float) -> DataFrame:
    """cluster and size: draws above 2 until their sum reaches total * (1 - singletons), and singletons for the rest.

    kind: "geometric" (p), "normal" (mean, sd) or "uniform" (low, high). Draws are numbered and depend on seed and number
    alone; the running sum is taken within blocks of draws and over the blocks' sums.
    """
    if kind == "geometric":
        mean, size = 1 / parameters["p"], lambda u, v: F.ceil(F.log(1 - u) / math.log(1 - parameters["p"]))
    elif kind == "normal":
        mean, size = max(3.0, parameters["mean"]), lambda u, v: F.round(parameters["mean"] + parameters["sd"] * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v))
    elif kind == "uniform":
        mean, size = (parameters["low"] + parameters["high"]) / 2, lambda u, v: F.floor(parameters["low"] + u * (parameters["high"] - parameters["low"] + 1))
    else:
        raise ValueError(f"no such kind: {kind}")
    mass = total * (1 - singletons)
    draws = spark.range(int(4 * mass / mean) + 1000).select(F.col("id").alias("k"), size(uniform(seed, F.lit("u"), F.col("id")), uniform(seed, F.lit("v"), F.col("id"))).cast("long").alias("size")).where("size > 2")
    block = F.floor(F.col("k") / 4096)
    own = F.sum("size").over(Window.partitionBy("b").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    blocks = draws.groupBy(block.alias("b")).agg(F.sum("size").alias("s")).select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    taken = draws.withColumn("b", block).withColumn("own", F.coalesce(own, F.lit(0))).join(blocks, "b").where(F.col("own") + F.col("before") < mass).select("k", "size")
    missing = taken.agg(F.greatest(F.lit(0), F.lit(total) - F.coalesce(F.sum("size"), F.lit(0))).cast("long")).first()[0]
    rest = spark.range(missing).select((-F.col("id") - 1).alias("k"), F.lit(1).cast("long").alias("size"))
    return taken.unionByName(rest).withColumnRenamed("k", "cluster")


def discovery_rounds(clusters: DataFrame, rate: float, rounds: int, seed: int | str) -> DataFrame:
    """One row for each round of naive sampling: what was clustered, the largest found and left, entropies of both.

    clusters: cluster, size. In each round a cluster is found with the chance that a sample of `rate` of the mass that is
    left meets it twice. The mass changes from round to round, so rounds follow each other; each is one aggregation.
    """
    spark, left, out = clusters.sparkSession, clusters, None
    from ..functions.tables import kept

    for k in range(1, rounds + 1):
        mass = left.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if not mass:
            break
        x = F.col("size") * F.lit(rate)
        found = 1 - F.exp(-x) * (1 + x * F.exp(F.col("size") / F.lit(float(mass))))
        now = kept(left.withColumn("hit", uniform(seed, F.lit(k), F.col("cluster")) < found), "round")
        side = lambda hit, what: F.when(F.col("hit") == hit, what)

        def spread(hit: bool) -> Column:
            s, n = F.sum(side(hit, F.col("size"))), F.sum(side(hit, F.col("size") * F.log("size")))
            return F.coalesce(F.log(s) - n / s, F.lit(0.0))

        row = now.agg(
            F.coalesce(F.sum(side(True, F.col("size"))), F.lit(0)).cast("long").alias("n_clustered"), F.max(side(True, F.col("size"))).alias("max_clustered"), F.max(side(False, F.col("size"))).alias("max_left"), F.count(side(True, 1)).alias("n_clusters"),
            F.coalesce(F.sum(side(False, F.col("size"))), F.lit(0)).cast("long").alias("n_left"), (F.count(F.when(~F.col("hit") & (F.col("size") == 1), 1)) / F.greatest(F.lit(1), F.sum(side(False, F.col("size"))))).alias("singletons_left"),
            spread(True).alias("entropy_clustered"), spread(False).alias("entropy_left"),
        ).select(F.lit(k).alias("iteration"), "*")
        out = row if out is None else out.unionByName(row)
        left = now.where("not hit").drop("hit")
    return out if out is not None else spark.createDataFrame([], "iteration int")


def miss_curve(grid: DataFrame) -> DataFrame:
    """P(fewer than two of k members are among n drawn of N): hypergeometric, for rows (total, drawn, k); by sums of logarithms."""
    terms = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("k") - 1))
    # P(0) = prod (N-n-i)/(N-i); P(1) = k * n/(N-k+1) * prod over one factor less
    ratio = lambda last: F.aggregate(F.slice(terms, 1, last), F.lit(0.0), lambda a, i: a + F.when(F.col("total") - F.col("drawn") - i <= 0, F.lit(-1e300)).otherwise(F.log((F.col("total") - F.col("drawn") - i) / (F.col("total") - i))))
    none, one = F.exp(ratio(F.col("k").cast("int"))), F.col("k") * F.col("drawn") / (F.col("total") - F.col("k") + 1) * F.exp(ratio((F.col("k") - 1).cast("int")))
    return grid.withColumn("miss", none + one)


def missed_clusters(grid: DataFrame, compat: bool = False) -> DataFrame:
    """grid (total, drawn, k, m) with missed: P(each of m clusters of k members has fewer than two among n drawn of N), hypergeometric.

    The sum over the number i of clusters that have one member drawn, choose(m, i) k^i choose(N - km, n - i) / choose(N, n),
    is taken from logarithms, a row for each i, and added up as exponentials under the largest. compat: k in the place of
    k^i, as in the curves that were published. Null where km is over N.
    """
    total, n, k, m, i = (F.col(c) for c in ("total", "drawn", "k", "m", "i"))
    keys = ["total", "drawn", "k", "m"]
    terms = grid.select(*keys).distinct().where(k * m <= total).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least(m, n).cast("long"))).alias("i"))
    power = F.when(i > 0, F.log(k)).otherwise(0.0) if compat else i * F.log(k)
    terms = terms.withColumn("ln", power + log_choose(m, i) + log_choose(total - k * m, n - i) - log_choose(total, n)).where("ln is not null")
    most = terms.groupBy(*keys).agg(F.max("ln").alias("most"))
    sums = terms.join(most, keys).groupBy(*keys).agg((F.exp(F.first("most")) * F.sum(F.exp(F.col("ln") - F.col("most")))).alias("_sum"))
    return grid.join(sums, keys, "left").withColumn("missed", F.when(k * m <= total, F.coalesce("_sum", F.lit(0.0)))).drop("_sum")
