"""Comparison of cluster distributions: fragmentation curves, correlations, matched tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import in_order


def fragmentation(sizes: DataFrame, least: int = 0, column: str = "size") -> DataFrame:
    """x, cum and ng for x = 0, 0.5 .. 99.5 percent: the last cluster, largest first, up to which the sizes sum to no more than x percent; no row where there is none.

    Sizes above `least` count. Equal sizes are taken together (a table of sizes and how often they occur is all that is
    ordered): within one size, the last cluster that fits is found by division.
    """
    h = sizes.select(F.col(column).cast("long").alias("size")).where(F.col("size") > least).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    above = F.coalesce(F.sum(F.col("size") * F.col("n")).over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = h.select("size", "n", above.alias("above"), F.sum(F.col("size") * F.col("n")).over(Window.partitionBy()).alias("total"))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: k / 2.0))
    points = ranked.select("size", "n", "above", "total", grid.alias("x"))
    fit = F.least(F.col("n"), F.floor((F.col("total") * F.col("x") / 100 - F.col("above")) / F.col("size")))
    hit = points.withColumn("fit", fit).where("fit >= 1").withColumn("cum", F.col("above") + F.col("fit") * F.col("size"))
    return hit.groupBy("x").agg(F.max("cum").alias("cum"), F.max_by("size", "cum").alias("ng"))


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    """r and n over rows where both are known."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def mean_ranks(rows: DataFrame, column: str) -> DataFrame:
    """value and rank: the mean place of each distinct value, from 1; ranges of distinct values are ordered apart and then shifted."""
    n = in_order(rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("c")), [F.col("value")], "up_to", "c")
    return n.select("value", (F.col("up_to") - (F.col("c") - 1) / 2).alias("rank"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """r of the mean ranks, and n."""
    both = rows.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    rx, ry = mean_ranks(both, "x").withColumnsRenamed({"value": "x", "rank": "rx"}), mean_ranks(both, "y").withColumnsRenamed({"value": "y", "rank": "ry"})
    return both.join(rx, "x").join(ry, "y").agg(F.corr("rx", "ry").alias("r"), F.count(F.lit(1)).alias("n"))


def correlation_t(r: Column, n: Column) -> Column:
    """The t statistic of a correlation, with n - 2 degrees of freedom."""
    return r * F.sqrt((n - 2) / (1 - r * r))


def two_sided_p(t: float, freedom: float) -> float:
    """Probability of a t statistic as far from zero or farther, by the continued fraction of the incomplete beta function."""
    if math.isnan(t) or freedom <= 0:
        return math.nan
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0

    def fraction(x: float, a: float, b: float) -> float:
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        value, c, d = 1.0, 1.0, 0.0
        for k in range(400):
            m = k // 2
            step = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            value *= c * d
            if abs(1 - c * d) < 1e-13 and k:
                break
        return front * (value - 1)

    return fraction(x, a, b) if x < (a + 1) / (a + b + 2) else 1 - fraction(1 - x, b, a)


def with_p(correlation: DataFrame) -> DataFrame:
    """A correlation (r, n) with its t and its two-sided p. One row, so the driver's share is one number."""

    @F.pandas_udf("double")
    def p(t, n):
        import pandas as pd

        return pd.Series([two_sided_p(float(a), float(b) - 2) for a, b in zip(t, n, strict=True)])

    return correlation.withColumn("t", correlation_t(F.col("r"), F.col("n"))).withColumn("p", p("t", "n"))


def outer_compared(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer join on key, with -1 for what one side lacks."""
    return left.join(right, key, "full_outer").na.fill(-1, columns)


def one_sided(compared: DataFrame, column: str) -> DataFrame:
    return compared.where(F.col(column) == -1)


def rolled_up(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Rows, sum and maximum of a column for each key."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(column).alias("total"), F.max(column).alias("largest"))
