"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """From edges (a long, b long): node and root, the smallest node of its component, of every node that is no root.

    Each round links the larger neighbours of every node, then the smaller ones, to the smallest neighbour; the depth
    of a component falls by a constant factor each round. A round is two aggregations and two joins on the edges that
    are left, which are no more than there were at first. Null ends and loops are left out. No edges: no rows.
    """
    now = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    was = print_of(now)
    while was[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = common.stored(large.distinct(), "edges")
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        after = common.stored(small.distinct(), "edges")
        common.forget(large)
        common.forget(now)
        now, before = after, was
        was = print_of(now)
        if was == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
