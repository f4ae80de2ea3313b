"""Matching the clusters of two tools: abundances, centroids and their maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import outer_compared


def abundance_with_centroid(abundance: DataFrame, centroids: DataFrame) -> DataFrame:
    """abundance (sequence, count) with the centroid that has the sequence, null if none."""
    return abundance.join(centroids.select("sequence", "centroid"), "sequence", "left")


def matched(abundance: DataFrame, mapping: DataFrame, clusters: DataFrame) -> DataFrame:
    """centroid, other_sum, other_max, n_members, members_sum: abundances of the other tool summed by the centroid they map to, beside the own clusters; -1 for what one side lacks.

    abundance: other, count. mapping: other, centroid. clusters: centroid, seq_id, count.
    """
    joined = abundance.join(mapping, "other", "full_outer")
    theirs = joined.where("centroid is not null").groupBy("centroid").agg(F.sum("count").alias("other_sum"), F.max("count").alias("other_max"))
    ours = clusters.groupBy("centroid").agg(F.count(F.lit(1)).alias("n_members"), F.sum("count").alias("members_sum"))
    return outer_compared(theirs, ours, "centroid", ["other_sum", "other_max", "n_members", "members_sum"])
