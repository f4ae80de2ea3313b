"""Summaries of clusters, of one iteration and across iterations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import in_order


def cluster_summary(members: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """centroid, density (members), mode (largest multiplicity) and mode_seq (whose it is: the centroid if it ties, else the smallest id)."""
    m = members.select("centroid", "seq_id").distinct()
    m = m.withColumn("count", F.lit(1).cast("long")) if counts is None else m.join(counts.select("seq_id", "count"), "seq_id", "left").withColumn("count", F.coalesce("count", F.lit(1)).cast("long"))
    best = F.min_by("seq_id", F.struct(-F.col("count"), F.col("seq_id") != F.col("centroid"), "seq_id"))
    return m.groupBy("centroid").agg(F.count(F.lit(1)).alias("density"), F.max("count").alias("mode"), best.alias("mode_seq"))


def with_compat(summary: DataFrame) -> DataFrame:
    """summary with density_compat: a cluster's centre counted as the head of its line and, where it recruited itself, once more, as in files of earlier runs. The density of other columns is of distinct members."""
    return summary.withColumn("density_compat", F.col("density") + 1)


def bait_centres(summary: DataFrame) -> DataFrame:
    return summary.where("density > 1 or mode > 1").select(F.col("centroid").alias("seq_id"))


def mode_centres(summary: DataFrame) -> DataFrame:
    return summary.where("density > 1").select(F.col("mode_seq").alias("seq_id")).distinct()


def singletons(summary: DataFrame, alone: bool = True) -> DataFrame:
    return summary.where("density = 1" if alone else "density > 1")


def exact_median(values: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """median of a column for each key, from how often each value occurs, so that only distinct values meet."""
    keys = keys or []
    sizes = values.groupBy(*keys, F.col(column).alias("n")).agg(F.count(F.lit(1)).alias("c"))
    up_to = F.sum("c").over(Window.partitionBy(*keys).orderBy("n"))
    all_ = F.sum("c").over(Window.partitionBy(*keys))
    ranked = sizes.select(*keys, "n", up_to.alias("u"), all_.alias("t"), "c")
    hit = lambda k: F.min(F.when(F.col("u") > k, F.col("n")))
    return ranked.groupBy(*keys).agg(((hit(F.floor((F.col("t") - 1) / 2)) + hit(F.floor(F.col("t") / 2))) / 2.0).alias("median"))


def iteration_metrics(sizes: DataFrame, least: int, keys: list[str] | None = None, column: str = "density") -> DataFrame:
    """For each key: clusters of over one member, members in them, the densest cluster, mean and median size of those, clusters of `least` members or more, singletons."""
    keys = keys or []
    big = F.col(column) > 1
    value = lambda: F.when(big, F.col(column))
    found = sizes.groupBy(*keys).agg(
        F.count(value()).alias("n_clusters"),
        F.coalesce(F.sum(value()), F.lit(0)).cast("long").alias("n_clustered"),
        F.max(column).cast("long").alias("densest"),
        F.avg(value()).alias("mean_size"),
        F.count(F.when(F.col(column) >= least, 1)).alias("n_above_least"),
        F.count(F.when(F.col(column) == 1, 1)).alias("n_singletons"),
    )
    medians = exact_median(sizes.where(big), column, keys).withColumnRenamed("median", "median_size")
    return found.join(medians, keys, "left") if keys else found.join(medians)


def histogram(sizes: DataFrame, column: str = "size") -> DataFrame:
    """size, n (how many have it) and share of all."""
    h = sizes.groupBy(F.col(column).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def size_table(sizes: DataFrame, key: str, column: str = "density") -> DataFrame:
    """For each key: members in all, and clusters and members at or above several sizes."""
    at_least = lambda k, what: F.when(F.col(column) >= k, what)
    return sizes.groupBy(key).agg(
        F.sum(column).cast("long").alias("seq_counts"),
        *[F.count(at_least(k, F.lit(1))).alias(f"clusters_above_{k}") for k in (10, 20, 30, 35, 40)],
        *[F.coalesce(F.sum(at_least(k, F.col(column))), F.lit(0)).cast("long").alias(f"seqs_in_clusters_above_{k}") for k in (10, 20, 30, 40, 50)],
    )


def padded(sizes: DataFrame, total: int, column: str = "size") -> DataFrame:
    """sizes as a weighted table (size, n) with as many singletons added as are missing to `total` members."""
    h = sizes.groupBy(F.col(column).cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    missing = h.agg(F.greatest(F.lit(0), F.lit(total) - F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0))).cast("long").alias("n")).select(F.lit(1).cast("long").alias("size"), "n").where("n > 0")
    return h.unionByName(missing).groupBy("size").agg(F.sum("n").alias("n"))


def running(table: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """table with cum_<column> for each column, summed in order. For tables of one row an iteration."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return table.select("*", *[F.sum(c).over(w).alias(f"cum_{c}") for c in columns])


def with_previous(table: DataFrame, order: str, column: str) -> DataFrame:
    return table.withColumn(f"previous_{column}", F.lag(column).over(Window.orderBy(order)))


def carried(table: DataFrame, order: str, column: str) -> DataFrame:
    """The last value that isn't null, up to each row."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn(column, F.last(column, ignorenulls=True).over(w))


def running_ids(lines: DataFrame, iteration: str = "iteration", line: str = "line_no") -> DataFrame:
    """cluster_id: a number for each line over all iterations, from 0, in order; counted within ranges of lines and then shifted."""
    return in_order(lines, [F.col(iteration), F.col(line)], "cluster_id").withColumn("cluster_id", F.col("cluster_id") - 1)


def with_cluster_stats(rows: DataFrame, clusters: DataFrame, key: str = "iteration", column: str = "density") -> DataFrame:
    """Summary rows of a run, one for each iteration, beside number, members and largest of the clusters of that iteration; null where it has none."""
    stats = clusters.groupBy(key).agg(F.count(F.lit(1)).alias("clusters"), F.sum(column).cast("long").alias("members"), F.max(column).cast("long").alias("largest"))
    return rows.join(stats, key, "left")


def clusters_over_time(clusters: DataFrame, rows: DataFrame, time: str, key: str = "iteration") -> DataFrame:
    """Each cluster beside the time that its run had taken up to its iteration (rows: one for each iteration)."""
    return clusters.join(F.broadcast(running(rows, key, [time]).select(key, f"cum_{time}")), key, "left")


def total_time(rows: DataFrame, time: str, keys: list[str] | None = None) -> DataFrame:
    """The time of all iterations, of each combination of keys."""
    return rows.groupBy(*(keys or [])).agg(F.sum(time).alias(f"total_{time}"))


def category_counts(rows: DataFrame, key: str, category: str, wanted: list[str]) -> DataFrame:
    return rows.where(F.col(category).isin(wanted)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def maximum(rows: DataFrame, key: str, column: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(column).alias(f"max_{column}"))


def entropy(rows: DataFrame, label: Column) -> DataFrame:
    """Shannon entropy of the labels, natural logarithm; zero for no rows."""
    n = rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"))
    return total.select(F.coalesce(F.log("t") - F.col("s") / F.col("t"), F.lit(0.0)).alias("entropy"))
