"""New records recruited to fixed centres as they come in, with the clusters' summaries kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tables import kept
from ..operators.recruit import recruited


def merged(before: DataFrame | None, members: DataFrame) -> DataFrame:
    """centroid, density, mode and mode_seq after more members (centroid, seq_id, count), as cluster_summary() has them of all members at once."""
    new = members.select("centroid", F.lit(1).cast("long").alias("density"), F.col("count").alias("mode"), F.col("seq_id").alias("mode_seq"))
    both = new if before is None else before.select(*new.columns).unionByName(new)
    best = F.min_by("mode_seq", F.struct(-F.col("mode"), F.col("mode_seq") != F.col("centroid"), "mode_seq"))
    return both.groupBy("centroid").agg(F.sum("density").alias("density"), F.max("mode").alias("mode"), best.alias("mode_seq"))


def recruit_stream(stream: DataFrame, centres: DataFrame, similarity: float, out: str, checkpoint: str) -> StreamingQuery:
    """Members (seq_id, centroid, count) of each batch of the stream (seq_id, sequence and, if known, count; each record once) under out/members, and the summary after it under out/summary.

    A batch writes its own folders, and its summary is made from that of the batch before; so a batch that is repeated
    after a failure replaces itself, and a stream that starts again goes on with what was kept.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        rows = kept(batch.select("seq_id", "sequence", (F.coalesce("count", F.lit(1)) if "count" in batch.columns else F.lit(1)).cast("long").alias("count")), "batch")
        found = recruited(rows.select("seq_id", "sequence"), centres, similarity).join(rows.select("seq_id", "count"), "seq_id")
        found.write.mode("overwrite").parquet(f"{out}/members/batch={number}")
        members = spark.read.schema(found.schema).parquet(f"{out}/members/batch={number}")
        before = spark.read.parquet(f"{out}/summary/batch={number - 1}") if number else None
        merged(before, members).write.mode("overwrite").parquet(f"{out}/summary/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def members(spark: SparkSession, out: str) -> DataFrame:
    """seq_id, centroid, count and batch of all that the stream has recruited."""
    return spark.read.parquet(f"{out}/members")


def summary(spark: SparkSession, out: str) -> DataFrame:
    """The summary after the last batch."""
    all_ = spark.read.parquet(f"{out}/summary")
    return all_.join(F.broadcast(all_.groupBy().agg(F.max("batch").alias("batch"))), "batch", "left_semi").drop("batch")
