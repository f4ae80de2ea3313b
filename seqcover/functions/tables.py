"""Tables that are written once and read again, to cut the lineage of loops."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which executors share; a temporary folder only where that is unset and everything runs on this machine."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        known = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of kept() tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: What file_place() adds, in the order of lines.
PLACE = ["_file", "_block", "_at"]


def file_place() -> list[Column]:
    """Where a row of a text source stands: path, first byte of the split, and a number that grows within the split. Spark deals out splits by size, so its own row numbers don't follow the files."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]


def in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """rows with file_place(), which goes, and a number that grows with path, split and line: splits are ranked (a row each), not lines."""
    splits = rows.select("_file", "_block").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_file", "_block")).cast("long"))
    splits = splits.withColumnsRenamed({"_file": "_of", "_block": "_from"})
    placed = rows.join(F.broadcast(splits), (F.col("_file") == F.col("_of")) & (F.col("_block") == F.col("_from")))
    return placed.withColumn(name, F.shiftleft("_rank", 33) + F.col("_at").bitwiseAND((1 << 33) - 1)).drop(*PLACE, "_of", "_from", "_rank")


def in_order(df: DataFrame, order: list[Column], name: str = "place", column: str | None = None) -> DataFrame:
    """df with its place in the order, from 1, or with the sum of a column up to it.

    Rows are dealt out by ranges of the order and sorted there; only one number for each range is put in order. Rows
    that the order doesn't tell apart stay in one range, in any order.
    """
    dealt = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seat", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_seat", 33))
    value = F.lit(1) if column is None else F.col(column)
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = totals.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.col("_seat") - F.shiftleft("_part", 33) + 1 if column is None else F.sum(column).over(Window.partitionBy("_part").orderBy("_seat"))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_seat", "_part", "_own", "_before")
