"""Cluster files of this and other tools, as tables and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import minutes
from ..functions.tables import file_place, in_file_order


def lines_to_members(lines: DataFrame) -> DataFrame:
    """line_no, centroid, seq_id and pos from (line_no, value): the ids of a line, the centroid first."""
    ids = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    return lines.select("line_no", ids.alias("ids")).where(F.size("ids") > 0).select("line_no", F.get("ids", F.lit(0)).alias("centroid"), F.posexplode("ids").alias("pos", "seq_id"))


def first_lines(members: DataFrame) -> DataFrame:
    """Each seq_id once, in the first line that names it."""
    return members.groupBy("seq_id").agg(F.min_by(F.struct("line_no", "centroid", "pos"), F.struct("line_no", "pos")).alias("m")).select("m.line_no", "m.centroid", "seq_id", "m.pos")


def line_sizes(lines: DataFrame, least: int = 2) -> DataFrame:
    """line_no and size of the lines that name `least` ids or more."""
    return lines.select("line_no", F.size(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("size")).where(F.col("size") >= least)


def members_to_lines(members: DataFrame) -> DataFrame:
    """centroid and value: the centroid, then its other members in order, by tabs. A line is as long as its cluster."""
    others = F.sort_array(F.collect_list(F.when(F.col("seq_id") != F.col("centroid"), F.col("seq_id"))))
    return members.groupBy("centroid").agg(others.alias("others")).select("centroid", F.array_join(F.concat(F.array("centroid"), "others"), "\t").alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (growing with the files' paths and their lines, with gaps) and value."""
    return in_file_order(spark.read.text(path).select("value", *file_place()), "line_no").select("line_no", "value")


def write_lines(members: DataFrame, path: str) -> None:
    members_to_lines(members).select("value").write.text(path)


def merged_parts(members: DataFrame) -> DataFrame:
    """Members of one centroid over all parts, each once."""
    return members.select("centroid", "seq_id").distinct()


def write_edges(edges: DataFrame, path: str) -> None:
    """target and centre of each accepted pair, by a tab."""
    edges.select("target", "centre").write.option("sep", "\t").csv(path)


def read_duplicates(spark: SparkSession, path: str) -> DataFrame:
    """seq_id and count from lines "n<TAB>id, id ..": the first id stands for all."""
    raw = spark.read.option("sep", "\t").schema("count long, ids string").csv(path)
    return raw.select(F.get(F.split("ids", ", "), F.lit(0)).alias("seq_id"), "count")


def duplicate_lines(records: DataFrame) -> DataFrame:
    """value: "n<TAB>id, id .." for each sequence that two records (seq_id, sequence, ord) or more have, in order of ord. A line is as long as its ids."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("ord", "seq_id"))), lambda x: x["seq_id"].cast("string"))
    return records.groupBy("sequence").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids")).where("n > 1").select(F.concat_ws("\t", F.col("n").cast("string"), F.array_join("ids", ", ")).alias("value"))


def write_counts_literal(counts: DataFrame, path: str) -> None:
    """One Python literal {id: {"Counts": "n"}} for each part, a line for each id."""
    pair = F.concat(F.lit("{'"), F.regexp_replace(F.col("seq_id").cast("string"), r"(['\\])", r"\\$1"), F.lit("': {'Counts': '"), F.col("count").cast("string"), F.lit("'}}"))
    counts.select(pair.alias("value")).write.text(path)


def write_ids(ids: DataFrame, path: str) -> None:
    """One id on each line."""
    ids.select(F.col("seq_id").cast("string").alias("value")).write.text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("seq_id"))


def read_counts_literal(spark: SparkSession, path: str) -> DataFrame:
    """seq_id and count from Python literals {id: {"Counts": "n"}}, of one id or many in each, wherever lines end."""
    pairs = F.regexp_extract_all("value", F.lit(r"""(?:'([^'\\]*+(?:\\.[^'\\]*+)*+)'|"([^"\\]*+(?:\\.[^"\\]*+)*+)")\s*:\s*\{\s*['"]Counts['"]\s*:\s*['"]?(\d+)"""), F.lit(0))
    raw = spark.read.option("lineSep", "}").text(path).select(F.explode(pairs).alias("p"))
    parts = lambda k: F.regexp_extract("p", r"""^(?:'([^'\\]*+(?:\\.[^'\\]*+)*+)'|"([^"\\]*+(?:\\.[^"\\]*+)*+)")\s*:\s*\{\s*['"]Counts['"]\s*:\s*['"]?(\d+)""", k)
    return raw.select(F.regexp_replace(F.concat(parts(1), parts(2)), r"\\(.)", "$1").alias("seq_id"), parts(3).cast("long").alias("count"))


def centre_map(lines: DataFrame, turned: bool = False) -> DataFrame:
    """centroid and other for each member after the first of a line; the two swapped if turned."""
    pairs = lines_to_members(lines).where("pos > 0")
    a, b = ("other", "centroid") if turned else ("centroid", "other")
    return pairs.select(F.col("centroid").alias(a), F.col("seq_id").alias(b)).select("centroid", "other")


SUMMARY = "iteration int, cluster_id long, centroid string, density long, mode long, mode_seq string"


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.option("sep", "\t").option("header", True).csv(path)


def read_summary(spark: SparkSession, path: str, schema: str = SUMMARY) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def timed(summary: DataFrame, columns: list[str]) -> DataFrame:
    """Texts like "1.5 minutes" as numbers."""
    return summary.withColumns({c: minutes(F.col(c)) for c in columns})


def cdhit_sizes(spark: SparkSession, path: str) -> DataFrame:
    """cluster and size: the lines behind each line that starts with ">"."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    return raw.where(F.trim("value") != "").select(F.regexp_replace(F.get(lines, F.lit(0)), "^>", "").alias("cluster"), (F.size(lines) - 1).cast("long").alias("size"))


def uclust_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", ";").schema("cluster string, size long").csv(path)


def meshclust_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("cluster long, sequence string, identity double, category string").csv(path)


def abundances(spark: SparkSession, path: str) -> DataFrame:
    """sequence and count from a semicolon table with a header."""
    return spark.read.option("sep", ";").option("header", True).schema("sequence string, count long").csv(path)


def read_run(spark: SparkSession, path: str, schema: str = "cluster_id long, centroid string, density long, mode long, mode_seq string") -> DataFrame:
    """The summaries in folders Iteration_0, Iteration_1 ..: iteration counts from 1."""
    raw = spark.read.option("sep", "\t").option("header", True).schema(schema).csv(f"{path}/Iteration_*/")
    return raw.withColumn("iteration", F.regexp_extract(F.col("_metadata.file_path"), r"Iteration_(\d+)", 1).cast("int") + 1)


def write_bundle(results: DataFrame, path: str, keys: list[str]) -> None:
    """Results of many runs, one folder for each combination of keys (dataset, similarity, rate, variant ..)."""
    results.write.partitionBy(*keys).parquet(path)


def options_table(spark: SparkSession, options: dict) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in options.items()], "option string, value string")


def numbered(summary: DataFrame, order: list[str]) -> DataFrame:
    """cluster_id from 0 in each iteration."""
    return summary.withColumn("cluster_id", (F.row_number().over(Window.partitionBy("iteration").orderBy(*order)) - 1).cast("long"))
