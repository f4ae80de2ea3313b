"""Sequence records as text: FASTA and FASTQ in, FASTA out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_word, reverse_complement, trimmed
from ..functions.tables import file_place, in_file_order

WIDTH = 60
MANY_FILES = 100_000


def read_fasta(spark: SparkSession, path: str, whole_header: bool = False, strict: bool = False) -> DataFrame:
    """seq_id, header, sequence, length and ord (place in the file order) of each record.

    A line that starts with ">" begins a record; its other lines are trimmed and put together. What stands before the
    first record is left out, or an error if strict.
    """
    raw = in_file_order(spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), *file_place()), "ord")
    first = F.col("value").startswith(">")
    # the first piece of each file: one row for each file is all that is looked for, without sorting any
    begins = raw.groupBy(F.col("file").alias("of")).agg(F.min("ord").alias("least"))
    raw = raw.join(F.broadcast(begins) if len(raw.inputFiles()) <= MANY_FILES else begins, F.col("file") == F.col("of"))
    start = F.col("ord") == F.col("least")
    body = raw.withColumn("start", start).where(~F.col("start") | first | F.lit(strict))
    value = F.when(F.col("start"), F.when(first, F.expr("substr(value, 2)")).otherwise(F.raise_error(F.lit("the file doesn't start with a record")))).otherwise(F.col("value"))
    lines = F.split(value, "\n", -1)
    made = body.select(trimmed(lines[0]).alias("header"), F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1)), trimmed), "").alias("sequence"), "ord")
    return made.select((F.col("header") if whole_header else first_word(F.col("header"))).alias("seq_id"), "header", "sequence", F.length("sequence").alias("length"), "ord")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """file, place (from 0), header and sequence of records of exactly two lines, a ">" and a header, then letters on one line; anything else is an error that names the line.

    Whether a line is a header depends on the number of lines before it, and so on all splits before its own; each split
    counts its lines, and the parities of the sums in front shift those of the split.
    """
    lines = numbered_lines(spark, path).withColumn("k", F.col("line_no") % 2)
    right = (F.col("k") == 0) == F.col("value").startswith(">")
    value = F.when(right, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("records don't have two lines each: line "), F.col("line_no") + 1)))
    told = lines.select("file", F.floor(F.col("line_no") / 2).alias("place"), "k", value.alias("value"))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    found = told.groupBy("file", "place").agg(at(0).alias("header"), at(1).alias("sequence"))
    whole = F.when(F.col("sequence").isNotNull(), trimmed(F.expr("substr(header, 2)"))).otherwise(F.raise_error(F.concat(F.lit("a record without letters: "), F.col("header"))))
    return found.select("file", "place", whole.alias("header"), trimmed(F.col("sequence")).alias("sequence"))


def fasta_text(header, sequence):
    """A record as it is written, wrapped at WIDTH."""
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(sequence, f"(.{{{WIDTH}}})(?!$)", "$1\n"))


def write_fasta(records: DataFrame, path: str, by: str | None = None) -> None:
    """Records in order of ord in each part; one folder for each value of `by` if given."""
    columns = [fasta_text(F.col("header"), F.col("sequence")).alias("value")] + ([F.col(by)] if by else [])
    out = records.sortWithinPartitions("ord").select(*columns).write
    (out.partitionBy(by) if by else out).text(path)


def count_records(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.col("value").startswith(">")).count()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0 in each file) and value of every line, empty ones too. Files are split; only the counts of lines of each part are put in order."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    part = F.shiftright("at", 33).alias("part")
    parts = raw.groupBy("file", part).agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select(F.col("file").alias("of"), F.col("part").alias("of_part"), (before - F.col("least")).alias("shift"))
    return raw.join(shifts, (F.col("file") == F.col("of")) & (F.shiftright("at", 33) == F.col("of_part"))).select("file", (F.col("at") + F.col("shift")).alias("line_no"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, place (from 0), header, sequence and quality of records of four lines: "@" and a header, letters, a line that starts with "+", qualities. Empty reads are records; blank lines behind the last record are not. Anything else is an error."""
    lines = numbered_lines(spark, path).withColumn("k", F.col("line_no") % 4)
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    found = lines.groupBy("file", F.floor(F.col("line_no") / 4).alias("place")).agg(at(0).alias("header"), at(1).alias("sequence"), at(2).alias("sign"), at(3).alias("quality"))
    found = found.where(F.concat_ws("", "header", "sequence", "sign", "quality") != "")
    whole = F.col("header").startswith("@") & F.coalesce(F.col("sign").startswith("+"), F.lit(False)) & (F.length("sequence") == F.length(F.coalesce("quality", F.lit(""))))
    header = F.when(whole, F.expr("substr(header, 2)")).otherwise(F.raise_error(F.concat(F.lit("no whole record: "), F.col("header"))))
    return found.select("file", "place", header.alias("header"), F.coalesce("sequence", F.lit("")).alias("sequence"), F.coalesce("quality", F.lit("")).alias("quality"))


def fastq_text(header, sequence, quality):
    """A record as it is written."""
    return F.concat_ws("\n", F.concat(F.lit("@"), header), sequence, F.lit("+"), quality)


def quality_cut(reads: DataFrame, worst: int = 19, run: int = 3, share: float = 0.75) -> DataFrame:
    """reads cut before the first run of over `run` letters of a quality of `worst` or less (offset 33); those that lose more than 1 - share of their letters go, and so do those with an N left."""
    bad = f"[!-{re.escape(chr(33 + worst))}]{{{run + 1},}}"
    at = F.regexp_instr("quality", F.lit(bad))
    kept = F.when(at > 0, at - 1).otherwise(F.length("sequence"))
    cut = reads.withColumn("_kept", kept).where(F.col("_kept") >= share * F.length("sequence")).withColumns({c: F.substr(c, F.lit(1), F.col("_kept")) for c in ("sequence", "quality")})
    return cut.where(~F.contains("sequence", F.lit("N"))).drop("_kept")


def joined_pairs(forward: DataFrame, backward: DataFrame, least: int = 6, worse: float = 0.08) -> DataFrame:
    """seq_id, sequence and overlap of pairs of reads (seq_id, sequence) whose ends overlap by `least` letters or more with a share of at most `worse` of unlike ones: the overlap with the fewest unlike letters for its length. Pairs that don't overlap are left out."""
    both = forward.select("seq_id", F.col("sequence").alias("a")).join(backward.select("seq_id", reverse_complement(F.col("sequence")).alias("b")), "seq_id")
    most = F.least(F.length("a"), F.length("b"))
    unlike = lambda k: F.size(F.filter(F.zip_with(F.split(F.substr("a", F.length("a") - k + 1, k), ""), F.split(F.substr("b", F.lit(1), k), ""), lambda x, y: x != y), lambda x: x))
    tried = F.transform(F.sequence(F.lit(least), most), lambda k: F.struct(((unlike(k) * unlike(k) + 1) / k).alias("cost"), (-k).alias("shorter"), k.alias("overlap"), unlike(k).alias("unlike")))
    best = F.array_min(F.filter(tried, lambda x: x["unlike"] <= worse * x["overlap"]))
    return both.where(most >= least).withColumn("best", best).where("best is not null").select("seq_id", F.concat("a", F.substr("b", F.col("best.overlap") + 1, F.length("b"))).alias("sequence"), F.col("best.overlap").alias("overlap"))
