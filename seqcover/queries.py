"""Queries of the clustering library over the given tables, and the same in SQL.

Sequences are the addresses of pages (short and alike), whole; centres are those whose id is divisible by 20, the stated
query set of searches. Cluster sizes are the lines of each part, the orders of each customer and the events of each user.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .functions.tables import kept, shared_folder
from .jobs import cluster as job
from .operators import bounds, compare, evaluate, greedy, records, recruit, simulate, summary
from .sources import clusters, fasta
from .streaming import recruit as streaming

S = 0.9


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _urls(spark, d):
    return _t(spark, d, "pages").select(F.col("page_id").alias("seq_id"), F.coalesce("url", F.lit("")).alias("sequence"), F.col("page_id").alias("ord"))


def _centres(spark, d):
    return _urls(spark, d).where("seq_id % 20 = 0")


def _edges(spark, d):
    return recruit.edges(_urls(spark, d).select("seq_id", "sequence"), _centres(spark, d), S)


def _recruited(spark, d):
    return recruit.recruited(_urls(spark, d).select("seq_id", "sequence"), _centres(spark, d), S)


def _host_counts(spark, d):
    """Multiplicities for pages: how many pages have the same scheme and host."""
    host = F.regexp_extract("sequence", "^[a-z]+://[^/]*", 0)
    pages = _urls(spark, d).withColumn("host", host)
    return pages.join(pages.groupBy("host").agg(F.count(F.lit(1)).alias("count")), "host").select("seq_id", "count")


def _part_sizes(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("size"))


def _customer_sizes(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.count(F.lit(1)).alias("density"))


def _user_sizes(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))


def _months(spark, d):
    return _t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("iteration")).agg(F.count(F.lit(1)).alias("n_seqs"), F.count(F.when(F.col("o_totalprice") >= 200000, 1)).alias("n_big"))


def dedup_counts(spark, d):
    r = _t(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.coalesce("text", F.lit("")).alias("sequence"), F.col("doc_id").alias("ord"))
    return records.deduplicated(r).select("seq_id", F.md5("sequence").alias("digest"), "count")


def strand_counts(spark, d):
    """Turns of conversations as letters, those of assistants read backwards: how often each occurs on either strand."""
    letters = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    t = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.concat_ws("-", "conv_id", "turn").alias("seq_id"), letters.alias("s"), "role")
    both = t.select("ord", "seq_id", F.when(F.col("role") == "assistant", scalars.reverse_complement(F.col("s"))).otherwise(F.col("s")).alias("sequence"))
    # each of the first turns once more, from its other strand
    again = both.where("ord % 1000 = 0").select(F.col("ord") + 500, F.concat("seq_id", F.lit("-again")), scalars.reverse_complement(F.col("sequence")))
    return records.deduplicated(both.union(again), canonical_strand=True).select("seq_id", F.md5("sequence").alias("digest"), "count")


def sample_md5(spark, d):
    return records.sampled(_t(spark, d, "documents").select(F.col("doc_id").alias("seq_id")), 0.25, 7)


def include_ids(spark, d):
    return records.included(_t(spark, d, "documents").select("doc_id", "source"), _t(spark, d, "labels"), "doc_id")


def exclude_ids(spark, d):
    return records.excluded(_t(spark, d, "documents").select("doc_id", "source"), _t(spark, d, "labels"), "doc_id")


def ambiguous_edges(spark, d):
    return _edges(spark, d).select("target", "centre")


def recruit_cost(spark, d):
    return recruit.edges(_urls(spark, d).select("seq_id", "sequence"), _centres(spark, d), S, cost=True).select("target", "centre", F.col("cost").cast("long").alias("cost"))


def recruit_first_center(spark, d):
    return _recruited(spark, d)


def nonambiguous_weights(spark, d):
    return recruit.nonambiguous_weights(_edges(spark, d))


def ambiguous_assigned(spark, d):
    return recruit.ambiguous_assigned(_edges(spark, d), 11)


def cluster_summary(spark, d):
    return summary.cluster_summary(_recruited(spark, d), _host_counts(spark, d))


def bait_centers(spark, d):
    return summary.bait_centres(cluster_summary(spark, d))


def mode_centers(spark, d):
    return summary.mode_centres(cluster_summary(spark, d))


def greedy_clusters(spark, d):
    return greedy.clustered(_urls(spark, d).select("seq_id", "sequence"), S)


def iteration_metrics(spark, d):
    return summary.iteration_metrics(_part_sizes(spark, d).withColumnRenamed("size", "density"), 35)


def iteration_metrics_by_status(spark, d):
    return summary.iteration_metrics(_customer_sizes(spark, d), 5, ["o_orderstatus"])


def size_histogram_norm(spark, d):
    return summary.histogram(_part_sizes(spark, d))


def size_threshold_table(spark, d):
    return summary.size_table(_customer_sizes(spark, d), "o_orderstatus")


def fragmentation_curve(spark, d):
    return evaluate.fragmentation(_user_sizes(spark, d))


def fragmentation_parts(spark, d):
    return evaluate.fragmentation(_part_sizes(spark, d), 25)


def cumulative_by_iteration(spark, d):
    return summary.running(_months(spark, d), "iteration", ["n_seqs", "n_big"])


def adapt_rate(spark, d):
    days = _t(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    rate = F.when(F.col("previous_n").isNull(), F.lit(0.1)).otherwise(scalars.adapted_rate(F.lit(0.1), F.col("n"), F.col("previous_n"), 0.008))
    return summary.with_previous(days, "day", "n").withColumn("rate", F.round(rate, 9))


def carried_frontier(spark, d):
    m = _months(spark, d).select("iteration", F.when(F.col("n_seqs") % 3 == 0, F.col("n_seqs")).alias("frontier"))
    return summary.carried(m, "iteration", "frontier")


def miss_probability(spark, d):
    total = _t(spark, d, "lineitem").count()
    p = scalars.miss_probability(F.col("size"), F.lit(0.02 * total), F.lit(float(total)))
    return summary.histogram(_part_sizes(spark, d)).select("size", F.round(p, 9).alias("miss"))


def expected_sizes(spark, d):
    h = summary.histogram(_user_sizes(spark, d))
    return bounds.expected_sizes(h, float(_t(spark, d, "events").count()), 0.05).select("size", "obs", "n", F.round("found", 9).alias("found"))


def freeze_exact(spark, d):
    h = summary.histogram(_user_sizes(spark, d))
    return bounds.frozen_sizes(h, float(_t(spark, d, "events").count()), 0.05, 0.9).select("size", "obs", "n", F.round("chance", 6).alias("chance"), "frozen")


def simulated_discovery(spark, d):
    h = summary.histogram(_user_sizes(spark, d))
    return bounds.simulated(h, float(_t(spark, d, "events").count()), 0.05, 50, 5)


def size_outer_compare(spark, d):
    parts = _t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.sum("p_size").cast("long").alias("part_sum"))
    sold = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).where("l_quantity >= 50").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n_sold"))
    return evaluate.outer_compared(parts, sold, "name", ["part_sum", "n_sold"])


def matched_abundance(spark, d):
    abundance = _t(spark, d, "customer").select(F.col("c_custkey").alias("other"), F.col("c_nationkey").cast("long").alias("count"))
    mapping = _t(spark, d, "orders").select(F.col("o_custkey").alias("other"), F.col("o_orderpriority").alias("centroid")).distinct()
    own = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("centroid"), F.col("o_orderkey").alias("seq_id"), (F.col("o_custkey") % 7).alias("count"))
    return compare.matched(abundance, mapping, own)


def pearson(spark, d):
    joined = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return evaluate.pearson(joined, "c_acctbal", "o_totalprice").select(F.round("r", 6).alias("r"), "n")


def spearman(spark, d):
    joined = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return evaluate.spearman(joined, "c_acctbal", "o_totalprice").select(F.round("r", 6).alias("r"), "n")


def entropy(spark, d):
    return summary.entropy(_t(spark, d, "events"), F.col("event_type")).select(F.round("entropy", 6).alias("entropy"))


def miss_curve(spark, d):
    h = _part_sizes(spark, d).select(F.col("size").alias("k")).distinct()
    total = _t(spark, d, "lineitem").count()
    grid = h.select("k", F.lit(total).cast("long").alias("total"), F.explode(F.array(*[F.lit(x) for x in (1, 2, 5, 10)])).alias("percent")).withColumn("drawn", F.floor(F.col("total") * F.col("percent") / 100))
    return simulate.miss_curve(grid).select("k", F.col("percent").cast("long").alias("percent"), F.round("miss", 7).alias("miss"))


def log_factorial(spark, d):
    """In how many orders each supplier's lines can stand, as a logarithm."""
    n = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("l_suppkey", "n", F.round(scalars.log_factorial(F.col("n")), 5).alias("ln_factorial"))


def kmer_spectrum(spark, d):
    return records.kmers(_t(spark, d, "benchmark").select(F.col("item_id").alias("seq_id"), F.coalesce("text", F.lit("")).alias("sequence")), 4)


def kmer_rollup(spark, d):
    return records.rolled_up(kmer_spectrum(spark, d), 2)


def kmer_excess(spark, d):
    return records.kmer_excess(_urls(spark, d), _centres(spark, d), 4)


def filter_length(spark, d):
    return records.filter_length(_t(spark, d, "benchmark").select(F.coalesce("text", F.lit("")).alias("sequence")))


def fasta_sort(spark, d):
    """The places of all page addresses, longest first."""
    return records.length_places(_urls(spark, d)).select("seq_id", F.length("sequence").cast("long").alias("n"), F.col("place").cast("long").alias("place"))


def fasta_shuffle(spark, d):
    return records.shuffled_places(_urls(spark, d), 3).select("seq_id", F.col("place").cast("long").alias("place"))


def _select(mode: str) -> Callable:
    def query(spark, d):
        return records.selected(_urls(spark, d).select("seq_id", "sequence"), _recruited(spark, d), mode)

    return query


def _turns(spark, d):
    t = _t(spark, d, "conversations")
    return t.select(F.col("conv_id").cast("string").alias("centroid"), F.concat_ws("-", "conv_id", "turn", "role").alias("seq_id"))


def members_to_lines(spark, d):
    return clusters.members_to_lines(_turns(spark, d))


def lines_to_members(spark, d):
    lines = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.coalesce("text", F.lit("")).alias("value"))
    return clusters.first_lines(clusters.lines_to_members(lines)).select("seq_id", "line_no", F.col("pos").cast("long").alias("pos"))


def line_sizes(spark, d):
    lines = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.coalesce("text", F.lit("")).alias("value"))
    return clusters.line_sizes(lines).withColumn("size", F.col("size").cast("long"))


def singleton_padding(spark, d):
    return summary.padded(_user_sizes(spark, d), 2 * _t(spark, d, "events").count())


def category_counts(spark, d):
    return summary.category_counts(_t(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["A", "R"])


def iteration_maximum(spark, d):
    return summary.maximum(_customer_sizes(spark, d), "o_orderstatus", "density")


def running_ids(spark, d):
    o = _t(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("iteration"), F.col("o_orderkey").alias("line_no"))
    return summary.running_ids(o).withColumn("cluster_id", F.col("cluster_id").cast("long"))


def one_iteration(spark, d):
    """One whole round of the job over the page addresses: members, by the sampled centres after the shift to modes."""
    reads = _urls(spark, d)
    return job.run(reads, job.Options(similarity=S, rate=0.3, iterations=1, least=2))[0]


def three_iterations(spark, d):
    rows = job.run(_urls(spark, d), job.Options(similarity=S, rate=0.3, iterations=3, least=2))[1]
    return rows.select("iteration", "rate", *job.METRICS, "largest_open_bound")


def stream_summary(spark, d):
    """Page addresses in four files as a stream of four batches that stops after the second and starts again: the summary that it keeps."""
    path, out = _folder(spark, "stream"), _folder(spark, "streamed")
    own = _urls(spark, d).join(_host_counts(spark, d), "seq_id").withColumn("part", F.pmod("seq_id", F.lit(4)).cast("int"))
    centres = kept(_centres(spark, d), "centres")
    for last in (2, 4):
        own.where(F.col("part").between(last - 2, last - 1)).select("seq_id", "sequence", "count", "part").repartition(2, "part").write.mode("append").parquet(path)
        stream = spark.readStream.schema("seq_id long, sequence string, count long").option("maxFilesPerTrigger", 1).parquet(path)
        streaming.recruit_stream(stream, centres, S, out, f"{out}-checkpoint").awaitTermination()
    return streaming.summary(spark, out)


def cluster_summary_compat(spark, d):
    """Summaries with the density that files of earlier runs give."""
    return summary.with_compat(cluster_summary(spark, d))


def frontier_by_quarter(spark, d):
    """Events of each quarter of a day as an iteration, their users as clusters: which sizes are frozen after each, the mass that is left and the bound."""
    e = _t(spark, d, "events").groupBy(F.floor(F.hour("ts") / 6).cast("int").alias("iteration"), "user_id").agg(F.count(F.lit(1)).alias("size"))
    histograms = kept(e.groupBy("iteration", "size").agg(F.count(F.lit(1)).alias("n")), "histograms")
    return bounds.frontier_rows(histograms, [0, 1, 2, 3], float(_t(spark, d, "events").count()), 0.05, 0.9)


def missed_clusters(spark, d):
    """The chance that all of m clusters of a part's size are missed, for sizes, m and shares of lines that are drawn."""
    total = _t(spark, d, "lineitem").count()
    grid = _part_sizes(spark, d).select(F.col("size").alias("k")).distinct().select("k", F.lit(total).cast("long").alias("total"), F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 2, 5, 20)])).alias("m"))
    grid = grid.select("k", "total", "m", F.explode(F.array(*[F.lit(x) for x in (1, 2, 5, 10)])).alias("percent")).withColumn("drawn", F.floor(F.col("total") * F.col("percent") / 100))
    compat = simulate.missed_clusters(grid, compat=True).withColumnRenamed("missed", "compat")
    return simulate.missed_clusters(compat).select("k", "m", F.col("percent").cast("long").alias("percent"), F.round("missed", 6).alias("missed"), F.round("compat", 6).alias("compat"))


def recruit_sweep(spark, d):
    """How many addresses are recruited, and to how many centres, at five similarities: one join at the lowest answers all."""
    return recruit.swept(_urls(spark, d).select("seq_id", "sequence"), _centres(spark, d), [0.86, 0.88, 0.9, 0.92, 0.94])


def two_line_records(spark, d):
    """Page addresses written as records of two lines each and read back by the strict reader."""
    path = _folder(spark, "pairs")
    u = _urls(spark, d).where("sequence <> ''")
    u.select(F.concat(F.lit(">"), F.col("seq_id"), F.lit(" > x\n"), F.col("sequence")).alias("value")).write.text(path)
    return fasta.read_pairs(spark, path).select("header", "sequence")


def naive_rounds(spark, d):
    return simulate.discovery_rounds(_user_sizes(spark, d).withColumnRenamed("user_id", "cluster"), 0.05, 4, 3)


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def equal_length_clusters(spark, d):
    """Reads of one length and four letters: 28 that all addresses of a site have, and three of their own."""
    letters = lambda c, n: F.substring(F.md5(c), 1, n)
    made = F.concat(letters(F.regexp_extract("sequence", "^[a-z]+://[^/]*", 0), 28), letters(F.col("sequence"), 3))
    return greedy.clustered(_urls(spark, d).select("seq_id", F.translate(made, "0123456789abcdef", "ACGTACGTACGTACGT").alias("sequence")), S)


def apart_clusters(spark, d):
    return greedy.apart_clustered(_urls(spark, d).select("seq_id", "sequence"), S)


def recruit_substring(spark, d):
    """The inner parts of all benchmark texts, by their best substring in the texts whose id is divisible by 20."""
    texts = _t(spark, d, "benchmark").select(F.col("item_id").alias("seq_id"), F.coalesce("text", F.lit("")).alias("sequence"))
    # without its ends, a target never stands where the centre begins
    targets = texts.select("seq_id", F.substr("sequence", F.lit(11), F.length("sequence") - 20).alias("sequence"))
    centres = texts.where("seq_id % 20 = 0").withColumn("ord", F.col("seq_id"))
    return recruit.edges(targets, centres, 0.97, anywhere=True, cost=True).select("target", "centre", F.col("cost").cast("long").alias("cost"))


def letters_recruit(spark, d):
    """Whole turns of conversations as sequences of four letters, recruited to those whose number is divisible by 20."""
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    made = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq_id"), F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("sequence"))
    made = kept(made.withColumn("ord", F.col("seq_id")), "letters")
    return recruit.recruited(made.select("seq_id", "sequence"), made.where("seq_id % 20 = 0"), 0.95)


def fasta_round_trip(spark, d):
    """Page addresses written as FASTA and read back."""
    path = _folder(spark, "fasta")
    fasta.write_fasta(_urls(spark, d).select(F.concat_ws(" ", F.concat(F.lit("p"), "seq_id"), F.lit("of > pages")).alias("header"), "sequence", "ord"), path)
    return fasta.read_fasta(spark, path).select("seq_id", "header", "sequence", F.col("length").cast("long").alias("length"))


def _reads(spark, d):
    """Addresses with qualities from their MD5, written as FASTQ and read back."""
    path, u = _folder(spark, "fastq"), _urls(spark, d)
    quality = F.substr(F.repeat(F.md5("sequence"), 8), F.lit(1), F.length("sequence"))
    u.select(fasta.fastq_text(F.col("seq_id").cast("string"), F.col("sequence"), quality).alias("value")).write.text(path)
    return fasta.read_fastq(spark, path)


def fastq_quality_cut(spark, d):
    return fasta.quality_cut(_reads(spark, d), worst=20, run=3, share=0.25).select("header", "sequence", "quality")


def fastq_sample_counts(spark, d):
    """Reads of each host, which stands for a sample."""
    host = F.regexp_extract("sequence", "^[a-z]+://[^/]*", 0)
    return _reads(spark, d).groupBy(host.alias("sample")).agg(F.count(F.lit(1)).alias("n_reads"))


def joined_reads(spark, d):
    """Benchmark texts as letters, read from both ends with an overlap of ten, and joined again."""
    letters = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    whole = _t(spark, d, "benchmark").select(F.col("item_id").alias("seq_id"), letters.alias("s"))
    half = F.floor(F.length("s") / 2).cast("int")
    forward = whole.select("seq_id", F.substr("s", F.lit(1), half + 5).alias("sequence"))
    backward = whole.select("seq_id", scalars.reverse_complement(F.substr("s", half - 4, F.length("s"))).alias("sequence"))
    return fasta.joined_pairs(forward, backward, least=10, worse=0.0).select("seq_id", "sequence", F.col("overlap").cast("long").alias("overlap"))


def cluster_lines_round_trip(spark, d):
    """Turns as clusters, written as lines in two parts, read back and merged."""
    path, turns = _folder(spark, "lines"), _turns(spark, d)
    clusters.write_lines(turns.repartition(2), path)
    return clusters.merged_parts(clusters.lines_to_members(clusters.read_lines(spark, path)))


def pair_file(spark, d):
    path = _folder(spark, "pairs")
    clusters.write_edges(_edges(spark, d), path)
    return spark.read.option("sep", "\t").schema("target long, centre long").csv(path)


def duplicate_report(spark, d):
    """Sources as sequences: the report of repeated ones, written and read back."""
    path = _folder(spark, "report")
    r = _t(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.coalesce("source", F.lit("")).alias("sequence"), F.col("doc_id").alias("ord"))
    clusters.duplicate_lines(r).write.text(path)
    return clusters.read_duplicates(spark, path).select(F.col("seq_id").cast("long").alias("seq_id"), "count")


def counts_literal(spark, d):
    path = _folder(spark, "counts")
    clusters.write_counts_literal(_part_sizes(spark, d).select(F.concat(F.lit("part '"), "l_partkey", F.lit("'")).alias("seq_id"), F.col("size").alias("count")), path)
    return clusters.read_counts_literal(spark, path)


def id_list(spark, d):
    path = _folder(spark, "ids")
    clusters.write_ids(_t(spark, d, "labels").select(F.col("doc_id").alias("seq_id")), path)
    return records.included(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("seq_id"), "source"), clusters.read_ids(spark, path))


def summary_file(spark, d):
    path = _folder(spark, "summary")
    own = cluster_summary(spark, d).select(F.lit(1).alias("iteration"), F.col("centroid").alias("cluster_id"), F.col("centroid").cast("string").alias("centroid"), "density", "mode", F.col("mode_seq").cast("string").alias("mode_seq"))
    clusters.write_summary(own, path)
    return clusters.read_summary(spark, path)


def run_folder(spark, d):
    """Customers of each order status as a run of three iterations, written to folders and read back with running numbers."""
    path = _folder(spark, "run")
    own = _customer_sizes(spark, d)
    for k, status in enumerate(("F", "O", "P")):
        some = own.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("cluster_id"), F.col("o_custkey").cast("string").alias("centroid"), "density", F.lit(1).cast("long").alias("mode"), F.col("o_custkey").cast("string").alias("mode_seq"))
        clusters.write_summary(some, f"{path}/Iteration_{k}")
    return summary.running_ids(clusters.read_run(spark, path).select("iteration", F.col("cluster_id").alias("line_no"), "density")).select("iteration", "line_no", "density", F.col("cluster_id").cast("long").alias("cluster_id"))


def result_bundle(spark, d):
    path = _folder(spark, "bundle")
    clusters.write_bundle(_customer_sizes(spark, d), path, ["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderstatus", "o_custkey", "density")


def other_tools(spark, d):
    """Members of each supplier's parts in the files of three other tools, read back: how many clusters and members each has."""
    own = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    a, b, c = (_folder(spark, x) for x in ("cdhit", "uclust", "meshclust"))
    own.select(F.concat(F.lit(">Cluster "), "cluster", F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), "size"), lambda k: F.concat(k, F.lit("\t>x"))), "\n")).alias("value")).write.text(a)
    own.select("cluster", "size").write.option("sep", ";").csv(b)
    _t(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_discount", "l_returnflag").write.option("sep", "\t").csv(c)
    mesh = summary.category_counts(clusters.meshclust_rows(spark, c), "cluster", "category", ["A", "R"]).withColumnRenamed("n", "size")
    found = {"cdhit": clusters.cdhit_sizes(spark, a), "uclust": clusters.uclust_sizes(spark, b), "meshclust": mesh}
    rows = [x.agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("size").alias("n_members")).select(F.lit(name).alias("tool"), "*") for name, x in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def abundance_files(spark, d):
    """Abundances by name beside the centroid of that name, and those of one side alone."""
    path = _folder(spark, "abundances")
    _t(spark, d, "part").groupBy(F.col("p_name").alias("sequence")).agg(F.count(F.lit(1)).alias("count")).write.option("sep", ";").option("header", True).csv(path)
    centroids = _t(spark, d, "part").where("p_size > 25").groupBy(F.col("p_name").alias("sequence")).agg(F.min("p_partkey").alias("centroid"))
    return compare.abundance_with_centroid(clusters.abundances(spark, path), centroids)


def one_sided_sizes(spark, d):
    return evaluate.one_sided(size_outer_compare(spark, d), "n_sold").select("name", "part_sum", scalars.log_safe(F.col("n_sold")).cast("long").alias("n_sold"))


def centre_maps(spark, d):
    lines = clusters.members_to_lines(_turns(spark, d)).select(F.monotonically_increasing_id().alias("line_no"), "value")
    return clusters.centre_map(lines, turned=True)


def correlation_p(spark, d):
    joined = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return evaluate.with_p(evaluate.pearson(joined, "c_acctbal", "o_totalprice")).select(F.round("t", 5).alias("t"), F.round("p", 6).alias("p"), "n")


def _timed_rows(spark, d):
    return clusters.timed(_months(spark, d).select("iteration", F.concat(F.lit(" "), F.col("n_big").cast("string"), F.lit(".5 minutes ")).alias("minutes")), ["minutes"])


def summary_with_stats(spark, d):
    """A row for each month, its minutes as text, beside its customers as clusters."""
    own = _t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("iteration"), "o_custkey").agg(F.count(F.lit(1)).alias("density"))
    return summary.with_cluster_stats(_timed_rows(spark, d), own)


def clusters_over_time(spark, d):
    own = _t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("iteration"), "o_custkey").agg(F.count(F.lit(1)).alias("density"))
    return summary.clusters_over_time(own, _timed_rows(spark, d), "minutes")


def total_time(spark, d):
    return summary.total_time(_timed_rows(spark, d).withColumn("year", F.substring("iteration", 1, 4)), "minutes", ["year"])


def log_choices(spark, d):
    """Ways to choose the large orders of a month among all."""
    m = _months(spark, d).select("iteration", F.col("n_seqs").alias("n"), F.col("n_big").alias("k"))
    return m.withColumn("ln_choices", F.round(scalars.log_choose(F.col("n"), F.col("k")), 5))


def singleton_split(spark, d):
    """Clusters of one member, and of more, in each order status."""
    own = _customer_sizes(spark, d)
    count = lambda alone, name: summary.singletons(own, alone).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias(name))
    return count(True, "n_alone").join(count(False, "n_shared"), "o_orderstatus", "full_outer").na.fill(0)


def counted_records(spark, d):
    """Multiplicities of documents from the report of repeated sources, one where it says nothing; as shares."""
    report = duplicate_report(spark, d)
    own = records.with_counts(_t(spark, d, "documents").select(F.col("doc_id").alias("seq_id")), report)
    return own.select("seq_id", F.col("count").cast("long").alias("count"), F.round(scalars.percent(F.lit(1), F.col("count")), 6).alias("share"))


def option_rows(spark, d):
    """Options of a run over this many pages, as text and back."""
    n = _t(spark, d, "pages").count()
    rows = clusters.options_table(spark, {"pages": n, "adaptive": True, "mode_shift": " FALSE "})
    return rows.select("option", F.when(F.col("option") == "pages", F.lit(True)).otherwise(scalars.truth(F.when(F.col("option") == "pages", F.lit("true")).otherwise(F.col("value")))).alias("is_true"), F.when(F.col("option") == "pages", F.col("value")).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dedup_counts, strand_counts, sample_md5, include_ids, exclude_ids, ambiguous_edges, recruit_cost, recruit_first_center, nonambiguous_weights, ambiguous_assigned, cluster_summary, bait_centers, mode_centers, greedy_clusters, iteration_metrics,
        iteration_metrics_by_status, size_histogram_norm, size_threshold_table, fragmentation_curve, fragmentation_parts, cumulative_by_iteration, adapt_rate, carried_frontier, miss_probability, expected_sizes, freeze_exact, simulated_discovery,
        size_outer_compare, matched_abundance, pearson, spearman, entropy, miss_curve, log_factorial, kmer_spectrum, kmer_rollup, kmer_excess, filter_length, fasta_sort, members_to_lines, lines_to_members, line_sizes, singleton_padding,
        category_counts, iteration_maximum, running_ids, one_iteration, three_iterations, naive_rounds, fasta_shuffle, apart_clusters, equal_length_clusters, recruit_substring, letters_recruit, fasta_round_trip, fastq_quality_cut, fastq_sample_counts, joined_reads,
        cluster_lines_round_trip, pair_file, duplicate_report, counts_literal, id_list, summary_file, run_folder, result_bundle, other_tools, abundance_files, one_sided_sizes, centre_maps, correlation_p, summary_with_stats, clusters_over_time,
        total_time, log_choices, singleton_split, counted_records, option_rows, stream_summary, cluster_summary_compat, frontier_by_quarter, missed_clusters, recruit_sweep, two_line_records,
    )
} | {f"select_{mode}": _select(mode) for mode in ("centres", "rest", "members")}

from .oracle import ORACLE_SQL  # noqa: E402,F401
