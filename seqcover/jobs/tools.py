"""Single steps over files: clustering, recruiting, sorting and selecting.

python -m seqcover.jobs.tools cluster reads.fasta out [--similarity 0.99] [--mismatches n] [--no-overlap]
python -m seqcover.jobs.tools recruit reads.fasta centres.fasta out [--anywhere] [--ambiguous SEED] [--pairs]
python -m seqcover.jobs.tools sort reads.fasta out [--shuffle SEED]
python -m seqcover.jobs.tools select reads.fasta clusters.txt out --mode centres|rest|members
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import greedy, records, recruit
from ..sources import clusters, fasta


def _written(found: DataFrame, out: str) -> None:
    """Records in order of place, in as many parts as they come in."""
    fasta.write_fasta(found.withColumn("ord", F.col("place")).repartitionByRange("ord"), out)


def cluster(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = fasta.read_fasta(spark, a.reads).select("seq_id", "sequence")
    found = greedy.apart_clustered(reads, a.similarity) if a.no_overlap else greedy.clustered(reads, a.similarity, a.mismatches)
    clusters.write_lines(found, a.out)


def recruited(spark: SparkSession, a: argparse.Namespace) -> None:
    reads, centres = fasta.read_fasta(spark, a.reads).select("seq_id", "sequence"), fasta.read_fasta(spark, a.centres).select("seq_id", "sequence", "ord")
    pairs = recruit.edges(reads, centres, a.similarity, a.mismatches, anywhere=a.anywhere)
    if a.pairs:
        clusters.write_edges(pairs, a.out)
    elif a.ambiguous is not None:
        clusters.write_lines(recruit.ambiguous_assigned(pairs, a.ambiguous), a.out)
    else:
        clusters.write_lines(pairs.groupBy(F.col("target").alias("seq_id")).agg(F.min_by("centre", "ord").alias("centroid")), a.out)


def sort(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = fasta.read_fasta(spark, a.reads)
    _written(records.length_places(reads) if a.shuffle is None else records.shuffled_places(reads, a.shuffle), a.out)


def select(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = fasta.read_fasta(spark, a.reads)
    members = clusters.first_lines(clusters.lines_to_members(clusters.read_lines(spark, a.clusters))).select("centroid", "seq_id")
    fasta.write_fasta(records.selected(reads, members, a.mode), a.out, by="centroid" if a.mode == "members" else None)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    steps = p.add_subparsers(required=True)
    for step, files in ((cluster, ["reads", "out"]), (recruited, ["reads", "centres", "out"]), (sort, ["reads", "out"]), (select, ["reads", "clusters", "out"])):
        own = steps.add_parser({recruited: "recruit"}.get(step, step.__name__))
        own.set_defaults(step=step)
        for name in files:
            own.add_argument(name)
        if step in (cluster, recruited):
            own.add_argument("--similarity", type=float, default=0.99)
            own.add_argument("--mismatches", type=int)
        if step is cluster:
            own.add_argument("--no-overlap", action="store_true")
        if step is recruited:
            own.add_argument("--anywhere", action="store_true")
            own.add_argument("--ambiguous", type=int)
            own.add_argument("--pairs", action="store_true")
        if step is sort:
            own.add_argument("--shuffle", type=int)
        if step is select:
            own.add_argument("--mode", choices=["centres", "rest", "members"], default="centres")
    a = p.parse_args(argv)
    a.step(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
