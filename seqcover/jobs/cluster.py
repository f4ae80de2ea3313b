"""The iterative clustering job: sample, cluster, recruit, shift to modes, subtract, and adapt the rate.

python -m seqcover.jobs.cluster reads.fasta out [options]
"""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import forget, kept
from ..operators import bounds, greedy, records, recruit, summary


@dataclass(frozen=True)
class Options:
    similarity: float = 0.99
    rate: float = 0.001
    adaptive: bool = True
    delta: float = 0.008
    iterations: int = 50
    least: int = 50
    mode_shift: bool = True
    confidence: float = 0.9
    seed: int = 0
    stop_when_done: bool = False


def iteration(left: DataFrame, counts: DataFrame, options: Options, rate: float, number: int) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """The members (centroid, seq_id) of one round, its cluster summary, what is left of the records, and figures of its steps by name.

    Density counts distinct members, the centroid included; a centre that an earlier centre takes has no line of its own.
    """
    figures, began = {}, time.time()

    def took(step: str) -> None:
        nonlocal began
        figures[f"minutes_{step}"], began = (time.time() - began) / 60, time.time()

    some = kept(records.sampled(left, rate, f"{options.seed}-{number}"), "sample")
    found = kept(summary.cluster_summary(greedy.clustered(some, options.similarity), counts), "found")
    figures["n_cluster_singletons"] = summary.singletons(found).count()
    took("cluster")
    order = left.select("seq_id", "ord")
    baited = recruit_to(left, summary.bait_centres(found), order, options.similarity)
    totals = kept(summary.cluster_summary(baited, counts), "summary")
    figures |= metrics_of(totals, options.least, "bait")
    took("bait")
    if options.mode_shift:
        centres = kept(summary.mode_centres(totals), "centres")
        if not centres.isEmpty():
            forget(baited, totals)
            baited = recruit_to(left, centres, order, options.similarity)
            totals = kept(summary.cluster_summary(baited, counts), "summary")
            figures |= metrics_of(totals, options.least, "shift")
        forget(centres)
    took("shift")
    members = baited
    forget(some, found)
    return members, totals, kept(records.excluded(left, members.select("seq_id").distinct()), "left"), figures


#: Figures of the clusters of a step, as iteration_metrics() names them.
METRICS = ("n_clusters", "n_clustered", "densest", "mean_size", "median_size", "n_above_least", "n_singletons")


def metrics_of(totals: DataFrame, least: int, step: str) -> dict:
    row = summary.iteration_metrics(totals, least).first()
    return {f"{name}_{step}": row[name] for name in METRICS}


def recruit_to(left: DataFrame, ids: DataFrame, order: DataFrame, similarity: float) -> DataFrame:
    centres = records.included(left, ids).select("seq_id", "sequence").join(order, "seq_id")
    return kept(recruit.recruited(left.select("seq_id", "sequence"), centres, similarity), "members")


def next_rate(rate: float, current: float, previous: float, delta: float) -> float:
    return min(1.0, rate + (1 - current / previous) * delta) if previous and current < previous else rate


def run(reads: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Members (iteration, centroid, seq_id) and one summary row for each iteration, from records (seq_id, sequence, ord)."""
    spark = reads.sparkSession
    unique = kept(records.deduplicated(reads), "unique")
    counts, left = unique.select("seq_id", "count"), unique.select("seq_id", "sequence", "ord")
    total = float(left.count())
    frontier, rate, sizes, rows, members = bounds.frontier_start(spark, total), options.rate, [], [], None
    for number in range(1, options.iterations + 1):
        if options.adaptive and len(sizes) >= 2:
            rate = next_rate(rate, sizes[-1], sizes[-2], options.delta)
        began = time.time()
        own, totals, after, figures = iteration(left, counts, options, rate, number)
        figures["minutes"] = (time.time() - began) / 60
        members = own.select(F.lit(number).alias("iteration"), "*") if members is None else members.unionByName(own.select(F.lit(number).alias("iteration"), "*"))
        last = "shift" if "n_clusters_shift" in figures else "bait"
        figures |= {name: figures[f"{name}_{last}"] for name in METRICS}
        sizes.append(figures["n_clustered"])
        before, frontier = frontier, bounds.frontier_step(frontier, summary.histogram(totals, "density").select("size", "n"), rate, options.confidence)
        figures["largest_open_bound"] = frontier.first().bound
        forget(before, totals, *([left] if number > 1 else []))
        rows.append((number, rate, *(figures.get(c) for c in FIGURES)))
        left = after
        if options.stop_when_done and left.isEmpty():
            break
    columns = "iteration int, rate double, " + ", ".join(f"{c} {'double' if c.startswith(('mean', 'median', 'minutes')) else 'long'}" for c in FIGURES)
    return members if members is not None else spark.createDataFrame([], "iteration int, centroid string, seq_id string"), spark.createDataFrame(rows, columns)


#: The columns of a run's summary beside iteration and rate: those of the last step, of each step, and times.
FIGURES = [*METRICS, "largest_open_bound", *(f"{name}_{step}" for step in ("bait", "shift") for name in METRICS), "n_cluster_singletons", "minutes_cluster", "minutes_bait", "minutes_shift", "minutes"]


def sweep(reads: DataFrame, options: Options, deltas: list[float] | None = None) -> DataFrame:
    """Summary rows of the four variants (adaptive or not, mode shift or not) and of each delta."""
    out = None
    variants = [(f"adaptive={a} shift={m}", replace(options, adaptive=a, mode_shift=m)) for a in (True, False) for m in (True, False)]
    for name, own in variants + [(f"delta={d}", replace(options, delta=d)) for d in deltas or []]:
        rows = run(reads, own)[1].withColumn("variant", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def main(argv: list[str] | None = None) -> None:
    from ..sources import clusters, fasta

    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("reads")
    p.add_argument("out")
    for name, kind in (("similarity", float), ("rate", float), ("delta", float), ("iterations", int), ("least", int), ("confidence", float), ("seed", int)):
        p.add_argument(f"--{name}", type=kind, default=getattr(Options, name))
    p.add_argument("--no-adaptive", action="store_true")
    p.add_argument("--no-mode-shift", action="store_true")
    p.add_argument("--stop-when-done", action="store_true")
    p.add_argument("--sweep", type=float, nargs="*", metavar="DELTA", help="summaries only, of the four variants and of each of these deltas")
    a = p.parse_args(argv)
    options = Options(a.similarity, a.rate, not a.no_adaptive, a.delta, a.iterations, a.least, not a.no_mode_shift, a.confidence, a.seed, a.stop_when_done)
    spark = SparkSession.builder.getOrCreate()
    if a.sweep is not None:
        clusters.write_bundle(sweep(fasta.read_fasta(spark, a.reads), options, a.sweep), f"{a.out}/sweep", ["variant"])
        return
    members, rows = run(fasta.read_fasta(spark, a.reads), options)
    clusters.write_bundle(members, f"{a.out}/members", ["iteration"])
    clusters.write_summary(rows, f"{a.out}/summary")
    clusters.write_summary(clusters.options_table(spark, vars(options)), f"{a.out}/options")


if __name__ == "__main__":
    main()
