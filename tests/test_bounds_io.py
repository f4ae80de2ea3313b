import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from seqcover.functions import scalars
from seqcover.jobs import cluster
from seqcover.operators import bounds, simulate, summary
from seqcover.sources import clusters, fasta
from seqcover.streaming.recruit import members as members_of
from seqcover.streaming.recruit import recruit_stream
from seqcover.streaming.recruit import summary as summary_of


def test_tails_equal_sums(spark):
    rows = [(k, n, p, obs) for k, (n, p, obs) in enumerate((n, p, obs) for n, p in ((10, 0.3), (200, 0.02), (50, 0.9), (7, 0.0), (7, 1.0), (3000, 0.5)) for obs in (0, 1, n // 3, n // 2, n - 1, n, n + 1))]
    got = {r.k: r.chance for r in bounds.upper_tails(spark.createDataFrame(rows, "k long, n long, found double, obs long"), ["k"]).collect()}
    for k, n, p, obs in rows:
        want = sum(Fraction(math.comb(n, j)) * Fraction(p) ** j * (1 - Fraction(p)) ** (n - j) for j in range(obs, n + 1)) if n < 300 else None
        if want is not None:
            assert abs(got[k] - float(want)) < 1e-9, (n, p, obs)
    assert abs(got[len(rows) - 4] - 0.5073) < 1e-3  # P(X >= 1500) of 3,000 tosses
    large = spark.createDataFrame([(1, 10**9, 1e-3, 10**6)], "k long, n long, found double, obs long")
    assert abs(bounds.upper_tails(large, ["k"]).first().chance - 0.5) < 1e-3


def test_factorials(spark):
    numbers = [*range(40), 170, 1000, 10**6]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select(scalars.log_factorial(F.col("n")).alias("x"), scalars.log_choose(F.col("n"), F.lit(5)).alias("c")).collect()
    for n, r in zip(numbers, got, strict=True):
        assert math.isclose(r.x, math.lgamma(n + 1), rel_tol=1e-13, abs_tol=1e-9)
        assert (r.c is None) == (n < 5) and (r.c is None or math.isclose(r.c, math.log(math.comb(n, 5)), rel_tol=1e-9, abs_tol=1e-6))


def test_missed_clusters_equal_exact_chances(spark):
    grid = [(30, 6, k, m) for k in (2, 3, 5) for m in (1, 2, 4)] + [(30, 6, 8, 4)]
    df = spark.createDataFrame(grid, "total long, drawn long, k long, m long")
    for compat in (False, True):
        for r in simulate.missed_clusters(df, compat).collect():
            if r.k * r.m > r.total:
                assert r.missed is None
                continue
            want = sum(Fraction(math.comb(r.m, i) * (r.k if compat and i else r.k**i) * math.comb(r.total - r.k * r.m, r.drawn - i), math.comb(r.total, r.drawn)) for i in range(min(r.m, r.drawn) + 1))
            assert abs(r.missed - float(want)) < 1e-9


def test_frontier_gives_mass_back(spark, monkeypatch):
    # sizes in FROZEN count as found
    monkeypatch.setattr(bounds, "frozen_sizes", lambda h, *_: bounds.expected_sizes(h, 1000.0, 0.1).withColumn("chance", F.lit(0.0)).withColumn("frozen", F.col("size").isin(frozen)))
    histogram = lambda sizes: spark.createDataFrame(list(sizes.items()), "size long, n long")
    frozen = [50, 60, 1]
    state = bounds.frontier_step(bounds.frontier_start(spark, 1000.0), histogram({1: 100, 5: 10, 50: 2, 60: 1}), 0.1, 0.9)
    assert {(r.mass, r.bound) for r in state.collect()} == {(840.0, 50)} and {r["size"] for r in state.where("upper").collect()} == {50, 60}
    frozen = [2]
    state = bounds.frontier_step(state, histogram({5: 1, 2: 7}), 0.1, 0.9)
    assert {(r.mass, r.bound) for r in state.collect()} == {(840.0, 50)} and {r["size"]: r.n for r in state.where("not frozen").collect()} == {5: 11}
    frozen = [5]
    state = bounds.frontier_step(state, spark.createDataFrame([], "size long, n long"), 0.1, 0.9)
    assert {(r.mass, r.bound) for r in state.collect()} == {(785.0, 5)}
    state = bounds.frontier_step(state, spark.createDataFrame([], "size long, n long"), 0.1, 0.9)
    assert [tuple(r) for r in state.collect()] == [(None, None, False, False, 785.0, 5)]


def test_simulation_meets_binomial(spark):
    h = spark.createDataFrame([(4, 30, 1.0)], "size long, n long, share double")
    e = bounds.expected_sizes(h, 120.0, 0.3).first()
    mean = sum(r.k * r.share for r in bounds.simulated(h, 120.0, 0.3, 400, 1).collect())
    assert abs(mean - e.n * e.found) < 4 * math.sqrt(e.n * e.found * (1 - e.found) / 400)


def test_drawn_sizes_reach_the_mass(spark):
    for kind, p in (("geometric", {"p": 0.05}), ("normal", {"mean": 30, "sd": 10}), ("uniform", {"low": 2, "high": 60})):
        sizes = [r.size for r in simulate.drawn_sizes(spark, kind, 3000, 0.2, 5, **p).collect()]
        assert sum(sizes) >= 3000 and all(s == 1 or s > 2 for s in sizes)


def test_discovery_rounds_keep_the_mass(spark):
    table = spark.createDataFrame([(k, 1 + k % 40) for k in range(60)], "cluster long, size long")
    rows = simulate.discovery_rounds(table, 0.1, 3, 2).orderBy("iteration").collect()
    left = sum(1 + k % 40 for k in range(60))
    for r in rows:
        assert r.n_clustered + r.n_left == left
        left = r.n_left


def test_fasta_round_trip(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_text(">x first > one\nACGT\n  AC \n\n>y\r\nGG\r\nTT\r\n>z\n")
    got = [(r.seq_id, r.header, r.sequence) for r in fasta.read_fasta(spark, str(path)).orderBy("ord").collect()]
    assert got == [("x", "x first > one", "ACGTAC"), ("y", "y", "GGTT"), ("z", "z", "")]
    assert fasta.count_records(spark, str(path)) == 3
    long = spark.createDataFrame([("h", "A" * 130, 0)], "header string, sequence string, ord long")
    fasta.write_fasta(long, str(tmp_path / "out"))
    assert fasta.read_fasta(spark, str(tmp_path / "out")).first().sequence == "A" * 130
    assert max(map(len, "".join(p.read_text() for p in (tmp_path / "out").glob("part*")).split("\n"))) == 60
    (tmp_path / "q.fastq").write_text("@r1\nAC\n+\nII\n@r2\nGG\n+\n!!\n")
    assert [(r.header, r.sequence, r.quality) for r in fasta.read_fastq(spark, str(tmp_path / "q.fastq")).collect()] == [("r1", "AC", "II"), ("r2", "GG", "!!")]


def test_cluster_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("a\tb c\t\nd\n\nb a\n")
    lines = clusters.read_lines(spark, str(tmp_path / "c.txt"))
    assert sorted((r.seq_id, r.centroid) for r in clusters.first_lines(clusters.lines_to_members(lines)).collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    assert sorted(r.size for r in clusters.line_sizes(lines).collect()) == [2, 3]
    (tmp_path / "x.clstr").write_text(">Cluster 0\n0 a\n1 b\n>Cluster 1\n0 c\n")
    assert sorted((r.cluster, r.size) for r in clusters.cdhit_sizes(spark, str(tmp_path / "x.clstr")).collect()) == [("Cluster 0", 2), ("Cluster 1", 1)]
    (tmp_path / "d.txt").write_text("3\ta, b, c\n")
    assert [tuple(r) for r in clusters.read_duplicates(spark, str(tmp_path / "d.txt")).collect()] == [("a", 3)]
    (tmp_path / "d.dict").write_text("{'a': {'Counts': '3'}}")
    assert [tuple(r) for r in clusters.read_counts_literal(spark, str(tmp_path / "d.dict")).collect()] == [("a", 3)]


def test_job_and_stream(spark, tmp_path):
    reads = spark.createDataFrame([(str(k), "ACGTTGCA" * 5 + "ACGT"[k % 4] * (k % 3), k) for k in range(40)], "seq_id string, sequence string, ord long")
    members, rows = cluster.run(reads, cluster.Options(similarity=0.9, rate=0.5, iterations=2, least=2))
    kept = rows.collect()
    assert set(cluster.FIGURES) <= set(kept[0].asDict()) and all(r.minutes > 0 and r.minutes_cluster > 0 and r.n_clustered == (r.n_clustered_bait if r.n_clusters_shift is None else r.n_clustered_shift) for r in kept)
    assert rows.count() == 2 and members.count() == members.select("seq_id").distinct().count() > 0
    assert summary.cluster_summary(members).agg({"density": "sum"}).first()[0] == members.count()
    reads.select("seq_id", "sequence").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id string, sequence string").parquet(str(tmp_path / "in"))
    recruit_stream(stream, reads.where("ord < 3"), 0.9, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert members_of(spark, str(tmp_path / "out")).count() == 40 and summary_of(spark, str(tmp_path / "out")).agg({"density": "sum"}).first()[0] == 40


def test_stream_that_fails_and_starts_again_keeps_the_batch_summary(spark, tmp_path):
    """Four files, one a batch; the second batch fails after it has written its members, and the stream starts again."""
    from seqcover.operators import recruit
    from seqcover.streaming import recruit as streaming

    base = ["ACGTTGCAACGGTCATTGCA", "TTGGCCAATTGGCCAATTGG", "CATCATCATCATCATCATCA"]
    rows = [(str(k), base[k % 3][:-1] + "ACGT"[k % 4], 1 + k % 5) for k in range(48)]
    reads = spark.createDataFrame(rows, "seq_id string, sequence string, count long")
    centres = spark.createDataFrame([(str(k), base[k], k) for k in range(3)], "seq_id string, sequence string, ord long")
    for k in range(4):
        reads.where(f"cast(seq_id as int) % 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, calls, merged = str(tmp_path / "out"), [], streaming.merged

    def failing(before, members):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return merged(before, members)

    start = lambda: streaming.recruit_stream(spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), centres, 0.9, out, str(tmp_path / "state"))
    streaming.merged = failing
    try:
        with pytest.raises(Exception, match="lost"):
            start().awaitTermination()
        start().awaitTermination()
    finally:
        streaming.merged = merged
    assert len(calls) == 5
    want = summary.cluster_summary(recruit.recruited(reads.select("seq_id", "sequence"), centres, 0.9), reads.select("seq_id", "count"))
    rows_in = lambda df: sorted((r.centroid, r.density, r["mode"], r.mode_seq) for r in df.collect())
    assert rows_in(streaming.summary(spark, out)) == rows_in(want) and len(rows_in(want)) == 3
    assert streaming.members(spark, out).count() == 48


def test_sweep_from_the_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "r.fasta").write_text(">r1\nACGT\n>r2\nAC\n")
    seen = []

    def run(reads, options):
        seen.append(options)
        return None, spark.createDataFrame([(reads.count(), options.rate)], "n long, rate double")

    monkeypatch.setattr(cluster, "run", run)
    cluster.main([str(tmp_path / "r.fasta"), str(tmp_path / "out"), "--rate", "0.9", "--stop-when-done", "--sweep", "0.01", "0.02"])
    rows = spark.read.parquet(str(tmp_path / "out" / "sweep")).collect()
    assert {(r.variant, r.n, r.rate) for r in rows} == {(v, 2, 0.9) for v in [*(f"adaptive={a} shift={m}" for a in (True, False) for m in (True, False)), "delta=0.01", "delta=0.02"]}
    assert {(o.adaptive, o.mode_shift) for o in seen[:4]} == {(a, m) for a in (True, False) for m in (True, False)} and [o.delta for o in seen[4:]] == [0.01, 0.02] and all(o.stop_when_done for o in seen)
