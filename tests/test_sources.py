"""Files: FASTQ and FASTA at the edges of lines and parts, duplicate reports, literals."""

import pytest
from pyspark.sql import functions as F

from seqcover.functions.tables import in_order
from seqcover.operators import evaluate, records
from seqcover.sources import clusters, fasta


def fastq(*reads):
    return "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in reads)


@pytest.mark.parametrize("split", [None, 64])
def test_fastq(spark, tmp_path, split):
    reads = [("r1", "AC", "II"), ("r2", "", ""), ("r3 second word", "GG", "@@"), ("@r4", "ACGT", "+@>!")] + [(f"n{k}", "ACGTN"[: k % 6] * 3, "@+!I5"[: k % 6] * 3) for k in range(40)]
    (tmp_path / "a.fastq").write_text(fastq(*reads))
    (tmp_path / "b.fastq").write_bytes(fastq(("only", "TT", "##")).replace("\n", "\r\n").encode() + b"\r\n\r\n")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = fasta.read_fastq(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    of = lambda name: [(r.header, r.sequence, r.quality) for r in sorted(got, key=lambda r: r.place) if r.file.endswith(name)]
    assert of("a.fastq") == reads and of("b.fastq") == [("only", "TT", "##")]


@pytest.mark.parametrize("text", ["r1\nAC\n+\nII\n", "@r1\nAC\n-\nII\n", "@r1\nAC\n+\nIII\n", "@r1\nAC\n"])
def test_fastq_that_is_none_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.fastq").write_text(text)
    with pytest.raises(Exception, match="no whole record"):
        fasta.read_fastq(spark, str(tmp_path / "x.fastq")).collect()


def test_quality_cut_and_joined_pairs(spark):
    rows = [("a", "ACGTACGTAC", "IIIIIIIIII"), ("b", "ACGTACGTAC", "IIIIIIII44"), ("c", "ACGTACGTAC", "IIIIIIII!!"[:4] + "!!!!II"), ("d", "ACGTACGTAC", "II!!!I!!!I"), ("e", "ACNTACGTAC", "IIIIIIIIII"), ("f", "", "")]
    reads = spark.createDataFrame(rows, "header string, sequence string, quality string")
    assert {r.header: len(r.sequence) for r in fasta.quality_cut(reads).collect()} == {"a": 10, "b": 10, "d": 10, "f": 0}
    assert {r.header: (r.sequence, r.quality) for r in fasta.quality_cut(reads, share=0.4).where("header = 'c'").collect()} == {"c": ("ACGT", "IIII")}
    whole = "ACGGTCATTGCAACGTTGACCATG"
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    forward = [("x", whole[:16]), ("y", whole[:8]), ("z", "AAAA")]
    backward = [("x", turned(whole[8:])), ("y", turned(whole[12:])), ("z", "CCCC")]
    table = lambda rows: spark.createDataFrame(rows, "seq_id string, sequence string")
    assert [tuple(r) for r in fasta.joined_pairs(table(forward), table(backward)).collect()] == [("x", whole, 8)]


def test_fasta_of_many_files(spark, tmp_path):
    (tmp_path / "a").write_text("left out\n>x one\nAC\n GT \n>>y\nA\n")
    (tmp_path / "b").write_text(">z\n\nAC>GT\n")
    got = {r.header: r.sequence for r in fasta.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"x one": "ACGT", ">y": "A", "z": "AC>GT"}
    with pytest.raises(Exception, match="start with a record"):
        fasta.read_fasta(spark, str(tmp_path), strict=True).collect()


def test_order_over_files_of_unlike_sizes(spark, tmp_path):
    """Spark packs splits by size, the largest first; records and lines come in order of paths all the same."""
    (tmp_path / "a.fa").write_text(">a0\nAC\n>a1\nGT\n")
    (tmp_path / "b.fa").write_text("".join(f">b{k}\n{'ACGT' * 10}\n" for k in range(60)))
    (tmp_path / "c.fa").write_text(">c0\nAC\n")
    want = ["a0", "a1", *(f"b{k}" for k in range(60)), "c0"]
    lines = [x for name in "abc" for x in (tmp_path / f"{name}.fa").read_text().split("\n")[:-1]]
    for split in (None, 128, 700):
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            assert [r.seq_id for r in fasta.read_fasta(spark, str(tmp_path)).orderBy("ord").collect()] == want
            assert [r.value for r in clusters.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == lines
            assert [r.header for r in fasta.read_pairs(spark, str(tmp_path)).orderBy("file", "place").collect()] == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("split", [7, 64, 4096])
@pytest.mark.parametrize("text", [">a\nAC\n>b\n", ">a\nAC\nGT\n>b\nAC\n", "x\n>a\nAC\n", ">a\n>b\nAC\nGT\n", ">a\nAC\n\n>b\nAC\n"])
def test_records_that_have_not_two_lines_are_errors(spark, tmp_path, split, text):
    (tmp_path / "x.fa").write_text(">k\nACGTACGT\n" * 20 + text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        with pytest.raises(Exception, match="two lines|without letters"):
            fasta.read_pairs(spark, str(tmp_path / "x.fa")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_very_long_values_of_every_pattern(spark, tmp_path):
    """Patterns with groups that repeat would run out of stack on long values."""
    long = "x" * 300_000
    (tmp_path / "c").write_text(f"{{'{long}': {{'Counts': '3'}}, \"it's {long}\": {{'Counts': 4}}, '{chr(92)}'{long}': {{'Counts': 5}}}}")
    assert {r.seq_id[:4]: (len(r.seq_id), r["count"]) for r in clusters.read_counts_literal(spark, str(tmp_path / "c")).collect()} == {"xxxx": (300_000, 3), "it's": (300_005, 4), "'xxx": (300_001, 5)}
    (tmp_path / "f").write_text(f">h{' ' * 100_000}e\n{'A' * 300_000}{' ' * 100_000}\n")
    assert [(r.seq_id, r.length) for r in fasta.read_fasta(spark, str(tmp_path / "f")).collect()] == [("h", 300_000)]
    fasta.write_fasta(fasta.read_fasta(spark, str(tmp_path / "f")), str(tmp_path / "out"))
    assert fasta.read_fasta(spark, str(tmp_path / "out")).first().length == 300_000


def test_reports_and_literals(spark, tmp_path):
    rows = [("a", "AA", 2), ("b", "AA", 1), ("c", "CC", 3)]
    lines = clusters.duplicate_lines(spark.createDataFrame(rows, "seq_id string, sequence string, ord long"))
    assert [r.value for r in lines.collect()] == ["2\tb, a"]
    (tmp_path / "c").write_text("{'it\\'s': {'Counts': '3'}, \"x\": {'Counts': '1'},\n 'y{': {'Counts': 12}}")
    assert {r.seq_id: r["count"] for r in clusters.read_counts_literal(spark, str(tmp_path / "c")).collect()} == {"it's": 3, "x": 1, "y{": 12}
    counts = spark.createDataFrame([("o'b\\c", 5), ("plain", 1)], "seq_id string, count long")
    clusters.write_counts_literal(counts, str(tmp_path / "out"))
    assert {r.seq_id: r["count"] for r in clusters.read_counts_literal(spark, str(tmp_path / "out")).collect()} == {"o'b\\c": 5, "plain": 1}


def test_places_and_sums_over_ranges(spark):
    rows = [(k, (k * 7919) % 503) for k in range(1000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    want = {k: i + 1 for i, (k, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.k: r.place for r in in_order(df, [F.col("v"), F.col("k")]).collect()} == want
    sums = {r.k: r.s for r in in_order(df, [F.col("k")], "s", "v").collect()}
    total = 0
    for k, v in rows:
        total += v
        assert sums[k] == total
    none = spark.createDataFrame([], "seq_id long, sequence string, ord long")
    assert records.length_places(none).count() == 0


def test_p_values():
    # quantiles of the t distribution: two-sided p of 0.05 and 0.01
    for freedom, t, p in ((1, 12.7062, 0.05), (5, 2.57058, 0.05), (30, 2.75, 0.01), (1000, 1.96234, 0.05), (3, 0.0, 1.0)):
        assert abs(evaluate.two_sided_p(t, freedom) - p) < 2e-5 and abs(evaluate.two_sided_p(-t, freedom) - p) < 2e-5


def test_single_steps(spark, tmp_path):
    from seqcover.jobs import tools

    base = "ACGTTGCAACGGTCATTGCAACGTTGACCA"
    (tmp_path / "r.fasta").write_text(f">a long\n{base}\n>b\n{base[:-1]}\n>c\n{'G' * 20}\n>d\n{'T' + base[1:]}\n")
    (tmp_path / "c.fasta").write_text(f">c\n{'G' * 20}\n>a\n{base}\n")
    run = lambda *args: tools.main([str(tmp_path / x) if x.endswith(".fasta") or x.startswith("out") else x for x in args])
    lines = lambda out: sorted(x for p in (tmp_path / out).rglob("part*") for x in p.read_text().split("\n") if x)
    run("cluster", "r.fasta", "out1", "--similarity", "0.9")
    assert lines("out1") == ["c", "d\ta\tb"]
    run("recruit", "r.fasta", "c.fasta", "out2", "--similarity", "0.9")
    assert lines("out2") == ["a\tb\td", "c"]
    run("recruit", "r.fasta", "c.fasta", "out3", "--similarity", "0.9", "--pairs")
    assert lines("out3") == ["a\ta", "b\ta", "c\tc", "d\ta"]
    run("sort", "r.fasta", "out4")
    assert [r.seq_id for r in fasta.read_fasta(spark, str(tmp_path / "out4")).orderBy("ord").collect()] == ["d", "a", "b", "c"]
    run("select", "r.fasta", "out2", "out5", "--mode", "rest")
    assert [x for x in lines("out5") if x[0] == ">"] == [">b", ">d"]
    run("select", "r.fasta", "out2", "out6", "--mode", "members")
    assert {p.parent.name for p in (tmp_path / "out6").rglob("part*")} == {"centroid=a", "centroid=c"}
