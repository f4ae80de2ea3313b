import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from seqcover.functions import aligned, distance, scalars
from seqcover.operators import greedy, recruit


def prefix_model(t, q):
    """All target letters used, trailing centre letters free."""
    row = list(range(len(q) + 1))
    for a in t:
        new = [row[0] + 1]
        for j, b in enumerate(q):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def r_model(n, s):
    return int(np.floor((np.float32(1) - np.float32(s)) * np.float32(n)))


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s) + 1)
        what = rng.randrange(3)
        if what == 0:
            s.insert(k, rng.choice("ACGT"))
        elif s and k < len(s):
            s[k : k + 1] = [] if what == 1 else [rng.choice("ACGT")]
    return "".join(s)


@pytest.mark.parametrize("similarity", [0.99, 0.98, 0.97, 0.96, 0.95, 1.0])
def test_radius_is_single_precision(spark, similarity):
    lengths = [1, 49, 50, 99, 100, 101, 199, 200, 250, 300]
    df = spark.createDataFrame([(n,) for n in lengths], "n int").select("n", scalars.radius(F.col("n"), similarity).alias("r"))
    assert {r.n: r.r for r in df.collect()} == {n: r_model(n, similarity) for n in lengths}


def test_distance_equals_model(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        q = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 60)))
        t = edited(rng, q[: rng.randrange(1, len(q) + 1)], rng.randrange(5))
        if t:
            pairs.append((t, q, rng.randrange(6)))
    df = spark.createDataFrame(pairs, "t string, q string, r int")
    made = df.select("t", "q", "r", distance.prefix_distance(F.col("t"), F.col("q"), F.col("r")).alias("d"), distance.within_prefix(F.col("t"), F.col("q"), F.col("r")).alias("ok"), distance.substring_distance(F.col("t"), F.col("q"), F.col("r")).alias("sub"))
    for row in made.collect():
        d = prefix_model(row.t, row.q)
        assert row.d == (d if d <= row.r else None) and row.ok == (d <= row.r)
        sub = min(prefix_model(row.t, row.q[k:]) for k in range(len(row.q) + 1))
        assert row.sub == (sub if sub <= row.r else None)


def sequences(rng, n):
    seeds = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 60))) for _ in range(6)]
    return [edited(rng, rng.choice(seeds), rng.randrange(5)) for _ in range(n)]


def test_recruit_and_greedy_equal_sequential_models(spark):
    rng, s = random.Random(9), 0.9
    seqs = [(k, x) for k, x in enumerate(sequences(rng, 80) + ["", "A"])]
    accept = lambda t, q: bool(t and q) and prefix_model(t, q) <= min(r_model(len(t), s), r_model(len(q), s))
    df = spark.createDataFrame([(k, x, k) for k, x in seqs], "seq_id long, sequence string, ord long").repartition(3)
    centres = df.where("seq_id % 7 = 3")
    want = {k: next((c for c, q in seqs if c % 7 == 3 and accept(x, q)), None) for k, x in seqs}
    got = {r.seq_id: r.centroid for r in recruit.recruited(df, centres, s).collect()}
    assert got == {k: c for k, c in want.items() if c is not None}
    left, model = sorted(seqs, key=lambda x: (len(x[1]), x[1], x[0]), reverse=True), {}
    for k, q in left:
        if k not in model:
            model[k] = k
            for j, t in left:
                if j not in model and accept(t, q):
                    model[j] = k
    assert {r.seq_id: r.centroid for r in greedy.clustered(df, s).collect()} == model


def test_empty_tables(spark):
    none = spark.createDataFrame([], "seq_id long, sequence string, ord long")
    assert recruit.recruited(none, none, 0.9).count() == 0
    assert greedy.clustered(none, 0.9).count() == 0


def substring_model(t, q):
    return min(prefix_model(t, q[k:]) for k in range(len(q) + 1))


@pytest.mark.parametrize("ordered", [True, False])
def test_batches_of_pairs_equal_models(ordered):
    """Targets that share beginnings, centres of several targets, empty strings, limits of their own, letters beyond ASCII, targets of several words of bits."""
    rng = random.Random(11)
    base = ["".join(rng.choices("ACG\u00e9\U0001d11e", k=rng.randrange(0, 150))) for _ in range(6)]
    centres = [edited(rng, b, 3) for b in base] + [""]
    pairs = [(edited(rng, rng.choice(base)[: rng.randrange(0, 150)], rng.randrange(8)), rng.choice(centres), rng.randrange(12)) for _ in range(300)]
    pairs += [("", "", 0), ("A", "", 1), ("A", "", 0), ("ACG" * 50, "ACG" * 50, 0)]
    if ordered:
        pairs.sort(key=lambda p: (p[1], p[0]))
    t, q, most = (list(x) for x in zip(*pairs, strict=True))
    within = lambda model: [d if d <= r else -1 for a, b, r in pairs for d in [model(a, b)]]
    assert aligned.prefix_costs(t, q, np.array(most)).tolist() == within(prefix_model)
    assert aligned.substring_costs(t, q, np.array(most)).tolist() == within(substring_model)
    assert aligned.prefix_costs([], [], np.zeros(0, int)).tolist() == []


def test_dense_groups_of_one_length_write_few_rows(spark, monkeypatch):
    """Two groups of reads of one length, all alike within each: many times more pairs than rows that are written, in batches of any size."""
    rng, s = random.Random(2), 0.9
    seeds = ["".join(rng.choices("ACGT", k=40)) for _ in range(2)]
    seqs = [(k, x[: 1 + k % 30] + rng.choice("ACGT") + x[2 + k % 30 :]) for k in range(120) for x in [seeds[k % 2]]]
    df = spark.createDataFrame(seqs, "seq_id long, sequence string").repartition(3)
    left, model = sorted(seqs, key=lambda x: (len(x[1]), x[1], x[0]), reverse=True), {}
    for k, q in left:
        if k not in model:
            model[k] = k
            model |= {j: k for j, t in left if j not in model and prefix_model(t, q) <= r_model(40, s)}
    written = []
    monkeypatch.setattr(greedy, "ACCEPTORS", 3)
    monkeypatch.setattr(greedy, "kept", lambda table, name, keep=greedy.kept: (written.append((name, keep(table, name))), written[-1][1])[1])
    monkeypatch.setattr(greedy, "forget", lambda *tables: None)
    for batch in (10_000, 16):
        written.clear()
        assert {r.seq_id: r.centroid for r in greedy.clustered(df, s, batch=batch).collect()} == model
        listed = sum(x.selectExpr("sum(size(by))").first()[0] for name, x in written if name == "states" and x.where("state = 'waits'").count())
        assert listed <= 3 * 120 * len(written)


def test_targets_within_the_radius_and_hot_segments(spark, monkeypatch):
    """Targets as short as their radius match every centre that is long enough; segments that all share are dealt out."""
    rng = random.Random(8)
    targets = [(k, "".join(rng.choices("AC", k=rng.randrange(1, 12)))) for k in range(60)]
    centres = [(k, "".join(rng.choices("AC", k=rng.randrange(1, 14))), k) for k in range(25)]
    monkeypatch.setattr(recruit, "PAIRS", 20)
    t, q = spark.createDataFrame(targets, "seq_id long, sequence string"), spark.createDataFrame(centres, "seq_id long, sequence string, ord long")
    for mismatches in (0, 2, 5):
        want = {(a, b) for a, x in targets for b, y, _ in centres if prefix_model(x, y) <= mismatches}
        rows = [(r.target, r.centre) for r in recruit.edges(t, q, 0.9, mismatches=mismatches).collect()]
        assert set(rows) == want and len(rows) == len(want)
        want = {(a, b) for a, x in targets for b, y, _ in centres if substring_model(x, y) <= mismatches}
        assert {(r.target, r.centre) for r in recruit.edges(t, q, 0.9, mismatches=mismatches, anywhere=True).collect()} == want
