"""Tries walked beside each other, tables compared block by block, and what is built on them, against plain versions."""

import random

import numpy as np
import pytest
from test_distance import edited, prefix_model, r_model, sequences

from seqcover.functions import tries
from seqcover.operators import cells, greedy, recruit


@pytest.mark.parametrize("portion", [20, 1 << 19])
def test_walk_equals_model(monkeypatch, portion):
    """Equal strings, radii of their own, letters beyond ASCII and U+0000, centres shorter than targets, portions of a few pairs."""
    rng = random.Random(portion)
    monkeypatch.setattr(tries, "PORTION", portion)
    monkeypatch.setattr(tries, "GIVEN", portion)
    for letters in ("AC", "A\0", "A\u00e9\U0001d11eB"):
        base = ["".join(rng.choices(letters, k=rng.randrange(1, 25))) for _ in range(4)]
        t = [edited(rng, rng.choice(base)[: rng.randrange(1, 25)], rng.randrange(5)) or "A" for _ in range(40)]
        q = [edited(rng, rng.choice(base), rng.randrange(3)) or "A" for _ in range(15)]
        near, far = ([rng.randrange(7) for _ in x] for x in (t, q))
        got = [x for part in tries.near_pairs(t, q, near, far) for x in zip(*(y.tolist() for y in part), strict=True)]
        want = {(a, b, d) for a, x in enumerate(t) for b, y in enumerate(q) for d in [prefix_model(x, y)] if d <= min(near[a], far[b])}
        assert set(got) == want and len(got) == len(want)


def test_chains_take_no_round_each(spark, monkeypatch):
    """Each read accepts the next one only, so every decision waits for the one before; few tables are written all the same."""
    seqs = [(k, "A" * (40 - k) + "C" * k) for k in range(40)]
    df, written = spark.createDataFrame(seqs, "seq_id long, sequence string"), []
    monkeypatch.setattr(greedy, "kept", lambda table, name, keep=greedy.kept: (written.append(name), keep(table, name))[1])
    want, left = {}, sorted(seqs, key=lambda x: (len(x[1]), x[1], x[0]), reverse=True)
    for k, q in left:
        if k not in want:
            want |= {j: k for j, t in left if j not in want and prefix_model(t, q) <= 1}
    assert {r.seq_id: r.centroid for r in greedy.clustered(df, 0.9, mismatches=1).collect()} == want
    assert len(written) <= 4


def test_blocks_give_each_target_one_centre(spark, monkeypatch):
    """Targets that all meet many centres go through blocks: the same edges and first centres, few rows from each block."""
    rng, s = random.Random(4), 0.9
    seqs = [(k, x) for k, x in enumerate(sequences(rng, 150))]
    for name, value in (("TARGETS", 40), ("CENTRES", 10)):
        monkeypatch.setattr(cells, name, value)
    monkeypatch.setattr(recruit, "MANY", 0)
    df = spark.createDataFrame([(k, x, -k) for k, x in seqs], "seq_id long, sequence string, ord long").repartition(3)
    centres = df.where("seq_id % 4 = 3")
    cost = {(a, b): prefix_model(t, q) for a, t in seqs for b, q in seqs if b % 4 == 3}
    within = lambda s: {(a, b) for (a, b), d in cost.items() if d <= min(r_model(len(seqs[a][1]), s), r_model(len(seqs[b][1]), s))}
    got = [(r.target, r.centre) for r in recruit.edges(df, centres, s).collect()]
    assert set(got) == within(s) and len(got) == len(set(got))
    assert {r.seq_id: r.centroid for r in recruit.recruited(df, centres, s).collect()} == {a: max(b for x, b in within(s) if x == a) for a, _ in within(s)}
    first = recruit.walked(df.selectExpr("seq_id AS target", "sequence AS t"), centres.selectExpr("seq_id AS centre", "sequence AS q", "ord"), [0.85, s], first=True).collect()
    assert len({(r.similarity, r.target) for r in first}) == sum(len({a for a, _ in within(x)}) for x in (0.85, s))
    assert len(first) <= 8 * 2 * 150 and len(first) < len(within(s)) + len(within(0.85))


def test_runs_are_counted_in_blocks(spark, monkeypatch):
    """Tables and sums of a few numbers at a time; how often a run occurs counts; nothing is joined or shuffled by runs."""
    from collections import Counter

    from seqcover.operators import records

    rng = random.Random(6)
    seqs = [(k, "".join(rng.choices("ACé", k=rng.randrange(12)))) for k in range(60)]
    spectra = {k: Counter(x[i : i + 3] for i in range(len(x) - 2)) for k, x in seqs}
    want = {(a, b, sum((spectra[a] - spectra[b]).values())) for a in spectra for b in spectra if b % 3 == 0 and spectra[a] & spectra[b]}
    t, q = ([x for k, x in seqs if k % 3 == 0 or every] for every in (True, False))
    for runs, sums in ((50, 20), (1 << 20, 1 << 20)):
        monkeypatch.setattr(records, "RUNS", runs)
        monkeypatch.setattr(records, "SUMS", sums)
        got = [(a, 3 * b, n - c) for part in records.common_runs(t, q, 3) for a, b, c, n in zip(*(x.tolist() for x in part), strict=True)]
        assert set(got) == want and len(got) == len(want)
    df = spark.createDataFrame(seqs, "seq_id long, sequence string")
    found = records.kmer_excess(df, df.where("seq_id % 3 = 0"), 3)
    assert {tuple(r) for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().toString()


def test_weights_and_draws_of_pairs(spark):
    """Targets with one acceptor and with more; ids of text."""
    pairs = [(f"t{a}", f"c{b}") for a in range(30) for b in range(6) if (a * 7 + b * 5) % 11 < 1 + a % 4]
    count = {a: sum(x == a for x, _ in pairs) for a, _ in pairs}
    df = spark.createDataFrame(pairs, "target string, centre string")
    weights = {r.centre: r.weight for r in recruit.nonambiguous_weights(df).collect()}
    assert weights == {b: 1 + sum(y == b and count[a] == 1 for a, y in pairs) for _, b in pairs}
    drawn = {r.seq_id: r.centroid for r in recruit.ambiguous_assigned(df, 3).collect()}
    assert drawn.keys() == count.keys() and {*drawn.items()} <= set(pairs)
    assert "Window" not in recruit.nonambiguous_weights(df)._jdf.queryExecution().toString()
