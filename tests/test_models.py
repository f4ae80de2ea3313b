"""Queries that have no SQL, against plain sequential versions over the smallest tables."""

import hashlib
import math

import pyarrow.parquet as pq
import pytest
from helpers import SMALL
from test_distance import prefix_model, r_model

from seqcover import queries as core
from seqcover.jobs import cluster as job
from seqcover.operators import bounds, greedy, recruit


def table(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


def uniform(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 2**32


class Cache(dict):
    def __missing__(self, key):
        t, q, most = key
        self[key] = bool(t and q) and len(q) >= len(t) - most and prefix_model(t, q) <= most
        return self[key]


near = Cache()


def accepts(t, q, s, times=1):
    return near[t, q, times * min(r_model(len(t), s), r_model(len(q), s))]


def greedy_model(rows, s):
    left, out = sorted(rows, key=lambda x: (len(x[1]), x[1], x[0]), reverse=True), {}
    for k, q in left:
        if k not in out:
            out[k] = k
            out.update({j: k for j, t in left if j not in out and accepts(t, q, s)})
    return out


def recruit_model(rows, centres, s):
    return {k: c for k, t in rows for c in [next((c for c, q in centres if accepts(t, q, s)), None)] if c is not None}


def summary_model(members, counts):
    """centroid: (density, mode, mode_seq)"""
    out = {}
    for c in set(members.values()):
        own = [k for k, x in members.items() if x == c]
        best = min(own, key=lambda k: (-counts.get(k, 1), k != c, k))
        out[c] = (len(own), max(counts.get(k, 1) for k in own), best)
    return out


class Frontier:
    """Open sizes and how many clusters have them, the mass that is left, the smallest size that gave its mass back."""

    def __init__(self, mass):
        self.mass, self.bound, self.pool = mass, 0, {}

    def add(self, sizes):
        for size, n in sizes.items():
            self.pool[size] = self.pool.get(size, 0) + n

    def freeze(self, frozen):
        left = {s: n for s, n in self.pool.items() if s not in frozen}
        upper = {s for s in frozen if s >= max(left, default=0)}
        self.mass -= sum(s * self.pool[s] for s in upper)
        self.pool, self.bound = left, min(upper, default=self.bound)
        return self.bound


def tail(n, p, least):
    return 1 - sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(least))


def run_model(rows, options):
    first, counts = {}, {}
    for k, s in sorted(rows):
        own = first.setdefault(s, k)
        counts[own] = counts.get(own, 0) + 1
    left = [(k, s) for s, k in first.items()]
    left.sort()
    frontier, rate, sizes, out, members = Frontier(float(len(left))), options.rate, [], [], []
    for number in range(1, options.iterations + 1):
        if options.adaptive and len(sizes) >= 2:
            rate = job.next_rate(rate, sizes[-1], sizes[-2], options.delta)
        some = [x for x in left if uniform(f"{options.seed}-{number}", x[0]) < rate]
        found = summary_model(greedy_model(some, options.similarity), counts)
        bait = {c for c, (density, mode, _) in found.items() if density > 1 or mode > 1}
        own = recruit_model(left, [x for x in left if x[0] in bait], options.similarity)
        totals = summary_model(own, counts)
        modes = {m for density, _, m in totals.values() if density > 1}
        if modes:
            own = recruit_model(left, [x for x in left if x[0] in modes], options.similarity)
            totals = summary_model(own, counts)
        members += [(number, c, k) for k, c in own.items()]
        left = [x for x in left if x[0] not in own]
        dense = [d for d, _, _ in totals.values()]
        big = sorted(d for d in dense if d > 1)
        sizes.append(sum(big))
        frontier.add({d: dense.count(d) for d in set(dense)})
        pool, frozen = dict(frontier.pool), set()
        if pool and frontier.mass > 0:
            drawn, total = math.floor(rate * frontier.mass), sum(pool.values())
            for size, n in pool.items():
                x = size * drawn / frontier.mass
                p = 1 - math.exp(-x) * (1 + x * math.exp(size / frontier.mass))
                if tail(math.floor(max(n, n / total * frontier.mass / size)), p, n) >= options.confidence:
                    frozen.add(size)
        out.append((number, len(big), sum(big), max(dense, default=None), sum(d >= options.least for d in dense), dense.count(1), frontier.freeze(frozen)))
    return members, out


def test_iterations_equal_the_model(spark):
    rows = [(p["page_id"], p["url"] or "") for p in table("pages")]
    one = job.Options(similarity=core.S, rate=0.3, iterations=1, least=2)
    three = job.Options(similarity=core.S, rate=0.3, iterations=3, least=2)
    assert sorted((r.iteration, r.centroid, r.seq_id) for r in core.one_iteration(spark, SMALL).collect()) == sorted(run_model(rows, one)[0])
    got = [(r.iteration, r.n_clusters, r.n_clustered, r.densest, r.n_above_least, r.n_singletons, r.largest_open_bound) for r in core.three_iterations(spark, SMALL).orderBy("iteration").collect()]
    assert got == run_model(rows, three)[1]


def test_iterations_of_dense_records_equal_the_model(spark):
    import random

    rng = random.Random(5)
    seeds = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(5)]
    rows = []
    for k in range(90):
        s = list(rng.choice(seeds))
        for _ in range(rng.randrange(3)):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        rows.append((k, "".join(s)[: 40 - rng.randrange(3)]))
    options = job.Options(similarity=0.9, rate=0.3, iterations=2, least=3)
    members, summary = job.run(spark.createDataFrame([(k, s, k) for k, s in rows], "seq_id long, sequence string, ord long"), options)
    want, want_rows = run_model(rows, options)
    assert sorted((r.iteration, r.centroid, r.seq_id) for r in members.collect()) == sorted(want) and want
    assert [(r.iteration, r.n_clusters, r.n_clustered, r.densest) for r in summary.orderBy("iteration").collect()] == [x[:4] for x in want_rows]


def sizes_of_users():
    out = {}
    for e in table("events"):
        out[e["user_id"]] = out.get(e["user_id"], 0) + 1
    return out


def test_discovery_rounds_equal_the_model(spark):
    left, want = sizes_of_users(), []
    for k in range(1, 5):
        mass = sum(left.values())
        if not mass:
            break
        found = {u for u, s in left.items() if uniform(3, k, u) < 1 - math.exp(-0.05 * s) * (1 + 0.05 * s * math.exp(s / mass))}
        hit, rest = [s for u, s in left.items() if u in found], [s for u, s in left.items() if u not in found]
        spread = lambda x: math.log(sum(x)) - sum(s * math.log(s) for s in x) / sum(x) if x else 0.0
        want.append((k, sum(hit), max(hit, default=None), max(rest, default=None), len(hit), sum(rest), rest.count(1) / max(1, sum(rest)), spread(hit), spread(rest)))
        left = {u: s for u, s in left.items() if u not in found}
    got = core.naive_rounds(spark, SMALL).orderBy("iteration").collect()
    names = ["iteration", "n_clustered", "max_clustered", "max_left", "n_clusters", "n_left", "singletons_left", "entropy_clustered", "entropy_left"]
    assert len(got) == len(want)
    for r, w in zip(got, want, strict=True):
        assert [r[n] for n in names[:6]] == list(w[:6]) and [r[n] for n in names[6:]] == pytest.approx(list(w[6:]), abs=1e-9)


def test_simulated_discovery_equals_the_model(spark):
    sizes = list(sizes_of_users().values())
    total = float(len(table("events")))
    drawn, want = math.floor(0.05 * total), {}
    for size in set(sizes):
        n = math.floor(max(sizes.count(size), sizes.count(size) / len(sizes) * total / size))
        x = size * drawn / total
        found = 1 - math.exp(-x) * (1 + x * math.exp(size / total))
        for run in range(1, 51):
            k = sum(uniform(5, size, run, i) >= 1 - found for i in range(1, n + 1))
            want[size, k] = want.get((size, k), 0) + 1 / 50
    got = {(r["size"], r.k): r.share for r in core.simulated_discovery(spark, SMALL).collect()}
    assert got == pytest.approx(want)


def test_greedy_batches_equal_one_batch(spark):
    rows = [(p["page_id"], p["url"] or "") for p in table("pages")]
    df = spark.createDataFrame(rows, "seq_id long, sequence string")
    for batch in (3, 20):
        assert {r.seq_id: r.centroid for r in greedy.clustered(df, 0.8, batch=batch).collect()} == greedy_model(rows, 0.8)


def test_apart_clusters_equal_the_model(spark):
    s = 0.95
    base = "ACGTTGCAACGGTCATTGCAACGTTGACCA"
    rows = [(k, x) for k, x in enumerate([base, "T" + base[1:], "TT" + base[2:], base[:10] + "TTT" + base[13:], base[:20], "G" * 30, "", "A"])]
    df = spark.createDataFrame(rows, "seq_id long, sequence string")
    left, out, shut = sorted(rows, key=lambda x: (len(x[1]), x[1], x[0]), reverse=True), {}, set()
    for k, q in left:
        if k in shut:
            continue
        shut.add(k)
        out[k] = k
        for j, t in left:
            if j not in shut and accepts(t, q, s, 2):
                shut.add(j)
                most = min(r_model(len(t), s), r_model(len(q), s))
                if prefix_model(t, q) < most:
                    out[j] = k
    assert {r.seq_id: r.centroid for r in greedy.apart_clustered(df, s).collect()} == out


def test_substring_mode_and_short_targets(spark):
    texts = [(b["item_id"], b["text"] or "") for b in table("benchmark")]
    best = lambda t, q: min(prefix_model(t, q[k:]) for k in range(len(q) + 1))
    want = set()
    for i, x in texts:
        t = x[10 : 10 + max(0, len(x) - 20)]
        for j, q in texts:
            most = min(r_model(len(t), 0.97), r_model(len(q), 0.97))
            if j % 20 == 0 and t and q and len(q) >= len(t) - most and (d := best(t, q)) <= most:
                want.add((i, j, d))
    assert {(r.target, r.centre, r.cost) for r in core.recruit_substring(spark, SMALL).collect()} == want
    short = spark.createDataFrame([(1, "AC"), (2, "GTT")], "seq_id long, sequence string")
    centres = spark.createDataFrame([(9, "GT", 0), (8, "", 1)], "seq_id long, sequence string, ord long")
    assert {(r.target, r.centre) for r in recruit.edges(short, centres, 0.9, mismatches=2).collect()} == {(1, 9), (2, 9)}


def test_joined_reads_are_whole_again(spark):
    letters = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    whole = {b["item_id"]: "".join(c for c in (b["text"] or "").lower() if "a" <= c <= "z").translate(letters) for b in table("benchmark")}
    got = {r.seq_id: (r.sequence, r.overlap) for r in core.joined_reads(spark, SMALL).collect()}
    assert got and all(o >= 10 for _, o in got.values())
    assert sum(whole[k] == s for k, (s, _) in got.items()) >= 0.9 * len(got)


def test_correlation_p_equals_the_model(spark):
    r, n = (core.evaluate.pearson(spark.read.parquet(f"{SMALL}/customer.parquet").join(spark.read.parquet(f"{SMALL}/orders.parquet"), core.F.col("c_custkey") == core.F.col("o_custkey")), "c_acctbal", "o_totalprice").first())
    got = core.correlation_p(spark, SMALL).first()
    t = r * math.sqrt((n - 2) / (1 - r * r))
    # with so many rows, t is normal to three places
    assert got.n == n and abs(got.t - t) < 1e-4 and abs(got.p - math.erfc(abs(t) / math.sqrt(2))) < 1e-3
