"""Near-duplicates by similarity, for simhash: texts are linked whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words and shingles are those of simhash, but each shingle counts once; texts of fewer words are one shingle, and texts
without words (null too) have the empty one and are linked. Shingles are compared by XXH64 (seed 42), sets of the same
shingles by XXH64 of these. Whole components over links are one group.

First the trie of simhash links fingerprints of these sets that differ in at most BUDGET bits, and the sets of each
star's ends are compared. At a similarity of 0.8 fingerprints differ in about ten of 64 bits, where no trie can prune any
more; so what the trie has not connected is searched for in a second way that misses nothing. In any one order of all
shingles, two sets of sizes m and n with a similarity of 0.8 share a shingle within the first m - ceil(0.8 m) + 1 of the
one and the first n - ceil(0.8 n) + 1 of the other, and at the first that they share, enough shingles are left in both.
So each set goes to the buckets of its first shingles, and all pairs of a bucket with enough left are candidates whose
whole sets are compared. The order has shingles of many texts last (counted in one text of SAMPLE; the count decides how
large buckets get, not what is found).

Each set has parities of its shingles, by classes of hashes, about as many as it has shingles. Those that differ between
two sets are no more than the shingles that only one of them has, of which a ninth of both sizes is allowed; so pairs
with more are left out: by BITS parities within a bucket, before a pair becomes a row, and by all of them before whole
sets are moved.

Before all pairs of a bucket are taken, CHAINS rounds take of each bucket only a forest: no more pairs than it has rows,
which connect what all its pairs that parities leave would. Pairs that links connect already aren't compared again, so
that large groups of copies don't make a pair for each two of their members.

Sets are kept as the words they come from, joined by spaces, which take less room than hashes, and are hashed again
where they are compared.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, simhash

SHINGLE = 5
SAMPLE, COMMON, COMMON_ROWS = 16, 4, 200_000
BUDGET, CHAINS = 3, 1
#: Parities that rows of buckets have, and the most that a set has.
BITS, MOST_BITS = 512, 1 << 16
#: Pairs that a bucket gives at a time.
PAIRS = 200_000


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text, ascending."""
    own = text.lower().split()
    if not own:
        return np.array([xxhash.xxh64_intdigest(b"", 42)], "<u8")
    joined, starts = b" ".join(own), [0, *accumulate(len(w) + 1 for w in own)]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, starts[min(SHINGLE, len(own)) :], strict=False)], "<u8"))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two ascending sets have a similarity of 4/5: 5 * both >= 4 * (all - both)."""
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def fingerprint(x: np.ndarray) -> int:
    """A bit is 1 if over half of the shingles have it."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(x), 4096):
        bits += np.unpackbits(x[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(x), bitorder="little").view("<u8")[0])


def parities(x: np.ndarray, bits: int | None = None) -> bytes:
    """Of the numbers of hashes in classes: sets that differ in d hashes differ in d bits at most. bits: a power of two; None: as many as a set of this size has."""
    bits = bits or min(MOST_BITS, max(BITS, 1 << (len(x) - 1).bit_length()))
    return np.packbits(np.bincount((x % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def unlike(x: bytes, y: bytes) -> int:
    """How many parities differ, out of as many as both sets have: classes modulo a half are those modulo the whole, two by two."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    return int(np.bitwise_count(np.bitwise_xor.reduce(a.reshape(-1, len(b)), 0) ^ b).sum(dtype=np.int64))


def sets(docs: DataFrame) -> DataFrame:
    """id (the last one for null), node (which names the set), size, fp (its fingerprint), odd (BITS parities), parities and words of every row."""

    def each(batch: pa.RecordBatch):
        for part in common.slices(batch):
            words = [b" ".join(x.lower().split()) for x in common.texts(part)]
            found = [shingles(x) for x in words]
            yield {"id": pc.fill_null(part.column("doc_id").cast(pa.int64()), simhash.LAST), "node": np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in found], np.uint64).view(np.int64), "size": [len(x) for x in found], "fp": np.array([fingerprint(x) for x in found], np.uint64).view(np.int64), "odd": [parities(x, BITS) for x in found], "parities": [parities(x) for x in found], "words": words}

    return common.arrow_map(docs.select("doc_id", "text"), each, "id long, node long, size long, fp long, odd binary, parities binary, words binary")


def _common(own: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts, ascending, and their counts."""

    def each(batch: pa.RecordBatch):
        for part in common.slices(batch):
            yield {"shingle": np.concatenate([shingles(x) for x in part.column("words").to_pylist()]).view(np.int64)}

    some = common.arrow_map(own.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("words"), each, "shingle long")
    rows = some.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(COMMON_ROWS).collect()
    found, n = np.array([r.shingle for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(found)
    return found[order], n[order]


def _first(own: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """shingle, node, n and left (the shingles from this one on) of the first shingles of every set."""
    shared = own.sparkSession.sparkContext.broadcast(often)

    def each(batch: pa.RecordBatch):
        values, counts = shared.value
        for part in common.slices(batch):
            out, sizes = [], []
            for words in part.column("words").to_pylist():
                h = shingles(words)
                n = len(h)
                if len(values):
                    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
                    h = h[np.argsort(np.where(values[at] == h, counts[at], 0), kind="stable")]
                out.append(h[: n - -(-4 * n // 5) + 1])
                sizes.append(n)
            taken = [len(x) for x in out]
            yield {
                "shingle": np.concatenate(out).view(np.int64),
                "node": np.repeat(part.column("node").to_numpy(), taken),
                "n": np.repeat(np.array(sizes, np.int32), taken),
                "left": np.concatenate([np.arange(n, n - k, -1, dtype=np.int32) for n, k in zip(sizes, taken, strict=True)]),
            }

    return common.arrow_map(own.select("node", "words"), each, "shingle long, node long, n int, left int")


def _whole(batches):
    """Tables that hold whole buckets, from batches in order of shingle."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        s = batch.column("shingle").to_numpy()
        if sum(b.num_rows for b in held) < 50_000 or s[0] == s[-1]:
            continue
        k = int(np.searchsorted(s, s[-1]))
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, k)])
        held = [batch.slice(k)]
    if held:
        yield pa.Table.from_batches(held)


def _within(table: pa.Table):
    """Places i and j of pairs of a bucket with enough left to be similar, in portions; a bucket's rows are in order of n."""
    s, n, left = (table.column(c).to_numpy() for c in ("shingle", "n", "left"))
    n, left = n.astype(np.int64), left.astype(np.int64)
    i, d = np.arange(len(s) - 1), 1
    while len(i):
        i = i[i + d < len(s)]
        j = i + d
        i = i[(s[i] == s[j]) & (5 * n[i] >= 4 * n[j])]
        j = i + d
        good = 9 * np.minimum(left[i], left[j]) >= 4 * (n[i] + n[j])
        yield i[good], j[good]
        d += 1


def _several(batches):
    """Rows that another one of their bucket may be similar to."""
    for table in _whole(batches):
        kept = np.zeros(table.num_rows, bool)
        for i, j in _within(table):
            kept[i] = kept[j] = True
        yield from table.filter(pa.array(kept)).to_batches()


def _forest(i: np.ndarray, j: np.ndarray, root: np.ndarray):
    """Places among the pairs (i, j) of some that connect the trees, named in root by one of their rows, that all connect; changes root."""
    at = np.arange(len(i))
    while len(at := at[root[i[at]] != root[j[at]]]):
        x, y = root[i[at]], root[j[at]]
        high, first = np.unique(np.maximum(x, y), return_index=True)
        yield at[first]
        root[high] = np.minimum(x, y)[first]
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _pairs(whole: bool):
    """Pairs of a bucket that have enough left, aren't linked and whose parities don't rule out that they are similar: all, or (not whole) some that connect what these connect."""

    def run(batches):
        for table in _whole(batches):
            s, node, root, n = (table.column(c).to_numpy() for c in ("shingle", "node", "root", "n"))
            odd = np.frombuffer(b"".join(table.column("odd").to_pylist()), "<u8").reshape(-1, BITS // 64)
            n = n.astype(np.int64)
            _, first, tree = np.unique(np.stack([s, root]), axis=1, return_index=True, return_inverse=True) if len(s) else (None, s, s)
            tree = first[tree.reshape(-1)]
            for i, j in _within(table):
                apart = tree[i] != tree[j]
                i, j = i[apart], j[apart]
                for k in range(0, len(i), PAIRS):
                    x, y = i[k : k + PAIRS], j[k : k + PAIRS]
                    near = 9 * np.bitwise_count(odd[x] ^ odd[y]).sum(1, dtype=np.int64) <= n[x] + n[y]
                    x, y = x[near], y[near]
                    for at in [slice(None)] if whole else _forest(x, y, tree):
                        a, b = node[x[at]], node[y[at]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _side(sets: DataFrame, node: str, value: str, what: str, size: str | None = None) -> DataFrame:
    return sets.select(F.col("node").alias(node), F.col(what).alias(value), *([F.col("size").alias(size)] if size else []))


def _possible(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) whose parities don't rule out that they are similar."""

    def each(batch: pa.RecordBatch) -> dict:
        differ = [unlike(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        near = pa.array(9 * np.array(differ, np.int64) <= batch.column("m").to_numpy() + batch.column("n").to_numpy())
        return {"a": batch.column("a").filter(near), "b": batch.column("b").filter(near)}

    both = pairs.join(_side(own, "a", "x", "parities", "m"), "a").join(_side(own, "b", "y", "parities", "n"), "b")
    return common.arrow_map(both.select("a", "b", "m", "n", "x", "y"), each, "a long, b long")


def _similar(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def each(batch: pa.RecordBatch):
        for part in common.slices(batch):
            x, y = (part.column(c).to_pylist() for c in ("x", "y"))
            near = pa.array([similar(shingles(p), shingles(q)) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield {"a": part.column("a").filter(near), "b": part.column("b").filter(near)}

    nodes = common.stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes")
    sets = own.join(F.broadcast(nodes) if common.count_rows(nodes) <= simhash.BROADCAST_IDS else nodes, "node", "left_semi")
    both = pairs.join(_side(sets, "a", "x", "words"), "a").join(_side(sets, "b", "y", "words"), "b")
    return common.arrow_map(both.select("a", "b", "x", "y"), each, "a long, b long")


def _compared(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Similar ones of the pairs (a, b; a table), as many as connect what all similar ones connect.

    Whole sets are moved for one pair of each node first, and then for all those whose ends are still apart; as nearly
    all pairs that parities leave are similar, these are few.
    """
    left, found = common.stored(_possible(pairs, own), "possible"), None
    common.forget(pairs)
    for last in (False, True):
        picked = left if last else common.stored(left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "picked")
        near = common.stored(_similar(picked, own), "links")
        found = near if found is None else found.union(near)
        if last:
            break
        roots = common.stored(graph.components(found), "roots")
        root = lambda end: F.coalesce(f"root_{end}", end)
        apart = left.join(picked, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            apart = apart.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
        after = common.stored(apart.where(root("a") != root("b")).select("a", "b"), "possible")
        for table in (left, picked, roots):
            common.forget(table)
        left = after
        if left.isEmpty():
            break
    common.forget(left)
    return found


def links(own: DataFrame) -> DataFrame:
    """From sets (node, size, fp, odd, parities, words), each once: edges a, b that connect what similar pairs connect."""
    by_print = common.stored(own.groupBy("fp").agg(F.min("node").alias("id")), "prints")
    same = own.select("fp", "node").join(by_print, "fp").where("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    ordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = _compared(common.stored(ordered(simhash.links(by_print, BUDGET).union(same)), "pairs"), own)
    rows = _first(own, _common(own)).repartition("shingle").sortWithinPartitions("shingle", "n")
    rows = common.stored(rows.mapInArrow(_several, rows.schema), "buckets")
    for k in range(CHAINS + 1):
        roots = common.stored(graph.components(edges), "roots")
        now = rows.join(own.select("node", "odd").join(roots, "node", "left"), "node").withColumn("root", F.coalesce("root", "node"))
        dealt = now.select("shingle", "node", "root", "n", "left", "odd").repartition("shingle").sortWithinPartitions("shingle", "n", "node")
        pairs = common.stored(dealt.mapInArrow(_pairs(k == CHAINS), "a long, b long").distinct(), "pairs")
        common.forget(roots)
        edges = edges.union(_compared(pairs, own))
    common.forget(rows)
    return edges


def _sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored sets, id and node of every row of docs, and the edges between nodes."""
    own = common.stored(sets(docs), "sets", "zstd")
    names = own.select("id", "node")
    classes = common.stored(names.groupBy("node").agg(F.min("id").alias("id")), "classes")
    again = common.stored(names.join(classes.withColumnRenamed("id", "first"), "node").where("id <> first").select("id", "node").distinct(), "again")
    once = own
    if n := common.count_rows(again):
        once = own.join(F.broadcast(again) if n <= simhash.BROADCAST_IDS else again, ["id", "node"], "left_anti")
    repeated = common.stored(names.groupBy("id", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node").distinct(), "repeated")
    if n := common.count_rows(repeated):  # of rows with one id and equal texts, one
        some = F.broadcast(repeated) if n <= simhash.BROADCAST_IDS else repeated
        once = once.join(some, "node", "left_anti").unionByName(once.join(some, "node", "left_semi").dropDuplicates(["node"]))
    return own, names, links(once.select("node", "size", "fp", "odd", "parities", "words"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that links reach) of every row of docs (doc_id, text); rows of one id are linked."""
    _, names, edges = _sets(docs)
    several = names.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a")
    roots = graph.components(edges.union(names.join(several, "id").where("a <> node").select("a", F.col("node").alias("b"))))
    named = simhash.named_nodes(names, roots)
    found = named.join(named.groupBy("root").agg(F.min("id").alias("least")), "root")
    return found.select(F.expr(f"nullif(id, {simhash.LAST})").alias("doc_id"), F.expr(f"nullif(least, {simhash.LAST})").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row for each group of texts that links connect: one of its smallest doc_id. Unlike rows that share an id, or have none, are told apart by their texts."""
    own, names, edges = _sets(docs)
    rows = common.stored(simhash.named_nodes(names, graph.components(edges)), "rows")
    common.forget(own)  # by far the largest table of the stage

    def node(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(shingles(x).tobytes(), 42) for x in common.texts(batch)], np.uint64).view(np.int64)

    return simhash.kept(docs, rows, node)
