"""SimHash near-duplicates, joined by walking a binary trie of fingerprints against itself.

A-Z becomes a-z, words are maximal runs of other characters than ASCII white space, and shingles are runs of consecutive
words joined by one space, repeats included; a text of fewer words is one shingle, one without words has the fingerprint
zero (a null text too) and is linked like any other. A bit of the 64-bit fingerprint is 1 if over half the shingles'
XXH64 (seed 42) have it. Fingerprints that differ in at most `budget` bits are linked, and so, over links, are whole
components.

The trie holds each distinct fingerprint once, in budget + 1 orders of its bits: each order has another block of bits
in front, and of two fingerprints within the budget one block at least is equal, so that the walk may start from the
nodes below that block. Each block value is a task's subtree; subtrees of over SUBTREE fingerprints are split again in
the same way on the bits that are left, until they are small or no bits are left. From each start the walk goes down
pairs of nodes, adds the bits in which they differ and drops pairs over the budget. What a subtree links leaves the
task as a star around its smallest document, so groups of copies of any size make no more rows than they have members.

Rows of one document id share its component. Null ids are taken after all others. Texts of any length are read whole;
columns other than doc_id and text don't matter. No rows: no rows. Removing duplicates tells rows apart by id and
fingerprint, so that unlike texts with one id, or with none, all stay.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

SHINGLE, BUDGET = 3, 2
SUBTREE = 200_000
#: Node pairs that a walk holds at a time.
PAIRS = 200_000
BROADCAST_IDS = 4_000_000
LAST = (1 << 63) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    own = text.lower().split()
    if not own:
        return 0
    joined, n = b" ".join(own), max(1, len(own) - shingle + 1)
    starts = [0, *accumulate(len(w) + 1 for w in own)]
    h = np.array([xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, starts[min(shingle, len(own)) :], strict=False)], "<u8")
    bits = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        bits += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def each(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "fp": np.array([fingerprint(x, shingle) for x in common.texts(batch)], np.uint64).view(np.int64)}

    return common.arrow_map(docs.select("doc_id", "text"), each, "doc_id long, fp long")


def blocks(fixed: int, budget: int) -> list[tuple[int, int]]:
    """The bits below the first `fixed` ones in budget + 1 blocks: first bit and length of each."""
    left, n = 64 - fixed, budget + 1
    cuts = [fixed + left * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def turned(values: np.ndarray, fixed: int, start: int, length: int) -> np.ndarray:
    """The bits from start on, length of them, moved in front of the others behind the first `fixed` bits (bit 0 is the highest)."""
    if not length:
        return values
    v = values.astype(np.uint64)
    bit = lambda n: np.uint64((1 << n) - 1)
    top = v >> np.uint64(64 - fixed) << np.uint64(64 - fixed) if fixed else np.uint64(0)
    block = (v >> np.uint64(64 - start - length)) & bit(length)
    high = (v >> np.uint64(64 - start)) & bit(start - fixed) if start > fixed else np.uint64(0)
    low = v & bit(64 - start - length)
    return top | block << np.uint64(64 - fixed - length) | high << np.uint64(64 - start - length) | low


def walk(values: np.ndarray, fixed: int, budget: int):
    """Pairs of places in values (sorted, distinct, uint64) that differ in at most budget bits and agree in the first fixed ones, in portions."""
    head = values >> np.uint64(64 - fixed) if fixed else np.zeros(len(values), np.uint64)
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(values) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(values))
    many = last - first > 1
    a = np.stack([first[many], last[many]]).astype(np.int64)
    stack = [(fixed, a, a, np.zeros(a.shape[1], np.int64))]
    while stack:
        depth, a, b, cost = stack.pop()
        if not len(cost):
            continue
        if len(cost) > PAIRS:
            for k in range(0, len(cost), PAIRS):
                stack.append((depth, a[:, k : k + PAIRS], b[:, k : k + PAIRS], cost[k : k + PAIRS]))
            continue
        single = (a[1] - a[0] == 1) & (b[1] - b[0] == 1)
        i, j = a[0, single], b[0, single]
        near = np.bitwise_count(values[i] ^ values[j]) <= budget
        yield i[near], j[near]
        a, b, cost = a[:, ~single], b[:, ~single], cost[~single]
        if not len(cost):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        above = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)

        def halves(node, bit=bit, above=above):
            mid = np.searchsorted(values, (values[node[0]] & above) | bit)
            return np.stack([node[0], mid]), np.stack([mid, node[1]])

        (a0, a1), (b0, b1), same = halves(a), halves(b), a[0] == b[0]
        parts = [(a0, b0, cost, None), (a1, b1, cost, None), (a0, b1, cost + 1, None), (a1, b0, cost + 1, ~same)]
        x, y, c = [], [], []
        for p, q, d, only in parts:
            ok = (p[0] < p[1]) & (q[0] < q[1]) & (d <= budget) & ~((p[0] == q[0]) & (p[1] - p[0] == 1))
            ok = ok if only is None else ok & only
            x.append(p[:, ok])
            y.append(q[:, ok])
            c.append(d[ok])
        stack.append((depth + 1, np.concatenate(x, 1), np.concatenate(y, 1), np.concatenate(c)))


def stars(ids: np.ndarray, portions) -> tuple[np.ndarray, np.ndarray]:
    """Each id that the pairs link to a smaller one, with the smallest of its group."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    root = np.arange(len(ids))
    for i, j in portions:
        i, j = place[i], place[j]
        while len(i):
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
    moved = root != np.arange(len(ids))
    return ids[order][moved], ids[order][root[moved]]


def _below(rows: DataFrame, fixed: int, budget: int) -> DataFrame:
    """Each row (path, value, id) in budget + 1 orders of the bits after the first `fixed` ones."""
    own = blocks(fixed, budget)

    def each(batch: pa.RecordBatch):
        value = batch.column("value").to_numpy().view(np.uint64)
        for k, (start, length) in enumerate(own):
            turn = turned(value, fixed, start, length)
            at = fixed + length
            yield {"path": pa.array([f"{p}{k}" for p in batch.column("path").to_pylist()]), "head": (turn >> np.uint64(64 - at)).view(np.int64) if at else np.zeros(len(turn), np.int64), "fixed": np.full(len(turn), at, np.int32), "value": turn.view(np.int64), "id": batch.column("id").to_numpy()}

    return common.arrow_map(rows.select("path", "value", "id"), each, "path string, head long, fixed int, value long, id long")


def links(classes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """From the distinct fingerprints (fp, id): edges a, b between ids, stars that connect what the budget links."""
    rows = common.stored(_below(classes.select(F.lit("").alias("path"), F.col("fp").alias("value"), "id"), 0, budget), "trie")
    ready, fixed = [], [blocks(0, budget)]
    level = {length for _, length in fixed[0]}
    while True:
        large = rows.groupBy("path", "head").agg(F.count(F.lit(1)).alias("n"), F.first("fixed").alias("at")).where((F.col("n") > SUBTREE) & (F.col("at") < 60)).select("path", "head", "at")
        ats = [r[0] for r in large.select("at").distinct().collect()]
        if not ats:
            ready.append(rows)
            break
        hot = large.drop("at")
        ready.append(rows.join(hot, ["path", "head"], "left_anti"))
        over = common.stored(rows.join(hot, ["path", "head"], "left_semi"), "trie")
        more = None
        for at in ats:
            part = _below(over.where(F.col("fixed") == at), at, budget)
            more = part if more is None else more.unionByName(part)
        rows = common.stored(more, "trie")
    edges = None
    for part in ready:
        dealt = part.repartition("path", "head").sortWithinPartitions("path", F.expr("value ^ cast(-9223372036854775808 as bigint)"))
        found = dealt.mapInArrow(_walker(budget), "a long, b long")
        edges = found if edges is None else edges.union(found)
    return edges


def _walker(budget: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(table: pa.Table):
        paths, fixed = np.array(table.column("path").to_pylist(), object), table.column("fixed").to_numpy()
        values, ids = table.column("value").to_numpy().view(np.uint64), table.column("id").to_numpy()
        cuts = [0, *(np.flatnonzero(paths[1:] != paths[:-1]) + 1).tolist(), len(paths)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                a, b = stars(ids[s:e], walk(values[s:e], int(fixed[s]), budget))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            path, head = batch.column("path"), batch.column("head")
            if sum(b.num_rows for b in held) < 50_000 or (path[0] == path[-1] and head[0] == head[-1]):
                continue
            heads, paths = head.to_numpy(), path.to_pylist()
            k = batch.num_rows - 1
            while k > 0 and heads[k - 1] == heads[-1] and paths[k - 1] == paths[-1]:
                k -= 1
            yield from solve(pa.Table.from_batches([*held[:-1], batch.slice(0, k)]))
            held = [batch.slice(k)]
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def grouped(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row of docs (doc_id, text)."""
    prints = common.stored(fingerprints(docs, shingle), "fingerprints").withColumn("id", F.coalesce("doc_id", F.lit(LAST)))
    # rows with one doc_id but unlike texts belong together: their fingerprints are linked through the id
    classes = common.stored(prints.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    same_id = prints.join(classes.withColumnRenamed("id", "first"), "fp").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")) if _repeated(prints) else None
    edges = links(classes, budget)
    roots = graph.components(edges if same_id is None else edges.union(same_id))
    named = classes.join(roots, classes["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("root"))
    return prints.join(named, "fp").select("doc_id", "fp", F.expr(f"nullif(root, {LAST})").alias("component_id"))


def _repeated(prints: DataFrame) -> bool:
    return prints.where("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("fp").alias("n")).where("n > 1").limit(1).count() > 0


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """docs, all columns, with one row for each group of fingerprints that links connect: one of its smallest doc_id. Unlike rows that share an id, or have none, are told apart by their fingerprints."""
    prints = common.stored(fingerprints(docs, shingle).select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("fp").alias("node")), "fingerprints")
    classes = common.stored(prints.groupBy("node").agg(F.min("id").alias("id")), "classes")
    # classes are named by their fingerprints, as ids may be shared
    edges = links(classes.select(F.col("node").alias("fp"), F.col("node").alias("id")), budget)
    named = common.stored(named_nodes(prints, graph.components(edges)), "rows")

    def node(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([fingerprint(x, shingle) for x in common.texts(batch)], np.uint64).view(np.int64)

    return kept(docs, named, node)


def named_nodes(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (id, node) with the root of each node that has one, and else the node itself."""
    return rows.join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))


def kept(docs: DataFrame, rows: DataFrame, node) -> DataFrame:
    """docs, all columns, with one row for each root: one of those with its least (id, node).

    rows: id (LAST for null), node and root of every row of docs, stored. node: the nodes of a batch of docs (doc_id, text). Ids
    that no other row has decide by themselves; of the others, null among them, the nodes are made again. Of rows with
    equal id and node any one stays.
    """
    least = common.stored(rows.groupBy("root").agg(F.min(F.struct("id", "node")).alias("least")), "least")
    several = common.stored(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("id") == LAST)).select("id"), "several")
    lost = rows.join(least, "root").where(F.struct("id", "node") != F.col("least")).select("id")
    out = common.stored(lost.union(several).distinct(), "lost")
    id_ = common.unused("_id", docs.columns)
    with_id = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    small = lambda ids: F.broadcast(ids) if common.count_rows(ids) <= BROADCAST_IDS else ids
    named = lambda ids: ids.withColumnRenamed("id", id_)
    single = with_id.join(named(small(out)), id_, "left_anti").select(*docs.columns)
    if not common.count_rows(several):
        return single
    some, node_ = with_id.join(named(small(several)), id_, "left_semi"), common.unused("_node", [*docs.columns, id_])
    schema = some.withColumn(node_, F.lit(0).cast("long")).schema

    def run(batches):
        for whole in batches:
            for batch in common.slices(whole):
                own = node(batch.select(["doc_id", "text"]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, node_])

    chosen = least.select(F.col("least.id").alias(id_), F.col("least.node").alias(node_))
    again = some.mapInArrow(run, schema).join(chosen, [id_, node_], "left_semi").dropDuplicates([id_, node_])
    return single.unionByName(again.select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return grouped(common.table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
