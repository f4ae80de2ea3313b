"""Scores of texts under a causal self-attention model of subword ids, beside a unigram base.

A-Z becomes a-z; the tokens of a text are its words (maximal runs of other characters than ASCII white space) and then
one end. Texts whose crc32 of doc_id as text leaves 1 when divided by 5 are held out; the others are learnt from (a null
id is never held out, a null text is empty).

Base: counts of all training tokens, by one shuffle of counts summed in each task. The HEAD most frequent words (a
bounded number) go to the tasks; rarer ones are joined with their counts, one row for each document and word.

Model: the ids of each word by byte pairs merged in the order learnt from the counts of the HEAD most frequent words (all
bytes and the merges, SUBWORDS in all at most), and an end id. Texts are turned into ids once; the table of ids is stored and read
by all that follows. The first logits come from counts of ids behind one id, and behind the CONTEXTS most frequent pairs of ids, over all training tokens (by
one shuffle; no more than SUBWORDS squared, and CONTEXTS times SUBWORDS, sums reach the driver). Its weights learn from
every span of every training text: trainers work side by side, as many as have TRAINER_SPANS spans in each of ROUNDS
rounds, each on its share of the texts, and their weights are averaged after each round; fewer than LEAST_SPANS spans
are gone over several times. Scoring cuts each text into spans that overlap with the one before, so that each token is
scored once, with SPAN to 2 * SPAN - 1 ids of context.

Rows are scored one by one: equal texts get equal scores (the least, where rounding sets them apart), texts of any length are scored whole, an empty text is its
end alone, columns other than doc_id and text are left out. Without training texts all shares are even; no rows give no
rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention, common

VOCABULARY, SUBWORDS = "byte_bpe_multi_50k.tiktoken", 1024
#: Pairs that occur less often aren't merged: too little would be counted behind them.
LEAST_PAIRS = 400
HEAD, HEAD_BYTES = 65_536, 64
CONTEXTS = 4096
ROUNDS, BATCH, RATE = 2, 256, 0.015
TRAINER_SPANS, LEAST_SPANS = 400_000, 240_000
#: Spans that are made, and that are scored, at a time.
MADE, CHUNK = 4096, 512
CACHED = 300_000
#: Bytes of texts whose words are looked up together, and texts whose spans are made together.
GATHERED, TOGETHER = 4 << 20, 256
JOINED = 1000
PARTS = 32
END = ""


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


class Words:
    """The words of texts as tokens() has them: the different ones, which one each is, and how many each text has."""

    def __init__(self, texts: pa.Array):
        if texts.offset:  # Arrow reads slices that were cast from the wrong place
            texts = texts.take(pa.array(np.arange(len(texts))))
        cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null(""))))
        words = cut.flatten().dictionary_encode()
        self.different = words.dictionary
        self.names: list[bytes] = self.different.cast(pa.large_binary()).to_pandas().tolist()
        self.which, self.sizes = words.indices.to_numpy(), cut.value_lengths().to_numpy().astype(np.int64)
        if b"" in self.names:  # of texts without words
            empty = self.which == self.names.index(b"")
            self.sizes -= np.bincount(self.text_of()[empty], minlength=len(self.sizes))
            self.which = self.which[~empty]

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Subwords(dict):
    """Little-endian 16-bit ids of each word."""

    def __init__(self, path: str | tuple[bytes, ...], size: int):
        """path: of a vocabulary's file, of which the first ranks are taken, or the pieces by rank."""
        import tiktoken

        super().__init__()
        if isinstance(path, str):
            pattern = public_tokenizers.PATTERN
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if int(rank) < size}
        else:
            pattern, ranks = " [^ ]*|[^ ]+", {piece: rank for rank, piece in enumerate(path[:size])}
        self.coding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = np.array([size], "<u2").tobytes()
        self.begins = np.array([token[:1] == b" " for token, _ in sorted(ranks.items(), key=lambda x: x[1])])

    def __missing__(self, word: bytes) -> bytes:
        made = self.made(word)
        if len(word) <= HEAD_BYTES:
            if len(self) >= CACHED:
                self.clear()
            self[word] = made
        return made

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)) + self.end, "<u2").astype(np.int64)

    def _joined(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, from one text of all of them: the pattern cuts before each of its spaces if there is no other white space in it."""
        text = b" ".join([b"", *words]).decode()
        if len(text.split()) == len(words):
            ids = np.array(self.coding.encode_ordinary(text), "<u2")
            at, raw = (2 * np.flatnonzero(self.begins[ids])).tolist(), ids.tobytes()
            if len(at) == len(words):
                return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)]
        return [self.made(w) for w in words]

    def made(self, word: bytes) -> bytes:
        return np.array(self.coding.encode_ordinary(" " + word.decode()), "<u2").tobytes() if word else b""

    def documents(self, words: Words) -> list[np.ndarray]:
        """The 16-bit ids of each text; each different word is looked up once."""
        if len(self) >= CACHED:
            self.clear()
        own = list(map(self.get, words.names))
        new = [k for k, x in enumerate(own) if x is None]
        for a in range(0, len(new), JOINED):
            some = [words.names[k] for k in new[a : a + JOINED]]
            for k, x in zip(new[a : a + JOINED], self._joined(some), strict=True):
                own[k] = x
        self.update((words.names[k], own[k]) for k in new if len(words.names[k]) <= HEAD_BYTES)
        found = pa.array([*own, self.end], pa.large_binary())
        which = np.insert(words.which, np.cumsum(words.sizes), len(words.names))
        _, offsets, data = common.joined(found.take(pa.array(which)), words.sizes + 1).buffers()
        ids, ends = np.frombuffer(data, "<u2"), np.frombuffer(offsets, "<i8", len(words.sizes) + 1) >> 1
        return [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


_subwords: dict[tuple[str | tuple[bytes, ...], int], Subwords] = {}


def subwords(path: str | tuple[bytes, ...], size: int) -> Subwords:
    if (path, size) not in _subwords:
        _subwords[path, size] = Subwords(path, size)
    return _subwords[path, size]


def pieces(found: dict[bytes, int], size: int) -> tuple[bytes, ...]:
    """All bytes, then the byte pairs to merge, most frequent first (ties: first in order), learnt from counts of words: size of them, or fewer if what is left occurs less than LEAST_PAIRS times."""
    words = [([b"%c" % x for x in b" " + w], n) for w, n in found.items() if w]
    pairs, where = Counter(), defaultdict(set)
    for k, (parts, n) in enumerate(words):
        for pair in zip(parts, parts[1:], strict=False):
            pairs[pair] += n
            where[pair].add(k)
    made = dict.fromkeys(b"%c" % x for x in range(256))
    heap = [(-n, pair) for pair, n in pairs.items()]
    heapq.heapify(heap)
    while heap and len(made) < size:
        n, pair = heapq.heappop(heap)
        if -n < LEAST_PAIRS:
            break
        if -n != pairs[pair]:  # a count that has changed since
            continue
        made.setdefault(pair[0] + pair[1])
        changed = set()
        for k in where.pop(pair):
            parts, n = words[k]
            merged, at = [], 0
            while at < len(parts):
                both = at + 1 < len(parts) and parts[at] == pair[0] and parts[at + 1] == pair[1]
                merged.append(pair[0] + pair[1] if both else parts[at])
                at += 1 + both
            for old in zip(parts, parts[1:], strict=False):
                pairs[old] -= n
                changed.add(old)
            for new in zip(merged, merged[1:], strict=False):
                pairs[new] += n
                where[new].add(k)
                changed.add(new)
            words[k] = merged, n
        for other in changed:
            if pairs[other] > 0:
                heapq.heappush(heap, (-pairs[other], other))
    return tuple(made)


def counts(docs: DataFrame) -> DataFrame:
    """word and c of all training tokens; the end is the empty word."""

    def run(batches):
        held = []

        def summed():
            return pa.Table.from_batches(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"]).combine_chunks()

        for batch in common.gathered(batches, GATHERED):
            own = pa.array([not held_out(i) for i in batch.column("doc_id").to_pylist()], pa.bool_())
            words = Words(batch.column("text").filter(own))
            c = np.bincount(words.which, minlength=len(words.names))
            some = np.flatnonzero(c)
            held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([words.different.take(pa.array(some)).cast(pa.string()), pa.array([END])]), pa.array([*c[some].tolist(), len(words.sizes)], pa.int64())], names=["word", "c"]))
            if sum(x.num_rows for x in held) > 1_000_000:
                held = summed().to_batches()
                if sum(x.num_rows for x in held) > 400_000:
                    yield from held
                    held = []
        if held:
            yield from summed().to_batches()

    sums = docs.select("doc_id", "text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return sums.where(F.col("c") > 0)


def statistics(word_counts: DataFrame, path: str | tuple[bytes, ...], size: int, contexts: int) -> attention.Shape:
    """The model's shape and first logits, from counts of ids behind one and two others in all training tokens."""
    m = size + 2

    def run(batches):
        get = subwords(path, size)
        for batch in (part for whole in batches for part in common.slices(whole, 4096)):
            words = [np.frombuffer(get[w.encode()], "<u2") if w else np.array([size], "<u2") for w in batch.column("word").to_pylist()]
            code, word = attention.triples(words, size)
            code, which = np.unique(code, return_inverse=True)
            n = np.zeros(len(code), np.int64)
            np.add.at(n, which.reshape(-1), batch.column("c").to_numpy()[word])
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    found = common.stored(word_counts.select("word", "c").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "triples")
    before, last, next_ = F.floor(F.col("code") / (m * m)).alias("before"), F.floor(F.col("code") / m) % m, F.col("code") % m
    apart = found.select(before, last.alias("last"), next_.alias("next"), "n")
    one = apart.groupBy("last", "next").agg(F.sum("n").alias("n")).toPandas()
    often = apart.where(F.col("last") != size + 1).groupBy("before", "last").agg(F.sum("n").alias("whole")).orderBy(F.desc("whole"), "before", "last").limit(contexts)
    two = apart.join(F.broadcast(often.drop("whole")), ["before", "last"]).select("before", "last", "next", "n").toPandas()
    common.forget(found)
    order = lambda frame: frame.sort_values(list(frame.columns)).to_numpy(np.int64).reshape(-1, len(frame.columns))
    return attention.Shape(size, subwords(path, size).begins, order(one), order(two))


def coded(docs: DataFrame, path: str | tuple[bytes, ...], size: int, base: dict[bytes, float] | None = None) -> DataFrame:
    """One row for each row of docs: a key, doc_id, held_out, n_tokens, the 16-bit ids of the text, how many of its words base has and the sum of their values, and the other words with how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast(base or {})

    def run(batches):
        known, get = shared.value, subwords(path, size)
        key = TaskContext.get().partitionId() << 40
        for batch in common.gathered(batches, GATHERED):
            doc_ids, n, words = batch.column("doc_id").to_pylist(), batch.num_rows, Words(batch.column("text"))
            of, got = words.text_of(), np.array([known.get(w, math.nan) for w in words.names])[words.which]
            rare = np.isnan(got)
            # rare words of each document, and how often
            pairs, times = np.unique(of[rare] * max(1, len(words.names)) + words.which[rare], return_counts=True)
            where, which = np.divmod(pairs, max(1, len(words.names)))
            ends = pa.array(np.searchsorted(where, np.arange(n + 1)), pa.int32())
            others = pa.MapArray.from_arrays(ends, words.different.take(pa.array(which)).cast(pa.string()), pa.array(times, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(key, key + n)), pa.array(doc_ids, pa.int64()), pa.array([held_out(i) for i in doc_ids], pa.bool_()), pa.array(words.sizes + 1), pa.array([x.tobytes() for x in get.documents(words)], pa.binary()), pa.array(words.sizes - np.bincount(of[rare], minlength=n)), pa.array(np.bincount(of[~rare], got[~rare], n), pa.float64()), others],
                names=["key", "doc_id", "held_out", "n_tokens", "ids", "known", "base", "rare"],
            )
            key += n

    return docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, ids binary, known long, base double, rare map<string, long>")


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]


def trained(docs: DataFrame, word_counts: DataFrame, path: str | tuple[bytes, ...], size: int = SUBWORDS) -> tuple[attention.Shape, dict]:
    ids = common.stored(coded(docs, path, size).select("doc_id", "held_out", "ids"), "ids")
    try:
        shared, p = learnt(ids, word_counts, path, size)
        return shared.value, p
    finally:
        common.forget(ids)


def learnt(ids: DataFrame, word_counts: DataFrame, path: str | tuple[bytes, ...], size: int) -> tuple[Broadcast, dict]:
    """The model's shape, sent to the executors once, and its weights. ids: as coded() makes them."""
    shape = statistics(word_counts, path, size, CONTEXTS)
    p, sent = shape.parameters(), ids.sparkSession.sparkContext.broadcast(shape)
    n = int(shape.counts.sum()) // attention.SPAN
    if not shape.counts.any():
        return sent, p
    trainers, passes = max(1, n // (ROUNDS * TRAINER_SPANS)), max(1, -(-LEAST_SPANS // max(1, n)))
    texts = ids.where(~F.col("held_out")).select("ids", F.xxhash64("doc_id", "ids").alias("at"))
    spark = ids.sparkSession
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast(p)
        own = texts.where(F.pmod("at", F.lit(ROUNDS)) == k).repartition(trainers, "at")
        rates = RATE * (1 - k / ROUNDS), RATE * (1 - (k + 1) / ROUNDS)
        weights = own.sortWithinPartitions("at").mapInArrow(_trainer(sent, start, passes, rates), "n long, weights binary")
        rows = weights.repartition(min(trainers, 16)).mapInArrow(_summed, "n long, weights binary").collect()
        if rows:
            mean = sum(np.frombuffer(r.weights, "<f8") for r in rows) / max(1, sum(r.n for r in rows))
            p = attention.unpacked(p, mean.astype("<f4").tobytes())
    return sent, p


def _trainer(sent: Broadcast, start: Broadcast, passes: int, rates: tuple[float, float]):
    """rates: at first and at last."""

    def run(batches):
        shape = sent.value
        # about TRAINER_SPANS spans, as 16-bit ids
        held = [x for batch in batches for x in _ids(batch)]
        if not held:
            return
        sizes = np.array([-(-len(x) // attention.SPAN) for x in held])
        p, rng, n, done = {name: x.copy() for name, x in start.value.items()}, np.random.default_rng(5), int(sizes.sum()), 0
        adam = attention.Adam(p)
        for _ in range(passes):
            order = rng.permutation(len(held))
            chunk = np.cumsum(sizes[order]) // MADE
            for group in np.split(order, np.flatnonzero(np.diff(chunk)) + 1):
                spans = attention.Spans(shape, [held[k].astype(np.int64) for k in group])
                for k in rng.permutation(-(-len(spans) // BATCH)).tolist():
                    part = spans.part(k * BATCH, (k + 1) * BATCH)
                    rate = rates[0] + (rates[1] - rates[0]) * done / (passes * n)
                    adam.step(p, attention.gradients(shape, p, *part), rate + 1e-4)
                    done += len(part[0])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([attention.packed(p)], pa.binary())], names=["n", "weights"])

    return run


def _summed(batches):
    n, total = 0, None
    for batch in batches:
        for own, raw in zip(batch.column("n").to_pylist(), batch.column("weights").to_pylist(), strict=True):
            part = np.frombuffer(raw, "<f4").astype(float) * own
            n, total = n + own, part if total is None else total + part
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["n", "weights"])


def _head(word_counts: DataFrame) -> tuple[int, dict[bytes, int]]:
    """The least count of words of the head, and the head: as many of the most frequent counts as make at most HEAD short words."""
    short = word_counts.where(F.octet_length("word") <= HEAD_BYTES)
    least, room = 1 << 62, HEAD
    # counts of counts: one number for each count, summed for the rare ones, which no head of this size reaches in full
    by_count = short.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(HEAD).collect()
    for row in by_count:
        if row.n > room:
            break
        least, room = row.c, room - row.n
    return least, {r.word.encode(): r.c for r in short.where(F.col("c") >= least).collect()}


def scored(docs: DataFrame, path: str | None = None, size: int = SUBWORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of docs (doc_id, text). path: of a vocabulary to take instead of learning one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    word_counts = common.stored(counts(docs), "counts")
    total, distinct = word_counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least, head = _head(word_counts)
    if path is None:
        path = pieces(head, size)
        size = len(path)
    below = math.log10(total + 0.5 * (distinct + 1))
    base = {w: math.log10(c + 0.5) - below for w, c in head.items() if w}
    end_known = int(head.get(b"", 0) > 0)
    end_base = math.log10(head.get(b"", 0) + 0.5) - below
    ids = common.stored(coded(docs, path, size, base), "ids")
    sent, p = learnt(ids, word_counts, path, size)
    weights = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        shape, p = sent.value, weights.value
        ready = attention.tables(p)
        for batch in (part for whole in batches for part in common.slices(whole, TOGETHER)):
            scores = _scores(shape, p, ready, [x.astype(np.int64) for x in _ids(batch)])
            same = [hashlib.blake2b(x, digest_size=16).digest() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), pa.array(same, pa.binary()), pa.array(scores)], names=[*names, "same", "score"])

    names = ["key", "doc_id", "held_out", "n_tokens", "known", "base"]
    whole = ids.select(*names, "ids").mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, same binary, score double")
    rare = word_counts.where((F.col("c") < least) | (F.octet_length("word") > HEAD_BYTES))
    c = F.coalesce("c", F.lit(0))
    others = ids.select("key", F.explode("rare").alias("word", "times")).join(rare, "word", "left")
    more = others.groupBy("key").agg(F.sum(F.col("times") * (F.log10(c + 0.5) - below)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("found"))
    out = whole.join(more, "key", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    made = common.stored(out.select("key", "same", "doc_id", "held_out", "n_tokens", (F.col("known") + zero("found") + end_known).alias("n_known"), (F.col("base") + zero("more") + end_base).alias("base_score"), "score"), "scores")
    # products of matrices round by a row's place among others: of equal texts the least sum counts; many equal texts are dealt out over PARTS tasks
    sums = made.groupBy("same").agg(*(f(name).alias(f"{f.__name__}_{name}") for name in ("base_score", "score") for f in (F.min, F.max)))
    apart = sums.where((F.col("min_base_score") < F.col("max_base_score")) | (F.col("min_score") < F.col("max_score"))).select("same", "min_base_score", "min_score", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    even = made.withColumn("part", F.pmod("key", F.lit(PARTS)).cast("int")).join(apart, ["same", "part"], "left")
    return even.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.coalesce("min_base_score", "base_score").alias("base_score"), F.coalesce("min_score", "score").alias("score"))


def _scores(shape: attention.Shape, p: dict, ready: dict, documents: list[np.ndarray]) -> np.ndarray:
    spans, out = attention.Spans(shape, documents), np.zeros(len(documents))
    for k in range(0, len(spans), CHUNK):
        found = attention.log_probabilities(shape, p, ready, *spans.part(k, k + CHUNK), spans.given[k - 1] if k else None)
        np.add.at(out, spans.document[k : k + CHUNK], found.sum(1))
    return out / math.log(10)


def query(spark, sf_dir: str) -> DataFrame:
    return scored(common.table(spark, sf_dir, "documents"))
