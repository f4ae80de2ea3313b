"""Substring dedup by recompression: words that lie in long passages of documents with smaller ids go.

Words are maximal runs of other characters than ASCII white space, unchanged. A window is WINDOW consecutive words of a
document; each word covered by a window whose words also start in a document with a smaller doc_id goes, judged on the
input. Names are hashes, so equal sequences get equal names in all tasks without asking each other.

Round 1 names pairs: each word is a left or a right one by a bit of its name, and a left word joins the right word
behind it (equal neighbours never join, so a run of one word stays a run of equal symbols). The cut between two words
depends on these two alone; so two equal windows have the same symbols but for a word at either end. Symbols are put
together to phrases of PHRASE words or one more, and of every three neighbouring phrases the one with the least name
is an anchor; a window of 13 words holds three whole phrases away from its ends, and so an anchor that any equal window
has too. Round 2 shuffles anchors and finds those of two documents or more. Round 3 takes the windows around shared
anchors, names them by doubling (1, 2, 4, 8 words, 13), with 128 bits, and shuffles the names: a window's smallest
document is found and the others' windows go.

Both shuffles send packed arrays by bucket of the name. What a task can decide by itself (an anchor in two of its own
documents, a window in a smaller one) isn't sent but once, so a passage in a third of all documents makes one entry for
each task, not one for each document. A null text has no words. Rows with one doc_id are told apart by their text;
none of them is smaller than another. A null doc_id counts as larger than all others. Texts of any length are cut into
windows whole, in chunks of documents; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, PHRASE = 13, 6
#: Words that a task names at a time, and distinct words whose names it keeps.
CHUNK, CACHED = 500_000, 500_000
LAST = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of a sequence from the names of its two parts."""
    x = (left ^ (left >> np.uint64(29))) * _A + (right ^ (right >> np.uint64(32))) * _B
    x ^= x >> np.uint64(31)
    return x * _A


class _Names(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        made = self[word] = xxhash.xxh3_128_digest(word)
        return made


_names = _Names()


def names(words: list[bytes]) -> np.ndarray:
    """Two 64-bit names of each word."""
    return np.frombuffer(b"".join(map(_names.__getitem__, words)), "<u8").reshape(-1, 2)


def anchors(name: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the anchors in documents that lie one behind another and end at ends."""
    n = len(name)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    right = (name >> np.uint64(17)) & np.uint64(1) > 0
    joins = np.zeros(n, bool)  # with the word before
    joins[1:] = ~right[:-1] & right[1:]
    last = np.zeros(n + 1, bool)
    last[ends] = True
    joins[last[:n]] = False
    start = np.flatnonzero(~joins)
    size = np.diff(np.append(start, n))
    symbol = np.where(size == 2, mixed(name[start], name[np.minimum(start + 1, n - 1)]), name[start])
    document = np.searchsorted(ends, start, "right")
    # phrases: as few symbols from each one on as have PHRASE words
    m = len(start)
    phrase, words, done = symbol.copy(), size.copy(), size >= PHRASE
    whole = np.ones(m, bool)
    for k in range(1, PHRASE):
        at = np.arange(m) + k
        ok = (at < m) & ~done
        at = np.minimum(at, m - 1)
        ok_here = ok & (document[at] == document)
        whole &= done | ok_here
        phrase = np.where(ok_here, mixed(phrase, symbol[at]), phrase)
        words = np.where(ok_here, words + size[at], words)
        done = done | (words >= PHRASE)
    whole &= done
    value = np.where(whole, phrase, np.uint64(0xFFFFFFFFFFFFFFFF))
    chosen = np.zeros(m, bool)
    if m >= 3:
        three = np.stack([value[:-2], value[1:-1], value[2:]])
        ok = whole[:-2] & whole[1:-1] & whole[2:] & (document[:-2] == document[2:])
        chosen[(np.argmin(three, 0) + np.arange(m - 2))[ok]] = True
    at = np.flatnonzero(chosen)
    return phrase[at], start[at]


def windows(name: np.ndarray) -> np.ndarray:
    """128-bit names of all windows of one sequence of words, named by doubling."""
    out = []
    for k in range(2):
        one = name[:, k]
        two = mixed(one[:-1], one[1:])
        four = mixed(two[:-2], two[2:])
        eight = mixed(four[:-4], four[4:])
        n = len(one) - WINDOW + 1
        out.append(mixed(mixed(eight[:n], four[8 : 8 + n]), one[12 : 12 + n]))
    return np.stack(out, 1)


_zstd = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
_SENT = "bucket int, source long, kind int, name binary, doc binary, place binary"
_FOUND = "bucket int, doc binary, place binary"
_PLACES = "doc_id long, row long, places binary"


def _pressed(values: np.ndarray) -> bytes:
    return _zstd[0].compress(np.ascontiguousarray(values).tobytes())


def _opened(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_zstd[1].decompress(raw), kind)


def _row(bucket: int, source: int, kind: int, name: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple:
    return bucket, source, kind, name.tobytes(), _pressed(doc), _pressed(place.astype("<u4"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "source", "kind", "name", "doc", "place"])


def _chunks(batch: pa.RecordBatch):
    """Documents (doc_id, row, words) of a batch, as many at a time as have CHUNK words."""
    held, size = [], 0
    columns = (batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), common.texts(batch))
    for doc_id, row, text in zip(*columns, strict=True):
        own = text.split()
        if len(own) < WINDOW:
            continue
        held.append((doc_id, row, own))
        size += len(own)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sent(source: int, buckets: int, name: np.ndarray, doc: np.ndarray, place: np.ndarray, send: np.ndarray, decided: np.ndarray) -> list[tuple]:
    """A row for each bucket of what is sent, and one of what is decided. doc: doc_id and row of each entry."""
    rows = []
    if decided.any():
        rows.append(_row(int(source % buckets), source, 1, np.zeros(0, np.uint64), doc[decided], place[decided]))
    name, doc, place = name[send], doc[send], place[send]
    bucket = ((name if name.ndim == 1 else name[:, 0]) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((place, doc[:, 0], bucket))  # by document, as that packs best
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[b] : edges[b + 1]]
        rows.append(_row(b, source, 0, name[own], doc[own], place[own]))
    return rows


def _anchor_rows(buckets: int):
    def run(batches):
        source = TaskContext.get().partitionId() << 24
        for batch in batches:
            for held in _chunks(batch):
                ends = np.cumsum([len(w) for _, _, w in held])
                name, at = anchors(names([x for _, _, w in held for x in w])[:, 0], ends)
                which = np.searchsorted(ends, at, "right")
                place = at - np.concatenate([[0], ends])[which]
                order = np.lexsort((which, name))
                name, which, place = name[order], which[order], place[order]
                if len(name):
                    new = np.concatenate([[True], name[1:] != name[:-1]])
                    group = np.cumsum(new) - 1
                    first = np.flatnonzero(new)
                    many = which[np.append(first[1:], len(name)) - 1] != which[first]
                    # one entry stands for an anchor that two documents here share; -1 marks that it is decided
                    decided = many[group]
                    doc = np.stack([np.array([d for d, _, _ in held], np.int64)[which], np.zeros(len(which), np.int64)], 1)
                    yield _batch(_sent(source, buckets, name, doc, np.where(decided, 0xFFFFFFFF, place), ~decided | new, np.zeros(len(name), bool)) + _sent(source, buckets, name, doc, place, np.zeros(len(name), bool), decided))
                source += 1

    return run


def _window_rows(buckets: int):
    def run(batches):
        source = TaskContext.get().partitionId() << 24
        for batch in batches:
            starts = {(d, r): _opened(p, "<u4") for d, r, p in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("places").to_pylist(), strict=True)}
            for held in _chunks(batch):
                made, docs, places = [], [], []
                for doc_id, row, own in held:
                    at, n = starts[doc_id, row].astype(np.int64), len(own) - WINDOW + 1
                    around = np.zeros(n + WINDOW + 1, np.int64)
                    np.add.at(around, np.clip(at + PHRASE - WINDOW, 0, n), 1)
                    np.add.at(around, np.clip(at + 1, 0, n), -1)
                    own_at = np.flatnonzero(np.cumsum(around)[:n] > 0)
                    made.append(windows(names(own))[own_at])
                    docs.append(np.tile(np.array([[doc_id, row]], np.int64), (len(own_at), 1)))
                    places.append(own_at)
                name, doc, place = np.concatenate(made), np.concatenate(docs), np.concatenate(places)
                if len(name):
                    order = np.lexsort((doc[:, 0], name[:, 1], name[:, 0]))
                    name, doc, place = name[order], doc[order], place[order]
                    new = np.concatenate([[True], (name[1:] != name[:-1]).any(1)])
                    later = doc[:, 0] > doc[np.flatnonzero(new)[np.cumsum(new) - 1], 0]
                    yield _batch(_sent(source, buckets, name, doc, place, ~later, later))
                source += 1

    return run


def _held(batches):
    """The rows of each bucket together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _gathered(wide: int, buckets: int, pick):
    """Each bucket's entries together; pick says which of them are found. Decided ones are found anyway. What is found is packed by bucket of the document."""

    def run(batches):
        for rows in _held(batches):
            doc = [_opened(r["doc"], "<i8").reshape(-1, 2) for r in rows]
            place = [_opened(r["place"], "<u4") for r in rows]
            sent = [k for k, r in enumerate(rows) if not r["kind"]]
            found_doc, found_place = [doc[k] for k, r in enumerate(rows) if r["kind"]], [place[k] for k, r in enumerate(rows) if r["kind"]]
            if sent:
                d, p = np.concatenate([doc[k] for k in sent]), np.concatenate([place[k] for k in sent])
                name = np.concatenate([np.frombuffer(rows[k]["name"], np.uint64).reshape(-1, wide) for k in sent])
                source = np.repeat([rows[k]["source"] for k in sent], [len(place[k]) for k in sent])
                order = np.lexsort((d[:, 0], *name.T))
                name, d, p, source = name[order], d[order], p[order], source[order]
                found = pick(np.concatenate([[True], (name[1:] != name[:-1]).any(1)]), d, p, source)
                found_doc.append(d[found])
                found_place.append(p[found])
            d, p = np.concatenate(found_doc), np.concatenate(found_place)
            to = ((d[:, 0].astype(np.uint64) * _A >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((d[:, 1], d[:, 0], to))
            d, p, edges = d[order], p[order], np.searchsorted(to[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges)).tolist()
            cut = [slice(edges[b], edges[b + 1]) for b in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_pressed(d[c]) for c in cut], pa.binary()), pa.array([_pressed(p[c]) for c in cut], pa.binary())], names=["bucket", "doc", "place"])

    return run


def _by_document(batches):
    """One row for each document of a bucket, with all its places in order."""
    for rows in _held(batches):
        d = np.concatenate([_opened(r["doc"], "<i8").reshape(-1, 2) for r in rows])
        p = np.concatenate([_opened(r["place"], "<u4") for r in rows])
        order = np.lexsort((p, d[:, 1], d[:, 0]))
        d, p = d[order], p[order]
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]).any(1)])) if len(d) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(d)).tolist()
        packed = [_pressed(np.unique(p[a:b])) for a, b in zip(first.tolist(), ends, strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(d[first, 0]), pa.array(d[first, 1]), pa.array(packed, pa.binary())], names=["doc_id", "row", "places"])


def _shared(new: np.ndarray, doc: np.ndarray, place: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Entries of anchors that came from two tasks' documents or were decided in one."""
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    low, high = np.minimum.reduceat(source, first), np.maximum.reduceat(source, first)
    return (low != high)[group] & (place != 0xFFFFFFFF)


def _later(new: np.ndarray, doc: np.ndarray, place: np.ndarray, source: np.ndarray) -> np.ndarray:
    return doc[:, 0] > doc[np.flatnonzero(new)[np.cumsum(new) - 1], 0]


def _dealt(sent: DataFrame) -> DataFrame:
    return sent.repartition("bucket").sortWithinPartitions("bucket")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, row, text and removed (window starts, packed) of the documents (doc_id not null, row, text) that lose words."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = lambda sent, wide, pick: _dealt(_dealt(sent).mapInArrow(_gathered(wide, buckets, pick), _FOUND)).mapInArrow(_by_document, _PLACES)
    places = found(docs.mapInArrow(_anchor_rows(buckets), _SENT), 1, _shared).select("doc_id", "places")
    some = common.stored(docs.join(places, "doc_id").select("doc_id", "row", "text", "places"), "candidates")
    gone = found(some.mapInArrow(_window_rows(buckets), _SENT), 2, _later).withColumnRenamed("places", "removed")
    return some.select("doc_id", "row", "text").join(gone, ["doc_id", "row"])


def _kept(words: list[bytes], removed: bytes) -> tuple[int, bytes]:
    gone = np.zeros(len(words) + 1, np.int64)
    at = _opened(removed, "<u4").astype(np.int64)
    gone[at] += 1
    np.add.at(gone, at + WINDOW, -1)
    lost = np.cumsum(gone)[:-1] > 0
    return int(lost.sum()), b" ".join([w for w, x in zip(words, lost.tolist(), strict=True) if not x])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_removed and kept (the words that stay, joined by one space) of the documents that lose words."""

    def each(batch: pa.RecordBatch) -> dict:
        made = [_kept(t.split(), r) for t, r in zip(common.texts(batch), batch.column("removed").to_pylist(), strict=True)]
        return {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "n_removed": [n for n, _ in made], "kept": pa.array([k.decode() for _, k in made], pa.string())}

    return common.arrow_map(repeats(_rows(docs)), each, "doc_id long, row long, n_removed long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")

    def each(batch: pa.RecordBatch) -> dict:
        own = [t.split() for t in common.texts(batch)]
        return {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "n_words": [len(w) for w in own], "whole": [hashlib.sha256(b" ".join(w)).hexdigest() for w in own]}

    whole = common.arrow_map(_rows(docs), each, "doc_id long, row long, n_words long, whole string")
    less = deduplicated(docs).select("doc_id", "row", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["doc_id", "row"])
    out = whole.join(less, ["doc_id", "row"], "left")
    return out.select(F.expr(f"nullif(doc_id, {LAST})").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY win) AS first FROM x) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT words.doc_id, count(gone.k) AS n_removed, string_agg(word, ' ' ORDER BY words.k) FILTER (WHERE gone.k IS NULL) AS kept
                  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY words.doc_id) r ON d.doc_id = r.doc_id
"""
