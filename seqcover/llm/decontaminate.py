"""Benchmark decontamination by Wu-Manber search over words.

A-Z becomes a-z, and words are maximal runs of digits, a-z and bytes above ASCII. The test strings are the windows of
WINDOW consecutive words of each benchmark item; an item of fewer words, but not none, is one window, one without
words has none. Windows of one length are searched together: a table over blocks of two consecutive words says how
far the search may move on without missing a window (a block that no window has: by the whole window less one word);
where it says zero, the hash of the window's last block picks the windows that end so, and they are compared word by
word. Each document word inside an occurrence is hit.

Words are compared as bytes in full. Benchmarks of any size are taken in blocks of at most BLOCK_WORDS window words,
each a pass of its own over the documents without a shuffle; what was found so far travels along. Null texts have no
words; items that are null or share an id count under that id; rows that repeat are each judged, those without an id too.
Texts of any length are searched whole; no rows give no rows, and an empty benchmark hits nothing. Items that hold one
window alike are all counted.
"""

from __future__ import annotations

import hashlib
import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: a-z for A-Z, digits, a-z and what is beyond ASCII as they are, a space for the rest.
_SPELT = bytes(c if c >= 128 or chr(c) in string.digits + string.ascii_lowercase else ord(chr(c).lower()) if chr(c) in string.ascii_uppercase else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_SPELT).split()


class Windows:
    """Shift and suffix tables for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[str]]):
        self.length, self.width, self.windows = length, min(2, length), windows
        self.shift: dict = {}
        self.ends: dict = defaultdict(list)
        for window in windows:
            for k in range(length - self.width + 1):
                block = self._block(window, k)
                self.shift[block] = min(self.shift.get(block, length), length - self.width - k)
            self.ends[self._block(window, length - self.width)].append(window)

    def _block(self, own, k: int):
        return own[k] if self.width == 1 else (own[k], own[k + 1])

    def find(self, own: list[bytes], hit: np.ndarray, items: set[str]) -> None:
        """Marks the hit words of one document and adds the items whose windows occur."""
        m, n, w = self.length, len(own), self.width
        skip, shift, ends, windows = m - w + 1, self.shift, self.ends, self.windows
        at = m - w  # of the window's last block
        while at <= n - w:
            move = shift.get(own[at] if w == 1 else (own[at], own[at + 1]), skip)
            if move:
                at += move
                continue
            begin = at + w - m
            for window in ends[self._block(own, at)]:
                if all(map(bytes.__eq__, window, own[begin : begin + m])):
                    hit[begin : begin + m] = True
                    items.update(windows[window])
            at += 1


class Searcher:
    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        by_length: dict = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            own = words(text)
            for k in range(max(1, len(own) - window + 1) if own else 0):
                piece = tuple(own[k : k + window])
                if item not in by_length[len(piece)][piece]:
                    by_length[len(piece)][piece].append(item)
        self.tables = [Windows(length, dict(found)) for length, found in sorted(by_length.items())]

    def find(self, own: list[bytes]) -> tuple[np.ndarray, set[str]]:
        hit, items = np.zeros(len(own), bool), set()
        for table in self.tables:
            table.find(own, hit, items)
        return hit, items


def _blocks(benchmark: DataFrame):
    """The benchmark in blocks of whole items, each of at most BLOCK_WORDS window words (or one item), one at a time."""
    sized = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total * WINDOW // 2 // BLOCK_WORDS) or 1  # a word and its space are two characters at least
    for k in range(n):
        own = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else sized
        yield [(x.item_id or "", x.text.encode()) for x in own.collect()]


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of docs with its columns and, behind them, hit (a bit for each word, as packed bytes) and items (sorted array), under unused names."""
    h, i = common.unused("_hit", docs.columns), common.unused("_items", docs.columns)
    out = docs.select(*docs.columns, F.lit(None).cast("binary").alias(h), F.array().cast("array<string>").alias(i))
    spark, schema = docs.sparkSession, out.schema
    for items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            searcher = Searcher(shared.value)
            for batch in batches:
                hits, found = [], []
                for text, before, had in zip(common.texts(batch), batch.column(h).to_pylist(), batch.column(i).to_pylist(), strict=True):
                    own = words(text)
                    hit, names = searcher.find(own)
                    if before is not None:
                        hit |= np.unpackbits(np.frombuffer(before, np.uint8), count=len(own)).astype(bool)
                    hits.append(np.packbits(hit).tobytes())
                    found.append(sorted(names | set(had)))
                k, j = batch.schema.get_field_index(h), batch.schema.get_field_index(i)
                yield batch.set_column(k, batch.schema.field(k), pa.array(hits, batch.schema.field(k).type)).set_column(j, batch.schema.field(j), pa.array(found, batch.schema.field(j).type))

        out = out.mapInArrow(run, schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs (doc_id, text)."""
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def each(batch: pa.RecordBatch) -> dict:
        hit = [int(np.unpackbits(np.frombuffer(x or b"", np.uint8)).sum()) for x in batch.column("_hit").to_pylist()]
        items = batch.column("_items").to_pylist()
        return {
            "doc_id": batch.column("doc_id").cast(pa.int64()),
            "n_words": [len(words(x)) for x in common.texts(batch)],
            "n_hit": hit,
            "n_items": [len(x) for x in items],
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
            "contaminated": [x > 0 for x in hit],
        }

    return common.arrow_map(search(docs.select("doc_id", "text"), benchmark), each, schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that hold a benchmark window."""
    found = search(docs, benchmark)
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
