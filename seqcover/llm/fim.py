"""Fill-in-the-middle: a text is cut at two units into prefix, middle and suffix, which are written in another order.

Units are runs of A-Z and a-z, and every other code point alone. Three hashes of the document's id decide where the cuts
are and which form is written (plain, psm or spm), so that nothing depends on partitions or on a random state.

Each text is laid out in fixed blocks of BLOCK bytes of its UTF-8. A Fenwick tree over the blocks has the units that
begin in them and another the code points; a descent by halving powers of two finds the block in which the unit of a cut
begins, and the code points before it on the way; within the block the unit is counted off. A tree takes one number for
each block, and the descent as many steps as the number of blocks has bits.

A null text is empty. Empty texts, and texts with one of the three marks in them, are plain, so that the exact text can
be rebuilt from any output. A null id is hashed as no digits at all. Repeated rows give the same row each; texts of any
length are taken whole, one at a time; other columns stay and those of the same names are replaced. No rows: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 512
MARKS = ("<P>", "<S>", "<M>")
#: In hundredths: texts that are rearranged, and those of them in the order suffix, prefix, middle.
RATE, SPM = 90, 20
ROWS = 64


class Blocks:
    """Units and code points of a text (UTF-8 bytes) by blocks: where the k-th unit begins, and how many code points stand before a byte."""

    def __init__(self, text: bytes):
        b = np.frombuffer(text, np.uint8)
        low = b | 32
        letter = (low >= 97) & (low <= 122)
        self.points = (b & 0xC0) != 0x80
        self.units = self.points.copy()
        self.units[1:] &= ~(letter[1:] & letter[:-1])
        self.length, self.n = len(b), int(self.units.sum())
        starts = np.arange(0, self.length, BLOCK)
        count = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64) if self.length else np.zeros(0, np.int64)
        self.unit_tree, self.point_tree = fenwick(count(self.units)), fenwick(count(self.points))

    def cut(self, unit: int) -> tuple[int, int]:
        """The byte where this unit (from 0) begins and the code points before it; the ends of the text for the number of units."""
        block, left, points = 0, unit, 0
        step = 1 << max(0, len(self.unit_tree) - 1).bit_length()
        while step:
            to = block + step
            if to < len(self.unit_tree) and self.unit_tree[to] <= left:
                block, left, points = to, left - int(self.unit_tree[to]), points + int(self.point_tree[to])
            step >>= 1
        first = block * BLOCK
        if first >= self.length:
            return self.length, points
        at = int(np.flatnonzero(self.units[first : first + BLOCK])[left])
        return first + at, points + int(self.points[first : first + at].sum())


def fenwick(values: np.ndarray) -> np.ndarray:
    """The tree (from 1) whose node i sums the values of the i & -i places up to i."""
    up_to = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    i = np.arange(len(up_to))
    return up_to - up_to[i - (i & -i)]


def arranged(doc_id: int | None, text: bytes) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle (None if plain), and the output."""
    own = Blocks(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or h[2] % 100 >= RATE or any(m.encode() in text for m in MARKS):
        return own.n, "plain", None, None, text
    first, last = sorted((h[0] % (own.n + 1), h[1] % (own.n + 1)))
    (a, before), (b, up_to) = own.cut(first), own.cut(last)
    p, s, m = (mark.encode() for mark in MARKS)
    if h[3] % 100 < SPM:
        return own.n, "spm", before, up_to - before, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return own.n, "psm", before, up_to - before, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


MADE = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def transformed(docs: DataFrame) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output; docs: doc_id, text and any others."""
    rest = [c for c in docs.columns if c.lower() not in MADE]
    schema = docs.select(*rest).schema
    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"{n} {'binary' if n == 'output' else t}" for n, t in MADE.items())])

    def run(batches):
        for batch in (part for whole in batches for part in common.slices(whole, ROWS)):
            rows = [arranged(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True)]
            columns = [pa.array([r[k] for r in rows], pa.int64() if kind == "long" else pa.string() if name == "form" else pa.binary()) for k, (name, kind) in enumerate(MADE.items())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *MADE])

    common.small_batches(docs.sparkSession)
    return docs.select(*rest).mapInArrow(run, types).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    p, s, m = MARKS

    def part(one: str, two: str, three: str) -> dict[str, Column]:
        at, to = F.instr(output, two), F.instr(output, three)
        return {one: F.substr(output, F.lit(len(one) + 1), at - len(one) - 1), two: F.substr(output, at + len(two), to - at - len(two)), three: F.substr(output, to + len(three), F.length(output))}

    psm, spm = part(p, s, m), part(s, p, m)
    back = lambda x: F.concat(x[p], x[m], x[s])
    return F.when(form == "psm", back(psm)).when(form == "spm", back(spm)).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
             list_transform(range(4), lambda k: list_reduce(list_transform(range(8), lambda j: CAST(instr('0123456789abcdef', substr(h, 8 * k + j + 1, 1)) - 1 AS BIGINT)), lambda a, x: 16 * a + x)) AS g FROM d),
c AS (SELECT *, len(units) AS n, least(g[1] % (len(units) + 1), g[2] % (len(units) + 1)) AS a, greatest(g[1] % (len(units) + 1), g[2] % (len(units) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= {RATE} THEN 'plain' WHEN g[4] % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
