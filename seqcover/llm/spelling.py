"""Spelling variants: frequent words one edit apart, each under the most frequent of its near words.

Words are runs of LETTERS with A-Z in lower case; one occurrence in MISPRINT (by the CRC-32 of id and run) loses a
letter, as the contract has it. Those of LEAST_LENGTH code points or more that occur LEAST_COUNT times or more are the
vocabulary. Two of them are near if one inserted, deleted or replaced code point makes them equal.

The index of a block of words is bit-sliced: for each position and letter a bitset of the words that have it there. A
word is looked up letter by letter, all words of a block at once; four bitsets go along, of the words that agree so far
(no error), and of those with one error whose letters stand at the same place, one further on, or one back. Only the
slices of three positions exist at a time, so memory doesn't grow with the length of words.

Which words can meet: of two near words, the shorter (or either) of n code points, half of n - 1 agree at the front or
at the back. So each word goes into buckets by the hash of n and that front, and of n and that back, once with n its
length and once with one less, apart by powers of two of n. In front buckets the agreement is checked, in back buckets its absence, so that each pair
is found in one bucket only. A bucket of over a block's words is dealt out as a grid of blocks against blocks, so no
task holds more than two. What leaves a block is one row a word: how many near words it has there and the first of them
(the bits are in order of frequency, so it is the lowest). No pair is written.

Null texts have no words, a null id is hashed as no digits; repeated rows count each; runs and texts of any length are
taken whole; other columns don't matter; no rows give no rows. Forms have twice the count at least, so chains end; roots
are found by doubling, in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LETTERS = r"[A-Za-zÀ-ÿ]+"
MISPRINT, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: Words of a block, and letters of a block (blocks of longer words have fewer, one at least).
BLOCK, BLOCK_LETTERS = 4096, 1 << 22
#: Words that are looked up at a time.
LOOKED_UP = 512


def _misprinted(key: Column, run: Column) -> Column:
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % MISPRINT == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """word and n of the words of docs (a key column, text): counted before the shuffle."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.col(key).alias("_key"), F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run")).where(F.length("run") >= LEAST_LENGTH)
    words = runs.select(_misprinted(F.col("_key"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def entries(words: DataFrame) -> DataFrame:
    """word, n, m and bucket hash for each of the (at most) four buckets of a word; m is the length of the shorter of the two words of a pair."""
    half = F.ceil((F.col("m") - 1) / 2).cast("int")
    lengths = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    front, back = F.substr("word", F.lit(1), half), F.substr("word", F.length("word") - half + 1, half)
    sides = F.array(F.struct(F.lit(True).alias("front"), F.xxhash64(F.lit(0), "m", front).alias("h")), F.struct(F.lit(False).alias("front"), F.xxhash64(F.lit(1), "m", back).alias("h")))
    return lengths.withColumn("s", F.explode(sides)).select("word", "n", "m", "s.front", "s.h")


def _codes(words: list[str], width: int) -> np.ndarray:
    """Letters as small numbers, one row a word, zero behind its end."""
    out = np.zeros((len(words), width), np.uint8)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("latin-1"), np.uint8)
    return out


class Slices:
    """For each position the bitsets of a block's words by letter: of every code the words that have it there."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.words = codes, -(-len(codes) // 64)
        self.none = np.zeros((256, self.words), np.uint64)

    def packed(self, flags: np.ndarray) -> np.ndarray:
        """Rows of flags, one for each word, as rows of 64-bit numbers; the first word is the lowest bit."""
        out = np.zeros((len(flags), self.words * 8), np.uint8)
        out[:, : -(-flags.shape[1] // 8)] = np.packbits(flags, axis=1, bitorder="little")
        return out.view("<u8")

    def at(self, position: int) -> np.ndarray:
        if not 0 <= position < self.codes.shape[1]:
            return self.none
        out, column = self.none.copy(), self.codes[:, position]
        letters = np.unique(column[column > 0])
        out[letters] = self.packed(column[None, :] == letters[:, None])
        return out


def near(index: pd.DataFrame, asked: pd.DataFrame, front: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each asked entry (word, m) the number of near words in the index (entries in order of preference) and the place of the first, or -1."""
    longest = max(index["word"].str.len().max(), asked["word"].str.len().max())
    codes, wanted = _codes(index["word"].tolist(), longest + 1), _codes(asked["word"].tolist(), longest + 1)
    slices, sizes = Slices(codes), index["word"].str.len().to_numpy()
    lengths, m = asked["word"].str.len().to_numpy(), asked["m"].to_numpy()
    # a pair meets where both have entries for the length of the shorter one
    same_m = {x: index["m"].to_numpy() == x for x in np.unique(m)}
    of = {(x, n): slices.packed((flags & (sizes == n))[None, :])[0] for x, flags in same_m.items() for n in (x, x + 1)}
    shape, half = (len(asked), slices.words), -(-(m - 1) // 2)
    exact = np.full(shape, ~np.uint64(0))
    replaced, ahead, behind, agreed = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
    before, here = slices.none, slices.at(0)
    for i in range(int(lengths.max())):
        after = slices.at(i + 1)
        agreed[half == i] = exact[half == i]
        on = np.flatnonzero(lengths > i)
        letter = wanted[on, i]
        e, hit = exact[on], here[letter]
        replaced[on] = (replaced[on] & hit) | (e & ~hit)
        # one further on: the other word has a letter more; one back: a letter less
        ahead[on] = (ahead[on] | e) & after[letter]
        behind[on] = (behind[on] & before[letter]) | e
        exact[on] = e & hit
        before, here = here, after
    found = np.zeros(shape, np.uint64)
    for x in same_m:
        for n in (x, x + 1):
            rows = np.flatnonzero((m == x) & (lengths == n))
            if not len(rows):
                continue
            if n == x:  # an entry for its own length: words as long, or longer by one
                found[rows] = (replaced[rows] & of[x, x]) | ((ahead[rows] | exact[rows]) & of[x, x + 1])
            else:  # an entry for one less: words shorter by one
                found[rows] = behind[rows] & of[x, x]
    found &= agreed if front else ~agreed
    count = np.bitwise_count(found).sum(1, dtype=np.int64)
    column = (found != 0).argmax(1)
    lowest = found[np.arange(len(asked)), column]
    first = np.where(count > 0, column * 64 + np.bitwise_count((lowest & (~lowest + np.uint64(1))) - np.uint64(1)), -1)
    return count, first.astype(np.int64)


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near and best (n, other) of each word with near words: one row for each block in which it has some."""
    own = entries(words).withColumn("class", F.floor(F.log2("m")).cast("int"))
    sizes = {r["class"]: r.c for r in own.groupBy("class").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row for each power of two
    held = {k: max(1, min(block, BLOCK_LETTERS >> (k + 1))) for k in sizes}
    # so many buckets of either side that an even share is half a block
    of_class = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair] or [F.lit(0), F.lit(1)])[F.col("class")]
    named = own.withColumn("bucket", F.pmod("h", of_class({k: -(-c // held[k]) for k, c in sizes.items()})))
    parts = named.groupBy("front", "class", "bucket").agg(F.count(F.lit(1)).alias("c"))
    parts = common.stored(parts.select("front", "class", "bucket", F.ceil(F.col("c") / of_class(held)).cast("int").alias("parts")), "parts")
    dealt = named.join(parts, ["front", "class", "bucket"]).withColumn("part", F.pmod(F.xxhash64(F.lit(2), "word", "m"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("asked"))
    cells = F.concat(F.transform(every, lambda k: cell(F.col("part"), k, False)), F.transform(every, lambda k: cell(k, F.col("part"), True)))
    rows = dealt.select("front", "class", "bucket", "word", "n", "m", F.explode(cells).alias("c")).select("front", "class", "bucket", "word", "n", "m", "c.i", "c.j", "c.asked")

    def each(group: pd.DataFrame) -> pd.DataFrame:
        index = group[~group["asked"]].sort_values(["n", "word"], ascending=[False, True])
        asked = group[group["asked"]]
        out = []
        for k in range(0, len(asked), LOOKED_UP):
            some = asked.iloc[k : k + LOOKED_UP]
            if not len(index):
                break
            count, first = near(index, some, bool(group["front"].iloc[0]))
            hit = count > 0
            best = index.iloc[first[hit]]
            out.append(pd.DataFrame({"word": some["word"].to_numpy()[hit], "n_near": count[hit], "other": best["word"].to_numpy(), "other_n": best["n"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"word": [], "n_near": [], "other": [], "other_n": []})

    return rows.groupBy("front", "class", "bucket", "i", "j").applyInPandas(each, "word string, n_near long, other string, other_n long")


def forms(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form and form_n from a stored table of words (word, n)."""
    found = neighbours(words, block).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("b"))
    form = F.expr("CASE WHEN -b.less >= 2 * n THEN b.other END")
    out = words.join(found, "word", "left").withColumn("form", form)
    return out.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), -F.col("b.less")).alias("form_n"))


def roots(named: DataFrame) -> DataFrame:
    """word and root of each word with a form, from word and form (null: none), by doubling."""
    now = common.stored(named.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = common.stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        common.forget(now)
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary of docs."""
    words = common.stored(vocabulary(docs, key), "vocabulary")
    named = common.stored(forms(words, block), "forms")
    common.forget(words)
    return named.join(roots(named), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
