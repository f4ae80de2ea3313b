"""Quality rules: statistics of each text, and an isolation forest that finds texts unlike the good ones.

Words are maximal runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return.
A null text counts as empty. Fixed rules reject a text of fewer than MIN_WORDS words, or one in which over half of
the words lie in three-word windows that occur twice or more. The forest judges the rest: random splits isolate an
odd row in few steps, and a row whose mean path is shorter than the calibrated one goes.

The forest is fitted on all labelled documents (documents that share an id count once, by the least figures of each
kind; of several labels of an id the best one). Half of them (by a hash of the id) grow the trees: splits fall anywhere
between the least and the greatest figures of that half, and every row of it that is labelled good is counted at the
leaf of each tree that it reaches. The other half, which the trees haven't seen, gives the threshold: all its scores are
counted in STEPS steps, so that at most MAX_LOST of its good rows go; a score of just the threshold stays. Spark counts;
only extremes and counts by leaf and by step reach the driver, however many rows there are. Where either half has no
good rows, all labelled rows do both. Without labelled good rows there is no forest, and only the fixed rules decide.

Each row is judged by itself: repeated rows get equal verdicts, null ids too, texts of any length are read whole, other
columns don't matter, and no rows give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
TREES = 100
DEPTH = 8
MAX_LOST, STEPS = 0.005, 100_000
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_lone", "n_digits"]
#: Continuation bytes of UTF-8, which start no character.
_CONTINUED = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(65, 91))
#: Words without a letter or digit.
_LONE = re.compile(rb"(?<!\S)[^A-Za-z0-9\x80-\xff\s]+(?!\S)")


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    v = len(seen)
    if v < 1 << 21:
        code = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # pairs are renamed so that three names fit in 63 bits
        code = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1] * v + ids[2:]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n + 2, bool)
    for k in range(3):
        hit[k : n + k] |= twice
    return int(hit.sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = text.split()
    chars = len(text.translate(None, SPACES + _CONTINUED))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        chars,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(text) - len(text.translate(None, _CAPITALS)),
        len(text) - len(text.translate(None, b"!?")),
        len(_LONE.findall(text)),
        len(text) - len(text.translate(None, b"0123456789")),
    )


def features(counts: np.ndarray) -> np.ndarray:
    """Scale-free figures from a row of COUNTS for each text."""
    c = counts.astype(float)
    words, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), np.maximum(c[:, 5], 1)
    shares = [c[:, 2] / words, c[:, 3] / lines, c[:, 4] / words, c[:, 6] / chars, c[:, 7] / words, c[:, 8] / words, c[:, 9] / chars]
    return np.stack([np.log1p(c[:, 0]), np.log(chars / words), *map(np.sqrt, shares)], 1)


def _path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth at which n rows are told apart by random splits."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Random trees of DEPTH levels; node i has the children 2i+1 and 2i+2."""

    def __init__(self, low: np.ndarray, high: np.ndarray, seed: int = 7):
        """low and high: the extremes of all figures that splits may fall between, odd ones too."""
        rng = np.random.default_rng(seed)
        nodes = 2 ** (DEPTH + 1) - 1
        self.feature = np.zeros((TREES, nodes), np.int16)
        self.split = np.full((TREES, nodes), np.inf)
        self.length = np.zeros((TREES, nodes))
        self.norm = self.threshold = 1.0
        for t in range(TREES):
            self._grow(t, 0, 0, low, high, rng)

    def _grow(self, t: int, node: int, depth: int, low: np.ndarray, high: np.ndarray, rng) -> None:
        """A node without figures to split has its way always to the left (split at infinity)."""
        free = np.flatnonzero(high > low)
        if depth == DEPTH or not len(free):
            return
        f = rng.choice(free)
        at = rng.uniform(low[f], high[f])
        self.feature[t, node], self.split[t, node] = f, at
        least, most = low.copy(), high.copy()
        least[f] = most[f] = at
        self._grow(t, 2 * node + 1, depth + 1, low, most, rng)
        self._grow(t, 2 * node + 2, depth + 1, least, high, rng)

    def places(self, rows: np.ndarray, t: int) -> np.ndarray:
        """The node of the last level that each row reaches in tree t."""
        node, each = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (rows[each, self.feature[t, node]] > self.split[t, node])
        return node

    def fill(self, counts: np.ndarray) -> None:
        """Path lengths from counts of the rows that count as usual, by tree and place in the last level."""
        self.norm, levels = float(max(_path(counts[0].sum()), 1)), [counts]
        for _ in range(DEPTH):
            levels.append(levels[-1][:, ::2] + levels[-1][:, 1::2])
        length = np.full((TREES, 1), np.nan)
        for depth, n in enumerate(reversed(levels)):
            length = np.repeat(length, n.shape[1] // length.shape[1], 1)
            split = self.split[:, n.shape[1] - 1 : 2 * n.shape[1] - 1]
            length = np.where(np.isnan(length) & ((n < 2) | np.isinf(split)), depth + _path(n), length)
        self.length[:, 2**DEPTH - 1 :] = length

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the higher, the odder."""
        total = np.zeros(len(rows))
        for t in range(TREES):
            total += self.length[t, self.places(rows, t)]
        return 2.0 ** (-total / TREES / self.norm)

    def calibrate(self, good: np.ndarray, bad: np.ndarray) -> None:
        """The threshold with the most correct verdicts (share of good kept plus share of bad rejected) among those that lose at most MAX_LOST of the good, from counts of scores by step."""
        kept, gone = np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / max(bad.sum(), 1)
        tried = np.flatnonzero(((good > 0) | (bad > 0)) & (np.cumsum(good) >= np.ceil(good.sum() * (1 - MAX_LOST))))
        self.threshold = float(_ENDS[tried[np.argmax((kept + gone)[tried])]])


#: Upper ends of the steps of scores.
_ENDS = np.arange(STEPS + 1) / STEPS
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, odd double, kept boolean"


def _measure(batch: pa.RecordBatch, forest: Forest | None) -> dict:
    counts = np.array([statistics(x) for x in common.texts(batch)], np.int64).reshape(-1, len(COUNTS))
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])
    odd = forest.scores(features(counts)) if forest else np.zeros(len(counts))
    kept = ~failed & (odd <= forest.threshold if forest else True)
    return {"doc_id": batch.column("doc_id").cast(pa.int64()), **{c: counts[:, k] for k, c in enumerate(COUNTS)}, "base_failed": failed, "odd": odd, "kept": kept}


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """COUNTS, good and grows (whether the trees take the row in) of each labelled document that passes the fixed rules, once."""
    best = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    measured = common.arrow_map(docs.where("doc_id is not null").select("doc_id", "text"), lambda b: _measure(b, None), _SCHEMA)
    once = measured.where("not base_failed").groupBy("doc_id").agg(*(F.min(c).alias(c) for c in COUNTS))
    grows = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    return common.stored(once.join(best, "doc_id").select(*COUNTS, (F.col("quality") > 0).alias("good"), grows.alias("grows")), "labelled")


def _figures(batch: pa.RecordBatch) -> np.ndarray:
    return features(np.stack([batch.column(c).to_numpy() for c in COUNTS], 1))


def _counted(rows: DataFrame, columns: list[str], shape: tuple[int, ...], cells) -> np.ndarray:
    """How many rows are in each cell: cells gives a batch's as flat numbers; columns go to them."""

    def run(batches):
        n = np.zeros(int(np.prod(shape)), np.int64)
        for batch in batches:
            for part in common.slices(batch, 1024):
                for some in cells(part):
                    n += np.bincount(some, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])

    found = rows.select(*columns).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(np.prod(shape)), np.int64)
    out[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out.reshape(shape)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Forest | None:
    """The forest for docs (doc_id, text) from all labels (doc_id, quality); only extremes and counts reach the driver."""
    rows = _labelled(docs, labels)

    def extremes(batch: pa.RecordBatch):
        x, good, grows = _figures(batch), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "grows"))
        for g, w in ((g, w) for g in (False, True) for w in (False, True)):
            if len(own := x[(good == g) & (grows == w)]):
                k = np.arange(x.shape[1])
                yield {"good": np.full(len(k), g), "grows": np.full(len(k), w), "feature": k.astype(np.int32), "low": own.min(0), "high": own.max(0)}

    ends = common.arrow_map(rows, extremes, "good boolean, grows boolean, feature int, low double, high double")
    ends = ends.groupBy("good", "grows", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    halves = set(ends["grows"][ends["good"]])
    if not halves:
        common.forget(rows)
        return None
    grown, rest = (rows.where("grows"), rows.where("not grows")) if len(halves) == 2 else (rows, rows)
    span = (ends[ends["grows"]] if len(halves) == 2 else ends).groupby("feature").agg({"low": "min", "high": "max"}).sort_index()
    forest = Forest(span["low"].to_numpy(), span["high"].to_numpy(), seed)

    def leaves(batch: pa.RecordBatch):
        x, first = _figures(batch), 2**DEPTH - 1
        return (t * 2**DEPTH + forest.places(x, t) - first for t in range(TREES))

    # the forest is sent with these functions, so fill() comes between them
    forest.fill(_counted(grown.where("good"), COUNTS, (TREES, 2**DEPTH), leaves))

    def steps(batch: pa.RecordBatch):
        step = np.searchsorted(_ENDS, forest.scores(_figures(batch)))
        yield batch.column("good").to_numpy(zero_copy_only=False) * len(_ENDS) + step

    bad, good = _counted(rest, [*COUNTS, "good"], (2, len(_ENDS)), steps)
    forest.calibrate(good, bad)
    common.forget(rows)
    return forest


def verdicts(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """COUNTS, base_failed, odd (the forest's score) and kept of every row of docs (doc_id, text)."""
    return common.arrow_map(docs.select("doc_id", "text"), lambda b: _measure(b, forest), _SCHEMA)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules and the forest keep; repeated rows stay repeated."""
    forest = fit(docs, labels)
    columns = docs.columns

    def run(batches):
        for batch in (part for whole in batches for part in common.slices(whole, 1024)):
            yield batch.filter(pa.array(_measure(batch, forest)["kept"]))

    return docs.select(*columns).mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return verdicts(docs, fit(docs, common.table(spark, sf_dir, "labels"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "odd")
