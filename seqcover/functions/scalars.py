"""Column functions: identifiers, radii, sampling numbers, rates and probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factorials below this are taken from a table.
EXACT = 16


def first_word(header: Column) -> Column:
    """The identifier of a header: what stands before the first white space."""
    return F.regexp_extract(header, r"^\S*", 0)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def radius(length: Column, similarity: float) -> Column:
    """floor((1 - similarity) * length) in single precision, as a whole number."""
    one, s = F.lit(1).cast("float"), F.lit(similarity).cast("float")
    return F.floor((one - s) * length.cast("float")).cast("int")


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number from 0 to below 1 that depends on the seed and the keys alone, the same in every engine with MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def adapted_rate(rate: Column, current: Column, previous: Column, delta: float) -> Column:
    """The sampling rate of the next round: raised where this round clustered less than the one before; 1 at most."""
    return F.least(F.lit(1.0), F.when(current < previous, rate + (1 - current / previous) * delta).otherwise(rate))


def miss_probability(size: Column, drawn: Column, total: Column) -> Column:
    """Probability that a cluster of this size has fewer than two members among the drawn ones (Poisson limit)."""
    x = size * drawn / total
    return F.exp(-x) * (1 + x * F.exp(size / total))


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number: Stirling's series, whose error is under 1e-11 from EXACT on; below, the products themselves."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n >= EXACT, series).otherwise(F.get(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(EXACT)]), n.cast("int")))


def log_choose(n: Column, k: Column) -> Column:
    """The logarithm of the number of ways to choose k of n; null if there are none."""
    return F.when((k >= 0) & (k <= n), log_factorial(n) - log_factorial(k) - log_factorial(n - k))


def minutes(text: Column) -> Column:
    """12.5 from "12.5 minutes" and the like."""
    return F.regexp_extract(text, r"[-0-9.eE+]+", 0).cast("double")


def minutes_text(value: Column) -> Column:
    return F.concat(F.lit(" "), F.round(value, 2).cast("string"), F.lit(" minutes "))


def nucleotide_code(letter: Column) -> Column:
    """0 to 3 for A, C, G, T (U) of either case; other letters count as A."""
    at = F.instr(F.lit("ACGT"), F.regexp_replace(F.upper(letter), "U", "T"))
    return F.when(at > 0, at - 1).otherwise(0)


def reverse_complement(sequence: Column) -> Column:
    return F.translate(F.reverse(sequence), "ACGTacgt", "TGCAtgca")


def truth(text: Column) -> Column:
    """true or false in any case, with white space around; anything else is an error."""
    value = F.lower(trimmed(text))
    return F.when(value == "true", True).when(value == "false", False).otherwise(F.raise_error(F.concat(F.lit("neither true nor false: "), text)))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole)


def log_safe(count: Column) -> Column:
    """One in the place of the -1 that stands for a missing count, so that logarithmic axes can show it."""
    return F.when(count == -1, 1).otherwise(count)
