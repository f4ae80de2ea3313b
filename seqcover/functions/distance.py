"""Edit distance of a target to the best prefix (or substring) of a centre, and who accepts whom.

Unit costs, case-sensitive. The whole target must be used, the rest of the centre is free, so the distance isn't
symmetric. A centre accepts a target if the distance is within the radius of both lengths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import radius


def prefix_distance(target: Column, centre: Column, most: Column) -> Column:
    """The distance if it is `most` at most, else null."""
    n = F.length(target)
    ends = F.sequence(F.greatest(F.lit(0), n - most), F.greatest(F.greatest(F.lit(0), n - most), F.least(F.length(centre), n + most)))
    tried = F.transform(ends, lambda j: F.levenshtein(target, F.substr(centre, F.lit(1), j)))
    best = F.array_min(tried)
    return F.when(best <= most, best)


def within_prefix(target: Column, centre: Column, most: Column) -> Column:
    """Whether the prefix distance is `most` at most. One banded comparison with the prefix as long as the target settles most pairs: it is between the distance and twice the distance."""
    n = F.length(target)

    def near(j: Column, limit: Column) -> Column:
        return F.call_function("levenshtein", target, F.substr(centre, F.lit(1), j), limit)

    first = near(n, (2 * most).cast("int"))
    ends = F.sequence(F.greatest(F.lit(0), n - most), n + most)
    scan = F.exists(ends, lambda j: near(j, most.cast("int")) >= 0)
    return (F.length(centre) >= n - most) & (first >= 0) & ((first <= most) | scan)


def substring_distance(target: Column, centre: Column, most: Column) -> Column:
    """The distance to the best substring of the centre if it is `most` at most, else null."""
    starts = F.sequence(F.lit(1), F.length(centre) + 1)
    best = F.array_min(F.transform(starts, lambda k: F.coalesce(prefix_distance(target, F.substr(centre, k, F.length(centre)), most), most + 1)))
    return F.when(best <= most, best)


def allowed(target_length: Column, centre_length: Column, similarity: float, mismatches: int | None = None) -> Column:
    """The most edits between a target and a centre of these lengths."""
    if mismatches is not None:
        return F.lit(mismatches)
    return F.least(radius(target_length, similarity), radius(centre_length, similarity))


def accepts(target: Column, centre: Column, similarity: float, mismatches: int | None = None) -> Column:
    return within_prefix(target, centre, allowed(F.length(target), F.length(centre), similarity, mismatches))
