"""Pairs of strings within an edit distance, by walking the trie of the targets beside the trie of the centres.

A pair of nodes stands for all targets and centres that begin so, and has one band of the distance table: the letters of
a target's beginning against those of a centre's, as far as the radius reaches. Where the least number of a band is over
what any pair below may have, all these pairs end there; so beginnings that many strings share are compared once, and
strings that differ early cost nothing. Nodes of one depth are dealt with together, in portions of bounded size, the
deepest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Numbers that the bands of one portion may hold, and pairs that are given at a time.
PORTION, GIVEN = 1 << 19, 1 << 18


def coded(*sides: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each list of strings: its letters as small numbers from 1, one row a string, 0 behind its end; and the lengths."""
    made = []
    for strings in sides:
        n = np.array([len(x) for x in strings], np.int64)
        points = np.zeros((len(strings), int(n.max(initial=0))), np.uint32)
        if points.size:
            points.flat[np.flatnonzero(np.arange(points.shape[1]) < n[:, None])] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
        made.append((points, n))
    known = np.unique(np.concatenate([np.unique(points) for points, _ in made]))
    number = np.zeros(int(known.max(initial=0)) + 1, np.uint8 if len(known) < 255 else np.uint16 if len(known) < 65_535 else np.uint32)
    number[known] = np.arange(1, len(known) + 1)
    return [(np.where(np.arange(points.shape[1]) < n[:, None], number[points], 0).astype(number.dtype), n) for points, n in made]


class Trie:
    """Strings in order; a node of depth d is a range of rows that agree in their first d letters, the end being one."""

    def __init__(self, letters: np.ndarray, n: np.ndarray, radius: np.ndarray, depth: int):
        rows, width = letters.shape
        letters = np.pad(letters, ((0, 0), (0, max(0, depth - width))))[:, :depth]
        big = np.ascontiguousarray(letters.astype(letters.dtype.newbyteorder(">")))
        self.order = np.argsort(big.view(f"S{max(1, big.dtype.itemsize * depth)}").ravel(), kind="stable") if depth else np.arange(rows)
        self.letters, self.n, self.radius = letters[self.order], n[self.order], radius[self.order]
        differ = self.letters[1:] != self.letters[:-1]
        common = np.concatenate([[-1], np.where(differ.any(1), differ.argmax(1), depth)]) if depth else np.array([-1] + [0] * (rows - 1))
        self.starts, self.ends, self.child, self.most = [], [], [], []
        new = np.bincount(np.maximum(common, 0), minlength=depth + 1)
        for d in range(depth + 1):
            if d and not new[d - 1]:  # no string leaves another here: the nodes are those above
                self.starts.append(self.starts[-1]), self.ends.append(self.ends[-1]), self.most.append(self.most[-1])
            else:
                self.starts.append(np.flatnonzero(common < d) if d else np.zeros(1, np.int64))
                self.ends.append(np.append(self.starts[-1][1:], rows))
                self.most.append(np.maximum.reduceat(self.radius, self.starts[-1]))
            if d:
                above, own = self.starts[-2], self.starts[-1]
                alone = above is own and self.child and len(self.child[-1]) == len(own) + 1 and self.child[-1][-1] == len(own) and self.child[-1][0] == 0 and d > 1 and self.starts[-3] is own
                self.child.append(self.child[-1] if alone else np.append(np.searchsorted(own, above), len(own)))


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts: which one each of as many rows belongs to, and its number there."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def cut_up(n: np.ndarray, most: int) -> list[slice]:
    """Pieces of a row of counts, each with a sum of `most` or of one count."""
    if not len(n):
        return []
    total = np.cumsum(n)
    ends, at = [], 0
    while at < len(n):
        at = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        ends.append(at)
    return [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]


def near_pairs(targets: list[str], centres: list[str], target_radius: np.ndarray, centre_radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of targets and centres, and the edit distance of the target to the best prefix of the centre, of the pairs where it is within both radii; a portion at a time, each pair once. Only as many letters of a centre count as the longest target and the radius reach."""
    if not targets or not centres:
        return
    (t_letters, t_n), (q_letters, q_n) = coded(targets, centres)
    target_radius, centre_radius = np.asarray(target_radius, np.int64), np.asarray(centre_radius, np.int64)
    reach, longest = int(min(target_radius.max(), centre_radius.max())), int(t_n.max())
    if reach < 0:
        return
    kind = np.int8 if reach <= 40 else np.int16 if reach <= 10_000 else np.int32
    far, width = kind({1: 90, 2: 25_000, 4: 1 << 28}[np.dtype(kind).itemsize]), 2 * reach + 1
    t, q = Trie(t_letters, t_n, target_radius, longest + 1), Trie(q_letters, q_n, centre_radius, longest + reach)
    # row c of a band at depth i is place i + c - reach of the centre, whose letter before it is row i + c of this
    beside, steps, rows = np.pad(q.letters, ((0, 0), (reach, 1))).T.copy(), np.arange(width), max(1, PORTION // width)
    t_beside, shortest = t.letters.T.copy(), int(q.n.min())
    t_many, q_many = ([np.diff(x) for x in side.child] for side in (t, q))

    def ends(i: int, u: np.ndarray, v: np.ndarray, cost: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs below these: targets that end at depth i, centres below nodes of depth i + reach."""
        t_from, q_from = t.starts[i + 1][u], q.starts[i + reach][v]
        t_rows, q_rows = t.ends[i + 1][u] - t_from, q.ends[i + reach][v] - q_from
        for piece in cut_up(t_rows * q_rows, GIVEN):
            of, at = _spread(t_rows[piece])
            one, its = t_from[piece][of] + at, q_rows[piece][of]
            for part in cut_up(its, GIVEN):
                to, place = _spread(its[part])
                to = to + part.start
                a, b, c = one[to], q_from[piece][of[to]] + place, cost[piece][of[to]]
                ok = c <= np.minimum(t.radius[a], q.radius[b])
                if ok.any():
                    yield t.order[a[ok]], q.order[b[ok]], c[ok].astype(np.int64)

    v = np.arange(len(q.starts[reach]))
    place = (steps - reach)[:, None]
    band = np.where((place >= 0) & (place <= q.n[q.starts[reach]][None, :]), place, far).astype(kind)
    stack = [(0, np.zeros(len(v), np.int64), v, band)]
    while stack:
        i, u, v, band = stack.pop()
        first, last = t.child[i][u], t.child[i][u + 1]
        ended = t.letters[t.starts[i + 1][first], i] == 0
        if ended.any():
            cost = band[:, ended].min(0)
            own = cost <= np.minimum(t.most[i + 1][first[ended]], q.most[i + reach][v[ended]])
            yield from ends(i, first[ended][own], v[ended][own], cost[own])
            first = first + ended
        if i == longest:
            continue
        before, after = q.child[i + reach][v], q.child[i + reach][v + 1]
        of, at = _spread((last - first) * (after - before))
        if not len(of):
            continue
        down, over = np.divmod(at, np.take(after - before, of))
        cu, cv = np.take(first, of) + down, np.take(before, of) + over
        u_row, v_row = np.take(t.starts[i + 1], cu), np.take(q.starts[i + reach + 1], cv)
        old = np.take(band, of, axis=1)
        new = np.take(beside[i : i + width], v_row, axis=1) != np.take(t_beside[i], u_row)
        new = old + new
        old += kind(1)
        np.minimum(new[:-1], old[1:], out=new[:-1])
        if i + 1 + reach > shortest:
            m = np.take(q.n, v_row)
            short = np.flatnonzero(m < i + 1 + reach)
            new[:, short] = np.where((steps[:, None] + (i + 1 - reach)) > m[short], far, new[:, short])
        for c in range(1, width):
            np.minimum(new[c], new[c - 1] + kind(1), out=new[c])
        if i % 16 == 15:  # what is far grows by one a letter
            np.minimum(new, far, out=new)
        on = np.flatnonzero(new.min(0) <= np.minimum(np.take(t.most[i + 1], cu), np.take(q.most[i + reach + 1], cv)))
        if not len(on):
            continue
        cu, cv, new = np.take(cu, on), np.take(cv, on), np.take(new, on, axis=1)
        more = np.take(t_many[i + 1], cu) * np.take(q_many[i + reach + 1], cv) if i + 1 < longest else np.ones(len(cu), np.int64)
        for piece in cut_up(more, rows):
            stack.append((i + 1, cu[piece], cv[piece], new[:, piece]))


def first_acceptors(strings: list[str], radius: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """For strings in order, what the sequential rule gives: the number of the centre that accepts each one first, and the distance; -1 for centres. A string is a centre if no earlier centre accepts it. So many strings are settled at a time, and take what they accept of all that follow."""
    radius = np.asarray(radius, np.int64)
    first, cost, left = np.full(len(strings), -1), np.full(len(strings), -1), np.arange(len(strings))
    while len(left):
        some, left = left[:step], left[step:]
        names = [strings[k] for k in some]
        found = [(a[b < a], b[b < a], c[b < a]) for a, b, c in near_pairs(names, names, radius[some], radius[some])]
        a, b, c = (np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]) for k in range(3))
        order = np.lexsort((b, a))
        a, b, c = a[order], b[order], c[order]
        cut, alone = np.searchsorted(a, np.arange(len(some) + 1)), np.ones(len(some), bool)
        for k in np.unique(a):
            hits = cut[k] + np.flatnonzero(alone[b[cut[k] : cut[k + 1]]])
            if len(hits):
                alone[k], first[some[k]], cost[some[k]] = False, some[b[hits[0]]], c[hits[0]]
        if len(left):
            heads = some[alone]
            best, price = first_of([strings[k] for k in left], [strings[k] for k in heads], radius[left], radius[heads])
            taken = best >= 0
            first[left[taken]], cost[left[taken]] = heads[best[taken]], price[taken]
            left = left[~taken]
    return first, cost


def first_of(targets: list[str], centres: list[str], target_radius: np.ndarray, centre_radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each target the number of the first centre that accepts it, and the distance; -1 if none does."""
    best, price = np.full(len(targets), len(centres)), np.full(len(targets), -1)
    for a, b, c in near_pairs(targets, centres, target_radius, centre_radius):
        order = np.lexsort((b, a))
        a, b, c = a[order], b[order], c[order]
        head = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        a, b, c = a[head], b[head], c[head]
        less = b < best[a]
        best[a[less]], price[a[less]] = b[less], c[less]
    return np.where(best < len(centres), best, -1), price
