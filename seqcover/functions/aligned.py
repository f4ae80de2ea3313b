"""Edit distances of many pairs at once, for batches of pairs inside a task.

prefix_costs goes down the letters of all targets together and keeps, for each pair, the band of the distance table
that can stay within the pair's limit. Pairs that follow each other with the same centre and targets that begin alike
share one band as long as the letters are the same, as in a walk down the trie of the targets; a band that exceeds its
limit ends all pairs that share it. Sorted by centre and target, most of the table is computed once.

substring_costs carries the vertical differences of each pair's table as bits, 64 rows a word, over the centre's letters
once; the score in the last row is the distance to the best substring that ends there.
"""

from __future__ import annotations

import numpy as np

#: Numbers that the tables of one portion of pairs may hold.
PORTION = 4 << 20


def codes(strings: list[str], left: int = 0, right: int = 0) -> np.ndarray:
    """Code points, one row a string, zeros behind its end; so many columns of zeros besides on either side."""
    made = np.array(strings, np.str_)
    width = made.itemsize // 4
    out = np.zeros((len(strings), left + width + right), np.uint32)
    if width:
        out[:, left : left + width] = made.view(np.uint32).reshape(len(strings), width)
    return out


def in_portions(one, t: list[str], q: list[str], most: np.ndarray) -> np.ndarray:
    """one(t, q, most) for portions of the pairs, by the longest of them."""
    longest = max(map(len, t), default=0) + max(map(len, q), default=0) + 4 * int(most.max(initial=0)) + 8
    step = max(1, PORTION // longest)
    return np.concatenate([one(t[k : k + step], q[k : k + step], most[k : k + step]) for k in range(0, len(t), step)] or [np.zeros(0, np.int64)])


def prefix_costs(t: list[str], q: list[str], most: np.ndarray) -> np.ndarray:
    """The edit distance of each target to the best prefix of its centre; -1 where it is over `most`."""
    return in_portions(_prefix_costs, t, q, most)


def _prefix_costs(t: list[str], q: list[str], most: np.ndarray) -> np.ndarray:
    n, m = np.array([len(x) for x in t]), np.array([len(x) for x in q])
    reach, count = int(most.max()), len(t)
    width, most = 2 * reach + 1, most.astype(np.int64)
    letters = codes(t)
    # column j of a row's band at depth i is place i + j - reach of the centre
    other = codes(q, left=reach, right=max(0, int(n.max()) - int(m.max())) + width)
    new = np.array([True] + [a != b for a, b in zip(q, q[1:], strict=False)])
    alike = np.zeros(count, np.int64)
    if letters.shape[1] and count > 1:
        equal = (letters[1:] == letters[:-1]) & (letters[1:] > 0)
        alike[1:] = np.where(equal.all(1), letters.shape[1], equal.argmin(1))
    alike[new] = -1
    limit = np.repeat(np.maximum.reduceat(most, np.flatnonzero(new)), np.diff([*np.flatnonzero(new), count]))
    kind = np.int16 if letters.shape[1] < 8000 else np.int32
    far, steps = kind(20_000), np.arange(width, dtype=kind)
    table = np.where(steps >= reach, steps - reach, far).astype(kind)[None, :]
    cost = np.full(count, -1, np.int64)
    done = np.flatnonzero(n == 0)
    cost[done] = 0
    left, row = np.flatnonzero(n > 0), np.zeros(int((n > 0).sum()), np.int64)
    for i in range(letters.shape[1]):
        if not len(left):
            break
        lead = alike[left] <= i
        lead[0] = True
        own = left[lead]
        before = table[row[lead]]
        table = before + (other[own, i : i + width] != letters[own, i, None])
        np.minimum(table[:, :-1], before[:, 1:] + 1, out=table[:, :-1])
        if i + 1 + reach > m[own].min():
            table[steps[None, :] + (i + 1 - reach) > m[own, None]] = far
        table = np.minimum.accumulate(table - steps, axis=1) + steps
        np.minimum(table, far, out=table)
        row = np.cumsum(lead) - 1
        least = table.min(1)
        ended = n[left] == i + 1
        cost[left[ended]] = least[row[ended]]
        on = ~ended & (least <= limit[own])[row]
        left, row = left[on], row[on]
    return np.where(cost <= most, cost, -1)


def substring_costs(t: list[str], q: list[str], most: np.ndarray) -> np.ndarray:
    """The edit distance of each target to the best substring of its centre; -1 where it is over `most`."""
    return in_portions(_substring_costs, t, q, most)


def _substring_costs(t: list[str], q: list[str], most: np.ndarray) -> np.ndarray:
    letters, other = codes(t), codes(q)
    count, words = len(t), max(1, -(-letters.shape[1] // 64))
    n = np.array([len(x) for x in t])
    one, top = np.uint64(1), np.uint64(63)
    up, down = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64)
    last_word, last_bit = np.maximum(n - 1, 0) // 64, (np.maximum(n - 1, 0) % 64).astype(np.uint64)
    score, best = n.copy(), n.copy()
    bits = np.zeros((count, words * 8), np.uint8)
    for j in range(other.shape[1]):
        packed = np.packbits((letters == other[:, j, None]) & (letters > 0), axis=1, bitorder="little")
        bits[:, : packed.shape[1]] = packed
        equal = bits.view("<u8")
        more, less = np.zeros(count, np.uint64), np.zeros(count, np.uint64)  # what the row above gains or loses in this column
        for w in range(words):
            e, p, v = equal[:, w], up[w], down[w]
            across = e | v
            e = e | less
            along = (((e & p) + p) ^ p) | e
            gain, loss = v | ~(along | p), p & along
            mine = last_word == w
            score[mine] += ((gain[mine] >> last_bit[mine]) & one).astype(np.int64) - ((loss[mine] >> last_bit[mine]) & one).astype(np.int64)
            gain, loss, more, less = (gain << one) | more, (loss << one) | less, gain >> top, loss >> top
            up[w], down[w] = loss | ~(across | gain), gain & across
        np.minimum(best, score, out=best)
    best[n == 0] = 0
    return np.where(best <= most, best, -1)
