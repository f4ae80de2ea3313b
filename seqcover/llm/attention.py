"""A small causal self-attention model of subword ids, in numpy, on top of counts of ids behind one and two others.

Inputs are cut into spans of SPAN ids; a span's positions attend to those of their own span up to themselves and to the
span before, by content and distance. The prediction of the next id is a softmax over classes of ids, then one over the
ids of the class; classes hold ids of similar frequency, and ids that were never counted share the last class evenly.
The logits start from the smoothed shares that were counted behind the id before, and behind the two before where these
are a frequent pair of a word; the attention learns what the counts don't know.
"""

from __future__ import annotations

import numpy as np

SPAN, SIZE, KEYS = 16, 32, 16
#: Counts behind one id, and behind two, are smoothed by as many draws from the shares of all ids, and behind one.
SMOOTHED = 4.0
LARGEST = 0.5


def triples(words: list[np.ndarray], size: int) -> np.ndarray:
    """Codes ((before last) * (size + 2) + last) * (size + 2) + next of every id of each word (ids under size; size alone for the end of a text), with size + 1 for what is outside it; a word's own end is such a next."""
    outside, m = size + 1, size + 2
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.full(int(lengths.sum()) + 3 * len(words), outside, np.int64)
    at = np.arange(int(lengths.sum())) + np.repeat(3 * np.arange(len(words)) + 2, lengths)
    flat[at] = np.concatenate(words) if words else 0
    code = (flat[:-2] * m + flat[1:-1]) * m + flat[2:]
    whole = np.zeros(len(flat), bool)
    whole[at] = True
    ends = np.cumsum(lengths + 3) - 1
    whole[ends[flat[ends - 1] != size]] = True
    return code[np.flatnonzero(whole[2:])], np.repeat(np.arange(len(words)), np.where(flat[ends - 1] != size, lengths + 1, lengths))


class Shape:
    """Ids by rank of frequency, their classes, and the logits that the counts give in each context.

    Inputs are ranks of ids that were counted, then "never counted", "start" and "no id". Contexts are inputs (the id
    before), then the pairs of ids that have contexts of their own.
    """

    def __init__(self, size: int, begins: np.ndarray, behind_one: np.ndarray, behind_two: np.ndarray):
        """begins: whether each id begins a word; then rows (last, next, n) of all pairs and (before last, last, next, n) of those with contexts of their own, as triples() names them."""
        self.ids, outside, m = size + 1, size + 1, size + 2
        table = np.zeros((m, m))
        np.add.at(table, (behind_one[:, 0], behind_one[:, 1]), behind_one[:, 2])
        self.counts = table[:, : self.ids].sum(0)
        order = np.argsort(-self.counts, kind="stable")
        self.rank = np.empty(self.ids, np.int64)
        self.rank[order] = np.arange(self.ids)
        self.used = used = max(1, int(np.count_nonzero(self.counts)))
        # classes of frequent ids are small ones: the ranks where they begin go up with the square
        self.edges = np.unique(np.round(used * np.linspace(0, 1, 1 + int(np.ceil(0.8 * np.sqrt(used)))) ** 2).astype(np.int64))
        self.classes = len(self.edges) - 1
        self.unused = self.ids - used
        self.of = np.repeat(np.arange(self.classes + 1, dtype=np.int16), np.append(np.diff(self.edges), self.unused))
        self.rare, self.start, self.none = used, used + 1, used + 2
        order = order[:used]
        shares = self.counts[order] + 0.01
        shares /= shares.sum()
        fresh = table[outside][order]  # what words begin with, and the end of a text
        fresh = (fresh + SMOOTHED * shares) / (fresh.sum() + SMOOTHED)

        def known(counted: np.ndarray, ended: np.ndarray, like: np.ndarray) -> np.ndarray:
            """Shares from counts; behind a word's end comes what words begin with."""
            counted = counted + ended[:, None] * fresh + SMOOTHED * like
            return counted / counted.sum(1, keepdims=True)

        one = np.tile(shares, (used + 3, 1))
        one[:used] = known(table[np.ix_(order, order)], table[order, outside], shares)
        one[self.start] = fresh
        pairs, which = np.unique(behind_two[:, 0] * m + behind_two[:, 1], return_inverse=True)
        own = np.zeros((len(pairs), m))
        np.add.at(own, (which.reshape(-1), behind_two[:, 2]), behind_two[:, 3])
        two = known(own[:, order], own[:, outside], one[np.minimum(self.rank[np.minimum(pairs % m, size)], self.rare)])
        self.begins = np.append(begins, [True] * (self.ids - len(begins)))
        self.pairs = pairs
        self._find_contexts()
        every = np.concatenate([one, two])
        whole = np.add.reduceat(every, self.edges[:-1], 1)
        missing = 1e-5 if self.unused else 1e-30
        self.class_bias = np.log(np.concatenate([whole * (1 - missing), np.full((len(whole), 1), missing)], 1)).astype(np.float32)
        #: of each class, a row for each context
        self.bias = [np.log(every[:, a:b] / whole[:, j : j + 1]).astype(np.float32) for j, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False))]

    def _find_contexts(self) -> None:
        """The context of each pair of an input's raw id with the one before it; made again where the shape is sent."""
        m = self.ids + 1
        self.context = np.tile(np.append(np.minimum(self.rank, self.rare), self.start), (m, 1)).astype(np.int32)
        self.context[self.pairs // m, self.pairs % m] = self.used + 3 + np.arange(len(self.pairs))

    def __getstate__(self) -> dict:
        return {name: x for name, x in self.__dict__.items() if name != "context"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._find_contexts()

    def parameters(self, seed: int = 3) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.normal(0, scale, shape)).astype(np.float32)
        return {
            "e": draw(0.5, self.used + 3, SIZE), "q": draw(0.25, SIZE, KEYS), "k": draw(0.25, SIZE, KEYS), "v": draw(0.25, SIZE, SIZE), "r": draw(0.25, SIZE, SIZE),
            "b": np.zeros(2 * SPAN, np.float32), "uc": np.zeros((SIZE, self.classes + 1), np.float32), "um": np.zeros((SIZE, self.used), np.float32),
        }


class Spans:
    """Consecutive spans of documents whose ids end with their end id: inputs, contexts, ranks of the next ids (-1 where none), document, and whether it is its document's first."""

    def __init__(self, shape: Shape, documents: list[np.ndarray]):
        lengths = np.array([len(x) for x in documents], np.int64)
        counts = -(-lengths // SPAN)
        total = int(counts.sum())
        given, next_, context = np.full(total * SPAN, shape.none, np.int32), np.full(total * SPAN, -1, np.int32), np.full(total * SPAN, shape.none, np.int32)
        if total:
            outside = shape.ids
            ids = np.concatenate(documents)
            starts = np.cumsum(lengths) - lengths
            at = np.arange(len(ids)) + np.repeat((np.cumsum(counts) - counts) * SPAN - starts, lengths)
            next_[at] = shape.rank[ids]
            last = np.concatenate([[outside], ids[:-1]])
            last[starts[lengths > 0]] = outside
            before = np.concatenate([[outside], last[:-1]])
            begins = np.append(shape.begins, True)[last]
            given[at] = np.append(np.minimum(shape.rank, shape.rare), shape.start)[last]
            context[at] = shape.context[np.where(begins, outside, before), last]
        self.given, self.context, self.next = given.reshape(total, SPAN), context.reshape(total, SPAN), next_.reshape(total, SPAN)
        self.document = np.repeat(np.arange(len(documents)), counts)
        self.first = firsts(self.document)

    def __len__(self) -> int:
        return len(self.given)

    def part(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.given[a:b], self.context[a:b], self.first[a:b], self.next[a:b]


def firsts(document: np.ndarray) -> np.ndarray:
    """Whether each span is its document's first."""
    first = np.ones(len(document), bool)
    first[1:] = document[1:] != document[:-1]
    return first


_OFFSET = np.clip(np.arange(SPAN)[:, None] + SPAN - np.arange(2 * SPAN)[None, :], 0, 2 * SPAN - 1)
_LATER = np.arange(SPAN)[:, None] + SPAN < np.arange(2 * SPAN)[None, :]
#: For positions that can't be seen, and the most that attention may say (its gradient passes there as if it were free).
_FAR, _MOST = np.float32(-1e9), np.float32(30)


def tables(p: dict) -> dict:
    """Products that depend on an id alone."""
    return {n: p["e"] @ p[n] for n in ("q", "k", "v", "r")}


def _with_before(x: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """Each span's rows behind those of the span before it; before: of the one before the first."""
    out = np.empty((len(x), 2 * SPAN, x.shape[2]), np.float32)
    out[:, SPAN:] = x
    out[1:, :SPAN] = x[:-1]
    out[:1, :SPAN] = 0 if before is None else before
    return out


def _attend(p: dict, ready: dict, given: np.ndarray, first: np.ndarray, before: np.ndarray | None):
    """Queries, keys, values, weights, what was attended to and the hidden states of consecutive spans; before: inputs of the span before them."""
    flat = given.ravel()
    at = lambda n: ready[n].take(flat, 0).reshape(*given.shape, -1)
    earlier = lambda n: None if before is None else ready[n].take(before, 0)
    q, k, v = at("q"), _with_before(at("k"), earlier("k")), _with_before(at("v"), earlier("v"))
    a = np.matmul(q, k.transpose(0, 2, 1))
    a *= np.float32(KEYS**-0.5)
    a += np.where(_LATER, _FAR, p["b"][_OFFSET])
    np.minimum(a, _MOST, out=a)
    np.exp(a, out=a)
    a[first, :, :SPAN] = 0
    a *= np.reciprocal(_sums(a))[..., None]
    o = np.matmul(a, v)
    h = at("r")
    h += o
    np.maximum(h, np.float32(0), out=h)
    return q, k, v, a, o, h.reshape(-1, SIZE)


def _by_class(shape: Shape, context: np.ndarray, next_: np.ndarray):
    """Places with a next id in order of its class; their contexts, classes and places in the class; and where each class begins."""
    goal = next_.ravel()
    some = np.flatnonzero(goal >= 0)
    of = shape.of[goal[some]]
    by = np.argsort(of, kind="stable")
    order, of = some[by], of[by].astype(np.int64)
    return order, context.ravel()[order], of, goal[order] - np.append(shape.edges[:-1], shape.used)[of], np.searchsorted(of, np.arange(shape.classes + 1))


def log_probabilities(shape: Shape, p: dict, ready: dict, given: np.ndarray, context: np.ndarray, first: np.ndarray, next_: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithms for consecutive spans, zero where there is no next id."""
    h = _attend(p, ready, given, first, before)[-1]
    order, x, of, at, edges = _by_class(shape, context, next_)
    h = h.take(order, 0)
    c = h @ p["uc"]
    c += shape.class_bias.take(x, 0)
    got = c[np.arange(len(of)), of].astype(float) - _log_sum(c)
    for j in range(shape.classes):
        a, b = edges[j], edges[j + 1]
        if b > a:
            m = h[a:b] @ p["um"][:, shape.edges[j] : shape.edges[j + 1]]
            m += shape.bias[j].take(x[a:b], 0)
            got[a:b] += m[np.arange(b - a), at[a:b]] - _log_sum(m)
    got[edges[-1] :] -= np.log(max(1, shape.unused))
    out = np.zeros(next_.size)
    out[order] = got
    return out.reshape(next_.shape)


def _sums(x: np.ndarray) -> np.ndarray:
    """Over the last axis; einsum is faster over few columns than sum, and unlike a product with ones gives equal rows equal sums wherever they lie."""
    return np.einsum("...j->...", x)


def _log_sum(x: np.ndarray) -> np.ndarray:
    total = _sums(np.exp(x))
    if np.isfinite(total).all():
        return np.log(total)
    top = x.max(1, keepdims=True)
    return top[:, 0] + np.log(np.exp(x - top).sum(1))


def _softmax(x: np.ndarray, whole: np.float32) -> np.ndarray:
    """Shares of whole; x is used up."""
    made = np.exp(x)
    total = _sums(made)
    if np.isfinite(total).all():
        made *= (whole / total)[:, None]
        return made
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x *= (whole / _sums(x))[:, None]
    return x


def gradients(shape: Shape, p: dict, given: np.ndarray, context: np.ndarray, first: np.ndarray, next_: np.ndarray) -> dict:
    """Of the mean negative logarithm over consecutive spans (of which the first sees nothing before it)."""
    first = first.copy()
    first[:1] = True
    ready = tables(p)
    q, k, v, a, o, h = _attend(p, ready, given, first, None)
    order, x, of, at, edges = _by_class(shape, context, next_)
    ho, share = h.take(order, 0), np.float32(1 / max(len(order), 1))
    dc = ho @ p["uc"]
    dc += shape.class_bias.take(x, 0)
    dc = _softmax(dc, share)
    dc[np.arange(len(of)), of] -= share
    g = {"uc": ho.T @ dc, "um": np.zeros_like(p["um"])}
    dho = dc @ p["uc"].T
    for j in range(shape.classes):
        s, e = edges[j], edges[j + 1]
        if e > s:
            own = slice(shape.edges[j], shape.edges[j + 1])
            dm = ho[s:e] @ p["um"][:, own]
            dm += shape.bias[j].take(x[s:e], 0)
            dm = _softmax(dm, share)
            dm[np.arange(e - s), at[s:e]] -= share
            g["um"][:, own] = ho[s:e].T @ dm
            dho[s:e] += dm @ p["um"][:, own].T
    dho *= ho > 0
    d = np.zeros((given.size, SIZE), np.float32)
    d[order] = dho
    d = d.reshape(*given.shape, SIZE)
    ds = np.matmul(d, v.transpose(0, 2, 1))
    ds -= np.einsum("spd,spd->sp", d, o)[:, :, None]
    ds *= a
    g["b"] = np.bincount(_OFFSET.ravel(), (ds.sum(0) * ~_LATER).ravel(), 2 * SPAN).astype(np.float32)
    ds *= np.float32(KEYS**-0.5)

    # what each position's query, key, value and residual want, the keys and values from both spans that see them
    wanted, at = np.empty((*given.shape, 2 * KEYS + 2 * SIZE), np.float32), {"q": slice(0, KEYS), "k": slice(KEYS, 2 * KEYS), "v": slice(2 * KEYS, 2 * KEYS + SIZE), "r": slice(2 * KEYS + SIZE, None)}
    np.matmul(ds, k, out=wanted[:, :, at["q"]])
    for name, both in (("k", np.matmul(ds.transpose(0, 2, 1), q)), ("v", np.matmul(a.transpose(0, 2, 1), d))):
        np.add(both[:-1, SPAN:], both[1:, :SPAN], out=wanted[:-1, :, at[name]])
        wanted[-1:, :, at[name]] = both[-1:, SPAN:]
    wanted[:, :, at["r"]] = d
    # sums by input
    flat = given.ravel()
    by = np.argsort(flat.astype(np.uint16), kind="stable")
    sorted_ = flat[by]
    edge = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    # two columns at a time, as one complex number
    rows, total = sorted_[edge], np.add.reduceat(wanted.reshape(flat.size, -1).take(by, 0).view(np.complex64), edge, 0).view(np.float32)
    g["e"] = np.zeros_like(p["e"])
    for name, part in at.items():
        g[name] = p["e"][rows].T @ total[:, part]
        g["e"][rows] += total[:, part] @ p[name].T
    return g


class Adam:
    """Adam over gradients of a norm of at most LARGEST."""

    def __init__(self, p: dict):
        self.m, self.v, self.t = {n: np.zeros_like(x) for n, x in p.items()}, {n: np.zeros_like(x) for n, x in p.items()}, 0

    def step(self, p: dict, g: dict, rate: float) -> None:
        """Changes p; g is used up."""
        self.t += 1
        norm = float(np.sqrt(sum(np.vdot(x, x) for x in g.values())))
        scale = np.float32(min(1.0, LARGEST / max(norm, 1e-30)))
        rate, even = np.float32(rate / (1 - 0.9**self.t)), np.float32((1 - 0.99**self.t) ** -0.5)
        for n in p:
            x, m, v = g[n], self.m[n], self.v[n]
            x *= scale
            m *= np.float32(0.9)
            m += np.float32(0.1) * x
            v *= np.float32(0.99)
            x *= x
            x *= np.float32(0.01)
            v += x
            np.sqrt(v, out=x)
            x *= even
            x += np.float32(1e-8)
            np.divide(m, x, out=x)
            x *= rate
            p[n] -= x


def packed(p: dict) -> bytes:
    return b"".join(p[n].astype("<f4").tobytes() for n in sorted(p))


def unpacked(like: dict, raw: bytes) -> dict:
    flat, at, out = np.frombuffer(raw, "<f4"), 0, {}
    for n in sorted(like):
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape).copy()
        at += like[n].size
    return out
