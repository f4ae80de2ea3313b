"""Token ids in files of independently coded blocks: context mixing over order-0 to order-2 predictions, and a range coder.

A stripe is a run of whole documents. Its ids, named by their rank in the stripe's own order of frequency, are cut into
blocks of BLOCK ids. Each block starts from the same state and can be decoded by itself; its CRC-32 is checked. Order 0
predicts every id by its share of the stripe's ids, which the head of the stripe has. The order-1 and order-2 contexts
(hashed) each predict the id that came last behind them in the block; how sure they are is how often in a row that came
true, and their weight is an adaptive share of the block's predictions, as sure as this one, that came true. The three
are mixed into one distribution: order 2 takes its weight, order 1 its weight of the rest, and order 0 what is left. All
blocks of a stripe are coded side by side with numpy, one id of each at a time.

Layout of a stripe, little-endian: MAGIC, then unsigned 32-bit block length, numbers of documents, ids, distinct ids and
blocks, and the sizes of four zlib streams: document ids (signed 64-bit), their numbers of ids, ids in order of rank and
how often each occurs (unsigned 32-bit); then for each block the size and the CRC-32 of its ids (unsigned 32-bit), then
the blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IDS2"
BLOCK = 1024
#: Shares of order 0 are out of 2**bits, with a few bits more than the number of distinct ids has; the mixed ones out of 2**(bits + _MORE).
_LEAST_BITS, _MOST_BITS, _MORE = 16, 27, 4
#: The coder's window has 48 bits and moves on by 16 while the width has less than 33.
_WINDOW, _WORD, _NARROW, _BELOW = 48, 16, 1 << 32, 32
#: Contexts are hashed to so many bits, and the coder names those of so many steps at a time.
_HASHED, _STEPS = 9, 64


def shares(counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Bits of the whole, and the ends of the ranks' shares of it (the first is 0); each rank has at least one."""
    n, bits = len(counts), max(_LEAST_BITS, int(len(counts)).bit_length() + 2)
    if bits > _MOST_BITS:
        raise ValueError("a stripe of too many distinct ids")
    own = 1 + counts.astype(np.int64) * ((1 << bits) - n) // max(1, int(counts.sum()))
    if n:
        own[0] += (1 << bits) - own.sum()
    return bits, np.concatenate([[0], np.cumsum(own)])


class _Mixer:
    """What n blocks side by side know so far; the coder and the decoder run the same steps.

    Rows are order 1 and order 2. For each of a block's contexts, `said` has the id that came last behind it and, in the
    lowest four bits, how sure that is; `true` has the share of a block's predictions, as sure, that came true. Blocks
    that are as sure have these shares side by side: most predictions are unsure, so theirs stay in the processor's cache.
    """

    def __init__(self, n: int, counts: np.ndarray):
        self.bits, self.ends = shares(counts)
        self.scale = self.bits + _MORE
        self.total = 1 << self.scale
        self.room = self.total - (1 << self.bits)
        self.lanes = max(1, n - 1).bit_length()
        self.n, self.said = n, np.full(2 * n << _HASHED, -16, np.int32)
        self.true = np.repeat(np.array([64, *[1024] * 15, 64, *[2048] * 15], np.int32), 1 << self.lanes)
        # hashes of each rank, behind that of no rank, as the last one for order 1 and order 2 and as the one before it
        mixed = (np.arange(len(counts) + 1, dtype=np.int64) * 0x9E3779B1) & 0xFFFFFFFF
        self.hashed = np.stack([mixed >> (32 - _HASHED), (mixed * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - _HASHED), (mixed >> 5) & ((1 << _HASHED) - 1)])
        self.cut(n)

    def cut(self, n: int) -> None:
        """The blocks from the n-th on have ended."""
        lane, order = np.arange(n), np.arange(2)[:, None]
        self.base, self.rows = (order * self.n + lane) << _HASHED, lane + (order << 4 + self.lanes)

    def contexts(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """From ranks plus one (zero for none): the hashes of order 1 and order 2."""
        out = np.empty((2, *last.shape), np.int64)
        np.take(self.hashed[0], last, out=out[0], mode="clip")
        np.bitwise_xor(self.hashed[1].take(last), self.hashed[2].take(before), out=out[1])
        return out

    def predict(self, contexts: np.ndarray) -> None:
        """f2 and f1, the widths of order 2 and order 1 (none where they agree); order 0 has what is left."""
        self.at = self.base + contexts
        self.was = self.said.take(self.at)
        self.sure = self.was & 15
        self.id = self.was >> 4
        self.row = self.sure.astype(np.int64)
        self.row <<= self.lanes
        self.row += self.rows
        self.share = self.true.take(self.row)
        wide = self.share.astype(np.int64)
        self.f2 = wide[1] * (self.room >> 12)
        self.f1 = self.room - self.f2
        self.f1 *= wide[0]
        self.f1 >>= 12
        self.f1 *= self.id[0] != self.id[1]
        self.known = self.f1 + self.f2
        self.left = self.total - self.known

    def interval(self, below: np.ndarray, above: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each id's share, from its share in order 0; hit2 and hit1 tell the ids that order 2 or else order 1 predicts."""
        below = below * self.left
        below >>= self.bits
        above = above * self.left
        above >>= self.bits
        above -= below
        below += self.known
        start, width = np.where(hit1, self.f2, below), np.where(hit1, self.f1, above)
        start[hit2] = 0
        np.copyto(width, self.f2, where=hit2)
        return start, width

    def update(self, rank: np.ndarray) -> None:
        rank = rank.astype(np.int32)
        hit = self.id == rank
        change = hit * np.int32(4064)
        change += np.int32(16)
        change -= self.share
        change >>= 4
        change += self.share
        self.true[self.row] = change
        self.said[self.at] = np.where(hit, self.was + (self.sure < 15), rank << 4)


def _coded(ranks: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Each row of ranks, as long as lengths says (longest first), by itself."""
    n, most = ranks.shape
    mixer = _Mixer(n, counts)
    low_, wide_ = np.zeros(n, np.int64), np.full(n, 1 << _WINDOW, np.int64)
    # words of 16 bits, and above them a carry into the word before
    out = np.zeros((n, 2 * most + 8), np.uint32)
    flat, first = out.reshape(-1), np.arange(n) * out.shape[1]
    end, alive = first.copy(), n
    for t in range(most):
        if lengths[alive - 1] <= t:
            while lengths[alive - 1] <= t:
                alive -= 1
            mixer.cut(alive)
        k = t % _STEPS
        if not k:
            some = np.zeros((min(_STEPS, most - t) + 2, n), np.int64)
            some[2 * (not t) :] = ranks[:, max(0, t - 2) : t + _STEPS].T
            some[2 * (not t) :] += 1
            contexts, ranks_ = mixer.contexts(some[1:-1], some[:-2]), some[2:] - 1
            below, above = mixer.ends.take(ranks_, mode="clip"), mixer.ends.take(ranks_ + 1, mode="clip")
        rank, low, wide = ranks_[k, :alive], low_[:alive], wide_[:alive]
        mixer.predict(contexts[:, k, :alive])
        hit = mixer.id == rank
        start, width = mixer.interval(below[k, :alive], above[k, :alive], hit[1], hit[0])
        wide >>= mixer.scale
        start *= wide
        low += start
        wide *= width
        while len(lanes := np.flatnonzero(wide < _NARROW)):
            here, at = low[lanes], end[lanes]
            flat[at] = here >> _BELOW
            end[lanes] = at + 1
            low[lanes] = (here & (_NARROW - 1)) << _WORD
            wide[lanes] <<= _WORD
        mixer.update(rank)
    for _ in range(3):
        flat[end] = low_ >> _BELOW
        end += 1
        low_ = (low_ & (_NARROW - 1)) << _WORD
    end -= first
    out = out[:, : int(end.max(initial=0))]
    while (over := out >> 16).any():
        out &= (1 << _WORD) - 1
        out[:, :-1] += over[:, 1:]
    made = out.astype(">u2")
    return [made[k, : end[k]].tobytes() for k in range(n)]


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b of numbers under 2**48 whose quotient is under 2**27: a float can't round that up to the next whole number, and its division is faster."""
    out = a.astype(float)
    out /= b
    return out.astype(np.int64)


def _decoded(blocks: list[bytes], lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n, most = len(blocks), int(lengths.max(initial=0))
    mixer = _Mixer(n, counts)
    at_share = np.repeat(np.arange(len(counts), dtype=np.int32), np.diff(mixer.ends))
    data = np.zeros((n, max(map(len, blocks), default=0) // 2 + 8), np.uint16)
    for k, block in enumerate(blocks):
        words = np.frombuffer(block[: len(block) // 2 * 2], ">u2")
        data[k, : len(words)] = words
    flat, last = data.reshape(-1), (np.arange(n) + 1) * data.shape[1] - 1
    next_ = np.arange(n) * data.shape[1] + 3
    # how far the code lies above the low end, and the width
    wide_, first = np.full(n, 1 << _WINDOW, np.int64), data[:, :3].astype(np.int64)
    code_ = (first[:, 0] << 32) | (first[:, 1] << _WORD) | first[:, 2]
    out = np.zeros((most + 2, n), np.int32)
    alive = n
    for t in range(most):
        if lengths[alive - 1] <= t:
            while lengths[alive - 1] <= t:
                alive -= 1
            mixer.cut(alive)
        wide, code = wide_[:alive], code_[:alive]
        mixer.predict(mixer.contexts(out[t + 1, :alive], out[t, :alive]))
        wide >>= mixer.scale
        target = np.minimum(_quotient(code, wide), mixer.total - 1)
        hit2 = target < mixer.f2
        hit1 = target < mixer.known
        hit1 &= ~hit2
        # the rank whose share, narrowed to what is left, holds the target
        target -= mixer.known
        target += 1
        target <<= mixer.bits
        target -= 1
        target = _quotient(target, mixer.left)
        rank = at_share.take(target, mode="clip").astype(np.int64)
        np.copyto(rank, mixer.id[0], where=hit1)
        np.copyto(rank, mixer.id[1], where=hit2)
        start, width = mixer.interval(mixer.ends.take(rank, mode="clip"), mixer.ends.take(rank + 1, mode="clip"), hit2, hit1)
        start *= wide
        code -= start
        wide *= width
        while len(lanes := np.flatnonzero(wide < _NARROW)):
            at = next_[lanes]
            code[lanes] = (code[lanes] << _WORD) | flat[np.minimum(at, last[lanes])]
            next_[lanes] = at + 1
            wide[lanes] = np.maximum(wide[lanes], 1) << _WORD
        code &= (1 << _WINDOW) - 1
        mixer.update(rank)
        rank += 1
        out[t + 2, :alive] = rank
    return out[2:].T - 1


def packed(doc_ids: list[int], documents: list[np.ndarray]) -> bytes:
    """One stripe. Document ids may be any signed 64-bit numbers, repeated or not; documents may be empty."""
    lengths = np.array([len(x) for x in documents], "<u4")
    ids = np.concatenate(documents).astype("<u4") if documents else np.zeros(0, "<u4")
    small = len(ids) and ids.max() < 1 << 24
    if small:  # small ids need no sort
        found = np.bincount(ids)
        names = np.flatnonzero(found)
        counts = found[names]
    else:
        names, which, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((names, -counts))
    rank_of = np.zeros(len(found) if small else len(order), np.int32)
    rank_of[names[order] if small else order] = np.arange(len(order))
    n = -(-len(ids) // BLOCK)
    ranks = np.zeros(n * BLOCK, np.int32)
    np.take(rank_of, ids if small else which.reshape(-1), out=ranks[: len(ids)], mode="clip")
    sizes = np.minimum(BLOCK, len(ids) - BLOCK * np.arange(n))
    blocks = _coded(ranks.reshape(n, BLOCK)[:, : sizes.max(initial=0)], sizes, counts[order]) if n else []
    streams = [zlib.compress(x.tobytes()) for x in (np.array(doc_ids, "<i8"), lengths, names[order].astype("<u4"), counts[order].astype("<u4"))]
    checks = [zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].tobytes()) for k in range(n)]
    head = struct.pack("<4s9I", MAGIC, BLOCK, len(documents), len(ids), len(names), n, *map(len, streams))
    return b"".join([head, *streams, *(struct.pack("<2I", len(b), c) for b, c in zip(blocks, checks, strict=True)), *blocks])


def unpacked(stripe: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids; ValueError if a block isn't what was written."""
    magic, block, n_docs, n_ids, distinct, n, *sizes = struct.unpack_from("<4s9I", stripe)
    if magic != MAGIC:
        raise ValueError("not a stripe of ids")
    at, streams = 40, []
    for size, kind in zip(sizes, ("<i8", "<u4", "<u4", "<u4"), strict=True):
        streams.append(np.frombuffer(zlib.decompress(stripe[at : at + size]), kind))
        at += size
    doc_ids, lengths, names, counts = streams
    table = [struct.unpack_from("<2I", stripe, at + 8 * k) for k in range(n)]
    at += 8 * n
    blocks = []
    for size, _ in table:
        blocks.append(stripe[at : at + size])
        at += size
    own = np.minimum(block, n_ids - block * np.arange(n))
    if not n:
        return doc_ids, lengths, np.zeros(0, "<u4")
    # rows of a stripe of one short block are no longer than that block
    ranks = _decoded(blocks, own, counts).reshape(-1)[:n_ids]
    if ranks.min(initial=0) < 0 or ranks.max(initial=0) >= distinct:
        raise ValueError("a block names an id that the stripe has not")
    ids = names[ranks]
    for k, (_, check) in enumerate(table):
        if zlib.crc32(ids[k * block : (k + 1) * block].tobytes()) != check:
            raise ValueError(f"block {k} of {n} fails its check")
    return doc_ids, lengths, ids
