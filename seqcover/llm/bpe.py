"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece there is exactly one last token that the merges can leave there: the vocabulary token
ending at that place which the merges keep apart from the last token of the prefix before it. Keeping that token for
every prefix gives the encoding of all prefixes at once: bytes are appended without encoding anything again, and an
edit recomputes from its place until the stored tokens agree with the old ones for the length of the longest token.

A text is first split by a pattern, and each piece is encoded by itself; a piece that is a token as a whole is that
token, as in tiktoken. No special tokens are recognised. A null text is empty and has no ids. Each row is encoded by
itself: repeated rows give equal ids, null ids stay null, texts of any length are encoded whole, columns besides doc_id
and text are left out, no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pieces whose ids a Python worker keeps, the longest of them in characters, and pairs of tokens that it keeps answers for.
CACHED, CACHED_CHARS, PAIRS = 100_000, 64, 250_000
TEXTS = 256
#: Bytes at the end of a prefix by which the lengths that its last token may have are looked up.
TAIL = 4


class Vocabulary:
    """Ranks by token bytes, with the answers to "do the merges keep these tokens apart?" as they come up."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._stable: dict[int, bool] = {}
        self._apart: dict[int, bool] = {}
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            ends.setdefault(token[-TAIL:], set()).add(len(token))
        #: Lengths of the tokens that end in these TAIL bytes, and of shorter ones that may, the longest first.
        self.lengths = {tail: tuple(sorted(own | set(range(1, TAIL)), reverse=True)) for tail, own in ends.items() if len(tail) == TAIL}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merged(self, piece: bytes) -> list[int]:
        """The merges carried out one by one: the definition, for short strings."""
        rank, none = self.rank.get, 1 << 40
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return [self.rank[x] for x in parts]

    def stable(self, token: int) -> bool:
        """Whether the merges turn the token's own bytes into the token."""
        if (known := self._stable.get(token)) is None:
            known = self._stable[token] = self.merged(self.bytes[token]) == [token]
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges turn the bytes of the right token into it, and leave the two tokens, the left one being stable, side by side."""
        pair = left << 32 | right
        if (known := self._apart.get(pair)) is None:
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            known = self._apart[pair] = self.stable(right) and self._parted(self.bytes[left], self.bytes[right])
        return known

    def _parted(self, left: bytes, right: bytes) -> bool:
        """Whether no merge of both strings' bytes joins the one to the other."""
        rank, none, piece, first = self.rank.get, 1 << 40, left + right, len(left)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while (best := min(pairs)) < none:
            at = pairs.index(best)
            if at == first - 1:
                return False
            first -= at < first
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return len(parts) == 2


_SHORT = tuple(range(TAIL - 1, 0, -1))


class Prefixes:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def _last(self, end: int) -> int:
        v, piece, last = self.vocabulary, self.piece, self.last
        rank, apart = v.rank.get, v._apart.get
        for length in v.lengths.get(piece[end - TAIL : end], _SHORT) if end >= TAIL else _SHORT:
            if length > end or (token := rank(piece[end - length : end])) is None:
                continue
            if length == end:
                good = v.stable(token)
            elif (good := apart(last[end - length] << 32 | token)) is None:
                good = v.apart(last[end - length], token)
            if good:
                return token
        raise ValueError(f"the vocabulary lacks byte {piece[end - 1]}")

    def append(self, more: bytes) -> None:
        start = len(self.piece)
        self.piece += more
        for end in range(start + 1, len(self.piece) + 1):
            self.last.append(self._last(end))

    def turn(self, piece: bytes) -> None:
        """Becomes another piece; prefixes that both have stay."""
        was, same, most = self.piece, 0, min(len(self.piece), len(piece))
        while same < most and was[same] == piece[same]:
            same += 1
        del self.last[same + 1 :]
        self.piece = was[:same]
        self.append(piece[same:])

    def replace(self, at: int, gone: int, new: bytes) -> int:
        """Puts new in the place of gone bytes from at on; returns how many prefixes were computed again."""
        tail = self.last[at + gone + 1 :]
        self.piece = self.piece[:at] + new + self.piece[at + gone :]
        del self.last[at + 1 :]
        agreed = done = 0
        for end in range(at + 1, len(self.piece) + 1):
            self.last.append(self._last(end))
            done += 1
            k = end - at - len(new) - 1
            agreed = agreed + 1 if k >= 0 and self.last[end] == tail[k] else 0
            if agreed >= self.vocabulary.longest:
                self.last += tail[k + 1 :]
                break
        return done

    def ids(self) -> list[int]:
        """Tokens from the end to the start, turned round."""
        if self.piece in self.vocabulary.rank:
            return [self.vocabulary.rank[self.piece]]
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes[self.last[end]])
        return out[::-1]


class EditedText:
    """A text that changes: only pieces near an edit are split and encoded again."""

    #: The pattern looks at no more characters than these beyond a piece's start without taking them.
    BACK = 3

    def __init__(self, vocabulary: Vocabulary, text: str = "", pattern: str = public_tokenizers.PATTERN):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.pieces: list[tuple[str, list[int]]] = []
        self.replace(0, 0, text)

    def text(self) -> str:
        return "".join(piece for piece, _ in self.pieces)

    def ids(self) -> list[int]:
        return [x for _, ids in self.pieces for x in ids]

    def append(self, more: str) -> int:
        return self.replace(sum(len(piece) for piece, _ in self.pieces), 0, more)

    def replace(self, at: int, gone: int, new: str) -> int:
        """Returns how many pieces were encoded again."""
        starts = [0]
        for piece, _ in self.pieces:
            starts.append(starts[-1] + len(piece))
        first = 0
        while first < len(self.pieces) and starts[first + 1] <= at - self.BACK:
            first += 1
        text = self.text()
        whole = text[:at] + new + text[at + gone :]
        old = {s + len(new) - gone: k for k, s in enumerate(starts) if s >= at + gone}
        made, end = [], len(self.pieces)
        for m in self.pattern.finditer(whole, starts[first]):
            if m.start() >= at + len(new) and m.start() in old:
                end = old[m.start()]
                break
            made.append((m[0], Prefixes(self.vocabulary, m[0].encode()).ids()))
        self.pieces[first:end] = made
        return len(made)


class _Ids(dict):
    """Little-endian ids of each piece; of those not met again since the last CACHED new ones, none are kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def learn(self, pieces: set[str]) -> None:
        """Takes in all pieces. New ones are encoded in order, each from the prefixes that it shares with the one before."""
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        new = pieces.difference(self)
        again = new & self.older.keys()
        self.update((x, self.older[x]) for x in again)
        prefixes, rank = Prefixes(self.vocabulary), self.vocabulary.rank.get
        for piece in sorted(new - again):
            raw = piece.encode()
            if (token := rank(raw)) is None:
                prefixes.turn(raw)
                ids = prefixes.ids()
                self[piece] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                self[piece] = token.to_bytes(4, "little")

    def forget(self, pieces: set[str]) -> None:
        """Drops the long ones of pieces."""
        for piece in pieces:
            if len(piece) > CACHED_CHARS:
                self.pop(piece, None)


_loaded: dict[str, tuple[Vocabulary, _Ids, list[bytes]]] = {}


def loaded(path: str) -> tuple[Vocabulary, _Ids, list[bytes]]:
    """Once in each Python process."""
    if path not in _loaded:
        v = Vocabulary.load(path)
        _loaded[path] = v, _Ids(v), [v.bytes.get(i, b"") for i in range(max(v.bytes, default=-1) + 1)]
    return _loaded[path]


def _encoded(texts: pa.Array, split, ids_of: _Ids):
    """Each text (null: empty) and its ids; the pieces of TEXTS texts are encoded together."""
    for k in range(0, len(texts), TEXTS):
        some = [x or "" for x in texts[k : k + TEXTS].to_pylist()]
        cut = [split(x) for x in some]
        pieces = set().union(*cut)
        ids_of.learn(pieces)
        yield from zip(some, [b"".join(map(ids_of.__getitem__, own)) for own in cut], strict=True)
        ids_of.forget(pieces)


def encoded(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and either ids (little-endian unsigned 32-bit) and whether they decode to the text, or both as SHA-256."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, round_trip boolean")

    def each(batch: pa.RecordBatch) -> dict:
        _, ids_of, token = loaded(path)
        split, spell = regex.compile(pattern).findall, token.__getitem__
        counts, first, second = [], [], []
        for text, ids in _encoded(batch.column("text"), split, ids_of):
            decoded = b"".join(map(spell, np.frombuffer(ids, "<u4").tolist()))
            counts.append(len(ids) // 4)
            if digests:
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(decoded).hexdigest())
            else:
                first.append(ids)
                second.append(decoded == text.encode())
        names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "round_trip")
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_tokens": counts, names[0]: first, names[1]: second}

    return common.arrow_map(docs.select("doc_id", "text"), each, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return encoded(common.table(spark, sf_dir, "documents"), digests=True)
