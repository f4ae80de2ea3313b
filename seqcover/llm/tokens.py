"""Token ids of all documents in files, in ascending order of doc_id, and their return from them.

Documents are dealt out by ranges of doc_id and sorted, so that the files in order of their part hold all documents in
order (null ids first, rows of one id in order of a hash of their text, by which they are dealt out too). A file is a Parquet part with a row for each stripe of
about STRIPE ids of whole documents in the format of idfile. A document's ids are those of the tokenizers library, each
white-space-separated chunk encoded once in a while and then looked up (the tokenizer splits there anyway), and an end
id. A null text is empty and has the end id alone; a text of any length is one document of one stripe. Repeated rows are
documents of their own; columns besides doc_id and text are left out; no rows give files without documents.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, idfile

VOCABULARY, END = "word_bpe_49k.json", 2
STRIPE = 5 << 20
#: The normal form and the cut before merging of the tokenizers that are known here.
KNOWN_FORM = ["NFC", "Replace", "Lowercase"]
KNOWN_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that are in normal form and stay one in lower case: ASCII, Latin letters, dashes, quotes; the letters among them in lower case; and that cut for texts of these.
_LETTERS = "a-zß-öø-ÿœ"
PLAIN = r"\A[\x00-\x7FÀ-ÖØ-öø-ÿŒœ–—‘-”…]*\z"
PIECES = rf"('(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^ \t-\r{_LETTERS}0-9]+)"
JOINED = 200
CACHED, CACHED_CHARS = 300_000, 64
#: Bytes of texts that are encoded together: the more, the fewer chunks and pieces are met again.
GATHERED = 8 << 20
#: White space of Python that isn't the tokenizer's, and chunks of texts that have it.
SEPARATORS, CHUNKS = re.compile("[\x1c-\x1f]"), re.compile(r"[\S\x1c-\x1f]+")


def chunked(text: str) -> list[str]:
    """The text cut at the tokenizer's white space."""
    return CHUNKS.findall(text) if SEPARATORS.search(text) else text.split()


class Encoder:
    """Ids by chunk or piece; of those not met again since the last CACHED new ones, none are kept.

    Texts of plain characters are put into lower case and cut into chunks and pieces by Arrow, as the tokenizer would,
    each different chunk once for all texts given at a time; each new piece is merged by the tokenizer's own model, JOINED
    at a time in one text, whose ids fall apart behind those that end a piece. Chunks of other texts, and all chunks if the
    tokenizer has another normal form or cut, go through the whole tokenizer one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        suffix, form, cut = said["model"].get("end_of_word_suffix"), said["normalizer"] or {}, said["pre_tokenizer"] or {}
        known_form = [x["type"] for x in form.get("normalizers", [])] == KNOWN_FORM
        known_cut = [x.get("pattern", {}).get("Regex") for x in cut.get("pretokenizers", [])] == [KNOWN_CUT, None] and cut["pretokenizers"][1]["type"] == "ByteLevel"
        self.plain = bool(suffix) and known_form and known_cut
        self.special = [x["content"] for x in said["added_tokens"]]
        self.merging = Tokenizer(self.tokenizer.model)
        self.merging.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.merging_bare = Tokenizer(self.tokenizer.model)
        self.merging_bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        found: list = [None] * len(pieces)
        # bytes of ASCII letters have their own names, so those pieces need no ByteLevel
        bare = [c.isalpha() and c.isascii() for c in pieces]
        for merging, which in ((self.merging_bare, np.flatnonzero(bare).tolist()), (self.merging, np.flatnonzero(~np.array(bare, bool)).tolist())):
            parts = [[pieces[k] for k in which[a : a + JOINED]] for a in range(0, len(which), JOINED)]
            made: list[bytes] = []
            for some, e in zip(parts, merging.encode_batch_fast([" ".join(some) for some in parts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                at, raw = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
                made += [raw[a:b] for a, b in zip([0, *at], at, strict=False)] if len(at) == len(some) and at[-1] == len(raw) else self._whole(some)
            for k, own in zip(which, made, strict=True):
                found[k] = own
        return found

    def _plain(self, texts: pa.Array) -> np.ndarray:
        """Whether PIECES cuts each text's chunks as the tokenizer does."""
        if not self.plain:
            return np.zeros(len(texts), bool)
        found = pc.match_substring_regex(texts, PLAIN).to_numpy(zero_copy_only=False)
        for x in self.special:
            found &= ~pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        return found

    def _looked_up(self, found: list[str], encoded: Callable[[list[str]], list[bytes]]) -> pa.LargeBinaryArray:
        """The ids of chunks or pieces; new ones are encoded and, unless they are long, known from then on."""
        own = list(map(self.known.get, found))
        fresh = [k for k, x in enumerate(own) if x is None]
        for k in fresh:
            own[k] = self.older.get(found[k])
        new = [k for k in fresh if own[k] is None]
        for k, x in zip(new, encoded([found[k] for k in new]), strict=True):
            own[k] = x
        self.known.update((found[k], own[k]) for k in fresh if len(found[k]) <= CACHED_CHARS)
        return pa.array(own, pa.large_binary())

    def _encoded_plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Each different chunk is cut once, and each different piece looked up once."""
        cut = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        chunks = cut.flatten().dictionary_encode()
        different = chunks.dictionary
        whole = pc.utf8_is_alpha(different)
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(different.filter(pc.invert(whole)), PIECES, r"\1 "))
        pieces = pa.concat_arrays([different.filter(whole), parts.flatten()]).dictionary_encode()
        found = self._looked_up(pieces.dictionary.to_pandas().tolist(), self._pieces).take(pieces.indices)
        # from pieces to chunks (those of one piece first), then to texts
        whole = whole.to_numpy(zero_copy_only=False)
        place = np.empty(len(whole), np.int32)
        place[np.concatenate([np.flatnonzero(whole), np.flatnonzero(~whole)])] = np.arange(len(whole))
        found = common.joined(found, np.concatenate([np.ones(np.count_nonzero(whole), np.int64), _sizes(parts)]))
        return _arrays(common.joined(found.take(pa.array(place[chunks.indices.to_numpy()])), _sizes(cut)))

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; an Arrow array has no nulls."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        plain = self._plain(texts)
        out: list = [None] * len(texts)
        if plain.any():
            for k, own in zip(np.flatnonzero(plain).tolist(), self._encoded_plain(texts.filter(pa.array(plain))), strict=True):
                out[k] = own
        odd = np.flatnonzero(~plain).tolist()
        if odd:
            cut = [chunked(texts[k].as_py()) for k in odd]
            names = list(set().union(*cut))
            place = {c: k for k, c in enumerate(names)}
            found = self._looked_up(names, self._whole).take(pa.array([place[c] for own in cut for c in own], pa.int64()))
            for k, own in zip(odd, _arrays(common.joined(found, np.array([len(own) for own in cut]))), strict=True):
                out[k] = own
        return out


def _arrays(found: pa.LargeBinaryArray) -> list[np.ndarray]:
    _, offsets, data = found.buffers()
    ids = np.frombuffer(data, "<u4") if data else np.zeros(0, "<u4")
    ends = (np.frombuffer(offsets, "<i8", len(found) + 1) >> 2).tolist()
    return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().to_numpy().astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """Once in each Python process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, stripe: int = STRIPE) -> None:
    """Files of part, stripe, n_ids and data in folder, which all executors share."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        get = encoder(path)
        part, number, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "stripe": pa.array([number], pa.int32()), "n_ids": pa.array([size], pa.int64()), "data": pa.array([idfile.packed(ids, held)], pa.binary())})

        for batch in common.gathered(batches, GATHERED):
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), get.encode(batch.column("text").fill_null("")), strict=True):
                ids.append(NONE if doc_id is None else doc_id)
                held.append(np.append(own, np.array([end], "<u4")))
                size += len(own) + 1
                if size >= stripe:
                    yield row()
                    number, ids, held, size = number + 1, [], [], 0
        if held:
            yield row()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("like", F.xxhash64("text")).repartitionByRange("doc_id", "like").sortWithinPartitions("doc_id", "like", "text").drop("like")
    dealt.mapInArrow(run, "part int, stripe int, n_ids long, data binary").write.option("compression", "none").parquet(folder)


#: Stands for a null doc_id in files.
NONE = -(1 << 63)


def read(spark, folder: str, ids: bool = True) -> DataFrame:
    """part, stripe, place, doc_id, n_tokens, ids_crc32 and (if asked for) ids, little-endian, of every document in the files."""

    def each(batch: pa.RecordBatch):
        for part, stripe, data in zip(*(batch.column(c).to_pylist() for c in ("part", "stripe", "data")), strict=True):
            doc_ids, lengths, all_ids = idfile.unpacked(data)
            ends = np.cumsum(lengths, dtype=np.int64)
            raw = [all_ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield {
                "part": np.full(len(raw), part, np.int32),
                "stripe": np.full(len(raw), stripe, np.int32),
                "before": ends - lengths,
                "doc_id": pa.array(doc_ids.astype(np.int64), mask=doc_ids == NONE),
                "n_tokens": lengths.astype(np.int64),
                "ids_crc32": [zlib.crc32(x) for x in raw],
            } | ({"ids": pa.array(raw, pa.binary())} if ids else {})

    files = spark.read.schema("part int, stripe int, n_ids long, data binary").parquet(folder)
    out = common.arrow_map(files.select("part", "stripe", "data"), each, "part int, stripe int, before long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    # ids before each stripe: by part, then within it; neither window meets more rows than there are parts or stripes of a part
    own = files.select("part", "stripe", "n_ids")
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = own.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier(Window.orderBy("part")).alias("before_part"))
    stripes = own.select("part", "stripe", earlier(Window.partitionBy("part").orderBy("stripe")).alias("before_stripe")).join(parts, "part")
    return out.join(stripes, ["part", "stripe"]).withColumn("start", F.col("before") + F.col("before_stripe") + F.col("before_part"))


def query(spark, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "documents"), folder)
    return read(spark, folder, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
