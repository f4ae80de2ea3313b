import hashlib
import json
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from helpers import SMALL, rows_of
from tokenizers import Tokenizer

import __spark_entry__
from seqcover.llm import attention, bpe, common, decontaminate, html, html_samples, idfile, linededup, lm, neardup, pii, quality, simhash, substring, tokens
from seqcover.llm import queries as llm

SPACE = re.compile(r"[ \t-\r]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def documents(spark):
    return common.table(spark, SMALL, "documents").select("doc_id", "text").collect()


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(llm.QUERIES[name](spark, SMALL)) == rows_of(duck.execute(llm.ORACLE_SQL[name]).df())


def test_each_operator_has_a_query():
    found = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 14)) and "pipeline" in found


# quality rules


def rules(text):
    own = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(zip(own, own[1:], own[2:], strict=False))
    hit = {k + j for k in range(len(own) - 2) if seen[tuple(own[k : k + 3])] > 1 for j in range(3)}
    return len(own), sum(map(len, own)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, documents, odd, none):
    got = {r.doc_id: r for r in llm.QUERIES["op3_quality_rules"](spark, SMALL).collect()}
    for doc in documents:
        r, want = got[doc.doc_id], rules(doc.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert sorted((r.n_words, r.n_repeat_words) for r in quality.verdicts(odd, None).collect()) == sorted((rules(r.text)[0], rules(r.text)[4]) for r in odd.collect())
    labels = common.table(spark, SMALL, "labels")
    assert quality.keep(odd, labels.limit(0)).columns == odd.columns and quality.keep(none, labels).count() == 0


def slow_odd(forest, figures):
    """The mean path of one row, node by node."""
    total = 0.0
    for t in range(quality.TREES):
        node = 0
        while 2 * node + 2 < 2 ** (quality.DEPTH + 1):
            node = 2 * node + (2 if figures[forest.feature[t, node]] > forest.split[t, node] else 1)
        total += forest.length[t, node]
    return 2 ** (-total / quality.TREES / forest.norm)


def test_verdicts_equal_slow_paths(spark, documents):
    docs, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    forest, again = quality.fit(docs, labels), quality.fit(docs.union(docs).repartition(5), labels)
    assert forest.threshold == again.threshold and (forest.split == again.split).all()
    got = {r.doc_id: (r.base_failed, r.kept, r.odd) for r in llm.QUERIES["op3_quality_rules"](spark, SMALL).collect()}
    for doc in documents:
        failed, kept, odd = got[doc.doc_id]
        want = slow_odd(forest, quality.features(np.array([quality.statistics((doc.text or "").encode())]))[0])
        assert math.isclose(odd, want, rel_tol=1e-9) and kept == (not failed and odd <= forest.threshold)


def test_forest_tells_bad_from_good(spark):
    labels = common.table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality.verdicts(docs := common.table(spark, "/root/testdata/sf0.01", "documents"), quality.fit(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.4


def test_forest_counts_every_labelled_row(spark):
    """More labelled rows than any bound there was: path lengths and threshold equal those from all rows, held together in one place."""
    word = "concat(if(id % 10 = 0 and k % 4 = 0, '#', 'w'), substr(md5(concat(id, ' ', k)), 1, 2 + id % 7))"
    docs = spark.range(20_500).selectExpr("id as doc_id", f"concat_ws(' ', transform(sequence(1, cast(52 + id % 30 as int)), k -> {word})) as text")
    labels = docs.selectExpr("doc_id", "if(doc_id % 20 = 0, 0.0, 1.0) as quality")
    forest = quality.fit(docs, labels)
    grows = "pmod(xxhash64(doc_id, 'half'), 2) = 0 as grows"
    rows = quality.verdicts(docs, None).where("not base_failed").selectExpr(*quality.COUNTS, "doc_id % 20 > 0 as good", grows).toPandas()
    assert len(rows) > 20_000
    x, good, grows = quality.features(rows[quality.COUNTS].to_numpy()), rows["good"].to_numpy(), rows["grows"].to_numpy()
    for t in range(0, quality.TREES, 9):
        todo = [(0, 0, x[good & grows])]
        while todo:
            node, depth, own = todo.pop()
            if depth == quality.DEPTH or len(own) < 2 or np.isinf(forest.split[t, node]):
                first, last = node, node
                for _ in range(quality.DEPTH - depth):
                    first, last = 2 * first + 1, 2 * last + 2
                assert np.allclose(forest.length[t, first : last + 1], depth + quality._path(len(own)), rtol=1e-12)
            else:
                above = own[:, forest.feature[t, node]] > forest.split[t, node]
                todo += [(2 * node + 1, depth + 1, own[~above]), (2 * node + 2, depth + 1, own[above])]
    g, b = (np.ceil(forest.scores(x[~grows & w]) * quality.STEPS) for w in (good, ~good))
    best = max((np.mean(g <= c) + np.mean(b > c), -c) for c in np.unique(np.append(g, b)) if np.mean(g <= c) >= 1 - quality.MAX_LOST)
    assert math.isclose(forest.threshold * quality.STEPS, -best[1])


# line dedup


def test_line_dedup_edges(spark, odd, none):
    out = linededup.clean(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert linededup.clean(none).count() == 0
    pages = spark.createDataFrame([(k, "h" if k < 12 else None, f"top\n\nbody {k}\nbody {k}") for k in range(14)] + [(99, None, None)], "doc_id long, source string, text string")
    for limit in (linededup.BROADCAST_BYTES, -1):
        linededup.BROADCAST_BYTES, was = limit, linededup.BROADCAST_BYTES
        got = {r.doc_id: r.text for r in linededup.clean(pages, ratio=0.2).collect()}
        linededup.BROADCAST_BYTES = was
        assert got == {k: f"\nbody {k}\nbody {k}" for k in range(14)} | {99: None}


def test_line_dedup_knows_the_ratio_alone(spark):
    rows = [(f"{n}-{k}", f"h{n}", f"same\nown {n} {k}\nhalf {k // 2}") for n in (1, 2, 4, 5, 40) for k in range(n)]
    got = {r.doc_id: r.text for r in linededup.clean(spark.createDataFrame(rows, "doc_id string, source string, text string"), ratio=0.5).collect()}
    for n in (1, 2, 4, 5, 40):
        for k in range(n):
            half = n > 2 or n == 1  # on two of two pages; on two of four it is just the ratio, which stays
            assert got[f"{n}-{k}"] == "\n".join(["same"] * (n == 1) + [f"own {n} {k}"] + [f"half {k // 2}"] * half)


# simhash


def slow_print(text, n=3):
    own = lower(text).encode().split()
    parts = [b" ".join(own[k : k + n]) for k in range(max(1, len(own) - n + 1))] if own else []
    return sum(1 << b for b in range(64) if parts and 2 * sum(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in parts) > len(parts))


def slow_groups(rows, budget):
    """Smallest id reachable over links, from (id, fingerprint) rows."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if (a ^ b).bit_count() <= budget and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def test_simhash_equals_brute_force(spark, documents):
    rows = [(d.doc_id, slow_print(d.text)) for d in documents]
    want = slow_groups(rows, 2)
    got = llm.QUERIES["op9_simhash"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in rows}


@pytest.mark.parametrize("subtree", [simhash.SUBTREE, 2])
def test_trie_walk_finds_all_links(spark, subtree, monkeypatch):
    monkeypatch.setattr(simhash, "SUBTREE", subtree)
    rng = np.random.default_rng(3)
    prints = {int(x) for x in rng.integers(0, 2**63, 12)}
    for _ in range(80):
        prints.add(int(rng.choice(sorted(prints))) ^ (1 << int(rng.integers(62))))
    rows = [(k, p) for k, p in enumerate(sorted(prints, key=hash))]
    from seqcover.llm import graph

    roots = {r.node: r.root for r in graph.components(simhash.links(spark.createDataFrame(rows, "id long, fp long"), 2)).collect()}
    assert {i: roots.get(i, i) for i, _ in rows} == slow_groups(rows, 2)


def test_simhash_edges(odd, none):
    out = simhash.deduplicated(odd)
    kept = out.collect()
    assert out.columns == odd.columns and simhash.deduplicated(none).count() == 0
    prints = [slow_print(r.text) for r in kept]
    assert len(kept) == len({i for i in slow_groups(list(enumerate({slow_print(r.text) for r in odd.collect()})), 2).values()}) and len(set(prints)) == len(prints)
    assert sorted(r.component_id for r in simhash.grouped(odd).collect() if r.doc_id == 5) == [5, 5, 5]


@pytest.mark.parametrize("deduplicated", [simhash.deduplicated, neardup.deduplicated])
def test_unlike_rows_without_ids_of_their_own_stay(spark, deduplicated):
    rng = np.random.default_rng(4)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(6)]
    rows = [(7, text[0]), (None, text[0]), (None, text[1]), (None, text[2]), (None, text[3]), (None, text[3]), (8, text[4]), (8, text[5]), (8, text[5]), (9, text[5])]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long").repartition(3)
    got = deduplicated(docs).collect()
    assert sorted(((r.doc_id or 0), text.index(r.text)) for r in got) == [(0, 1), (0, 2), (0, 3), (7, 0), (8, 4), (8, 5)]


# decontamination


def test_decontaminate_edges(spark, odd, none):
    items = spark.createDataFrame([(1, "P0 p1, p2 p3 p4 p5 p6 p7 p8 p9 p10"), (2, "of1 the"), (3, None), (4, ""), (None, "A"), (10, "of1 THE")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(odd, items).collect()}
    assert (got[9].n_hit, got[9].n_items) == (11, 1) and got[3].n_hit == 1 and got[0].n_words == 0
    assert got[5].items_sha256 == hashlib.sha256(b"10,2").hexdigest()
    assert decontaminate.clean(odd, items).columns == odd.columns and decontaminate.clean(none, items).count() == 0
    assert decontaminate.clean(odd, items.limit(0)).count() == odd.count()
    was, decontaminate.BLOCK_WORDS = decontaminate.BLOCK_WORDS, 60
    blocks = rows_of(decontaminate.report(odd, items))
    decontaminate.BLOCK_WORDS = was
    assert blocks == rows_of(decontaminate.report(odd, items)) and len(blocks) == odd.count()


# byte-level BPE


def coding():
    v = bpe.Vocabulary.load(public_tokenizers.path(bpe.VOCABULARY))
    return v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.rank, special_tokens={})


def test_bpe_equals_library(spark, documents, odd, none):
    _, library = coding()
    got = {r.doc_id: r for r in llm.QUERIES["op5_byte_bpe"](spark, SMALL).collect()}
    for d in documents:
        ids = library.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
    out = bpe.encoded(odd).collect()
    assert len(out) == odd.count() and all(r.round_trip for r in out) and bpe.encoded(none).count() == 0


def test_bpe_appends_and_edits():
    import random

    v, library = coding()
    rng, letters = random.Random(2), "abcdefgthe ñé\n  '0123!!#=—中"
    for _ in range(200):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(50)))
        edited = bpe.EditedText(v, text)
        at = rng.randint(0, len(text))
        gone, new = rng.randint(0, len(text) - at), "".join(rng.choice(letters) for _ in range(rng.randrange(5)))
        edited.replace(at, gone, new)
        edited.append(new)
        assert edited.ids() == library.encode_ordinary(text[:at] + new + text[at + gone :] + new)
    piece = bpe.Prefixes(v, b"unbelievable" * 20)
    redone = piece.replace(5, 1, b"E")
    assert piece.ids() == bpe.Prefixes(v, piece.piece).ids() and redone < 120


def test_new_pieces_share_prefixes(monkeypatch):
    """Pieces learnt together have the ids that they have alone, for less than a prefix each of their bytes; equal whatever the vocabulary leaves out."""
    v = bpe.Vocabulary.load(public_tokenizers.path(bpe.VOCABULARY))
    pieces = {"", "é", "unbelievable", *(f" unbeliev{a}{b}zq" for a in "abcdeéß" for b in "xyz"), *("qx" * k for k in range(1, 40)), "#" * 300, "1" * 77}
    done, last = [], bpe.Prefixes._last
    monkeypatch.setattr(bpe.Prefixes, "_last", lambda self, end: done.append(end) or last(self, end))
    ids = bpe._Ids(v)
    ids.learn(pieces)
    assert len(done) < 0.5 * sum(len(x.encode()) for x in pieces)
    for x in pieces:
        raw = x.encode()
        assert np.frombuffer(ids[x], "<u4").tolist() == ([v.rank[raw]] if raw in v.rank else v.merged(raw)) == tiktoken.Encoding("all", pat_str="(?s).+", mergeable_ranks=v.rank, special_tokens={}).encode(x)
    ids.forget(pieces)
    assert all(len(x) <= bpe.CACHED_CHARS for x in ids)


# substring dedup


def slow_substring(rows):
    first = {}
    for doc_id, text in rows:
        own = words(text)
        for k in range(len(own) - 12):
            key = tuple(own[k : k + 13])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        own = words(text)
        gone = {k + j for k in range(len(own) - 12) if first[tuple(own[k : k + 13])] < doc_id for j in range(13)}
        out.append((doc_id, len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone)))
    return out


@pytest.mark.parametrize("chunk", [60, substring.CHUNK])
def test_substring_equals_brute_force(spark, odd, none, chunk, monkeypatch, tmp_path):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    passages = [[f"v{x}" for x in rng.integers(0, 9, rng.integers(12, 40))] for _ in range(6)] + [["a"] * 30, ["a", "b"] * 12]
    rows = []
    for k in range(60):
        own = []
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(len(passages)))]
            a = int(rng.integers(0, 5))
            own += [f"v{x}" for x in rng.integers(0, 9, rng.integers(0, 8))] + p[a : len(p) - int(rng.integers(0, 5))]
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.where("doc_id is not null").select((odd.doc_id + 100).alias("doc_id"), "text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.query(spark, str(tmp_path)).collect())
    want = slow_substring([(r.doc_id, r.text) for r in docs.collect()])
    assert got == sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in want)
    assert substring.deduplicated(none).count() == 0 and substring.deduplicated(odd).count() > 0


# token ids


def test_token_files(spark, documents, odd, none, tmp_path):
    library, at = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY)), 0
    got = {r.doc_id: r for r in llm.QUERIES["op7_token_ids"](spark, SMALL).collect()}
    for d in sorted(documents, key=lambda d: d.doc_id):
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    tokens.write(odd, f"{tmp_path}/odd", stripe=50)
    rows = sorted(tokens.read(spark, f"{tmp_path}/odd").collect(), key=lambda r: r.start)
    assert len(rows) == odd.count() and [r.doc_id for r in rows[:2]] == [None, None]
    assert sorted(r.ids for r in rows) == sorted(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in odd.collect())
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    tokens.write(none, f"{tmp_path}/none")
    assert tokens.read(spark, f"{tmp_path}/none").count() == 0


def test_tokens_of_control_characters_and_white_space():
    path = public_tokenizers.path(tokens.VOCABULARY)
    library = Tokenizer.from_file(path)
    odd = [*map(chr, [*range(0x21), *range(0x7F, 0xA1)]), *"\u1680\u180e\u2000\u2007\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"]
    texts = [t for c in odd for t in (f"ab{c}cd", f"{c}ab.{c} {c}cd{c}", c)] + ["".join(f"w{c}" for c in odd)]
    for text, got in zip(texts, tokens.Encoder(path).encode(texts), strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_words_of_plain_texts_are_looked_up_once():
    class Counting(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    encoder, texts = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY)), ["Of the one's 12, of «the» two. " * 1000, "of THE two", "", "of the"]
    encoder.known = Counting()
    got = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in got] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.known = Counting()
    assert len(encoder.encode([texts[0].replace("«", "").replace("»", "")])[0]) > 9000 and encoder.known.asked < 50
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": ["x" * 1000]}) for k in range(20_000)]
    gathered = [b.column("doc_id").to_pylist() for b in common.gathered(iter(batches), tokens.GATHERED)]
    assert len(gathered) <= 4 and [k for own in gathered for k in own] == list(range(20_000))


def test_plain_characters_and_pieces():
    library, rng = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY)), np.random.default_rng(3)
    plain = [*map(chr, [*range(128), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]), *"Œœ–—‘’‚‛“”…"]
    some = [*plain, *["'", " ", *"stredvmlabSTRE01.,"] * 9]
    texts = [f"a{c}B{c} {c}" for c in plain] + ["".join(rng.choice(some, rng.integers(1, 50))) for _ in range(1500)] + [f"a{x}b" for x in ("<|endoftext|>", "<|startoftext|>")]
    encoder = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)
    assert not encoder._plain(pa.array(["\u0301a", "×", "a\u00a0b", "日", "<|endoftext|>"])).any() and encoder._plain(pa.array(texts[:-2])).all()


def test_quotients_are_exact():
    rng = np.random.default_rng(4)
    b = rng.integers(1 << 11, 1 << 21, 100_000)
    k = rng.integers(0, 1 << 27, len(b))
    for more in (0, 1, b - 1):
        assert (idfile._quotient(k * b + more, b) == k).all()


def test_stripes_come_back_and_damage_shows():
    rng = np.random.default_rng(0)
    for docs in ([], [[]], [[5]], [[], [2], []], [[7] * 9000], [rng.integers(0, 1 << 20, 5000).tolist(), [], [1, 2, 3] * 3000], [rng.zipf(1.3, 9000).clip(0, 49000).tolist()]):
        made = [np.array(x, np.uint32) for x in docs]
        raw = idfile.packed(list(range(len(made))), made)
        ids, lengths, all_ids = idfile.unpacked(raw)
        assert ids.tolist() == list(range(len(made))) and lengths.tolist() == [len(x) for x in made] and all_ids.tolist() == [x for d in docs for x in d]
    broken = bytearray(raw)
    broken[-300] ^= 8
    with pytest.raises(ValueError):
        idfile.unpacked(bytes(broken))
    assert len(raw) < 2 * 9000


# private data


def luhn(digits):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def digest(parts, at=0, digits=12):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[at : at + digits], 16)


def moved(text, other, key, kind, round_):
    out, whole = [], hashlib.sha256(f"{key}|{kind}|{round_}|{other}".encode()).hexdigest()
    for i, c in enumerate(text):
        by = digest((whole, i // 32), 2 * (i % 32), 2)
        first, n = (48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26)
        out.append(chr(first + (ord(c) - first + by) % n))
    return "".join(out)


def mixed(text, key, kind):
    if len(text) == 1:
        first, n = (48, 10) if text.isdigit() else (97, 26) if text.islower() else (65, 26)
        return chr(first + (ord(text) - first + 1 + digest((key, kind, "one")) % (n - 1)) % n)
    l, r = text[: len(text) // 2], text[len(text) // 2 :]
    for k in range(8):
        l, r = (moved(l, r, key, kind, k), r) if k % 2 == 0 else (l, moved(r, l, key, kind, k))
    return l + r


def pair(l, r, lefts, rights, key, kind):
    for k in range(8):
        l, r = ((l + digest((key, kind, k, r))) % lefts, r) if k % 2 == 0 else (l, (r + digest((key, kind, k, l))) % rights)
    return l, r


def refilled(shape, plain):
    plain = iter(plain)
    return "".join(next(plain) if re.match("[A-Za-z0-9]", c) else c for c in shape)


def real_date(y, m, d):
    import datetime

    try:
        return datetime.date(y, m, d)
    except ValueError:
        return None


def slow_pseudonym(m, key):
    plain = lambda x: re.sub("[^A-Za-z0-9]", "", x)
    whole = lambda kind: re.fullmatch(pii.KINDS[kind], m, re.A)
    name = re.match(r"[A-Za-z_-]+\s*[=:]\s*[\"']?", m, re.A)
    if name and "@" not in m:
        secret = m[name.end() :]
        return name[0] + refilled(secret, mixed(plain(secret), key, "secret"))
    if "@" in m:
        local, rest = m[: m.index("@")], m[m.index("@") :]
        return refilled(local, mixed(plain(local), key, "email")) + rest if plain(local) else m
    if whole("date"):
        parts, sign = re.split("[-/.]", m), re.search("[-/.]", m)[0]
        first = len(parts[0]) == 4
        year = int(parts[0] if first else parts[2])
        order = [(1, 2)] if first else [(1, 0), (0, 1)]  # places of month and day
        for at_m, at_d in order:
            month, day = int(parts[at_m]), int(parts[at_d])
            if real_date(year, month, day) and 1900 <= year <= 2100:
                d0, dn = (1, 9) if day < 10 else (10, 22)
                m0, mn = (1, 9) if month < 10 else (10, 3)
                l, r = year - 1900, (month - m0) * dn + day - d0
                while True:
                    l, r = pair(l, r, 201, dn * mn, key, f"date{d0}{m0}")
                    if real_date(l + 1900, r // dn + m0, r % dn + d0):
                        break
                parts[0 if first else 2] = str(l + 1900)
                parts[at_m], parts[at_d] = str(r // dn + m0).rjust(len(parts[at_m]), "0"), str(r % dn + d0).rjust(len(parts[at_d]), "0")
                return sign.join(parts)
            if real_date(year, month, day):
                return None
        return None
    if whole("ip"):
        a, b, c, d = map(int, m.split("."))
        l, r = pair(a * 256 + b, c * 256 + d, 1 << 16, 1 << 16, key, "ip")
        return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
    if whole("card"):
        digits = plain(m)
        if not luhn(digits):
            return None
        body = mixed(digits[:-1], key, "card")
        return refilled(m, next(body + str(k) for k in range(10) if luhn(body + str(k))))
    if whole("ssn"):
        area, group, serial = map(int, m.split("-"))
        l, r = pair(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        return f"{l + 1 + (l >= 665):03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"
    return refilled(m, mixed(plain(m), key, "phone"))


def slow_text(text, key):
    n = 0

    def put(m):
        nonlocal n
        made = slow_pseudonym(m[0], key)
        n += made is not None
        return m[0] if made is None else made

    return re.sub(pii.PATTERN, put, text, flags=re.A), n


def test_pseudonyms_equal_brute_force(spark, documents):
    extra = [
        "a@b.com A@b.com 7@b.com a.b@c.de _@x.org", "3/4/2020 and 03/04/2020, 3-4-2020; 4.12.1999 31.12.1999 29/02/2000 12/31/1999 2001-1-9 1/1/1850 30/02/2020", "token=abcdef password: 'Xy9_zz-9' api-key = 000000 TOKEN:abcdef",
        "219-09-9999 665-01-0001 667-99-9999 899-01-0001 001-01-0001 000-12-3456 666-12-3456 900-12-3456", "4111 1111 1111 1111 3782-822463-10005 4111111111111112 10.0.0.1 255.255.255.255 1.2.3.4.5 +49 (089) 555-1234 (212) 555.1234 212-555-1234", "", None,
    ]
    rows = [(d.doc_id, d.text) for d in documents] + [(10**6 + k, t) for k, t in enumerate(extra)]
    made = pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "some key").collect()
    got = {r.doc_id: (r.text, r.n_private) for r in made}
    want = {i: (None, 0) if t is None else slow_text(t, "some key") for i, t in rows}
    assert {i: x for i, x in got.items() if want[i] != x} == {} and sum(n for _, n in got.values()) > 40
    plain = {r.doc_id: (r.text, r.n_private) for r in llm.QUERIES["op8_pii"](spark, SMALL).collect()}
    assert plain == {d.doc_id: slow_text(d.text, pii.DEMO_KEY) for d in documents}


def test_pseudonyms(spark, odd, none):
    text = "pay 4111111111111111 or 4111-1111-1111-1111, not 4111111111111112. +1 (017) 555-7713 on 2020-02-29 = 29.02.2020, not 2020-02-30; 97.51.17.173 a.b.34@mail7.example.com token = \"b44e15e09fd311c3\" 123-45-6789 v4.0 1.2.3.4.5"
    docs = spark.createDataFrame([(1, text), (2, "4111111111111111 4111111111111111"), (3, "12/31/1999 31/12/1999"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(docs, "k").collect()}
    t = got[1].text
    cards = re.findall(r"\d{16}", t)
    assert cards[1] == "4111111111111112" and cards[0] != "4111111111111111" and luhn(cards[0])
    assert cards[0] == re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", t)[0].replace("-", "") and got[2].text == f"{cards[0]} {cards[0]}"
    y, m, d = re.search(r"on (\d{4})-(\d\d)-(\d\d)", t).groups()
    assert f"= {d}.{m}.{y}, not 2020-02-30;" in t and (y, m, d) != ("2020", "02", "29")
    for gone in ("555-7713", "97.51.17.173", "a.b.34@", "b44e15e09fd311c3", "123-45-6789"):
        assert gone not in t
    assert re.search(r"[a-z]\.[a-z]\.\d\d@mail7\.example\.com", t) and re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", t) and "v4.0 1.2.3.4.5" in t and got[1].n_private == 9
    a, b = got[3].text.split(" ")
    assert a.split("/")[:2] == b.split("/")[1::-1] and got[4].text is None and got[4].n_private == 0
    assert pii.pseudonymised(docs, "other").first().text != t
    out = pii.pseudonymised(odd, "k")
    assert out.columns == [*odd.columns, "n_private"] and sorted(map(repr, (r.text for r in out.collect()))) == sorted(map(repr, (r.text for r in odd.collect()))) and pii.pseudonymised(none, "k").count() == 0


def test_pseudonyms_of_very_long_values(spark):
    """Domains of 100,000 labels, secrets of a million letters with and without signs between them, long runs of what might begin a match."""
    rng = np.random.default_rng(1)
    letters = "".join(rng.choice(list("abcXYZ019"), 1_000_000))
    texts = ["x@a" + ".a" * 100_000, "token=" + letters, "secret: " + "a-b_" * 50_000, "x@" * 50_000, "1-" * 50_000, "+1 " * 50_000, "1.1." * 50_000, "a" * 200_000 + "@b", "token=" * 50_000, "." * 100_000 + "@a.b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.text, r.n_private) for r in pii.pseudonymised(rows, "k").collect()} == {k: slow_text(t, "k") for k, t in enumerate(texts)}


def test_pseudonyms_are_permutations(spark):
    from pyspark.sql import functions as F

    n = spark.range(201 * 27).select(pii.paired(F.floor(F.col("id") / 27), F.col("id") % 27, 201, 27, "k", "date110").alias("x"))
    assert n.agg(F.countDistinct("x"), F.min("x.l"), F.max("x.l"), F.min("x.r"), F.max("x.r")).first() == (201 * 27, 0, 200, 0, 26)
    s = spark.range(1000).select(pii.permuted(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "card").alias("x"))
    assert s.where("x rlike '^[0-9]{3}$'").distinct().count() == 1000
    days = [f"{y}-{m:02d}-{d:02d}" for y in range(1900, 2101, 4) for m in range(1, 13) for d in range(10, 32) if real_date(y, m, d)]
    made = pii.pseudonymised(spark.createDataFrame([(x,) for x in days], "text string"), "k").select("text").distinct()
    assert made.count() == len(days) and all(real_date(*map(int, r.text.split("-"))) for r in made.collect())
    ssn = spark.createDataFrame([(f"{a:03d}-{g:02d}-{k:04d}",) for a in (1, 665, 667, 899) for g in (1, 50, 99) for k in range(1, 9999, 40)], "text string")
    made = pii.pseudonymised(ssn, "k").select("text").distinct()
    assert made.count() == ssn.count() and all(re.fullmatch(pii.KINDS["ssn"], r.text, re.A) for r in made.collect())
    one = {r.text for r in pii.pseudonymised(spark.createDataFrame([(f"{c}@b.com",) for c in "abcdefghijklmnopqrstuvwxyz"], "text string"), "k").collect()}
    assert len(one) == 26
    assert all(r.text != f"{c}@b.com" for c, r in zip("abc", pii.pseudonymised(spark.createDataFrame([(f"{c}@b.com",) for c in "abc"], "text string"), "k").collect(), strict=True))


# pages


def article(page):
    import html as library

    m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    body = re.sub(r"<[a-zA-Z/][^>]*(>|\Z)", lambda t: "" if re.match(r"</?b>", t[0]) else " ", m[1] if m else "")
    return " ".join(library.unescape(body).split())


def test_main_text(spark):
    pages = common.table(spark, SMALL, "pages")
    got = {r.page_id: (r.text, r.n_chars) for r in llm.QUERIES["op10_html_text"](spark, SMALL).collect()}
    assert got == {p.page_id: (t, len(t)) for p in pages.collect() for t in [article(p.html)]}
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<nav><a href=/>Home</a> <a href=/b>News</a></nav><article><h1>A&amp;B</h1><p>One<b>two</b>&nbsp; x<br>y</p><aside>Read more of this here</aside></article><section class='comments'><p>I think that this is all wrong, and so is the rest of it, my dear sirs</p></section><footer>&copy; me</footer>"), (4, "u", "<!-- <p>no --><script>if(a<b)</script><article><p>1 < 2 <"), (None, None, "<article><p>no id</p></article>")]
    rows += [rows[2], rows[2], (5, "u", "<nav><a>x</a></nav><article>" + "<p>a long page with many words of text in it</p>" * 20_000 + "</article>")]
    out = html.extracted(spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(rows) and [r.text for r in out if r.page_id == 3] == ["A&B Onetwo x y"] * 3
    assert [got[k].text for k in (1, 2, None)] == ["", "", "no id"] and got[3].n_chars == 14 and got[4].text.startswith("1 < 2") and len(got[5].text.split()) == 200_000
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars long")).count() == 0


def test_no_list_of_names_decides_alone(spark):
    tree = html.trained()
    pages = [p.html for p in common.table(spark, SMALL, "pages").collect()]
    for name in html.LISTS:
        lists = html.LISTS | {name: frozenset()}
        right = 0
        for page in pages:
            found = html.blocks(page, lists)
            right += " ".join(b[0] for b, main in zip(found, tree.main(html.features(found)), strict=True) if main) == article(page)
        assert right >= 0.9 * len(pages), name
    used = {html.FEATURES[f] for f, *_ in tree.nodes if f >= 0}
    assert {"words", "links"} <= used and any(x.startswith("words_") for x in used) and any(x.startswith("links_") for x in used)


def test_tree_on_pages_held_out():
    tree = html.trained()
    named = plain = n = 0
    for page in html_samples.HELD_OUT:
        want = [b[0][0] == "+" for b in html.blocks(page)]
        named += sum(a == b for a, b in zip(tree.main(html.features(html.blocks(page))).tolist(), want, strict=True))
        silent = html.blocks(page, dict.fromkeys(html.LISTS, frozenset()))
        plain += sum(a == b for a, b in zip(tree.main(html.features(silent)).tolist(), want, strict=True))
        n += len(want)
    assert named >= 0.9 * n and plain >= 0.6 * n


def test_tree_learns_its_table():
    tree, wrong, n = html.trained(), 0, 0
    for page in html.labelled_pages():
        found = html.blocks(page)
        wrong += sum(a != (b[0][0] == "+") for a, b in zip(tree.main(html.features(found)), found, strict=True))
        n += len(found)
    assert wrong <= 0.04 * n


# scores


def test_base_scores(spark, documents, odd, none, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_SPANS", 1)
    monkeypatch.setattr(lm, "HEAD", 300)
    own = {d.doc_id: lower(d.text).encode().split() for d in documents}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in own}
    count = Counter(w for i, x in own.items() if not held[i] for w in [*x, b""])
    n, v = sum(count.values()), len(count)
    for r in llm.QUERIES["op1_lm_score"](spark, SMALL).collect():
        x = [*own[r.doc_id], b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(x), sum(count[w] > 0 for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel_tol=1e-9) and -15 * len(x) < r.score < 0
    scored = lm.scored(odd).collect()
    assert len(scored) == odd.count() and len({(r.base_score, r.score) for r in scored if r.doc_id == 5}) == 1 and lm.scored(none).count() == 0
    long = spark.createDataFrame([(k, "of the long text " * 30_000 if k < 3 else None) for k in range(5)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in lm.scored(long).collect()) == [1, 1, 120_001, 120_001, 120_001]


def test_held_out_score_beats_the_base(spark):
    rows = [r for r in llm.QUERIES["op1_lm_score"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    tokens_ = sum(r.n_tokens for r in rows)
    assert sum(r.score - r.base_score for r in rows) / tokens_ > 0.05


def test_model_learns_from_every_span(spark, documents, monkeypatch, tmp_path):
    for name, value in (("LEAST_SPANS", 8), ("TRAINER_SPANS", 256)):
        monkeypatch.setattr(lm, name, value)
    made, folder = lm._trainer, str(tmp_path)

    def counting(*args):
        train = made(*args)

        def run(batches):
            import uuid

            for out in train(batches):
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                    file.write(str(sum(out.column(0).to_pylist())))
                yield out

        return run

    monkeypatch.setattr(lm, "_trainer", counting)
    path, size = public_tokenizers.path(lm.VOCABULARY), 300
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text")
    lm.trained(docs, lm.counts(docs), path, size)
    get = lm.subwords(path, size)
    want = sum(-(-len(get.ids(lm.tokens((d.text or "").encode()))) // attention.SPAN) for d in documents if not lm.held_out(d.doc_id))
    seen = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(seen) == want and len(seen) > 4


def model(size=12, seed=1):
    """A small shape, from the words of a few ids, and parameters that aren't zero."""
    rng = np.random.default_rng(seed)
    words = [rng.integers(0, size - 3, rng.integers(1, 5)) for _ in range(60)] + [np.array([size])] * 5
    code, _ = attention.triples(words, size)
    m = size + 2
    one, n_one = np.unique(code % (m * m), return_counts=True)
    two, n_two = np.unique(code, return_counts=True)
    two, n_two = two[(two // m % m) < size], n_two[(two // m % m) < size]
    shape = attention.Shape(size, np.arange(size) % 3 == 0, np.stack([one // m, one % m, n_one], 1), np.stack([two // m // m, two // m % m, two % m, n_two], 1))
    p = {n: x + rng.normal(0, 0.3, x.shape).astype(np.float32) for n, x in shape.parameters().items()}
    docs = [np.append(rng.integers(0, size, n), size) for n in (0, 1, 14, 15, 16, 40, 70)]
    return shape, p, docs


def slow_scores(shape, p, ids):
    """Logarithms of one document's ids, one position at a time."""
    out, keys = [], []
    inputs = [shape.start, *(min(shape.rank[x], shape.rare) for x in ids[:-1])]
    for t, goal in enumerate(ids):
        keys.append(p["e"][inputs[t]].astype(float))
        first = max(0, (t // attention.SPAN - 1) * attention.SPAN)
        x = keys[t]
        s = np.array([x @ p["q"] @ (keys[j] @ p["k"]) * attention.KEYS**-0.5 + p["b"][t - j] for j in range(first, t + 1)])
        a = np.exp(s - s.max())
        h = np.maximum(0, (a / a.sum()) @ np.stack([k @ p["v"] for k in keys[first:]]) + x @ p["r"])
        last = ids[t - 1] if t else shape.ids
        before = ids[t - 2] if t > 1 else shape.ids
        row = shape.context[shape.ids if t == 0 or shape.begins[last] else before, last]
        share = lambda logits, k: logits[k] - np.log(np.exp(logits).sum())
        rank = shape.rank[goal]
        c = int(shape.of[rank])
        got = share(h @ p["uc"] + shape.class_bias[row], c)
        if c == shape.classes:
            got -= np.log(shape.unused)
        else:
            own = slice(shape.edges[c], shape.edges[c + 1])
            got += share(h @ p["um"][:, own] + shape.bias[c][row], rank - shape.edges[c])
        out.append(got)
    return out


def test_model_equals_a_plain_loop_and_sums_to_one():
    shape, p, docs = model()
    spans, ready = attention.Spans(shape, docs), attention.tables(p)
    got = np.concatenate([attention.log_probabilities(shape, p, ready, *spans.part(k, k + 2), spans.given[k - 1] if k else None) for k in range(0, len(spans), 2)])
    for k, ids in enumerate(docs):
        mine = got[spans.document == k][spans.next[spans.document == k] >= 0]
        assert np.allclose(mine, slow_scores(shape, p, ids), atol=1e-3)
    total = 0
    for k in range(shape.ids):
        spans.next = np.full_like(spans.next, k)
        total = total + np.exp(attention.log_probabilities(shape, p, ready, *spans.part(0, 3)))
    assert shape.unused and np.allclose(total, 1, atol=1e-3)


def test_gradients_equal_differences(monkeypatch):
    shape, p, docs = model()
    spans = attention.Spans(shape, docs)
    n = (spans.next >= 0).sum()
    loss = lambda: -attention.log_probabilities(shape, p, attention.tables(p), *spans.part(0, len(spans))).sum() / n
    g, rng = attention.gradients(shape, p, *spans.part(0, len(spans))), np.random.default_rng(2)
    for name, x in p.items():
        way = rng.normal(0, 1, x.shape).astype(np.float32)
        way /= np.linalg.norm(way)
        step, was = np.float32(2e-2), x.copy()
        x += step * way
        up = loss()
        x[...] = was - step * way
        down = loss()
        x[...] = was
        assert abs((up - down) / (2 * step) - float((g[name] * way).sum())) < 5e-3 + 0.05 * abs(float((g[name] * way).sum())), name


def test_model_learns():
    shape, p, _ = model()
    docs = [np.array([k % 9, (k + 1) % 9, (k + 2) % 9] * 15 + [12]) for k in range(40)]
    spans = attention.Spans(shape, docs)
    score = lambda: attention.log_probabilities(shape, p, attention.tables(p), *spans.part(0, len(spans))).sum() / (spans.next >= 0).sum()
    was, adam = score(), attention.Adam(p)
    for _ in range(150):
        adam.step(p, attention.gradients(shape, p, *spans.part(0, len(spans))), 0.01)
    assert score() > was + 1


def test_words_are_encoded_once():
    get, asked = lm.Subwords(public_tokenizers.path(lm.VOCABULARY), 2048), []
    made, joined = get.made, get._joined
    get.made = lambda word: asked.append(word) or made(word)
    get._joined = lambda words: asked.extend(words) or joined(words)
    texts = ["The one\x1cand\u00a0the\x0btwo É, x", "", None, " \n", "the ONE, 日本\u3000a. " * 500, "no\u0085 white\u2028 space\x1f", *(f"w{k} it's <|x|>" for k in range(2500))]
    words = lm.Words(pa.array(texts))
    plain = [lm.tokens((t or "").encode()) for t in texts]
    assert words.sizes.tolist() == [len(x) for x in plain] and [words.names[k] for k in words.which] == [w for x in plain for w in x]
    got = get.documents(words)
    assert len(asked) < 2 * len(words.names)
    slow = lm.Subwords(public_tokenizers.path(lm.VOCABULARY), 2048)
    assert [x.tolist() for x in got] == [slow.ids(x).tolist() for x in plain]
    before = len(asked)
    assert len(get.documents(words)) == len(texts) and len(asked) == before


def test_pieces_equal_plain_merging(monkeypatch):
    monkeypatch.setattr(lm, "LEAST_PAIRS", 3)
    rng = np.random.default_rng(4)
    found = {bytes(rng.choice(list(b"aab\xc3"), rng.integers(0, 9)).tolist()): int(rng.integers(1, 6)) for _ in range(80)}
    words, plain = {w: [b"%c" % x for x in b" " + w] for w in found if w}, [b"%c" % x for x in range(256)]
    while len(plain) < 300:
        pairs = Counter()
        for w, parts in words.items():
            for pair in zip(parts, parts[1:], strict=False):
                pairs[pair] += found[w]
        best = min(pairs, key=lambda x: (-pairs[x], x), default=None)
        if best is None or pairs[best] < 3:
            break
        if best[0] + best[1] not in plain:
            plain.append(best[0] + best[1])
        for w, parts in words.items():
            out = []
            for x in parts:  # pairs from the left
                if out and (out[-1], x) == best and not (len(out) > 1 and out[-1] is None):
                    out[-1:] = [best[0] + best[1], None]
                else:
                    out.append(x)
            words[w] = [x for x in out if x is not None]
    assert list(lm.pieces(found, 300)) == plain and 270 < len(plain)
    assert list(lm.pieces(found, 265)) == plain[:265] and len(lm.pieces({}, 300)) == 256


def test_words_of_slices():
    texts = [f"One {k} " * (k % 7) for k in range(3000)]
    words = lm.Words(pa.array(texts).slice(1100, 900))
    assert [words.names[k] for k in words.which] == [w for t in texts[1100:2000] for w in lm.tokens(t.encode())]


def test_shape_is_sent_without_its_contexts():
    import pickle

    shape, _, _ = model(200)
    raw = pickle.dumps(shape)
    assert (pickle.loads(raw).context == shape.context).all() and len(raw) < sum(x.nbytes for x in (shape.class_bias, *shape.bias)) + shape.context.nbytes


def test_ids_are_those_of_the_whole_texts(spark, documents):
    found = Counter(w for d in documents for w in lower(d.text).encode().split())
    pieces = lm.pieces(dict(found.most_common(500)), 400)
    base = {w: math.log10(c) for w, c in found.most_common(100)}
    odd = [(-1, None), (-2, ""), (None, " x\x1fy\u2028z  \x0b" + "long" * 5000), (-3, "\n"), (-3, "\u00a0 the <|x|> the THE")]
    rows = lm.coded(spark.createDataFrame([(d.doc_id, d.text) for d in documents] + odd, "doc_id long, text string"), pieces, len(pieces), base).collect()
    assert len({r.key for r in rows}) == len(rows) == len(documents) + len(odd)
    want, got = Counter(), Counter()
    for i, t in [*((d.doc_id, d.text) for d in documents), *odd]:
        words = lower(t or "").encode().split()
        rare = Counter(w for w in words if w not in base)
        want[i, b"".join(b" " + w for w in words), len(words) + 1, len(words) - rare.total(), round(sum(base.get(w, 0) for w in words), 6), tuple(sorted(rare.items()))] += 1
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert ids[-1] == len(pieces) and r.held_out == lm.held_out(r.doc_id)
        got[r.doc_id, b"".join(pieces[k] for k in ids[:-1]), r.n_tokens, r.known, round(r.base, 6), tuple(sorted((w.encode(), n) for w, n in r.rare.items()))] += 1
    assert got == want


def test_held_out_score_with_learnt_pieces(spark):
    rows = [r for r in llm.QUERIES["op1_lm_score"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows) > 0.12


def test_equal_rows_have_equal_sums():
    rng = np.random.default_rng(5)
    for k in (1, 5, 16, 23, 32, 46):
        row = np.exp(rng.normal(size=k)).astype(np.float32)
        assert len({x for n in (*range(1, 40), 300) for x in attention._sums(np.tile(row, (n, 1))).tolist()}) == 1


def test_each_token_is_scored_once():
    shape, _, docs = model()
    spans = attention.Spans(shape, docs)
    assert [spans.next[spans.document == k][spans.next[spans.document == k] >= 0].tolist() for k in range(len(docs))] == [shape.rank[d].tolist() for d in docs]


# pipeline


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    documents = common.table(spark, SMALL, "documents")
    labels, bench = common.table(spark, SMALL, "labels"), common.table(spark, SMALL, "benchmark").collect()
    good = {r.doc_id for r in quality.verdicts(documents, quality.fit(documents, labels)).where("kept").collect()}
    docs = {r.doc_id: (r.source, r.text) for r in documents.collect() if r.doc_id in good}
    pages, on = Counter(s for s, _ in docs.values()), defaultdict(Counter)
    for s, t in docs.values():
        on[s].update({x for x in t.split("\n") if x.strip()})
    texts = {i: "\n".join(x for x in t.split("\n") if not (on[s][x] > 1 and on[s][x] > 0.05 * pages[s])) for i, (s, t) in docs.items()}
    groups = slow_similar(sorted(texts.items()))
    spelt = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {tuple(w[k : k + 10]) for w in map(spelt, (b.text for b in bench)) for k in range(max(1, len(w) - 9)) if w}
    clean = {i: t for i, t in texts.items() if groups[i] == i and not any(tuple(spelt(t)[k : k + 10]) in windows for k in range(len(spelt(t))))}
    _, library = coding()
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in clean.items()}


def slow_similar(rows):
    """Smallest id reachable over links of similarity 0.8, from (id, text) rows."""
    own = {i: lower(t).encode().split() for i, t in rows}
    own = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in own.items()}
    root = {i: i for i in own}
    for i, x in sorted(own.items()):
        for j, y in sorted(own.items()):
            if j < i and root[i] != root[j] and 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return root


@pytest.mark.parametrize("chains", [0, neardup.CHAINS])
def test_near_dedup_equals_brute_force(spark, documents, odd, none, chains, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(neardup, "CHAINS", chains)
    monkeypatch.setattr(neardup, "SAMPLE", 2)
    rng = np.random.default_rng(11)
    texts = [None, "", "a b", "A  b", "a b c"]
    for k in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(40, 300)))]
        passage = [f"p{x}" for x in range(30)]
        for _ in range(int(rng.integers(2, 12))):
            own = list(base)
            for at in rng.integers(0, len(own), int(rng.integers(0, max(2, len(own) // 25)))):
                own[at] = f"x{rng.integers(10**6)}"
            texts.append(" ".join(own + passage * (k % 2)))
    rows = [(1000 - i, t, "src") for i, t in enumerate(texts)]
    want = slow_similar([(i, t) for i, t, _ in rows])
    prints = slow_groups([(i, slow_print(t)) for i, t, _ in rows], 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert {r.doc_id: r.component_id for r in neardup.grouped(docs).collect()} == want
    assert len(set(want.values())) < len(set(prints.values()))
    assert {r.doc_id: r.component_id for r in neardup.grouped(common.table(spark, SMALL, "documents")).collect()} == slow_similar([(d.doc_id, d.text) for d in documents])
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, SMALL).collect()) == sorted(set(want.values()))
    assert stage(spark, none, SMALL).count() == 0 and stage(spark, odd, SMALL).columns == odd.columns


def test_near_dedup_of_a_large_group_makes_few_rows(spark, monkeypatch):
    rng, made, stored = np.random.default_rng(5), Counter(), common.stored
    base, texts = [f"word{x}" for x in range(300)], []
    for _ in range(200):
        own = list(base)
        for at in rng.choice(len(own), int(rng.integers(4, 12)), replace=False):
            own[at] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(own))

    def counted(df, name, *more):
        out = stored(df, name, *more)
        made[name] = max(made[name], out.count())
        if name == "sets":
            made["bytes"] = sum(os.path.getsize(x.removeprefix("file:").replace("///", "/")) for x in out.inputFiles())
        return out

    monkeypatch.setattr(common, "stored", counted)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r.doc_id: r.component_id for r in neardup.grouped(docs).collect()} == slow_similar(rows)
    assert made["pairs"] <= 5 * len(texts)
    assert made["bytes"] <= sum(map(len, texts))


def test_parities_never_rule_out_similar_sets():
    rng = np.random.default_rng(6)
    for n in (1, 5, 40, 600, 3000):
        x = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for d in (0, n // 9, n // 5):
            y = np.unique(np.concatenate([x[d:], rng.integers(0, 1 << 64, int(rng.integers(0, d + 1)), np.uint64)]))
            apart = len(np.setxor1d(x, y))
            assert neardup.unlike(neardup.parities(x), neardup.parities(y)) <= apart
            assert neardup.unlike(neardup.parities(x, neardup.BITS), neardup.parities(y)) <= apart


def test_pipeline_edges(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert name == "byte_bpe" or out.columns == docs.columns
            docs = common.stored(out, name) if name != "byte_bpe" else out
        assert docs.count() >= 0


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    for path in (root / "seqcover").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
    assert json.dumps(sorted(llm.ORACLE_SQL))
