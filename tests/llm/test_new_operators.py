"""Spelling variants, fill-in-the-middle and URL filters against brute force, on odd rows and on hot groups."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from helpers import SMALL, rows_of

from seqcover.llm import common, fim, spelling, urlfilter
from seqcover.llm import queries as llm

# spelling variants


def occurrences(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += len(run) >= 5
    return {w: n for w, n in found.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def variants(rows):
    n, near = occurrences(rows), {}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        near[w] = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if one_edit(w, x)]
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


def rows_in_order(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def test_variants_of_documents(spark):
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text")
    assert rows_in_order(llm.QUERIES["op11_spelling_variants"](spark, SMALL)) == variants([tuple(r) for r in docs.collect()])


def test_variants_in_hot_buckets(spark):
    """Words of one front and of one back, many chains, letters of the whole range, words of hundreds of letters; blocks so small that buckets are grids."""
    rng, long = random.Random(5), "q" * 300
    letters = "abcÀéÿ÷×"
    words = [f"same{''.join(rng.choices(letters, k=rng.randint(1, 4)))}" for _ in range(300)] + [f"{''.join(rng.choices(letters, k=rng.randint(1, 4)))}ends" for _ in range(300)]
    words += [long, long + "a", "a" + long, long[:-1], long[:150] + "z" + long[151:], "aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "abcde", "abcd", "fghij", "fghijk", "fghijkl"]
    rows = [(k, " ".join(w for w in words for _ in range(rng.choice((1, 1, 2, 4))))) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = variants(rows)
    assert rows_in_order(spelling.variants(df)) == want and rows_in_order(spelling.variants(df, block=16)) == want
    assert sum(r[4] for r in want) > 500 and any(r[2] not in (r[0], r[1]) for r in want)


def test_variants_of_odd_rows(spark, odd, none):
    odd = odd.selectExpr("* except (text)", "regexp_replace(text, 'word', 'words') AS text")
    assert rows_in_order(spelling.variants(odd)) == variants([(r.doc_id, r.text) for r in odd.collect()]) != []
    assert spelling.variants(none).count() == 0 and spelling.variants(odd.where("text is null")).count() == 0
    assert spelling.variants(odd.withColumnRenamed("doc_id", "key"), "key").count() > 0


# fill-in-the-middle


def arranged(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_any_text():
    rng = random.Random(3)
    texts = ["", "a", "ab", " ", "ß", "a" * 5000, "é" * 3000, "a<P>b", "<", "<P", "S>", "𝄞x𝄞", "\n\n\n"]
    texts += ["".join(rng.choices(["a", "Bc", " ", "é", "𝄞", "<", "P", ">", "x" * 700, "\u0301"], k=rng.randint(1, 900))) for _ in range(60)]
    for text in texts:
        for doc_id in (*range(40), None, -7):
            n, form, before, middle, output = fim.arranged(doc_id, text.encode())
            assert (n, form, before, middle, output.decode()) == arranged(doc_id, text)


def test_trees_and_cuts_at_every_unit():
    text = "ab c" * 700 + "é" * 400 + "z" * 2000 + "𝄞."
    units, own = re.findall("[A-Za-z]+|[^A-Za-z]", text), fim.Blocks(text.encode())
    done = ""
    for k in range(len(units) + 1):
        assert own.cut(k) == (len(done.encode()), len(done))
        done += units[k] if k < len(units) else ""


def test_fill_in_middle_of_odd_rows(spark, odd, none):
    own = odd.withColumn("Form", odd["kept"])
    got = fim.transformed(own)
    want = sorted((r.doc_id if r.doc_id is not None else -1, *(str(x) for x in arranged(r.doc_id, r.text))) for r in odd.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, *(str(x) for x in (r.n, r.form, r.prefix_chars, r.middle_chars, r.output))) for r in got.collect()) == want
    assert got.where(fim.restored(got["output"], got["form"]) != got["text"]).count() == 0
    assert fim.transformed(none).count() == 0 and "_hit" in got.columns and "Form" not in got.columns


# URL filters

HOSTS = ["good.org", "a.good.org", "example.org", "x.example.org", "b.com", "c.com", "n1.net", "n2.net", "n3.net", "n4.net", "notorg", "org"]


@pytest.fixture(scope="module")
def linked():
    rng, rows = random.Random(9), []
    paths = ["", "/", "/es/1", "/es", "/en/1", "/en/19?x=/es/", "/fr/2", "/de/3#f", "/fr", "?a=b/fr/", "#/de/"]
    for k in range(400):
        at, to = rng.choice(HOSTS), rng.choices(HOSTS, k=rng.randint(0, 4))
        html = "".join(f"<a class=x {rng.choice(['href', 'HREF'])} = {q}{rng.choice(['http:', 'https:', ''])}//{h.upper() if rng.random() < 0.3 else h}/p?{k}{q}>t</a><a data='http://{h}'>" for h in to for q in [rng.choice(['"', "'"])])
        rows.append((k, f"{rng.choice(['http', 'https'])}://{at}{rng.choice(paths)}", html + rng.choice(["", "<a href=//n4.net>", "<a <a " * 30, '<a href="/own">'])))
    rows += [(900, None, None), (901, "", ""), (902, "no scheme/org/", "<a href=http://n1.net>"), (903, "x\n://GOOD.ORG/é", None), (904, "http://a/b://c.org/", ""), (None, "http://b.com/fr/", None), (5, "http://n1.net/", None), (5, "http://n1.net/", None), (905, "http://" + "a." * 3000 + "org/", "<a " * 20000), (906, "http:///p", ""), (910, "http://d.com/de/1", None), (911, "http://n5.net/", "<a href=http://d.com/>")]
    return rows


def judged(rows):
    """By plain loops over dicts."""
    split = lambda u: (lambda r: (re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", r)[0]), re.split("[?#]", r[len(re.split("[/?#]", r)[0]) :])[0]))(u.split("://", 1)[1]) if u is not None and "://" in u else ("", "")
    found, edges, seeds = [], set(), {}
    for _, url, html in rows:
        host, path = split(url)
        fits = [(len(h + p), len(h), a, h + p) for a, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else None
        found.append((host, path, best))
        if best:
            seeds.setdefault(host, []).append(best[2])
        for tag in re.findall(r"<a[\s][^<>]*", html or "", re.I | re.A):
            m = re.search(r"[\s\"']href[ \t\n\f\r]*=[ \t\n\f\r]*[\"']?[ \t\n\f\r]*((?:https?:)?//[^/?#\"'\s<>]+)", tag, re.I | re.A)
            if m:
                to = split(m[1] if "://" in m[1] else "http:" + m[1])[0]
                if host and to and host != to:
                    edges.add((host, to))
    rank = {}
    for side, kind in ((0, "allow"), (1, "block")):
        e = [(a, b) if side == 0 else (b, a) for a, b in edges]
        degree = Counter(a for a, _ in e)
        base = {h: 3 * (v.count(kind) * urlfilter.UNIT // len(v)) // 20 for h, v in seeds.items() if kind in v}
        now = base
        for _ in range(urlfilter.ROUNDS):
            after = Counter(base)
            for a, b in e:
                after[b] += 17 * now.get(a, 0) // (20 * degree[a])
            now = after
        rank[side] = now
    out = []
    for (key, _, _), (host, path, best) in zip(rows, found, strict=True):
        trust, distrust = rank[0].get(host, 0), rank[1].get(host, 0)
        out.append((key, host, path, best and best[3], best[2] if best else "block" if distrust > trust else "allow", trust, distrust))
    return sorted(out, key=repr)


def test_urls_by_rules_and_links(spark, linked):
    df = spark.createDataFrame(linked, "page_id long, url string, html string").repartition(3)
    got = urlfilter.judged(df, urlfilter.rule_table(spark, urlfilter.RULES))
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == judged(linked)
    assert {r[4] for r in rows if r[1].endswith(".net")} == {"allow", "block"}
    con = duckdb.connect()
    pages = df.toPandas()  # noqa: F841
    con.execute("CREATE TABLE pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM pages")
    sql = con.execute(urlfilter.ORACLE).df()
    assert rows_of(got) == rows_of(sql)


def test_longest_rule_wins(spark):
    rules = [("allow", "a.org", "/x/"), ("block", "org", "/x/yy"), ("block", "a.org", "/x/"), ("allow", "org", "/"), ("block", "b.a.org", "")]
    urls = ["http://a.org/x/yyy", "http://a.org/x/", "http://b.a.org/x/y", "http://b.a.org", "http://aa.org/", "http://org/x/yy", "http://a.net/"]
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judged(df, urlfilter.rule_table(spark, rules)).collect()}
    # a.org/x/ (8), org/x/yy (8): the longer host; of one rule twice the block
    assert got == {0: ("a.org/x/", "block"), 1: ("a.org/x/", "block"), 2: ("a.org/x/", "block"), 3: ("b.a.org", "block"), 4: ("org/", "allow"), 5: ("org/x/yy", "block"), 6: (None, "allow")}


def test_urls_of_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, host string, rule string")
    rules = urlfilter.rule_table(spark, urlfilter.RULES)
    assert urlfilter.judged(none, rules).count() == 0
    some = spark.createDataFrame([(1, "http://x.com/de/", None, "h", "r"), (1, "http://x.com/fr/", None, "h", "r"), (None, None, None, None, None)], none.schema)
    assert [tuple(r) for r in urlfilter.kept(some, rules).orderBy("url").collect()] == [(None, None, None, None, None), (1, "http://x.com/fr/", None, "h", "r")]
    assert {r.verdict for r in urlfilter.judged(some, rules.limit(0)).collect()} == {"allow"}
