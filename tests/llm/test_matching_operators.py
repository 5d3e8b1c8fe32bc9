"""Substring dedup, near-duplicates, decontamination, top-k, URLs, HTML and components against brute force."""

import hashlib
import html
import random
import time
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mlframe.llm import components, decontamination, html_text, near_dedup, substring_dedup, topk, urls
from tests.llm.helpers import TEXTS, documents


def compare_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"create view {name} as select * from '{path}'")
    want = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=str)


def split_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


# Substring dedup


def test_automaton_against_search():
    rng = random.Random(4)
    for _ in range(200):
        least = rng.randint(1, 4)
        texts = [[rng.choice("ab") for _ in range(rng.randint(0, 10))] for _ in range(5)]
        ids = rng.sample(range(99), 5)
        has = lambda x, w: any(x[k : k + least] == w for k in range(len(x) - least + 1))
        want = [[min(i for x, i in zip(texts, ids, strict=True) if has(x, y[j : j + least])) for j in range(len(y) - least + 1)] for y in texts]
        assert substring_dedup.earliest(texts, ids, least) == want


@pytest.mark.parametrize("crowd", [4096, 3])
def test_substring_against_brute_force(spark, crowd):
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for _ in range(60):
        words = [rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.5:
            a = rng.randint(0, 40)
            words[3:3] = passage[a : a + rng.randint(5, 30)]
        texts.append("  ".join(words))
    docs = documents(spark, [*TEXTS, *texts, texts[3], "x " * 50])
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    first = {}
    for i in sorted(rows):
        w = split_words(rows[i])
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = substring_dedup.remove_repeats(docs, shard_segments=crowd).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("h"), "kept", "spans").collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            continue
        w = split_words(rows[r["doc_id"]])
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < r["doc_id"]:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (r["n_words"], r["n_removed"], r["kept"], r["h"]) == (len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == sum(gone)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


# Near-duplicates


def groups_by_force(rows, size, numerator):
    sets = {}
    for i, t in rows.items():
        w = split_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in rows}


@pytest.mark.parametrize("size,numerator", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, size, numerator):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(4, 150))]
        for _ in range(8):  # chains of edits: some links hold, some just fail
            texts.append(" ".join(base))
            for _ in range(rng.randint(0, 4)):
                base[rng.randrange(len(base))] = f"v{rng.randint(0, 400)}"
    texts += ["a b", "A  B", "a b c"]
    docs = documents(spark, [*TEXTS, *texts])
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    want = groups_by_force(rows, size, numerator)
    got = near_dedup.near_duplicates(docs, shingle=size, numerator=numerator).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]][1])
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_odd_sketch_estimates():
    rng = np.random.default_rng(3)
    for s in (0.8, 0.9):
        n = 2000
        shared = int(n * 2 * s / (1 + s))
        pool = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        sets = [np.unique(pool[:n]), np.unique(pool[n - shared :])]
        sketch = near_dedup.odd_sketch(near_dedup.minhash(sets, near_dedup.SHARP_SAMPLES), near_dedup.SHARP_BITS)
        flips = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
        estimate = 1 + near_dedup.SHARP_BITS / (4 * near_dedup.SHARP_SAMPLES) * np.log(1 - 2 * flips / near_dedup.SHARP_BITS)
        assert estimate == pytest.approx(s, abs=0.06)
        assert flips <= near_dedup.most_flips(near_dedup.SHARP_SAMPLES, near_dedup.SHARP_BITS, s)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 360)]
    df = spark.createDataFrame([*edges, (5, 5), (None, 3)], "a long, b long")
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = start
                stack += near[x]
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == {k: v for k, v in want.items() if len(near[k] - {k})}
    assert components.connected_components(df.limit(0)).count() == 0


# Decontamination


def test_decontamination_against_sql(spark):
    d = "/root/testdata/sf0.001"
    compare_sql(decontamination.op9_decontamination(spark, d), decontamination.OP9_SQL, documents=f"{d}/documents.parquet", benchmark=f"{d}/benchmark.parquet")


def test_decontamination_edges(spark):
    item = " ".join(f"q{k}" for k in range(40))
    part = " ".join(f"q{k}" for k in range(33))
    docs = documents(spark, [*TEXTS, f"before {item} after", f"{part} else", item.upper().replace(" ", ", "), "q1 q2 q3", " ".join(f"q{k}" for k in range(20))])
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "q1 q2 q3", "x"), (None, item, "x"), (1, item, "x")], "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.contained(docs, items, broadcast_rows=0).collect())
    n = len(TEXTS)
    assert got == [(n, 1), (n, 4), (n + 1, 1), (n + 1, 4), (n + 2, 1), (n + 2, 4), (n + 3, 4), (n + 4, 4)]  # short items stand inside long documents
    assert got == sorted((r["doc_id"], r["item_id"]) for r in decontamination.contained(docs, items).collect())
    short = spark.createDataFrame([(1, "answer is forty two"), (2, "Cat"), (3, "two is"), (4, "sat on the mat and then")], "item_id long, text string")
    inside = documents(spark, [*TEXTS, "the answer is, forty two. Or so"])
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contained(inside, short).collect()) == [(4, 2), (4, 4), (5, 2), (5, 4), (n, 1)]
    assert decontamination.contained(docs.limit(0), items).count() == 0 and decontamination.contained(docs, items.limit(0)).count() == 0
    plan = decontamination.contained(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Top-k


def test_topk_against_sql(spark):
    d = "/root/testdata/sf0.001"
    compare_sql(topk.op6_topk(spark, d), topk.OP6_SQL, embeddings=f"{d}/embeddings.parquet")


def test_topk_edges(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(120)] + [(k, [0.5] * 6) for k in range(200, 240)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [1.0]), (None, [1.0] * 6), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    good = [(i, np.floor(256 * np.float32(v).astype(float))) for i, v in rows if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all()]
    got = defaultdict(list)
    for r in topk.top_k(df.where("vec_id % 50 = 0"), df, query_block=2, vector_block=37).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {0, 50, 100, 200}
    for q, found in got.items():
        own = next(v for i, v in good if i == q)
        want = sorted(((int(v @ own), i) for i, v in good if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert found == [(i, s) for s, i in want]
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.5, 0.5]), (4, [9.0, 9.0, 9.0]), (50, [1.0, 1.0]), (100, [1.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<float>")
    found = [(r["query_id"], r["vec_id"], r["score"]) for r in topk.top_k(mixed.where("vec_id % 50 = 0"), mixed).orderBy("query_id", "rank").collect()]
    assert found == [(50, 2, 262144), (50, 1, 196608), (50, 3, 65536), (50, 100, 65536)]  # one longer vector hides nobody
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = np.floor(rng.normal(size=(300, 8)) * 256), np.floor(rng.normal(size=(9, 8)) * 256)
    lists, exact = topk.SortedLists(x), q @ x.T
    for depth in (1, 40, 150, 299, 300):
        lower, upper = lists.bounds(q, depth)
        assert (lower <= exact).all() and (exact <= upper).all()


# URLs


def test_urls_against_sql(spark):
    d = "/root/testdata/sf0.01"
    compare_sql(urls.op8_url_filter(spark, d), urls.OP8_SQL, pages=f"{d}/pages.parquet")


def test_url_aliases(spark, tmp_path):
    rows = [
        (1, "http://a.net/x", None),
        (2, "http://b.com/y", '<link rel="canonical" href="http://a.net/x/">'),
        (3, "https://www.b.com/y?utm_source=q#f", ""),
        (4, None, ""),
        (5, "nothing", "x"),
        (6, "http://c.com", '<META HTTP-EQUIV=refresh content="0; url=/z">'),
        (7, "http://c.com/z", '<link href="http://sub.example.net/en/1" rel=canonical>'),
        (8, "HTTP://C.COM/q", "<link rel=canonical href=//a.net/x>"),
        (9, "http://example.org/fr/1", '<link rel="canonical" href="http://a.net/x">'),
        (10, "http://xnet/a", ""),
        (10, "http://xnet/a", ""),
        (11, "http://d.com/p/q/r.html?v=1", '<link rel="canonical" href="y2">'),
        (12, "http://d.com/p/q/y2", ""),
        (13, "http://d.com/p/q/y2", '<link rel="canonical" href="../../k/./z?a=1&amp;b=2">'),
        (14, "http://d.com/k/z?a=1&b=2", '<link rel="canonical" href="?c=&#51;&#x26;d">'),
        (15, "http://d.com/k/z?c=3&d", '<meta http-equiv="refresh" content="0; url=/r?u=http://a.net/x">'),
        (16, "http://d.com/r?u=http://a.net/x", '<link rel="canonical" href="#top">'),
        (17, "http://e.com", '<link rel="canonical" href="mailto:x">'),
        (18, "http://f.com/a/b/", '<link rel="canonical" href="../..">'),
        (19, "http://f.com/", ""),
        (20, "http://d.com/p/y2", ""),
    ]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[9][2:] == ("org/fr/", "allow")
    assert got[2][3] == got[3][3] == got[8][3] == "allow"  # the explicit allow of page 9 outweighs the block of page 1
    assert got[6][3] == got[7][3] == "allow" and got[4] == ("", "", None, "allow") and got[10][2] is None
    component = {r["page_id"]: r["component"] for r in urls.filter_urls(pages).collect()}
    assert len({component[k] for k in range(11, 17)}) == 1 and component[11] not in (None, component[1]) and component[18] == component[19] == "f.com" and component[17] is None and component[20] is None
    fewer = {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages.where("page_id <> 9")).collect()}
    assert fewer[2] == fewer[3] == fewer[8] == "block" and fewer[1] == "block"
    more = spark.createDataFrame([("http://xnet/a", "http://b.com/y")], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages.where("page_id <> 9"), more).collect()}[10] == "block"
    assert urls.filter_urls(pages).count() == len(rows) and urls.filter_urls(pages.limit(0)).count() == 0
    pages.drop("verdict").write.parquet(str(tmp_path / "p"))
    compare_sql(urls.filter_urls(pages.drop("verdict")), urls.OP8_SQL, pages=f"{tmp_path}/p/*.parquet")


def test_alias_chains_cycles_and_a_hot_component(spark):
    # A chain of pages, a cycle, and one page with very many aliases.
    link = lambda k, url, to: (k, url, f'<link rel="canonical" href="{to}">')
    rows = [link(k, f"http://c.com/{k}", f"{k + 1}") for k in range(200)] + [(200, "http://example.org/fr/1", "")] + [link(201, "http://c.com/200", "//example.org/fr/1")]
    rows += [link(1000 + k, f"http://ring.com/{k}", f"/{(k + 1) % 50}") for k in range(50)]
    rows += [link(10_000 + k, f"http://hot{k % 7}.com/p{k}", "http://x.net/all") for k in range(20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["verdict"] == "allow" and got[k]["via"] == "alias" for k in range(200)) and got[200]["via"] == "rule"
    assert len({got[k]["component"] for k in range(202)}) == 1
    assert all(got[1000 + k]["component"] == "ring.com/0" and got[1000 + k]["via"] == "default" for k in range(50))
    assert all(got[10_000 + k]["verdict"] == "block" and got[10_000 + k]["via"] == "alias" for k in range(20_000))


# HTML


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<nav><ul><li>Menu</ul></nav><article><h1>A &amp; B</h1><p>one<br>two <b>three<p>four</article><footer>x</footer>", "A & B\n\none two three\n\nfour"),
        ("<article><p>x</p><div class='ad banner'>buy</div><script>var a='</p>';</script><style>p{}</style><p>y &lt;z&gt;</p><section id=comments><p>nice</p></section></article>", "x\n\ny <z>"),
        ("<header>Site</header><main><p>a\n  b</p><form><p>sign up</form><aside>see also</aside></main>", "a b"),
        ("<!-- <article>no</article> --><article>1 < 2 and 3</article>", "1 < 2 and 3"),
        ("<article><p title=\"a>b\">x</p><noscript>n</noscript><p hidden>h</p></article", "x"),
        ("<div role=navigation>nav</div><article><table><tr><td>a</td><td>b</td></tr></table></article>", "a b"),
    ],
)
def test_blocks(page, want):
    texts, marks = html_text.blocks_of(page)
    assert "\n\n".join(t for t, m in zip(texts, marks, strict=True) if m == "c") == want


def test_no_text_is_lost_to_quotes_and_time_is_linear():
    for page, want in [("<article><p class=it's>hello</p><p>you</article>", "hello\n\nyou"), ("<article><b title='x>y'>a</b> <i q=\"u>b</i> c</article>", "a b c"), ("<article>1 <b x=it's y=\"'\">2</b></article>", "1 2")]:
        texts, marks = html_text.blocks_of(page)
        assert "\n\n".join(t for t, m in zip(texts, marks, strict=True) if m == "c") == want
    for piece in ("<a '", "<a x='", '<a "', "<a", "</", "<!", "<!--", "<script>", "</script", "<a x='>", "<a b=c "):
        for end in ("", ">"):
            began = time.perf_counter()
            html_text.blocks_of(piece * 100_000 + end)
            assert time.perf_counter() - began < 5, piece


def slow_blocks(page):
    # The text inside article by a character-at-a-time reader, for pages of plain elements.
    out, piece, depth, at = [], "", 0, 0
    def flush():
        nonlocal piece
        text = " ".join(html.unescape(piece).split())
        if text and depth:
            out.append(text)
        piece = ""
    while at < len(page):
        if page[at] != "<":
            piece, at = piece + page[at], at + 1
            continue
        end, quote, last = at + 1, "", ""
        while quote or page[end] != ">":
            if quote and page[end] == quote:
                quote = ""
            elif not quote and page[end] in "'\"" and last == "=":
                quote = page[end]
            last, end = page[end], end + 1
        name = page[at + 1 : end].split()[0].rstrip("/")
        if name.strip("/") in ("p", "article", "h1", "li", "ul"):
            flush()
        elif name in ("br", "td"):
            piece += " "
        depth += {"article": 1, "/article": -1}.get(name, 0)
        at = end + 1
    flush()
    return out


def test_blocks_against_a_slow_reader():
    rng = random.Random(12)
    bits = ["<p>", "</p>", "<b>bold</b>", "<h1 id=x>", "</h1>", "<ul><li>", "</ul>", "<br>", "<a href=\"a>b\">li nk</a>", "<i title='>'>it<b x=1>al</b></i>", "<p data-x=it's>", "word ", " two\nlines", "&amp;", "&lt;b&gt;", "&#65;", "<br/>", " 1 "]
    for _ in range(300):
        page = "<div>x</div><article>" + "".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) + "</article><p>y</p>"
        texts, marks = html_text.blocks_of(page)
        assert [t for t, m in zip(texts, marks, strict=True) if m == "c"] == slow_blocks(page), page


def test_html_query_against_a_slow_reader(spark):
    d = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = html_text.op10_html_text(spark, d).collect()
    assert len(got) == len(pages) > 0
    for r in got:
        inside = re.search("(?s)<article>.*</article>", pages[r["page_id"]])[0]
        assert r["text"] == "\n\n".join(slow_blocks(inside)) and r["n_chars"] == len(r["text"])


def test_repeats_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(100):
        sizes = rng.integers(0, 12, 5)
        page = np.repeat(np.arange(5), sizes)
        tokens = rng.integers(0, 3, len(page))
        least = int(rng.integers(1, 5))
        where = defaultdict(set)
        windows = [k for k in range(len(tokens) - least + 1) if page[k] == page[k + least - 1]]
        for k in windows:
            where[tuple(tokens[k : k + least])].add(page[k])
        want = np.zeros(len(tokens), bool)
        for k in windows:
            if len(where[tuple(tokens[k : k + least])]) > 1:
                want[k : k + least] = True
        assert (html_text.repeated(tokens, page, least) == want).all()


def test_extract(spark):
    shared = "welcome to our site here you find all the news of the day"
    rows = [(k, f"http://h.com/{k}", f"<div>{shared}</div><div>story {k} has words {k * 7} of its own and more {k}</div>") for k in range(6)]
    rows += [(10, "http://h.com/a", f"<article><p>{shared}</p></article>"), (11, None, None), (12, "x", "<p>lone</p>"), (3, rows[3][1], rows[3][2])]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) and sum(r["page_id"] == 3 for r in got) == 2
    by = {r["page_id"]: r["text"] for r in got}
    for k in range(6):
        assert shared not in by[k] and f"{k} has words" in by[k]
    assert by[10] == shared and by[11] == "" and by[12] == "lone"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0
    many = {r["page_id"]: r["text"] for r in html_text.extract(pages, shard_chars=200, broadcast_hosts=0).collect()}
    assert many[10] == shared


def test_extract_repeats_across_shards(spark):
    word = lambda *k: "w" + "x".join(map(str, k))
    own = lambda k: " ".join(word(k, j) for j in range(30))
    pair = lambda k: " ".join(word("pair", k, j) for j in range(8 + k % 5))
    rows = [(k, f"http://h.com/{k}", f"<p>{own(k)}</p><p>{pair(k // 2)} {own(k + 1000)}</p>") for k in range(60)]
    rows += [(k, None, f"<p>{pair(k // 2)} {own(k)}</p>") for k in range(100, 120)]
    rows += [(k, f"http://h.com/c{k}", f"<p>{own(7777)}</p>") for k in range(200, 212)]  # copies count as one
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")
    whole = sorted(map(tuple, html_text.extract(pages).collect()))
    assert all(r[5] == 8 + r[0] // 2 % 5 and r[2].startswith("w") and "pair" not in r[2] for r in whole if r[0] < 200)
    assert all(r[5] == 0 and r[2] == own(7777) for r in whole if r[0] >= 200)
    for hosts in (0, 100):
        assert sorted(map(tuple, html_text.extract(pages, shard_chars=1000, broadcast_hosts=hosts).collect())) == whole
