"""Whitening, HTML extraction and the prefix trie against brute-force versions, with nulls, ties, repeated rows, long and empty input and clashing columns."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelforge.llm import html_extract, prefix_trie, whitening

VECTORS = "vec_id long, embedding array<float>, x string, label int"


def vectors(dim=7, rows=40, shift=0.0):
    rng = np.random.default_rng(3)
    out = [(i, [float(v) for v in rng.normal(shift, 1 + np.arange(dim) % 3)], "x", 1) for i in range(rows)]
    out += [out[3], (100, out[3][1], None, None), (None, out[5][1], "y", 2)]
    out += [(200, None, "x", 1), (201, [], "x", 1), (202, [1.0] * (dim + 1), "x", 1), (203, [None] + [1.0] * (dim - 1), "x", 1), (204, [float("nan")] * dim, "x", 1), (205, [float("inf")] * dim, "x", 1)]
    return out


def brute_whitening(rows, dim, many=4):
    """vec_id and integers of each valid row -> rows by (vec_id, component): n, deviation, |whitened|, explained."""
    valid = [(i, [math.floor(256 * c) for c in e]) for i, e in rows]
    fit = sorted({tuple(x) for _, x in valid})
    n, sums = len(fit), [sum(x[d] for x in fit) for d in range(dim)]
    scaled = np.array([[n * x[d] - sums[d] for d in range(dim)] for x in fit], float) / n
    values, axes = np.linalg.eigh(scaled.T @ scaled / n)
    out = []
    for i, x in valid:
        c = [n * x[d] - sums[d] for d in range(dim)]
        for k in range(1, min(many, dim) + 1):
            e = values[-k]
            out.append((-1 if i is None else i, k, n, sum(v * v for v in c), abs(float(np.array(c, float) / n @ axes[:, -k]) / math.sqrt(e)) if e > 1e-9 else None, e / values.sum()))
    return sorted(out, key=str)


@pytest.mark.parametrize("dim,shift,tile,block", [(7, 0.0, 3, 64), (7, 40000.0, 32, 1 << 18), (2, 0.0, 1, 5)])
def test_whitening(spark, dim, shift, tile, block):
    rows = vectors(dim, shift=shift)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    exact = {r[0]: r[1] for r in df.collect()}
    got = whitening.whiten(df, tile=tile, block=block).collect()
    good = [(r[0], exact[r[0]]) for r in rows if r[0] is None or r[0] < 200]
    want = brute_whitening(good, dim)
    have = sorted([(-1 if r.vec_id is None else r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got], key=str)
    assert [h[:4] for h in have] == [w[:4] for w in want]
    assert np.allclose([h[4:] for h in have], [w[4:] for w in want], rtol=1e-7, atol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_edges(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x", 1), (2, [1.0, 2.0], "x", 1)], VECTORS)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.n == 1 and r.deviation == 0 and r.identity_error is None for r in one)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0], "x", 1), (2, [-1e30, 1.0], "x", 1), (3, [0.0, 2.0], "x", 1)], VECTORS)).collect()
    assert len(huge) == 6 and sum(r.deviation is None for r in huge) == 4


TURNS = "conv_id long, turn long, role string, text string, c string, depth int"


def turns():
    rng = np.random.default_rng(8)
    out = []
    for c in [*range(-7, 40), 1_000_000]:
        for t in range(int(rng.integers(1, 12))):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", f"t{rng.integers(0, 2)}", "x", 1))
    out += [(50, None, None, None, "x", 1), (50, None, "a", "b", "x", 1), (50, 1, None, "é", "x", 1), (50, 1, None, "é", "x", 1), (None, 1, "user", "hi", "x", 1), (55, 0, "user", "", "x", 1)]
    out += [(77, i, "user", "long" if i % 2 else "", "x", 1) for i in range(300)] + [(78, 0, "user", "y" * 100_000, "x", 1)]
    return out + [out[0]]


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), role or "", text or ""))
    convs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        made[c] = convs.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], leaves[node], saved[node], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items()
    )


@pytest.mark.parametrize("heavy", [2000, 3])
def test_prefix_trie(spark, tmp_path, monkeypatch, heavy):
    monkeypatch.setattr(prefix_trie, "HEAVY", heavy)
    rows = turns()
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.query(spark, str(tmp_path)).collect()
    want = brute_trie(rows)
    assert sorted(map(tuple, got)) == want
    assert max(w[1] for w in want) > 250 and any(w[4] > 3 for w in want)


def test_prefix_trie_empty(spark, tmp_path):
    spark.createDataFrame([(None, 1, "a", "b", "x", 1)], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert prefix_trie.query(spark, str(tmp_path)).count() == 0


PAGES = "page_id long, url string, html string, text string, path int"
ARTICLE = "<h1>{t}</h1><p>First &amp; <b>bold</b>\n  words.<p>Second <a href='/x'>with a link</a>, and more text here.</p>"
WANT = "{t}\nFirst & bold words.\nSecond with a link, and more text here."


def page(t, inner=ARTICLE, wrap="<article>{}</article>", extra=""):
    body = wrap.format(inner.format(t=t))
    return (
        f"<!DOCTYPE html><html><head><title>{t} site</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body class='has-sidebar'><header><h1>Site name</h1></header>"
        f"<nav><ul><li><a href='/a'>A</a></li></ul></nav><!-- ad --><div class='ad'>Buy now</div>{body}{extra}<div id='cookie-notice'>We use cookies</div>"
        "<form action='/s'><p>Search</p></form><aside><p>Latest</p></aside><footer>&copy; someone</footer></body></html>"
    )


def test_html_text(spark):
    comments = "<section class='comments'>" + "<p>I like this very much indeed.</p>" * 60 + "</section>"
    rows = [(i, f"https://a.example.org/{i}", page(f"T{i}")) for i in range(5)]
    rows += [(10 + i, f"http://u@B.example.org:80/{i}?q", page(f"U{i}", wrap="<div class='post-%d'>{}</div>" % i, extra=comments)) for i in range(4)]
    # here the surroundings are longer than the article, but the host's other pages tell where it is
    rows += [(20, "//b.example.org/z", page("Z", inner="<p>{t}</p>", wrap="<div class='post-9'>{}</div>", extra="<div class='x'><p>" + "Unmarked promotion of other pages. " * 30 + "</p></div>"))]
    rows += [(30, None, page("N")), (31, "nonsense", page("M")), (32, "https://a.example.org/e", ""), (33, "https://a.example.org/n", None), rows[0]]
    rows += [(40, "https://c.example.org/", "<div class=w><ul><li>one<li>two &lt;b&gt; &nope; &#x41;<br>three</ul><table><tr><td>a<td>b<tr><td>c</table><p>open <!-- never closed")]
    rows += [(41, "https://d.example.org/", "plain text"), (42, "https://e.example.org/", "<nav>only a menu</nav>"), (43, "https://f.example.org/", page("L", inner="<p>{t}</p>" + "<p>word word</p>" * 20_000))]
    df = spark.createDataFrame([(*r, "text", 1) for r in rows], PAGES).repartition(4)
    got = defaultdict(list)
    for r in html_extract.main_text(df).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert len(got[0]) == 2
    one = {k: v[0] for k, v in got.items()}
    assert all(one[i] == WANT.format(t=f"T{i}") for i in range(5)) and all(one[10 + i] == WANT.format(t=f"U{i}") for i in range(4))
    assert one[20] == "Z" and one[30] == WANT.format(t="N") and one[31] == WANT.format(t="M") and one[32] == one[33] == one[42] == ""
    assert one[40] == "one\ntwo <b> &nope; A three\na b\nc\nopen" and one[41] == "plain text"
    assert one[43] == "L" + "\nword word" * 20_000


def test_headers_and_notices():
    cut = lambda body: html_extract.extract(f"<html><body>{body}</body></html>", [])[0]
    text = "<p>A text of some length.</p>"
    assert cut(f"<div id='page'><div id='header'><h1>Site</h1></div><div id='content'><h2>T</h2>{text}</div><div class='alert'>Mind the gap</div></div>") == "T\nA text of some length."
    assert cut(f"<div class='siteHeader'>Site</div><div class='post'><header><h1>T</h1></header>{text}<div class='copyright'>c</div></div>") == "T\nA text of some length."
    assert cut(f"<header><p>Site</p></header><main><header><h1>T</h1></header>{text}</main>") == "T\nA text of some length."
    assert cut(f"<div class='content'><h1>T</h1>{text}<ul><li><a href=1>x</a><li><a href=2>y</a><li><a href=3>z</a></ul><p>See <a href=4>this</a>, too.</p></div>") == "T\nA text of some length.\nSee this, too."


def test_html_salted_join_and_empty(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"https://h{i % 3}.org/", page(f"T{i}"), "", 1) for i in range(30)], PAGES)
    near = sorted(map(tuple, html_extract.main_text(df).collect()))
    monkeypatch.setattr(html_extract, "SMALL", 0)
    assert sorted(map(tuple, html_extract.main_text(df).collect())) == near and len(near) == 30
    assert html_extract.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_votes_are_counted_by_host(spark):
    df = spark.createDataFrame([(i, "https://v.org/", page("T", wrap="<main>{}</main>" if i < 3 else "<article>{}</article>" if i < 5 else "<div class='k7'>{}</div>"), "", 1) for i in range(6)], PAGES)
    ((host, paths),) = html_extract.host_paths(df).collect()
    assert host == "v.org" and [p.split("/")[-1] for p in paths] == ["main", "article", "div.k#"]


def test_broken_pages_take_linear_time():
    import time

    began = time.time()
    for bad in ("<div>" * 50_000, '<p class="' * 20_000, "<ul><li>" * 20_000, "<b " * 50_000, "<!-- <" * 20_000, "<section>" * 20_000 + "</div>" * 20_000, "<svg>" * 20_000 + "<p>x" * 20_000):
        html_extract.extract(bad + "x", [])
    assert time.time() - began < 20
