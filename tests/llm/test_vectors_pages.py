"""Operators on embeddings and pages, against brute force."""

import itertools
import re
import time
from html import unescape

import numpy as np
import pytest

from lakeloom.llm import embjoin, html_extract


def links(ids, vectors, cosine):
    good = [k for k, v in enumerate(vectors) if ids[k] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, part = [0] * len(ids), list(ids)
    for d in {len(vectors[k]) for k in good}:
        at = [k for k in good if len(vectors[k]) == d]
        x = np.array([vectors[k] for k in at], np.float64)
        norm = np.sqrt((x * x).sum(1))
        near = (x @ x.T) / np.outer(norm, norm) >= cosine
        np.fill_diagonal(near, False)
        for a, row in zip(at, near, strict=True):
            n[a] = int(row.sum())
        changed = True
        while changed:
            changed = False
            for a, row in zip(at, near, strict=True):
                least = min([part[a], *(part[at[j]] for j in np.flatnonzero(row))])
                changed |= least < part[a]
                part[a] = least
    changed = True
    while changed:  # rows with one id, and all that their links reach
        changed = False
        for k in good:
            to = min(part[j] for j in good if ids[j] == ids[k])
            if to < part[k]:
                old, changed = part[k], True
                part = [to if p == old and j in set(good) else p for j, p in enumerate(part)]
    return sorted(zip(ids, n, part, strict=True), key=repr)


def compare(spark, data, cosine=0.9):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, id int, m string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embjoin.link_vectors(df, cosine).collect()), key=repr)
    stored = [r["embedding"] for r in df.collect()]
    assert got == links([r[0] for r in data], stored, cosine)


def test_links_odd(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (None, [1.0, 0.0]), (12, [1.0])]
    compare(spark, [(*r, 1, 2, "x") for r in data])
    assert embjoin.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_links_of_repeated_ids(spark):
    rng = np.random.default_rng(44)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 120)] + rng.normal(size=(120, 6)) * 0.2
    compare(spark, [(int(i), [float(v) for v in r], 1, 2, "x") for i, r in zip(rng.integers(0, 100, 120), x, strict=True)])
    compare(spark, [(5, [1.0, 0.0], 1, 2, "x"), (5, [0.0, 1.0], 1, 2, "x"), (6, [1.0, 0.01], 1, 2, "x"), (2, [-1.0, 0.0, 0.0], 1, 2, "x"), (5, [0.0, 0.0], 1, 2, "x")])
    compare(spark, [(5, [1.0, 0.0], 1, 2, "x"), (5, [1.0], 1, 2, "x"), (3, [2.0], 1, 2, "x")])


def test_intervals_are_bounded(spark, monkeypatch):
    """Many intervals, whose pairs are made against boxes in parts, and none above the bound."""
    assert all(embjoin.interval_rows(n, d, t) * 8 * d <= embjoin.INTERVAL_BYTES for n in (10, 10**6, 10**12) for d in (2, 64, 4096) for t in (1, 6000))
    monkeypatch.setattr(embjoin, "INTERVAL_BYTES", 40 * 8 * 5)
    monkeypatch.setattr(embjoin, "BROADCAST_BOXES", 3)
    monkeypatch.setattr(embjoin, "BROADCAST_PAIRS", 3)
    rng = np.random.default_rng(45)
    x = rng.normal(size=(9, 5))[rng.integers(0, 9, 700)] + rng.normal(size=(700, 5)) * 0.2
    compare(spark, [(int(i), [float(v) for v in r], 1, 2, "x") for i, r in enumerate(x)])


@pytest.mark.parametrize("d, n", [(3, 900), (16, 1500), (2, 50)])
def test_links(spark, d, n):
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.3, 1.0], (n, 1))
    x[rng.random(n) < 0.2] = x[0]
    compare(spark, [(int(i), [float(v) for v in r], 1, 2, "x") for i, r in zip(rng.permutation(n), x, strict=True)])


def test_links_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = [(r["vec_id"], list(r["embedding"]), 1, 2, "x") for r in table.collect()]
    compare(spark, data, 0.9)
    compare(spark, data, 0.6)


def test_skipped_intervals_are_apart():
    rng = np.random.default_rng(1)
    lo = np.sort(rng.random((40, 2)), axis=0)
    hi = lo + 0.02
    want = {(i, j) for i in range(40) for j in range(i, 40) if embjoin._apart(lo[i], hi[i], lo[j], hi[j]) <= 0.1}
    assert set(embjoin.near_intervals(lo, hi, 0.1)) == want


def article(html):
    inside = re.search(r"<article[^>]*>(.*?)</article>", html, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inside))
    return "\n".join(b for b in blocks if b)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = html_extract.extract_main_text(pages).collect()
    assert len(got) == len(html) and all(r["text"] == article(html[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)


def test_unmarked_pages_and_boilerplate(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    model = html_extract.learn(pages)
    held = [r["html"] for r in pages.orderBy("page_id").limit(200).collect()]
    hidden = [h.replace("<article", "<div").replace("</article", "</div") for h in held]
    assert np.mean([a == article(h) for a, h in zip(html_extract.extract(hidden, model), held, strict=True)]) > 0.95
    noise = '<div class="comments"><p>I disagree with all of this, says a reader, at some length, and goes on about it for a while.</p></div>'
    noisy = [h.replace("</article>", f"</article>{noise}") for h in held]
    assert np.mean([a == article(h) for a, h in zip(html_extract.extract(noisy, model), held, strict=True)]) > 0.95


def test_pages_odd(spark):
    data = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p", "x"), (4, "u", "no markup &amp; none\n needed", "x"), (5, "u", "<article><p>a" + " b" * 200_000 + "</article>", "x"), (5, "u", "<!-- open <article><p>x", "x"), (6, "u", "<article><p>&lt;b&gt; kept &nbsp; text<script>var a='<p>no</p>'</script><li>one<li>two<table><tr><td>c1<td>c2</table></article><footer>f</footer>", "x")]
    got = [(r["page_id"], r["text"]) for r in html_extract.extract_main_text(spark.createDataFrame(data, "page_id long, url string, html string, text string")).collect()]
    assert len(got) == len(data) and got[0] == (1, "") and got[1] == (2, "") and got[3] == (4, "no markup & none needed")
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decoding_agrees():
    tree = html_extract.parse("<div><p>one two three</p><div class=ad><p>four</p></div></div><div><p>five</p></div>")
    rng = np.random.default_rng(4)
    for _ in range(200):
        keep = html_extract.decode(tree, rng.normal(size=len(tree.parent)) * 4)
        for i, up in enumerate(tree.parent):
            if up > 0 and keep[i] and not keep[up]:  # kept below what is not kept: then that one was left open, and so were all above it
                while up > 0:
                    assert not keep[up]
                    up = tree.parent[up]


def test_decoding_is_the_best_choice():
    """The decoding against all choices of states on small trees."""
    h, rng = html_extract, np.random.default_rng(6)
    for _ in range(40):
        tree = h.Tree()
        tree.add(-1, "")
        for i in range(1, int(rng.integers(2, 8))):
            tree.add(int(rng.integers(0, i)), "div")
            if rng.random() < 0.7:
                tree.blocks.append((i, "x" * int(rng.integers(1, 90)), 0))
        n = len(tree.parent)
        score, own = rng.normal(size=n) * 3, np.zeros(n)
        for i, text, _ in tree.blocks:
            own[i] += len(text)
        s = np.clip(score, -8, 8) * (0.1 + np.sqrt(own))
        worth = {h.KEPT: np.minimum(s, 0), h.DROPPED: np.minimum(-s, 0), h.OPEN: -h.OPEN_COST - np.where(own > 0, np.maximum(s, 0), 0)}
        found = {}
        for states in itertools.product(range(3), repeat=n):
            if any(up >= 0 and states[i] not in h._UNDER[states[up]] for i, up in enumerate(tree.parent)):
                continue
            value = sum(worth[c][i] for i, c in enumerate(states)) - h.TURN_COST * sum(up >= 0 and (states[up], states[i]) == (h.KEPT, h.DROPPED) for i, up in enumerate(tree.parent))
            keep = tuple(c == h.KEPT for c in states)
            found[keep] = max(found.get(keep, -1e9), value)
        assert found[tuple(h.decode(tree, score).tolist())] > max(found.values()) - 1e-9


def test_deep_pages_take_linear_time():
    began = time.perf_counter()
    for page in ("<div>" * 30_000 + "x", "<ul><li>" * 30_000 + "x", "<table><tr><td>" * 20_000 + "x", "<p>a" * 50_000):
        assert "".join(text for _, text, _ in html_extract.parse(page).blocks) in ("x", "a" * 50_000)
    assert time.perf_counter() - began < 10


def test_elements_end_where_html_ends_them():
    t = html_extract.parse("<ul><li>a<ul><li>b</ul><li>c</ul><p>d<div>e</div>f<table><tr><td>g<td>h<tr><td>i</table>j</p>k")
    assert [b for _, b, _ in t.blocks] == list("abcdefghijk")
    up = {b: t.tag[n] for n, b, _ in t.blocks}
    assert up["c"] == "li" and up["e"] == "div" and up["f"] == "" and up["i"] == "td" and up["j"] == ""


def test_text_that_is_not_shown_is_judged_too(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model, html = html_extract.learn(pages), pages.orderBy("page_id").first()["html"]
    more = '<noscript><p>Kept in full.</p></noscript><p aria-hidden="true">And this.</p><p>With <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p></article>'
    got = html_extract.extract([html.replace("</article>", more)], model)[0]
    assert got == article(html) + "\nKept in full.\nAnd this.\nWith x=1."


def test_pages_to_learn_from_are_bounded(spark):
    """One page may be most of the table: it is one page, and the trees are the same."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").cache()
    one = pages.filter("page_id = 3")
    many = pages.union(one).union(one)
    a, b = html_extract.learn(pages), html_extract.learn(many)
    assert (a.values == b.values).all() and (a.weights == b.weights).all()
