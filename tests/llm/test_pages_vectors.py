"""HTML extraction and embedding near-dedup."""

import brute
import numpy as np
import pytest

from millrace.llm import htmltext, itq, queries
from millrace.llm.common import read

P = "This is a paragraph of the article, with commas, and enough words to count as text. " * 2


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">menu one</a></li></ul></nav><div class="cookie-notice"><p>{P}</p></div>
    <div class="ad">Buy, buy, buy.</div><div id="sidebar"><p>{P}</p></div>
    <article><h1>Title &amp; more</h1><p>First&nbsp;  {P}<br>line<p>Second <b>bold</b> &lt;x&gt; &#233;</p><ul><li>one</li><li>two</li></ul>
    <form><p>{P}</p></form><blockquote>Quote.</blockquote><!-- gone --><table><tr><td>a</td><td>b</td></tr></table></article>
    <div class="comments"><p>{P}</p><p>{P}</p></div><footer>&copy; site</footer></body></html>"""
    assert htmltext.main_text(page).split("\n") == [
        "Title & more", ("First " + P.strip() + " line"), "Second bold <x> é", "one", "two", "Quote.", "a", "b",
    ]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "</p></div>", "<a href='x'>", "&amp;", "<b>" * 3000, "<div>" * 3000 + "deep" + "</div>" * 3000, "<div>" * 100_000 + "deep", "<ul><li>" * 20_000 + "</p>" * 20_000, "<li>x" * 20_000, "<table><tr><td>" * 9000, "<p>" + "<i x=\"" * 500])
def test_broken_pages_do_not_fail(page):
    assert isinstance(htmltext.main_text(page), str)


def test_deep_pages_take_linear_time():
    import time

    took = []
    for n in (20_000, 100_000):
        began = time.process_time()
        assert htmltext.main_text("<div>" * n + "deep" + "</div>" * n) == "deep"
        took.append(time.process_time() - began)
    assert took[1] < 15 * took[0]


def test_names_of_noise_and_headers_of_articles():
    page = f"""<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p class="social-history">{P}</p><section id="side-effects"><p>{P}</p></section>
    <div class="social-links">no</div><p class="notice">no</p><div class="reader-comments"><p>{P}</p></div><div class="adBanner">no</div><footer>no</footer></article><div class="side-bar">no</div>"""
    assert htmltext.main_text(page).split("\n") == ["Title", P.strip(), P.strip()]


def test_plain_and_short_pages():
    assert htmltext.main_text("just text") == "just text"
    assert htmltext.main_text("<html><body><article><p>Hi.</p></article><footer>no</footer></body></html>") == "Hi."
    assert htmltext.main_text("<nav>only menu</nav>") == ""


def test_siblings_of_the_best_container_stay():
    page = f"<body><div id='main'><section><p>{P}</p><p>{P}</p></section><section><p>{P}</p><p>{P}</p></section><div class='related'><a href='x'>{P}</a></div></div></body>"
    assert htmltext.main_text(page).split("\n") == [P.strip()] * 4


def test_all_pages(spark, small):
    got = {r.page_id: r for r in queries.op7_html_extraction(spark, small).collect()}
    for r in read(spark, small, "pages").collect():
        text = got[r.page_id].text
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        plain = [htmltext.SPACE.sub(" ", htmltext.html.unescape(x)).strip() for x in __import__("re").split(r"(?:<[^>]*>)+", inner)]
        assert text.replace("\n", " ").split() == " ".join(plain).split()
        assert got[r.page_id].n_chars == len(text) and got[r.page_id].url == r.url


def test_page_table_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "<p>x</p>"), (2, "u", "")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == ["", "", "", "x"]
    wide = spark.createDataFrame([("a", 1, "<p>x</p>", "t", 5, "u")], "`a.b` string, page_id long, html string, text string, n_chars int, url string")
    assert [tuple(r) for r in htmltext.extract(wide).collect()] == [(1, "u", "x", 1)]
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def exact(rows, threshold=0.9):
    """vec_id -> (n_links, component_id) by all pairs."""
    ids = [i for i, _ in rows]
    vectors = [np.array(v, float) if v and all(x is not None for x in v) else None for _, v in rows]
    ok = [v is not None and np.isfinite(v).all() and np.abs(v).max() > 0 for v in vectors]
    links, n = [], [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(vectors[a]) == len(vectors[b]):
                x, y = vectors[a] / np.abs(vectors[a]).max(), vectors[b] / np.abs(vectors[b]).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links.append((ids[a], ids[b]))
                    n[a] += 1
                    n[b] += 1
    top = brute.components(ids, links)
    return {i: (k, top[i]) for i, k in zip(ids, n)}


def test_vectors_whole_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in read(spark, small, "embeddings").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op10_embedding_dedup(spark, small).collect()}
    assert got == exact(rows)


@pytest.mark.parametrize("part_rows", [20_000, 40])
def test_vectors_recall_and_hot_groups(spark, monkeypatch, part_rows):
    """Groups about the threshold: no false link, and at least 0.9 of the true ones."""
    monkeypatch.setattr(itq, "PART_ROWS", part_rows)
    r = np.random.default_rng(1)
    rows = []
    for g in range(40):
        centre = r.standard_normal(64)
        for _ in range(int(r.integers(1, 14)) if g else 90):
            x = centre / np.linalg.norm(centre) + r.uniform(0, 0.36) * r.standard_normal(64) / 8
            rows.append((len(rows), x.astype(np.float32).tolist()))
    rows += [(len(rows) + k, rows[0][1]) for k in range(5)]
    want = exact(rows)
    got = {x.vec_id: x.n_links for x in itq.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert all(got[i] <= n for i, (n, _) in want.items())
    assert sum(got.values()) >= 0.9 * sum(n for n, _ in want.values())


@pytest.mark.parametrize("cell_rows", [100_000, 300])
def test_vectors_with_a_common_offset(spark, monkeypatch, cell_rows):
    """A mean of twice the noise: bits stay balanced, the true links are found, also where cells are over their bound."""
    monkeypatch.setattr(itq, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(itq, "GROUP", 4 if cell_rows < 1000 else 64)
    r = np.random.default_rng(2)
    x = r.standard_normal((1500, 32)) / np.sqrt(32)
    x = x + 2 * np.eye(32)[0]
    near = x[:300] + 0.25 * r.standard_normal((300, 32)) / np.sqrt(32)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([x, near]))]
    units = itq.unit(np.array([v for _, v in rows]))
    codes = itq.Codes(units, 8, 6)
    shares = ((units - codes.mean) @ codes.projection >= 0).mean(0)
    assert (abs(shares - 0.5) < 0.1).all()
    true = np.triu(units @ units.T >= 0.9, 1)
    want = true.sum(0) + true.sum(1)
    got = np.array([x.n_links for x in itq.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum() and want.sum() > 1000


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [nan] + [1.0] * 7), (5, [inf] + [1.0] * 7), (6, [None] + [1.0] * 7), (7, [1.0] * 8), (8, [2.0] * 8), (9, [1.0] * 8), (10, [1.0] * 4),
            (11, [1e300] * 8), (12, [1.0, -1.0] * 4), (12, [1.0, -1.0] * 4), (13, [1.0])]
    df = spark.createDataFrame([(i, v, 0, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id int, u string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in itq.dedup(df).collect()}
    assert {i: g for i, g in got.items() if i not in (7, 8, 9, 11, 12)} == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 13)}
    assert {i: got[i] for i in (7, 8, 9, 11)} == {7: (3, 7, True), 8: (3, 7, False), 9: (3, 7, False), 11: (3, 7, False)}
    assert got[12] == (1, 12, True)
    assert itq.dedup(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, [1.0] * 8), (5, [1.0] * 8), (None, None)], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in itq.dedup(none).collect()) == [(0, 0, 0), (0, 1, 5), (5, 1, 5)]


def test_whole_article_around_the_best_container():
    from millrace.llm.htmltext import main_text

    p = lambda k: f"<p>Paragraph {k} of the text, with commas, and enough words to count as one of its own here.</p>"
    page = "<body><nav><a href=x>Menu</a></nav><article><div>" + "".join(map(p, range(10))) + "</div><section>" + "".join(map(p, range(10, 13)))
    page += "</section><ul><li>First point</li><li>Second point</li></ul><div class=share>Share this</div><p>Short close.</p></article><footer>Foot</footer></body>"
    got = main_text(page).split("\n")
    assert [x.split()[1] for x in got[:13]] == [str(k) for k in range(13)] and got[13:] == ["First point", "Second point", "Short close."]
