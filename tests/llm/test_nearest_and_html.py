import random
import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import html_text, vptree
from quernel.llm.queries import op6_nearest, op9_html_text


def brute(vectors, asked, k):
    ids = np.array(sorted(vectors))
    all_of = np.array([vectors[i] for i in ids], float)
    out = {}
    for q in asked:
        d = np.sqrt(((all_of - np.array(vectors[q], float)) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [x for x, _ in a[q]] == [x for x, _ in b[q]]
        assert np.allclose([x for _, x in a[q]], [x for _, x in b[q]], rtol=1e-12)


def test_query_against_brute_force(spark, sf):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    same(found(op6_nearest(spark, sf).collect()), brute(vectors, [i for i in vectors if i % 100 == 0], 10))


@pytest.mark.parametrize("hot", [0, 700])
def test_many_shards_ties_and_equal_vectors(spark, hot):
    random.seed(1)
    vectors = {k: [float(random.randint(-2, 2)) + 0.5 for _ in range(4)] for k in range(900)}
    vectors |= {k: [1.5, 1.5, 1.5, 1.5] for k in range(hot)}
    df = spark.createDataFrame([(k, v, 3) for k, v in vectors.items()], "vec_id long, embedding array<double>, rank int").repartition(5)
    got = vptree.search(vptree.index(df, shard_rows=200), df.where("vec_id % 20 = 0"), k=7)
    same(found(got.collect()), brute(vectors, [i for i in vectors if i % 20 == 0], 7))


def test_queries_go_only_to_cells_that_may_hold_neighbours(spark):
    random = np.random.default_rng(6)
    centres = random.normal(size=(40, 6)) * 20
    vectors = {k: (centres[k % 40] + random.normal(size=6)).tolist() for k in range(4000)} | {k: [float(k), 1.0] for k in range(5000, 5600)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(4)
    built = vptree.index(df, shard_rows=100)
    assert len(built.cells) == 2 and built.trees.select("dim", "cell").distinct().count() > 20
    asked = [i for i in vectors if i % 20 == 0]
    same(found(vptree.search(built, df.where("vec_id % 20 = 0"), k=5).collect()), brute({k: v for k, v in vectors.items() if len(v) == 6}, [i for i in asked if i < 5000], 5) | brute({k: v for k, v in vectors.items() if len(v) == 2}, [i for i in asked if i >= 5000], 5))
    outer = built.cells[6]
    of = np.array([vectors[i] for i in asked if i < 5000])
    visits = sum(len(who) for _, who in outer.allowed(of, np.full(len(of), 4.0)))
    assert visits < 0.25 * len(of) * sum(n[0] < 0 for n in outer.nodes)


def test_relaxed_search_keeps_most_neighbours(spark):
    random = np.random.default_rng(3)
    vectors = {k: random.normal(size=8).tolist() for k in range(3000)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    trees = vptree.index(df, shard_rows=1000)
    exact = brute(vectors, range(0, 3000, 100), 10)
    got = found(vptree.search(trees, df.where("vec_id % 100 = 0"), k=10, factor=1.3).collect())
    assert np.mean([len({x for x, _ in got[q]} & {x for x, _ in exact[q]}) / 10 for q in exact]) >= 0.9


def test_repeated_rows_take_places_and_repeated_queries_are_one(spark):
    random.seed(5)
    rows = [(k, [float(k), 1.0]) for k in range(1, 301)] + [(7, [7.0, 1.0])] * 150 + [(8, [50.0, 1.0])] * 3 + [(300, [300.0, 1.0])] * 40
    random.shuffle(rows)
    asked = [(0, [7.2, 1.0]), (0, [7.2, 1.0]), (7, [7.0, 1.0]), (300, [300.0, 1.0]), (300, [300.0, 1.0]), (1000, [50.2, 1.0])]
    schema = "vec_id long, embedding array<double>"
    trees = vptree.index(spark.createDataFrame(rows, schema).repartition(4), shard_rows=100)
    got = found(vptree.search(trees, spark.createDataFrame(asked, schema).repartition(3), k=10).collect())
    want = {}
    for q, v in asked:
        near = sorted((float(np.hypot(v[0] - w[0], v[1] - w[1])), i) for i, w in rows if i != q)[:10]
        want[q] = [(i, d) for d, i in near]
    same(got, want)
    assert [i for i, _ in got[0]] == [7] * 10 and [i for i, _ in got[1000]][:4] == [8, 8, 8, 50]


def test_vectors_of_one_query_id_are_ranked_apart(spark):
    schema = "vec_id long, embedding array<double>"
    trees = vptree.index(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(1, 50)], schema))
    got = vptree.search(trees, spark.createDataFrame([(0, [1.0, 1.0]), (0, [49.0, 1.0])], schema), k=3).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 0.0), (1, 49, 0.0), (2, 2, 1.0), (2, 48, 1.0), (3, 3, 2.0), (3, 47, 2.0)]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (100, [9.0, 9.0]), (200, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(vptree.search(vptree.index(df), df.where("vec_id % 100 = 0")).collect())
    assert {q: [x for x, _ in v] for q, v in got.items()} == {0: [1, 100], 100: [1, 0]}
    assert vptree.search(vptree.index(df.limit(0)), df.limit(0)).count() == 0


def test_pages_against_a_plain_reading(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in op9_html_text(spark, sf).collect()}
    assert len(got) == len(pages)
    for r in pages:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"</?(p|br|h1)\b[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")
        want = " ".join(unescape(inner).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a b"), ("<p>a<b>b</b>c</p>", "abc"), ("<article>x <a href=\"", "x"),
    ("<article><p>a</p><aside>x</aside><form>q</form> tail</article><footer>f</footer>", "a tail"),
    ("<article>one<script>if(a<b){'</p>'}</script>two<!-- c --> &#233;&nbsp;!</article>", "onetwo é !"),
    ("<body><nav>n</nav><div id='content'><h1>T</h1><ul><li>a<li>b</ul><div class='user-comments'><p>c</p></div></div></body>", "T a b"),
    ("<article><header>h</header><div class='cookie-notice'>k</div>t<section class=comments>r</section></article>", "t"),
    ("<article>t<iframe>x</iframe><table><tr><td>1<td>2<tr><td>3</table></article>", "t 1 2 3"), ("<div>" * 3000 + "deep", "deep"),
    ("<article>t<p hidden>z</p><p style='display: none'>z</p><p aria-hidden=true>z</p></article>", "t"),
])
def test_markup(html, text):
    assert html_text.main_text(html) == text


STORY = "<article><h1>Title</h1><p>A long story that fills the page with its words.</p></article>"
SEEN = "Title A long story that fills the page with its words."


@pytest.mark.parametrize(("html", "text"), [
    (f"<div class='layout has-sidebar'>{STORY}<div class='sidebar'>s</div></div>", SEEN),
    (f"<div id='page-with-menu'><nav>n</nav>{STORY}</div>", SEEN), (f"<div class='post-header'>{STORY}</div>", SEEN),
    (f"<form id='aspnetForm'><div class='menu'><a>{'link ' * 50}</a></div>{STORY}</form>", SEEN),
    (f"<div class='modal-overlay-page'><div class='widget-area'>{STORY.replace('article', 'div')}</div><div class='comments'>c</div></div>", SEEN),
    (f"<article><div class='entry-header'><h1>Title</h1></div><div class='social'>s</div><p>{SEEN[6:]}</p></article>", SEEN),
    (f"<div class='menu-layout'><main><p>short</p></main></div><div class='sidebar'>{'many words ' * 20}</div>", "short"),
    (f"<div><p>short text</p></div><div class='comments'><p>{'a reader writes ' * 20}</p></div>", "short text"),
    (f"<div class='comments-open'>{STORY}</div><div class='comments'>c</div>", SEEN), ("<div class='discussion'><p>only this</p></div>", "only this"),
    (f"<div><p>short text</p></div><div class='mega-menu'><a>{'link ' * 50}</a></div><div class='related'><article><a>{'card ' * 20}</a></article></div>", "short text"),
])
def test_wrappers_named_like_noise_keep_their_article(html, text):
    assert html_text.main_text(f"<body>{html}</body>") == text


@pytest.mark.parametrize("depth", [150, 198, 199, 200, 201, 5000, 100_000])
@pytest.mark.parametrize("tag", ["div", "font", "span"])
def test_depth_has_no_limit(depth, tag):
    page = "<body>before" + f"<{tag}>" * depth + f"<nav>n</nav><div><article>{SEEN}<aside>x</aside><div>in</div> tail</article></div><div class=advert>v</div>after</body>"
    assert html_text.main_text(page) == html_text.main_text(page, {1: (0.0, 0.0)}) == f"{SEEN} in tail"
    page = "<body>" + f"<{tag}>" * depth + f"<nav>n</nav><p>a<p>b<ul><li>c<li>d</ul><{tag}>e</{tag}></{tag}>f" + f"</{tag}>" * (depth - 1) + " g"
    assert html_text.main_text(page) == html_text.main_text(page, {1: (0.0, 0.0)}) == ("a b c d e f g" if tag == "div" else "a b c d ef g")


def test_a_branch_that_all_pages_share_is_removed(spark):
    shared = "<div><p>Read all our terms before you go on.</p></div>"
    rows = [(k, f"https://h.example/{k}", f"<body>{shared}<section><p>Text number {k} with words of its own {k * 7}.</p></section></body>") for k in range(40)]
    rows += [(100, "https://lonely.example/", f"<body>{shared}<section><p>Alone.</p></section></body>"), (101, None, "<p>no url</p>"), (102, "https://h.example/x", None), (103, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert all(got[k] == f"Text number {k} with words of its own {k * 7}." for k in range(40))
    # A host with one page has the template of the others.
    assert got[100] == "Alone." and got[101] == "no url" and got[102] == "" and got[103] == ""
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<a ", '<a "', "<a '", "<p a=b", "</script ", "<script></script ", "<!-", "<", '<a href="x', "<div>", "<b>", "</p>", "<li>", "<td a='", "&amp"])
def test_hostile_pages_take_time_in_proportion(page):
    html_text.main_text(page * (100_000 // len(page)))
    started = time.process_time()
    html_text.main_text(page * (1_000_000 // len(page)) + "x")
    assert time.process_time() - started < 15


@pytest.mark.parametrize(("html", "text"), [
    ("<p>a<a b=\"c>d</p>e", "ad e"), ("<p title='>'>a</p>", "a"), ("a < b > c <3", "a < b > c <3"), ("<p a='x' A=y>a<br/>b", "a b"), ("<p>x</p junk='>'>y", "x y"), ("<?php a ?>x<!DOCTYPE html>y", "xy"),
    ("<p>one<p class=x\"y>two", "one two"), ("<SCRIPT>a</script x>b", "b"), ("<title>a</titlex>b</title>c", "c"), ("a<", "a"), ("a</", "a"), ("a<!", "a"), ("<é>x", "<é>x"),
])
def test_tags_are_scanned_forwards(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(("html", "text"), [
    ("<article>a<h2 class='related-work'>b</h2><p class='social-history'>c</p><div class='alert-rates'>d</div></article>", "a b c d"),
    (f"<div class='content no-sidebar'>{STORY}</div>", SEEN), (f"<div class='content no-sidebar'>{STORY.replace('article', 'div')}</div>", SEEN),
    (f"<div class='comment-list'>{'a reader writes ' * 9}</div><div class='widget-area'>{STORY}</div>", SEEN),
    (f"<main><p>{SEEN}</p><article><p>card</p></article></main><p>else</p>", f"{SEEN} card"), (f"<article><header><h1>Title</h1></header><p>{SEEN[6:]}</p><footer>f</footer></article>", SEEN),
    (f"{STORY}<section class='userComments'>c</section><div id=footerLinks>f</div><span class=ad>v</span>", SEEN),
])
def test_names_speak_by_their_head(html, text):
    assert html_text.main_text(f"<body>{html}</body>") == text


def test_the_tree_tells_boilerplate_by_itself(spark):
    """Pages whose parts no name tells apart: without the tree all of them keep their menu, with it a host of enough pages loses it."""
    random.seed(4)
    words = [f"word{k}" for k in range(400)]
    say = lambda n: " ".join(random.choices(words, k=n))
    pool = [say(6) for _ in range(12)]
    rows, want = [], {}
    for k in range(400):
        story = [say(30) for _ in range(4)]
        want[k] = " ".join(story)
        html = f"<body><div><ul><li>{random.choice(pool)}<li>{random.choice(pool)}</ul></div><div>{random.choice(pool)}</div><section>{''.join(f'<p>{x}</p>' for x in story)}</section></body>"
        rows.append((k, f"https://h{k % 3}.example/{k}", html))
    assert all(html_text.main_text(html) != want[k] for k, _, html in rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == want
    assert got == {r.page_id: r.text for r in html_text.extract(df, broadcast_rows=0).collect()}


def test_other_columns_and_repeated_rows(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumns({"host": F.lit("x"), "text": F.lit(1), "path": F.lit(2), "page": F.lit(3), "known": F.lit(4)})
    plain = {(r.page_id, r.url, r.text, r.n_chars) for r in op9_html_text(spark, sf).collect()}
    for rows in (0, 10**6):
        got = html_text.extract(pages.union(pages), broadcast_rows=rows).collect()
        assert len(got) == 2 * pages.count() and {tuple(r) for r in got} == plain


def test_pages_that_are_copies_keep_their_text(spark):
    df = spark.createDataFrame([(k, "https://h.example/", "<article><h1>T</h1><p>The same text.</p></article>") for k in range(30)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(df).collect()} == {"T The same text."}
