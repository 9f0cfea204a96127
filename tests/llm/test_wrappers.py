"""Main texts against a plain reading of the given pages and against pages written for the test."""

from __future__ import annotations

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import wrappers
from cohortspark.llm.wrappers import Page, Tree, induce, matching, merge

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def plain(source):
    """The given pages' articles by pattern: blocks end at h1 and p tags."""
    article = re.search(r"<article>(.*?)</article>", source, re.S).group(1)
    blocks = re.split(r"</?(?:h1|p)>", article)
    texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " " , b.replace("<b>", "")))).strip() for b in blocks]
    return "\n".join(t for t in texts if t)


def test_op11_on_the_given_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    found = {r.page_id: r for r in wrappers.op11(spark, FOLDER).collect()}
    assert set(found) == {p.page_id for p in pages}
    for p in pages:
        assert found[p.page_id].text == plain(p.html), p.page_id
        assert found[p.page_id].n_chars == len(found[p.page_id].text) and found[p.page_id].url == p.url


def blocks(source):
    return [b[1] for b in Page(source).blocks]


def test_reading_of_broken_markup():
    assert blocks("a<b>b</b> c<br>d<p>e &lt;f&gt; &#233;&nbsp;g<p>h</div>i") == ["ab c d", "e <f> é g", "h", "i"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul>d</ul><dl><dt>x<dd>y</dl>") == ["a", "b", "c", "d", "x", "y"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert blocks("a<script>if (a<b) '</p>'</script>b<!-- <p>x</p> -->c<style>z</style>") == ["abc"]
    assert blocks("<p>a <button>no</button>b<form>no<p>no</form>c<nav>no") == ["a b", "c"]
    assert blocks("x < y <3 <p title='a > b'>z") == ["x < y <3", "z"]
    assert blocks("") == [] and blocks("<") == ["<"] and blocks("<!-- open") == [] and blocks("<script>x") == []
    assert blocks("<div>" * 5_000 + "deep" + "</div>" * 5_000 + "<p>end") == ["deep", "end"]
    assert blocks("<article><header><h1>T</h1></header>x<aside>no</aside></article><header>no</header>") == ["T", "x"]


def test_regions_that_are_no_content():
    for name in ("ad", "side-bar ads", "cookie-notice", "comments", "share_buttons", "Newsletter"):
        assert blocks(f'<p>a</p><div class="{name}"><p>no</p></div><p id=x1>b</p>') == ["a", "b"], name
    assert blocks('<body class="no-sidebar"><div class="post readable">a</div><div hidden>no</div>') == ["a"]
    assert blocks('<article class="post"><p>a</article><article class="comment"><p>no</article>') == ["a"]


def random_tree(rng, depth=3):
    label = rng.choice("abc")
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else []
    return label + (f"({' '.join(kids)})" if kids else "")


def best(a, b):
    """Largest match by trying every pair of last children."""
    if a.label != b.label:
        return 0

    def forest(x, y):
        if not x or not y:
            return 0
        return max(forest(x[:-1], y), forest(x, y[:-1]), forest(x[:-1], y[:-1]) + best(x[-1], y[-1]))
    return 1 + forest(a.children, b.children)


def test_tree_matching_against_a_search():
    rng = random.Random(2)
    for _ in range(300):
        a, b = Tree.read("r(" + random_tree(rng) + ")"), Tree.read("r(" + random_tree(rng) + ")")
        assert matching(a, b, {}) == best(a, b)
        a.count()
        slots = merge(a, b, grow=False)
        assert sum(s >= 0 for s in slots) == best(a, b) and len(slots) == b.count()
        kept = [s for s in slots if s >= 0]
        assert kept == sorted(set(kept))


def test_a_wrapper_holds_every_tree():
    rng = random.Random(4)
    trees = ["r(" + random_tree(rng) + ")" for _ in range(12)]
    wrapper = Tree.read(induce(trees))
    wrapper.count()
    assert all(-1 not in merge(wrapper, Tree.read(t), grow=False) for t in trees)


def test_skeleton_numbers_follow_its_text():
    rng = random.Random(6)
    tags = ["<p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "x", '<div class="k9 b">', "</p>", "<h2>", "</h2>"]
    for _ in range(200):
        page = Page("".join(rng.choices(tags, k=rng.randrange(30))))
        skeleton, node = page.folded()
        labels = re.findall(r"[^() ]+", skeleton)
        assert [labels[n] for n in node] == page.labels


def site(i, n_paragraphs=3):
    """A page without telling names: menu, story and imprint lie in plain divs."""
    story = "".join(f"<p>Story {i} says thing {k} at some length.</p>" for k in range(n_paragraphs))
    links = "".join(f'<a href="/{i}/{k}">Read {i * 7 + k}</a> ' for k in range(4))
    return (f"<title>Story {i}</title><body><div><p>Welcome to our site</p><div>{links}</div></div>"
            f"<div><h1>Story {i}</h1>{story}</div><div><p>All rights reserved.</p></div></body>")


def test_constant_nodes_are_template(spark):
    rows = [(i, f"http://Plain.example/{i}", site(i, 1 + i % 4)) for i in range(8)]
    rows += [(100, "http://alone.example/", site(50)), (101, None, None), (102, "x", "")]
    rows += [(200 + i, "http://copies.example/", "<title>T</title><article><p>Same story.</p></article>") for i in range(20)]
    found = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(8):
        lines = [f"Story {i}"] + [f"Story {i} says thing {k} at some length." for k in range(1 + i % 4)]
        assert found[i] == "\n".join(lines)
    assert "Welcome to our site" in found[100] and found[101] == found[102] == ""   # one page shows no template
    assert all(found[200 + i] == "Same story." for i in range(20))                  # copies are one page


def test_template_lines_inside_articles(spark):
    rows = [(i, "http://a.example/", f"<title>{i}</title><article><h1>{i}</h1><p>Text {i}.</p><p>Thanks for reading!</p>"
             "</article>") for i in range(6)]
    rows += [(10 + i, "http://b.example/", f"<title>{i}</title><article><p>Text {i}.</p><p>Yes.</p></article>") for i in range(3)]
    found = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[0] == "0\nText 0." and found[10] == "Text 0.\nYes."


def test_trees_merged_in_groups(spark):
    rng = random.Random(8)
    rows = [("h" if i % 3 else "g", "r(" + random_tree(rng) + ")", 1 + i % 4) for i in range(60)]
    skeletons = spark.createDataFrame(rows, "host string, skeleton string, n long").groupBy("host", "skeleton").agg(
        F.sum("n").alias("n"))
    whole = {r.host: r.wrapper for r in wrappers.wrappers(skeletons, fan=7).collect()}
    for host, tree, _ in rows:
        wrapper = Tree.read(whole[host])
        wrapper.count()
        assert -1 not in merge(wrapper, Tree.read(tree), grow=False)


def test_empty_table_very_long_page_and_extra_columns(spark):
    assert wrappers.main_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(100_000)) + "</article>"
    frame = spark.createDataFrame([(1, "http://x/", long), (1, "http://x/", long), (None, None, "<p>a")], SCHEMA)
    wide = frame.withColumns({c: F.lit("x") for c in ("host", "title", "blocks", "slots", "text", "fixed", "skeleton", "n")})
    found = sorted(map(tuple, wrappers.main_texts(wide).collect()), key=lambda r: (r[0] is None, r[3]))
    assert [r[3] for r in found] == [sum(len(f"word {i}") + 1 for i in range(100_000)) - 1] * 2 + [1]
