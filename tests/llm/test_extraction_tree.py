"""The style tree's entropies and decisions against a plain version over all pages."""

import math
from collections import defaultdict
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import extraction
from paperloom.llm.extraction import CONTENT, NOISE, PLAIN, parse_page

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"
NONE = extraction.Entropies(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def _site(n, text="div class=text"):
    """A site without article tags: menu, a line that stays, text of its own, a line that changes between two."""
    return [
        (i, f"http://site.x/{i}", f"<html><body><div class=top><ul><li>Home<li>News</ul></div><{text}>" + "".join(f"<p>Own words {i} {k}.</p>" for k in range(1 + i % 4)) + f"</div><div class=low>Line {i % 2}</div><p class=end>The end.</body></html>")
        for i in range(n)
    ]


def _plain_tree(rows):
    """(host, path) -> pages, content and presentation entropy, from dictionaries and paths of labels."""
    looks, said, seen = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), set()
    for _, url, html in rows:
        host = urlparse(url).netloc
        if (host, html) in seen:
            continue
        seen.add((host, html))
        tree = parse_page(html, host)
        path, at = [(host,)], defaultdict(list)
        for i in range(1, len(tree.key)):
            siblings = [j for j in range(1, i + 1) if tree.above[j] == tree.above[i]]
            labels = [c for c in tree.children[tree.above[i]] if c != "#"]
            path.append((*path[tree.above[i]], labels[len(siblings) - 1]))
        for p, children in zip(path, tree.children):
            at[p].append(tuple(children))
        for p, x in at.items():
            looks[p][tuple(x)].add(html)
        for i, t in tree.blocks:
            said[path[i]][t].add(html)
    out = []
    for p, x in looks.items():
        m, n = sum(map(len, x.values())), sum(map(len, said[p].values()))
        if m > 1:
            kl = lambda groups: sum(len(g) * math.log(len(g)) for g in groups.values())
            content = 1 - kl(said[p]) / (n * math.log(m)) if n else 1.0
            look = 1 - kl(x) / (m * math.log(m))
            weigh = lambda e, to: (m * max(0.0, e) + extraction.PRIOR_PAGES * to) / (m + extraction.PRIOR_PAGES)
            out.append((m, round(weigh(content, 1), 9), round(weigh(look, 0), 9)))
    return sorted(out)


def test_entropies(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    rows += _site(30) + _site(30)
    got = extraction.style_tree(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.pages, round(r.content, 9), round(r.look, 9)) for r in got) == _plain_tree(rows)


def test_entropy_decides_without_names(spark):
    got = {r.page_id: r.text for r in extraction.extract_main_text(spark.createDataFrame(_site(40), SCHEMA)).collect()}
    assert got == {i: "\n".join(f"Own words {i} {k}." for k in range(1 + i % 4)) for i in range(40)}


def test_entropy_decides_within_an_article(spark):
    got = {r.page_id: r.text for r in extraction.extract_main_text(spark.createDataFrame([(i, u, h.replace("</article>", "<div>Tell a friend</div></article>")) for i, u, h in ((i, u, h.replace("<div class=text>", "<article>").replace(".</p></div>", ".</p></article>")) for i, u, h in _site(40))], SCHEMA)).collect()}
    assert got == {i: "\n".join(f"Own words {i} {k}." for k in range(1 + i % 4)) for i in range(40)}


def test_same_article_on_most_pages_stays(spark):
    rows = [(i, f"http://site.x/{i}", f"<nav>{i}</nav><article><p>{'The same text.' if i % 10 else f'Text {i}.'}</p></article>") for i in range(400)]
    got = {r.page_id: r.text for r in extraction.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "The same text." if i % 10 else f"Text {i}." for i in range(400)}


def test_both_ways_to_the_pages_agree(spark):
    rows = spark.createDataFrame(_site(300) + [(9, None, None), (9, None, ""), (9, "x", "<p>One")], SCHEMA).unionByName(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")).repartition(5)
    told, by_host = (sorted(map(tuple, extraction.extract_main_text(rows, most_told=most).collect()), key=str) for most in (extraction.MOST_TOLD, 0))
    assert told == by_host and len(told) == rows.count()


def test_articles_of_the_table(spark):
    """All given pages mark their article; blocks of all kinds have their importance from the tree."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    tree = extraction.style_tree(rows).toPandas()
    known = extraction.Entropies(tree["node"].to_numpy(), tree["content"].to_numpy(), tree["look"].to_numpy())
    weights = defaultdict(list)
    for r in rows.collect():
        page = parse_page(r.html, urlparse(r.url).netloc)
        for kind, weight in zip(*extraction.importance(page, known)):
            weights[kind].append(weight)
    assert min(weights[CONTENT]) > extraction.LEAST_IMPORTANCE > max(weights[NOISE]) and PLAIN not in weights


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>T</title><body><p>Hello</p></body></html>", ["Hello"]),
        ("<p>One<button>go<p>main text</p><p>last", ["Onego", "main text", "last"]),
        ('<p>One <a href="x>link</a> here</p><p class="b">two</p>', ["One link here", "two"]),
        ('<p>a</p><svg><path d="M0"/></svg><p>b</p><svg>tail', ["a", "b", "tail"]),
        ('<p title="1 > 0">a &lt;b&gt;&nbsp;c</p><!-- <p>no</p> --><p>d<![CDATA[ e ]]></p><!-- open', ["a <b> c", "d e"]),
        ("<script>var t='<p>no</p>';</script><style>p{}</style><p>yes<script>open", ["yes"]),
        ("<p class=related>In an <i>article</i> of some length that is the text of the page.</p><ul><li>x</ul>", ["In an article of some length that is the text of the page.", "x"]),
        ("x" * 300_000, ["x" * 300_000]),
        ("<div>" * 3_000 + "deep" + "</div>" * 3_000, ["deep"]),
        ("<p>" + "<b>a</b> " * 20_000, [" ".join("a" * 20_000)]),
    ],
)
def test_markup(page, want):
    assert extraction.kept_blocks(parse_page(page), NONE) == want


def test_clashing_names_and_odd_rows(spark):
    rows = [(1, "http://a.b/1", "<p>x", 1, 2), (1, "http://a.b/1", "<p>x", 1, 2), (None, "not a url", "<p>y", 1, 2), (2, None, None, 1, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host long, text long")
    assert sorted((r.page_id or 0, r.text) for r in extraction.extract_main_text(df).collect()) == [(0, "y"), (1, "x"), (1, "x"), (2, "")]
    for most in (0, 10):
        assert extraction.extract_main_text(df.where(F.lit(False)), most_told=most).count() == 0
