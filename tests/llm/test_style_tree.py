"""The site style tree: importance against brute force, pages whose tags and classes tell nothing, and long or broken pages."""

import math
import re
import time
from collections import defaultdict

import pytest
from test_text_operators import article_text

from rasterloom.llm import html_extract as H


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")


def masked(html):
    """The page without what its tags and classes say of its parts."""
    for tag in ("nav", "footer", "article"):
        html = html.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
    return html.replace(' class="ad"', "")


def test_parts_are_told_apart_without_their_names(spark, pages):
    rows = pages.collect()
    for shape in (str, masked):
        df = spark.createDataFrame([(r.page_id, r.url, shape(r.html)) for r in rows], "page_id long, url string, html string")
        assert H.low_branches(df).count() > 0
        got = {r.page_id: r.text for r in H.extract(df).collect()}
        assert got == {r.page_id: article_text(r.html) for r in rows}


def test_importance_is_exact(spark):
    html = [
        "<body><div class='m'>home. about.</div><div><p>one own. common.</p><p>first</p></div></body>",
        "<body><div class='m'>home. about.</div><div><p>two own. common.</p></div><div>tail<ul><li>x</li></ul></div></body>",
        "<body><div class='m'>home. other.</div><div><p>three own</p></div><div>tail<p>y</p></div></body>",
    ]
    rows = [(i, "http://a.org/", h) for i, h in enumerate(html)] + [(9, "http://a.org/again", html[0]), (10, "http://b.org", html[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.host, r.node): (r.pages, r.importance) for r in H.importance(df).collect()}
    distinct = {(H.host_of(u), h) for _, u, h in rows}
    for tree in (H.host_key("a.org"), H.host_key("b.org"), H.ALL):
        pages_of, feature, style = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
        for host, h in distinct:
            if tree not in (H.ALL, H.host_key(host)):
                continue
            page = H.Page(h)
            for b in page.blocks:
                pages_of[b.node].add((host, h))
                for s in re.split("[.]", b.text):
                    if s.strip():
                        feature[b.node][s.strip()].add((host, h))
                if b.node in page.children:
                    style[b.node][tuple(page.children[b.node])].add((host, h))
        assert {n for t, n in got if t == tree} == set(pages_of)
        for node, there in pages_of.items():
            m = len(there)
            if m < 2:
                want = 1.0
            else:
                content = 1 - sum(math.log(len(x)) for x in feature[node].values()) / len(feature[node]) / math.log(m)
                n = sum(len(x) for x in style[node].values())
                presentation = -sum(len(x) / n * math.log(len(x) / n) for x in style[node].values()) / math.log(m)
                share = H.GAMMA ** len(style[node])
                want = (1 - share) * presentation + share * content
            assert got[tree, node][0] == m and abs(got[tree, node][1] - want) < 1e-9


def test_classes_remove_nothing_by_their_names():
    text = lambda h: H.main_text(H.Page(h))
    assert text("<article><p>a</p><div class='share-price'><p>b</p></div><div class='ad-hoc-analysis widget-theory'>c</div></article>") == "a\nb\nc"
    assert text("<article><p>a</p><article class='x'><p>a reader's comment</p></article></article>") == "a"
    assert text("<div><p>a</p><div role=navigation>m</div></div>") == "a"


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a \"'>", "<div>", "<h1>", "<b>", "<p><b>", "<li>", "</script ", "<script></script ", "<!--", '<a href="x>', "<table><p><td>", "&", "a "])
def test_a_megabyte_of_anything_is_read_quickly(part):
    html = part * (1_000_000 // len(part)) + "</i></p>"
    start = time.process_time()
    H.main_text(H.Page(html))
    assert time.process_time() - start < 5
