"""Pages that leave things open, labels inside articles, ids of any type."""

import time

import pytest
from galleyproof.llm import htmltext as H


@pytest.mark.parametrize("part", ["<a ", "<", "</", "<a '", '<a "', "<!", "<!--", "<a ' \">", "<a '\">\"", "<div class='", "<p", "<b x=\"'>"])
def test_open_ends_take_linear_time(part):
    for tail in ("", ">", "'>", '">"', "<p>end"):
        page = "<p>start" + part * 100_000 + tail
        began = time.perf_counter()
        H.blocks(page)
        assert time.perf_counter() - began < 4, (part, tail)


def test_what_is_open_is_text():
    assert H.blocks("<p>a < b <c")[1] == ["a < b <c"]
    assert H.blocks("<p title='x > y'>one</p>two <a href=\"u>three")[1] == ["one", "two three"]
    assert H.blocks("<?xml?><!doctype html><p>x</ p>y")[1] == ["xy"]


def test_labels_inside_an_article():
    page = (
        "<article><header><h1>Title</h1></header><p class='notice-text'>keep</p><h2 id='social'>Social history</h2><p>Body</p><section id='related-work'><h2 id='comments'>Comments on it</h2><p>w</p></section>"
        "<div class='ad'>x</div><div class='cookie-notice'>x</div><section class='comments-area'>x</section><div id='comments'>x</div><p class='newsletter-signup box-2'>x</p><footer>x</footer></article>"
    )
    assert H.blocks(page)[0] == ["Title", "keep", "Social history", "Body", "Comments on it", "w"]


def test_ids_of_text(spark):
    rows = [("a", "http://h/1", "<article>one</article>"), ("b", "http://h/2", "<p>two"), (None, None, "<p>three"), ("b", "http://h/2", None)]
    out = H.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted((r.page_id or "", r.text) for r in out) == [("", "three"), ("a", "one"), ("b", ""), ("b", "two")]
