"""Broken markup is read in linear time; odd tables of pages; pages where only templates can tell."""

import time

import pytest

from perfweave.llm import html

SCHEMA = "page_id long, url string, html string"

BROKEN = {
    "unclosed quotes": lambda n: '<a href="x ' * (n // 11),
    "odd quotes": lambda n: "<i a='b\" c>" * (n // 11),
    "stray end tags": lambda n: "<div>" * (n // 10) + "</b>" * (n // 8),
    "tags never ended": lambda n: "<a" * (n // 2),
    "declarations never ended": lambda n: "</ " * (n // 3),
    "open inline elements": lambda n: "<p><div>" + "<b>" * (n // 6) + "<hr>" * (n // 8),
    "long attribute": lambda n: f"<div {'a' * (n // 2)} {'b ' * (n // 4)}>",
    "many deep articles": lambda n: "<div>" * (n // 10) + "<article>a</article>" * (n // 40),
}


@pytest.mark.parametrize("name", BROKEN)
def test_linear(name):
    def seconds(n):
        page = BROKEN[name](n)
        began = time.process_time()
        html.mark(html.parse(page))
        return time.process_time() - began

    # Four times the page; a quadratic parser would take 16 times as long, and minutes.
    small, large = min(seconds(100_000) for _ in range(2)), seconds(400_000)
    assert large < max(10 * small, 1.0)


@pytest.mark.parametrize(("page", "text"), [
    ('<p>a <a href="x>b</p><p>c', 'a <a href="x>b c'),
    ("<p title='>'>a</p><p title=\">\">b", "a b"),
    ('a <b "c" d="e', 'a <b "c" d="e'),
    ("a </ b> c <!d> e <?f> g", "a c e g"),
    ("<p>a<script>x</p>", "a"),
    ("<script a='>'>x</SCRIPT >b", "b"),
    ("<!-- a", ""),
    ("<p><b>a<hr><p>b</b></p>c", "a b c"),
    ("<div x class = menu>a</div><div hidden>b</div><div unhidden>c</div>", "c"),
])
def test_odd_markup(page, text):
    assert html.main_text(page) == text


def test_quotes_against_plain_search():
    """Ends of broken tags as a search from each of them finds them."""
    def plain(page, at):
        while at < len(page):
            if page[at] == ">":
                return at
            if page[at] in "\"'":
                at = page.find(page[at], at + 1)
                if at < 0:
                    return -1
            at += 1
        return -1

    for k in range(3000):
        page = "".join("a>\"'"[(k * 7919 + i * i * 31 + i * k) // 3 % 4] for i in range(k % 17))
        end = html._tag_ends(page)
        assert [end(at) for at in range(len(page))] == [plain(page, at) for at in range(len(page))], page


def test_only_templates_can_tell(spark):
    """No article, no declared name: what pages of a host share goes, what only one has stays."""
    def page(i, strange=""):
        return (f"<body><div class=q1><p>Start here</p><p>All topics</p></div><div class=q2><p>story {i}</p>{strange}"
                f"<div class=q3>Read more of us</div></div><div class=q4>Made by us</div></body>")

    rows = [(i, f"http://h.example/{i}", page(i, "<div class=q5>a rare box</div>" if i == 3 else "")) for i in range(12)]
    rows += [(100 + i, f"http://small.example/{i}", page(i)) for i in range(3)]
    got = {r.id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {i: f"story {i}" + (" a rare box" if i == 3 else "") for i in range(12)} | {
        100 + i: f"Start here All topics story {i} Read more of us Made by us" for i in range(3)}


def test_odd_tables(spark):
    rows = [(1, "http://h/1", "<p>a", "x"), (1, "http://h/1", "<p>a", "x"), (None, None, None, None), (2, "", "", ""), (3, "::", "b", "y")]
    # A column named as an inner one must not get in the way.
    pages = spark.createDataFrame(rows, f"{SCHEMA}, text string").selectExpr("*", "1 AS host", "2 AS marks", "3 AS id")
    got = sorted(((r.id, r.url, r.text) for r in html.extract(pages).collect()), key=str)
    assert got == sorted([(1, "http://h/1", "a")] * 2 + [(None, None, ""), (2, "", ""), (3, "::", "b")], key=str)
    assert html.extract(pages.limit(0)).count() == 0
