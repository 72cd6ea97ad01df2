"""Copies of a page do not make its article a template."""

from perfweave.llm import html

SCHEMA = "page_id long, url string, html string"
BOX = "<div class=x><p>Subscribe to us today</p></div>"


def page(i, head=""):
    return f"<html><head>{head}</head><body><article><h1>Head {i}</h1><p>text of page {i}</p>{BOX}</article></body></html>"


def texts(spark, rows):
    return {r.id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}


def test_copies_keep_their_text(spark):
    # 10 copies of one page among 15, their heads alike or not.
    for head in (lambda i: "", lambda i: f"<meta content={i}><script>{i}</script>"):
        got = texts(spark, [(i, f"http://h.example/{i}", page(max(i, 9), head(i))) for i in range(15)] + [(99, "http://g.example/", page(9))])
        # Six different pages are too few to tell a template.
        assert got == {i: f"Head {max(i, 9)} text of page {max(i, 9)} Subscribe to us today" for i in range(15)} | {99: got[9]}


def test_template_among_copies(spark):
    rows = [(i, f"http://h.example/{i}", page(max(i, 500))) for i in range(501 + 12)]
    got = texts(spark, rows)
    assert got == {i: f"Head {max(i, 500)} text of page {max(i, 500)}" for i, *_ in rows}


def test_whole_article_is_never_template():
    def hashed(tree):
        found = set()
        html.mark(tree, found)
        return found

    card = "<article><p>a card</p></article>"
    alone, several = (f"<div><main>{text}</main></div>" for text in (card, card + "<article><p>b</p></article>"))
    inner = hashed(html.parse("<p>a card</p>"))
    assert hashed(html.parse(alone)) == inner
    of_card = hashed(html.parse(several)) - inner - hashed(html.parse("<p>b</p>"))
    assert len(of_card) == 2
    # Of several article elements one can be template, a sole one never.
    assert html.main_text(several, of_card) == "" and html.main_text(alone, of_card) == "a card"
