"""Main text of web pages by site template removal.

Every element subtree is hashed, and Spark counts per host in how many different pages each hash occurs.
Subtrees that recur across many pages of a host are its template and are deleted; what a page's own tags
and class names declare as navigation, advert, form, comment and so on goes as well. The rest is the text.
Pages of one host with equal text count once, and an element that holds the whole article never is template.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import stage, table

# A subtree is template if it is in so many pages of its host, and in such a share of them.
MIN_PAGES = 10
MIN_SHARE = 0.5

# No pattern goes back over what it took, so each reads a place once.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]++))?")
_SPACE = re.compile(r"\s+")

# HTML's void elements, elements that stand in running text, elements whose content is not read, and
# elements never part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style noscript template svg textarea iframe title".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu object audio video canvas map".split())
# Elements that a new one of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words of class names and ids that declare a part as not the article.
DECLARED = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related "
    "reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())


class Node:
    __slots__ = ("tag", "declared", "parts", "mark")

    def __init__(self, tag: str, declared: bool) -> None:
        self.tag, self.declared, self.parts, self.mark = tag, declared, [], 0


def _declared(tag: str, attributes: str, opened: Counter[str]) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header":
        return not opened["article"] and not opened["main"]
    if not attributes or tag in ("body", "html", "main", "article"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and not DECLARED.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes))


def _tag_ends(page: str) -> Callable[[int], int]:
    """A function that gives the ``>`` outside quotes that ends what begins at a place, or -1; asked at rising places.

    Where a way through quotes and brackets leads is kept for each of them, so that all calls together take linear time.
    """
    last = {c: page.rfind(c) for c in ">\"'"}
    leads: dict[int, int] = {}
    near = 0 if max(last.values()) >= 0 else -1

    def following(at: int) -> int:
        return _SPECIAL.search(page, at).start() if at <= max(last.values()) else -1

    def end(at: int) -> int:
        nonlocal near
        if near >= 0 and (near < at or near == 0):
            near = following(at)
        way, q = [], near
        while q >= 0 and q not in leads:
            way.append(q)
            if page[q] == ">":
                leads[q] = q
            elif q == last[page[q]]:
                leads[q] = -1
            else:
                q = following(page.find(page[q], q + 1) + 1)
        found = leads[q] if q >= 0 else -1
        leads.update(dict.fromkeys(way, found))
        return found

    return end


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """``kind, tag, attributes, text``: kinds are text, open, close and raw. Comments and declarations give none.

    A tag whose quotes or bracket are never closed is text from its ``<`` on. Time is linear in any markup.
    """
    at, size, ends, last_end = 0, len(page), None, page.rfind(">")
    while at < size:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = size if stop < 0 else stop
            yield "text", "", "", page[at:stop]
            at = stop
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = size if stop < 0 else stop + 3
            continue
        tag = None
        if ends is None:
            m = _TAG.match(page, at)
            if m:
                tag, attributes, stop = m[2].lower(), m[3], m.end()
        if tag is None:
            m = _NAME.match(page, at)
            if m:
                ends = ends or _tag_ends(page)  # from the first broken tag of a page on
                stop = ends(m.end()) + 1
                if stop:
                    tag, attributes = m[2].lower(), page[m.end() : stop - 1]
        if tag is not None:
            if m[1]:
                yield "close", tag, "", ""
            elif tag in RAW:
                close = re.compile(rf"</{tag}\s*+>", re.I).search(page, stop)
                stop = close.end() if close else size
                yield "raw", tag, "", page[at:stop]
            else:
                yield "open", tag, attributes, ""
            at = stop
        elif page[at + 1 : at + 2] in ("!", "?", "/") and at < last_end:
            at = page.find(">", at) + 1
        else:
            yield "text", "", "", "<"
            at += 1


def parse(page: str) -> Node:
    """Element tree of a page. Broken markup never fails: open elements end with their parents."""
    root = Node("", False)
    stack = [root]
    # For each open element the place of the closest one, itself included, that does not stand in running text.
    block = [0]
    opened: Counter[str] = Counter()

    def close(at: int) -> None:
        opened.subtract(n.tag for n in stack[at:])
        del stack[at:], block[at:]

    for kind, tag, attributes, text in tokens(page):
        if kind == "text":
            stack[-1].parts.append(text)
        elif kind == "raw":
            raw = Node(tag, True)
            raw.parts.append(text)
            stack[-1].parts.append(raw)
        elif kind == "close":
            if opened[tag] > 0:
                # All that is walked over is closed.
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
        else:
            ends = CLOSES.get(tag, frozenset())
            if tag in PARAGRAPH_ENDS:
                ends = ends | {"p"}
            i = block[-1] if ends else 0
            while i > 0:
                if stack[i].tag in ends:
                    close(i)
                elif stack[i].tag in ("tr", "td", "th"):
                    i = block[i - 1]
                    continue
                break
            node = Node(tag, _declared(tag, attributes, opened))
            stack[-1].parts.append(node)
            if tag not in VOID and not attributes.endswith("/"):
                block.append(block[-1] if tag in INLINE else len(stack))
                stack.append(node)
                opened[tag] += 1
    return root


def mark(node: Node, found: set[int] | None = None) -> int:
    """Hashes every subtree: tag, own text and the hashes of the children, in order."""
    # Without recursion: markup can be nested arbitrarily deep.
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(p for p in n.parts if isinstance(p, Node))
    whole = _whole(node)
    for n in reversed(order):
        content = "\x00".join(_SPACE.sub(" ", p).strip() if isinstance(p, str) else str(p.mark) for p in n.parts)
        n.mark = xxhash.xxh64_intdigest(f"{n.tag}\x01{content}") - (1 << 63)
        if found is not None and content and n.tag not in ("", "html", "body") and n not in whole:
            found.add(n.mark)
    top = node.mark
    for n in whole:
        n.mark = None
    return top


def _whole(root: Node) -> set[Node]:
    """Elements that hold all article (or else main) elements of a page."""
    articles = _articles(root, frozenset())
    if not articles:
        return set()
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(p for p in n.parts if isinstance(p, Node))
    inside = dict.fromkeys(articles, 1)  # none of them lies in another
    for n in reversed(order):
        inside[n] = inside.get(n, 0) + sum(inside[p] for p in n.parts if isinstance(p, Node))
    return {n for n in order if inside[n] == len(articles)}


def main_text(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of the article: blocks in page order, one space between them."""
    if not page:
        return ""
    root = parse(page)
    if template:
        mark(root)
    return _text(root, template)


def _text(root: Node, template: frozenset[int] | set[int]) -> str:
    articles = _articles(root, template)
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if text:
            blocks.append(text)

    for top in articles or [root]:
        todo: list[Node | str | None] = [top]
        while todo:
            part = todo.pop()
            if part is None:
                end_block()
            elif isinstance(part, str):
                line.append(part)
            elif _gone(part, template):
                continue
            else:
                if part.tag not in INLINE:
                    end_block()
                    todo.append(None)
                todo.extend(reversed(part.parts))
        end_block()
    return " ".join(blocks)


def _gone(node: Node, template: frozenset[int] | set[int]) -> bool:
    return node.declared or bool(template) and node.mark in template


def _articles(root: Node, template: frozenset[int] | set[int]) -> list[Node]:
    """The outermost article elements, or else main elements, that are left."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if _gone(node, template):
                continue
            if node.tag == wanted:
                found.append(node)
            else:
                todo.extend(reversed([p for p in node.parts if isinstance(p, Node)]))
        if found:
            return found
    return []


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, marks``: hashes of the subtrees in at least ``min_pages`` pages and ``min_share`` of a host's
    pages, where pages of equal text are one. Of a host there are at most as many as ``1 / min_share`` times
    what a page of it has."""
    def subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                seen: dict[tuple[str, bytes], list[int]] = {}
                for host, page in zip(batch["host"][at : at + 500], batch["html"][at : at + 500], strict=True):
                    root = parse(page or "")
                    key = host, xxhash.xxh128_digest(_text(root, frozenset()).encode("utf-8", "surrogatepass"))
                    if key not in seen:
                        found: set[int] = set()
                        mark(root, found)
                        seen[key] = [0, *sorted(found)]  # 0 counts the pages
                yield pd.DataFrame({"host": [h for h, _ in seen], "content": [c for _, c in seen], "marks": list(seen.values())})

    # Of pages with equal text each task hands on one, and the smallest list of marks stands for all of them.
    different = pages.select("host", "html").mapInPandas(subtrees, "host string, content binary, marks array<long>").groupBy(
        "host", "content").agg(F.min("marks").alias("marks"))
    counts = stage(different.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages))
    total = counts.filter("mark = 0").select("host", F.col("n").alias("pages"))
    often = counts.filter("mark != 0").join(total, "host").filter(F.col("n") >= min_share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("mark").alias("marks"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``id, url, text`` of every row.

    Null and empty html give an empty text. Pages without a host (null or odd urls) share the empty one.
    Where a page has article (or else main) elements, only they count. Copies of a page count as one page.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    templates = stage(site_templates(rows, min_pages, min_share))

    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, marks in batches:
            yield pd.Series([main_text(h, frozenset(() if m is None else m)) for h, m in zip(htmls, marks, strict=True)], dtype=object)

    text.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    joined = rows.join(templates, "host", "left")
    return joined.select("id", "url", F.pandas_udf(text, "string")("html", "marks").alias("text"))


def op5_html(spark, sf_dir: str) -> DataFrame:
    texts = extract(table(spark, sf_dir, "pages"))
    return texts.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
