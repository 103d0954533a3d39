"""HTML to Markdown and plain text, as pandas functions over a column of pages.

A page is read into a small tree once. The region that counts is chosen on the tree, and a table of
rules says what each element puts before and after its contents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_MAIN = 200
#: Fixed values of the output: elements that are never shown, those shown only in a main region, and those without contents.
NEVER = frozenset("script style noscript template svg head iframe button select form".split())
ASIDE = frozenset("nav footer aside".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an element puts before and after its contents; elements that are not named put nothing.
RULES: dict[str, tuple[str, str]] = {
    **{f"h{n}": (f"\n\n{'#' * n} ", "\n") for n in range(1, 7)},
    **dict.fromkeys(("div", "section", "article", "main", "header", "figure", "dl", "dt", "dd"), ("\n", "\n")),
    **dict.fromkeys(("p", "blockquote", "table"), ("\n\n", "\n")),
    **dict.fromkeys(("br", "hr"), ("\n", "")),
    **dict.fromkeys(("ul", "ol"), ("", "\n\n")),
    **dict.fromkeys(("td", "th"), (" ", " |")),
    "tr": ("\n|", ""),
    "pre": ("\n\n```\n", "\n```\n\n"),
}
#: The same for plain text, which has neither heading marks nor fences.
PLAIN = RULES | dict.fromkeys((f"h{n}" for n in range(1, 7)), ("\n\n", "\n")) | {"pre": ("\n\n", "\n\n")}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    inside: list[Node | str] = field(default_factory=list)

    @property
    def hidden(self) -> bool:
        return self.tag in NEVER or "hidden" in self.attrs or self.attrs.get("aria-hidden") == "true"


class _Reader(HTMLParser):
    """Builds the tree. An end tag closes the innermost open element of its name, and all inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.path = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self.handle_endtag("head")  # whose end tag may be left out
        node = Node(tag, dict(attrs))
        self.path[-1].inside.append(node)
        if tag not in EMPTY:
            self.path.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        depth = next((i for i in range(len(self.path) - 1, 0, -1) if self.path[i].tag == tag), 0)
        if depth:
            del self.path[depth:]

    def handle_data(self, data: str) -> None:
        self.path[-1].inside.append(data)


def read(html: str | None) -> Node:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


def _walk(node: Node) -> Iterator[Node]:
    """All elements below ``node`` in the order of the page; no recursion, as pages can be deep."""
    todo = [node]
    while todo:
        at = todo.pop()
        yield at
        todo += [x for x in reversed(at.inside) if isinstance(x, Node)]


def _outermost(root: Node, wanted: set[int]) -> list[Node]:
    out, todo = [], [root]
    while todo:
        at = todo.pop()
        if id(at) in wanted:
            out.append(at)
        else:
            todo += [x for x in reversed(at.inside) if isinstance(x, Node)]
    return out


def _regions(root: Node) -> list[Node]:
    """The main elements, or else those with that role, or else the articles; none inside another."""
    found: dict[str, set[int]] = {"main": set(), "role": set(), "article": set()}
    for node in _walk(root):
        for name, hit in (("main", node.tag == "main"), ("role", node.attrs.get("role") == "main"), ("article", node.tag == "article")):
            if hit:
                found[name].add(id(node))
    return _outermost(root, next((x for x in found.values() if x), set()))


@dataclass
class _Open:
    """An element that is being rendered: what is left of it, and the text that it has given so far."""

    node: Node
    rest: Iterator[Node | str]
    text: list[str]
    verbatim: bool
    lists: tuple[str, ...]
    items: int = 0


def _render(node: Node, base: str, whole_page: bool, plain: bool = False) -> str:
    """An element and its contents, as Markdown or as plain text."""
    stack = [_Open(node, iter(node.inside), [], node.tag == "pre", ())]
    while True:
        top = stack[-1]
        child = next(top.rest, None)
        if isinstance(child, str):
            top.text.append(child if top.verbatim else re.sub(r"\s+", " ", child))
        elif child is not None:
            if not (child.hidden or (whole_page and child.tag in ASIDE)):
                lists = (*top.lists, child.tag) if child.tag in ("ul", "ol") else top.lists
                stack.append(_Open(child, iter(child.inside), [], top.verbatim or child.tag == "pre", lists))
        else:
            stack.pop()
            owner = next((x for x in reversed(stack) if x.node.tag in ("ul", "ol")), None)
            made = _element(top, base, owner, plain)
            if not stack:
                return made
            stack[-1].text.append(made)


def _element(done: _Open, base: str, owner: _Open | None, plain: bool) -> str:
    text, tag = "".join(done.text), done.node.tag
    if tag == "a" and not plain:
        href, label = done.node.attrs.get("href") or "", " ".join(text.split())
        follows = href and not href.startswith(("#", "javascript:", "mailto:"))
        return f"[{label}]({urljoin(base, href)})" if label and follows else text
    if tag == "li":
        mark = "- "
        if owner is not None and owner.node.tag == "ol":
            owner.items += 1
            mark = f"{owner.items}. "
        return "\n" + "  " * max(len(done.lists) - 1, 0) + mark + text
    if tag == "code" and not done.verbatim and not plain:
        return f"`{text}`"
    before, after = (PLAIN if plain else RULES).get(tag, ("", ""))
    return before + text + after


def _tidy(text: str) -> str:
    """Lines without white space at their ends, and at most one empty line between two."""
    kept: list[str] = []
    for line in map(str.rstrip, text.splitlines()):
        if line or (kept and kept[-1]):
            kept.append(line)
    return "\n".join(kept).strip()


def _body(root: Node, base: str, plain: bool = False) -> str:
    """The main regions, or the whole page if they have little text in Markdown."""
    regions = [x for x in _regions(root) if not x.hidden]
    marked = _tidy("".join(_render(x, base, False) for x in regions))
    enough = len(marked) >= MIN_MAIN
    if enough and not plain:
        return marked
    return _tidy("".join(_render(x, base, not enough, plain) for x in (regions if enough else [root])))


def to_markdown(html: str | None, base: str = "") -> tuple[str, str]:
    """(title, markdown) of a page's main region, or of the whole page if that has little text."""
    root = read(html)
    title = " ".join(" ".join("".join(x for x in node.inside if isinstance(x, str)) for node in _walk(root) if node.tag == "title").split())
    return title, _body(root, base)


def to_text(html: str | None) -> str:
    """The same contents as plain text: links by their labels; marks of the page's own text stay."""
    return _body(read(html), "", plain=True)


def markdown(html: Column, url: Column) -> Column:
    """(title, markdown) of a column of pages."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, urls in parts:
            yield pd.DataFrame([to_markdown(h, u or "") for h, u in zip(pages, urls, strict=True)], columns=["title", "markdown"])

    return F.pandas_udf(run, "title string, markdown string")(html, url)


def plain_text(html: Column) -> Column:
    return F.pandas_udf(lambda pages: pages.map(to_text), "string")(html)  # type: ignore[call-overload]


def convert(pages: DataFrame) -> DataFrame:
    """(page_id, title, markdown) of ``pages`` (page_id, url, html)."""
    return pages.select("page_id", markdown(F.col("html"), F.col("url")).alias("x")).select("page_id", "x.title", "x.markdown")
