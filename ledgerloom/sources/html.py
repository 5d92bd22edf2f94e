"""HTML documents as tables, texts, links and blocks, in one pass of an event parser for each document.

Only parsing is Python; what comes out are plain columns. Missing end tags of rows and cells are supplied.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import spread

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED_TEXT = frozenset(("script", "style"))
#: Parts of a page around its content, and class names of content, menus and people.
AROUND = frozenset("script style noscript nav footer header iframe".split())
CONTENT_CLASS = re.compile("content|entry|page")
MENU_CLASS = re.compile("menu|nav", re.I)
PEOPLE_CLASS = re.compile("team|member|leader|executive|staff|person|profile", re.I)
#: One line that holds a name of two or three words, a dash, comma or bar, and a title.
NAMED = re.compile(r"(?P<name>[A-Z][a-z]+(?: [A-Z][a-z-]+){1,2})\s*(?:[,|]|[–—])\s*(?P<title>\S.*)")
IMPLIED_END = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "li": ("li",), "p": ("p",), "option": ("option",)}


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.tag in tags]

    def strings(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in SKIPPED_TEXT:
                stack += reversed(n.kids)

    def text(self, sep: str = "", strip: bool = True) -> str:
        parts = (s.strip() if strip else s for s in self.strings())
        return sep.join(p for p in parts if p or not strip)

    @property
    def css(self) -> str:
        return self.attrs.get("class") or ""


class TreeParser(HTMLParser):
    """A tolerant tree: end tags without a start are dropped, open tags end with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = IMPLIED_END.get(tag, ())
        n = self.at
        while ends and n.parent is not None and n.tag not in ("table", "ul", "ol", "div"):
            if n.tag in ends:
                self.at = n.parent
            n = n.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.kids.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            if n.tag == "table" and tag in ("tr", "td", "th"):
                return
            n = n.parent

    def handle_data(self, data: str) -> None:
        if self.at.kids and isinstance(self.at.kids[-1], str):
            self.at.kids[-1] += data
        else:
            self.at.kids.append(data)


def tree(html: str | None) -> Node:
    parser = TreeParser()
    parser.feed(html or "")
    parser.close()
    return parser.root


def table_rows(html: str | None) -> list[tuple[int, int, list[str], str]]:
    """(table, row, cell texts, row text) in document order; nested tables count, and their rows belong to the outer ones, too."""
    out = []
    for t, table in enumerate(tree(html).find("table")):
        for r, row in enumerate(table.find("tr")):
            out.append((t, r, [c.text() for c in row.find("td", "th")], row.text()))
    return out


def document_text(html: str | None, sep: str, drop_tables: list[int] | None = None) -> str:
    """All text of a document, its strings joined by sep; no-break spaces are spaces, dropped tables leave nothing."""
    root = tree(html)
    if drop_tables:
        tables = root.find("table")
        for i in drop_tables:
            if i < len(tables) and tables[i].parent is not None and tables[i] in tables[i].parent.kids:
                tables[i].parent.kids.remove(tables[i])
    return root.text(sep, strip=False).replace("\xa0", " ")


def page_text(html: str | None) -> str:
    """The content of a page: its main part without menus, headers and footers, one line for each string (TXT-08)."""
    root = tree(html)
    for n in list(root.walk()):
        if n.tag in AROUND and n.parent is not None:
            n.parent.kids = [k for k in n.parent.kids if k is not n]
    wanted = root.find("main") or root.find("article") or [n for n in root.find("div") if CONTENT_CLASS.search(n.css)] or root.find("body")
    lines = wanted[0].text("\n", strip=False).splitlines() if wanted else []
    return "\n".join(x.strip() for x in lines if x.strip())


def links(html: str | None) -> list[tuple[int, str, str]]:
    """(ordinal, text, address) of the links in menus (TXT-09)."""
    root = tree(html)
    areas = root.find("nav") or [n for n in root.walk() if MENU_CLASS.search(n.css)]
    found = [(a.text(), a.attrs["href"]) for area in areas for a in area.find("a") if a.attrs.get("href") is not None]
    return [(i, t, h) for i, (t, h) in enumerate(found)]


def headings(html: str | None, tags: tuple[str, ...] = ("h2", "h3")) -> list[tuple[int, str]]:
    """(ordinal, text) of the headings (TXT-11)."""
    return list(enumerate(n.text() for n in tree(html).find(*tags)))


def _card(block: Node) -> tuple[str, str, str] | None:
    """(name, title, bio) of a block about one person: its first heading and what stands in the three elements behind it."""
    heads = block.find("h2", "h3", "h4", "strong")
    name = heads[0].text() if heads else ""
    if not 3 <= len(name) <= 60:
        return None
    beside = [k for k in heads[0].parent.kids if isinstance(k, Node)]
    said = [t for k in beside[beside.index(heads[0]) + 1 :][:3] if (t := k.text())]
    short = [t for t in said if len(t) < 80][:1]
    long = [t for t in said if t not in short and len(t) > 20][:1]
    return name, *(short or [""]), (long or [""])[0][:500]


def people(html: str | None) -> list[tuple[int, str, str, str]]:
    """(ordinal, name, title, bio) of the people that a page shows (TXT-10), before titles are filtered.

    Blocks whose class speaks of people come first; a page without one is searched for lines of a name and a title.
    """
    root = tree(html)
    found = [card for n in root.walk() if PEOPLE_CLASS.search(n.css) and (card := _card(n))]
    if not found:
        lines = (NAMED.fullmatch(n.text()) for n in root.find("h2", "h3", "h4", "p", "div", "span"))
        found = [(m["name"], m["title"], "") for m in lines if m and len(m["title"]) < 80]
    return [(i, *x) for i, x in enumerate(found)]


def _each(docs: DataFrame, keys: list[str], html: str, fields: str, rows: Callable[[str | None], list[tuple]]) -> DataFrame:
    """A row of keys and fields for each tuple that rows gives for a document."""
    names = [f.split(" ")[0] for f in re.split(r",\s*(?![^<]*>)", fields)]
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(*own, *x) for *own, text in batch.itertuples(index=False) for x in rows(text if isinstance(text, str) else None)]
            yield pd.DataFrame(found, columns=[*keys, *names])

    return spread(docs.select(*keys, F.col(html).alias("__html"))).mapInPandas(run, f"{kinds}, {fields}")


def scan_tables(docs: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, table_idx, row_idx, cells, row_text) of every table row of each document (SRC-05, SRC-06)."""
    return _each(docs, keys, html, "table_idx int, row_idx int, cells array<string>, row_text string", table_rows)


def scan_text(docs: DataFrame, keys: list[str], html: str = "html", sep: str = "\n", drop: str | None = None) -> DataFrame:
    """(keys, text) of each document (SRC-07, SRC-08). drop names an ARRAY<INT> column of tables to leave out (JN-02)."""
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [document_text(h if isinstance(h, str) else None, sep, list(d) if d is not None else None) for h, d in zip(batch["__html"], batch["__drop"])]
            yield batch[keys].assign(text=texts)

    left_out = F.col(drop) if drop else F.lit(None).cast("array<int>")
    return spread(docs.select(*keys, F.col(html).alias("__html"), left_out.alias("__drop"))).mapInPandas(run, f"{kinds}, text string")


def scan_page_text(docs: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    return _each(docs, keys, html, "clean_text string", lambda h: [(page_text(h),)])


def scan_links(docs: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    return _each(docs, keys, html, "ord int, link_text string, href string", links)


def scan_headings(docs: DataFrame, keys: list[str], html: str = "html", tags: tuple[str, ...] = ("h2", "h3")) -> DataFrame:
    return _each(docs, keys, html, "ord int, heading string", lambda h: headings(h, tags))


def scan_people(docs: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    return _each(docs, keys, html, "ord int, name string, title string, bio string", people)


def scan_titles(docs: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, title): the <title> of each document (TXT-12)."""
    return _each(docs, keys, html, "title string", lambda h: [(next((n.text() for n in tree(h).find("title")), None),)])
