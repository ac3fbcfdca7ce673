"""A tolerant HTML parser for whole pages: readable page, interactive elements and cleaned markup.

Runs on small pieces of Arrow batches; a page is one row, and nothing is kept between pieces.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Collection, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame

from ..functions.batches import map_rows
from ..operators.pages import SEARCH_HOSTS

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "head", "title"}
# What is dropped from cleaned markup ("asides" as it stands, so aside elements stay).
NOISE = {"script", "style", "noscript", "asides", "svg", "iframe", "nav", "footer", "button", "form"}
HIDING = re.compile(r"display:\s*none|visibility:\s*hidden", re.I)
SPACE = re.compile(r"[\s﻿]+")
EMAIL = re.compile(r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", re.I)
PHONE = re.compile(r"\+?\d[\d\s()-]{7,}\d")


def norm(s: str | None) -> str:
    return SPACE.sub(" ", s or "").strip()


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [k for k in reversed(node.kids) if isinstance(k, Node)]

    def hidden(self) -> bool:
        """Whether the element says of itself that it isn't shown; what lies in it isn't shown either."""
        return "hidden" in self.attrs or self.tag == "input" and self.attrs.get("type", "").lower() == "hidden" or bool(HIDING.search(self.attrs.get("style", "")))

    def shown(self) -> Iterator[tuple[int, int, Node]]:
        """The shown elements with their numbers in document order; those in an element lie between its number and the second one."""
        stack: list = [(self, 0)]
        found: list[list] = []
        while stack:
            node, entry = stack.pop()
            if node is None:
                found[entry][1] = len(found)
            elif not node.hidden():
                stack.append((None, len(found)))
                found.append([len(found), 0, node])
                stack += [(k, 0) for k in reversed(node.kids) if isinstance(k, Node)]
        yield from map(tuple, found)

    def text(self, most: int | None = None) -> str:
        """The text that would be shown; scripts, styles and hidden elements are left out.

        With ``most``, reading ends once that many characters other than spaces are there.
        """
        out: list[str] = []
        stack: list = [self]
        while stack and (most is None or most > 0):
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
                most = None if most is None else most - sum(map(len, node.split()))
            elif node.tag not in SILENT and not node.hidden():
                if node.tag in ("br", "p", "div", "li", "tr", "article", "section", "h1", "h2", "h3", "td", "th"):
                    out.append(" ")
                stack += reversed(node.kids)
        return "".join(out)


#: Elements that end an open one of these kinds (a list item ends the list item before it), up to the nearest of the limits.
ENDS = {"a": ({"a"}, {"td", "th", "li", "article"}), "li": ({"li"}, {"ul", "ol", "menu"}), "p": ({"p"}, {"div", "article", "section", "main", "body", "td", "th", "li", "blockquote"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select", "datalist"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
#: Block elements end an open paragraph.
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.open: dict[str, int] = {}

    def _end(self, kinds: set[str], limits: set[str]) -> None:
        """Closes the innermost open element of one of the kinds, if none of the limits is nearer."""
        if not any(self.open.get(k) for k in kinds):
            return
        node = self.at
        while node.parent is not None and node.tag not in kinds:
            if node.tag in limits:
                return
            node = node.parent
        if node.parent is not None:
            self._close(node)

    def _close(self, node: Node) -> None:
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[node.tag] -= 1
        self.at = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in BLOCKS:
            self._end(*ENDS["p"])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        if not self.open.get(tag):  # an end tag that nothing opened is ignored
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self._close(node)

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _first(root: Node, test) -> Node | None:
    return next((n for n in root.walk() if test(n)), None)


def _container(root: Node) -> Node:
    """The longest of main, article and the like; the body unless another is longer."""
    tests = (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("role") == "main", lambda n: n.attrs.get("id") == "main", lambda n: "main" in n.attrs.get("class", "").split(), lambda n: n.tag == "body")
    best, most = _first(root, tests[-1]) or root, 0
    for test in tests:
        node = _first(root, test)
        if node is not None and (size := len(norm(node.text()))) > most:
            best, most = node, size
    return best


def _cleaned(nodes: list) -> str:
    """Markup without noise, with few attributes; nesting may be as deep as it likes."""
    out: list[str] = []
    stack = list(reversed(nodes))  # nodes and texts to come, and end tags in a tuple
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            out.append(node[0])
        elif isinstance(node, str):
            out.append(entities.escape(node, False))
        elif node.tag not in NOISE:
            keep = {"a": ("href",), "img": ("src", "alt")}.get(node.tag, ())
            out.append(f"<{node.tag}{''.join(f' {k}="{entities.escape(node.attrs[k])}"' for k in keep if node.attrs.get(k))}>")
            if node.tag not in VOID:
                stack.append((f"</{node.tag}>",))
                stack += reversed(node.kids)
    return "".join(out)


def readable(url: str | None, html: str | None) -> dict:
    """A page as a record: title, text, headings, links, tables, contacts, description and cleaned markup, all of them whole.

    Rows and cells of a table in a table are also those of the outer one.
    """
    root = parse(html)
    box = _container(root)
    text = box.text()
    meta = {n.attrs.get("name") or n.attrs.get("property"): n.attrs.get("content", "") for n in reversed(list(root.walk())) if n.tag == "meta"}
    about = norm(meta.get("description") or meta.get("og:description"))
    cells = {id(n): norm(n.text()) for n in box.walk() if n.tag in ("td", "th")}
    tables = [[[cells[id(c)] for c in r.walk() if id(c) in cells] for r in t.walk() if r.tag == "tr"] for t in box.walk() if t.tag == "table"]
    heads = [norm(n.text()) for n in box.walk() if n.tag in ("h1", "h2", "h3")]
    links = [(norm(n.text()), n.attrs["href"]) for n in box.walk() if n.tag == "a" and n.attrs.get("href")]
    top = _first(root, lambda n: n.tag == "title")
    return {
        "url": url or "", "title": norm("".join(k for k in top.kids if isinstance(k, str))) if top else "", "text": norm(text),
        "headings": [h for h in heads if h], "links": [{"text": a, "href": b} for a, b in links if a], "tables": [t for t in tables if t],
        "emails": list(dict.fromkeys(map(norm, EMAIL.findall(text)))), "phones": list(dict.fromkeys(map(norm, PHONE.findall(text)))),
        "description": about, "cleaned_html": norm(_cleaned(box.kids)),
    }


# What marks a result card, its title and its snippet, in the order in which they are tried; hosts that are left out are in operators/pages.py.
CARDS = ("div.g", "div[data-snc]", "article", ".result", ".b_algo", ".web-result")
CARD_TITLES = ("h3", "h2", "[role=heading]")
SNIPPETS = (".VwiC3b", ".snippet", ".result__snippet", "p", ".b_caption p")
#: Characters a link's text must have where no card is found, characters of a snippet, and results of a page.
LINK_TEXT, SNIPPET, RESULTS = 8, 300, 8


def _matches(node: Node, selector: str) -> bool:
    """Whether a node matches a selector of the kinds above: tag, class, attribute, one ancestor."""
    *above, own = selector.split()
    m = re.fullmatch(r"([a-z0-9]*)(?:\.([\w-]+))?(?:\[([\w-]+)(?:=([\w-]+))?\])?", own)
    tag, cls, attr, value = m.groups()
    if tag and node.tag != tag or cls and cls not in node.attrs.get("class", "").split() or attr and (attr not in node.attrs or value and node.attrs[attr] != value):
        return False
    at = node.parent
    while above and at is not None and not _matches(at, above[-1]):
        at = at.parent
    return not above or at is not None


def _host(address: str) -> str:
    try:
        return re.sub("^www[.]", "", (urlsplit(address).hostname or "").lower())
    except ValueError:
        return ""


def result_cards(url: str | None, html: str | None, preferred: Collection[str] = (), most: int | None = RESULTS) -> list[dict]:
    """The results on a search page: card by card, each address once; where there is none, links with longer texts.

    Results of search engines themselves are left out, a result without a title
    has its host for one. Preferred hosts come first, then longer titles. What
    isn't shown counts neither as a card nor as part of one. The page is walked
    once; a card finds its parts by their numbers, so nested cards cost no more.
    """
    shown, out = list(parse(html).shown()), {}
    parts: dict[str, list[int]] = {"link": [], "title": [], "snippet": []}
    for i, _, n in shown:
        if n.tag == "a" and n.attrs.get("href"):
            parts["link"].append(i)
        if any(_matches(n, t) for t in CARD_TITLES):
            parts["title"].append(i)
        if any(_matches(n, t) for t in SNIPPETS):
            parts["snippet"].append(i)

    def within(kind: str, start: int, end: int) -> Node | None:
        """The first part of the kind in a card."""
        k = bisect_right(parts[kind], start)
        return shown[parts[kind][k]][2] if k < len(parts[kind]) and parts[kind][k] < end else None

    def add(link: Node, title: Node | None, snippet: Node | None) -> None:
        try:
            href = urljoin(url or "", link.attrs["href"].strip())
        except ValueError:
            return
        host = _host(href)
        if re.match("https?:", href, re.I) and host and href not in out and not any(h in host for h in SEARCH_HOSTS):
            name = norm(title.text() if title is not None else "") or norm(link.text()) or norm(link.attrs.get("aria-label"))
            out[href] = {"href": href, "host": host, "title": name or host, "snippet": norm(snippet.text(SNIPPET) if snippet is not None else "")[:SNIPPET]}

    for selector in CARDS:
        for start, end, card in shown:
            if _matches(card, selector) and (link := within("link", start, end)) is not None:
                add(link, within("title", start, end), within("snippet", start, end))
    if not out:
        for i in parts["link"]:
            link = around = shown[i][2]
            if len(norm(link.text()) or norm(link.attrs.get("aria-label"))) >= LINK_TEXT:
                while around is not None and around.tag not in ("article", "div", "li"):
                    around = around.parent
                add(link, None, around)
    return sorted(out.values(), key=lambda r: (r["host"] not in preferred, -len(r["title"])))[:most]


def _places(parent: Node) -> tuple[dict[int, int], Counter]:
    """The place of each element among those of its tag under ``parent``, by identity, and how many each tag has."""
    at, most = {}, Counter()
    for k in parent.kids:
        if isinstance(k, Node):
            most[k.tag] += 1
            at[id(k)] = most[k.tag]
    return at, most


def dom_path(node: Node, places: dict[int, tuple[dict[int, int], Counter]] | None = None) -> str:
    """Up to four steps toward the root, ended early by an id; ``places`` keeps what was counted under each parent for the next call."""
    parts: list[str] = []
    places = {} if places is None else places
    while node is not None and node.tag not in ("#root", "html") and len(parts) < 4:
        if node.attrs.get("id"):
            parts.append(f"{node.tag}#{re.sub(r'[^A-Za-z0-9_-]', '', node.attrs['id'])}")
            break
        if node.parent is None:
            parts.append(node.tag)
            break
        if id(node.parent) not in places:
            places[id(node.parent)] = _places(node.parent)
        at, most = places[id(node.parent)]
        parts.append(node.tag if most[node.tag] == 1 else f"{node.tag}:nth-of-type({at[id(node)]})")
        node = node.parent
    return ">".join(reversed(parts))


def elements(html: str | None) -> list[dict]:
    """All interactive elements of a page that are shown, in document order, without repeats (role, texts, href and path), with their whole texts."""
    out: list[dict] = []
    seen: set[str] = set()
    places: dict[int, tuple[dict[int, int], Counter]] = {}
    for _, _, n in parse(html).shown():
        a = n.attrs
        if not (n.tag in ("button", "input", "textarea", "select") or n.tag == "a" and "href" in a or a.get("role") in ("button", "link", "textbox", "searchbox") or a.get("contenteditable") == "true"):
            continue
        text, hint, aria = norm(n.text()), norm(a.get("placeholder")), norm(a.get("aria-label"))
        role = a.get("role") or {"a": "link", "button": "button", "select": "select"}.get(n.tag) or ("searchbox" if a.get("type", "").lower() == "search" else "textbox")
        path, href = dom_path(n, places), a.get("href", "") if n.tag == "a" else ""
        key = "|".join((role, text, hint, aria, href, path)).lower()
        if key in seen:
            continue
        seen.add(key)
        editable = role in ("textbox", "searchbox", "select") or n.tag in ("input", "textarea", "select") or a.get("contenteditable") == "true"
        out.append({"uid": f"nx-{len(out) + 1}", "role": role, "tag": n.tag, "type": a.get("type", ""), "text": text, "placeholder": hint, "aria_label": aria, "title_attr": norm(a.get("title")), "href": href, "name": norm(a.get("name")), "id": norm(a.get("id")), "dom_path": path, "editable": editable, "disabled": "disabled" in a})
    return out


PAGE = "page_id bigint, url string, title string, text string, headings array<string>, links array<struct<text:string,href:string>>, tables array<array<array<string>>>, emails array<string>, phones array<string>, description string, cleaned_html string"
ELEMENT = "page_id bigint, pos int, uid string, role string, tag string, type string, text string, placeholder string, aria_label string, title_attr string, href string, name string, id string, dom_path string, editable boolean, disabled boolean"


def readable_pages(pages: DataFrame) -> DataFrame:
    """Every page of ``pages`` (page_id, url, html) as a readable record; a null page is an empty record."""

    def made(own: dict[str, list]) -> list[dict]:
        return [{"page_id": i, **readable(u, h)} for i, u, h in zip(own["page_id"], own["url"], own["html"], strict=True)]

    return map_rows(pages.select("page_id", "url", "html"), made, PAGE)


CARD = "page_id bigint, rank int, href string, host string, title string, snippet string"


def search_cards(pages: DataFrame, preferred: Collection[str] = (), most: int | None = RESULTS) -> DataFrame:
    """A row for each result on each page (page_id, url, html), ``rank`` from 1; pages without any have none."""

    def made(own: dict[str, list]) -> list[dict]:
        return [{"page_id": i, "rank": k, **c} for i, u, h in zip(own["page_id"], own["url"], own["html"], strict=True) for k, c in enumerate(result_cards(u, h, preferred, most), 1)]

    return map_rows(pages.select("page_id", "url", "html"), made, CARD)


def page_elements(pages: DataFrame) -> DataFrame:
    """A row for each interactive element of each page; ``pos`` from 1."""

    def made(own: dict[str, list]) -> list[dict]:
        return [{"page_id": i, "pos": k, **e} for i, h in zip(own["page_id"], own["html"], strict=True) for k, e in enumerate(elements(h), 1)]

    return map_rows(pages.select("page_id", "html"), made, ELEMENT)
