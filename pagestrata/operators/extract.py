"""Content of a page tree: what is boilerplate, where the content lies, and its blocks."""

from __future__ import annotations

import re
from typing import NamedTuple

from .htmltree import WS, Node, collapse

_DROPPED_TAGS = frozenset(
    "aside base button canvas dialog embed footer form head iframe input label link meta nav noscript object script select style svg template textarea title".split()
)
_DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
_DROPPED_WORDS = frozenset(
    "ad ads advert banner breadcrumb breadcrumbs comment comments consent cookie cross-sell crumbs edit-tools feedback footer masthead menu nav newsletter pager pagination promo recommended "
    "related search share sidebar sidenav site-footer site-header skip skip-link social subscribe toc".split()
)
_HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
_BLOCKS = _HEADINGS | frozenset("blockquote dl figure hr img ol p pre table ul".split())
_CONTAINERS = frozenset("address article body center details div fieldset header hgroup main section".split())
_NOT_WORD = re.compile("[^a-z0-9-]+")
_LANGUAGE = re.compile(r"(?:language|lang|highlight)-([A-Za-z0-9_+#-]+)")
_TAIL = re.compile(f"[{WS}]+$")


def names_boilerplate(value: str) -> bool:
    """Whether a class, id or label holds a boilerplate word, whole, as a part between hyphens, or as two such parts."""
    for word in _NOT_WORD.split(value.lower()):
        if word in _DROPPED_WORDS:
            return True
        parts = word.split("-")
        if any(p in _DROPPED_WORDS for p in parts) or any(f"{a}-{b}" in _DROPPED_WORDS for a, b in zip(parts, parts[1:])):
            return True
    return False


def stripped(n: Node) -> bool:
    """Whether an element is boilerplate, with all below it."""
    if n._stripped is None:
        n._stripped = _judge(n)
    return n._stripped


def _judge(n: Node) -> bool:
    a = n.attrs
    if n.tag in _DROPPED_TAGS:
        return True
    if n.tag == "header" and (n.parent is None or n.parent.tag in ("#document", "body", "html") or a.get("role") == "banner"):
        return True
    if not a:
        return False
    return a.get("role", "").lower() in _DROPPED_ROLES or a.get("aria-hidden") == "true" or "hidden" in a or any(names_boilerplate(a[k]) for k in ("class", "id", "aria-label") if a.get(k))


def inline(n: Node) -> str:
    """An element's content as one line of prose: code in backticks, line breaks as spaces, images and boilerplate left out."""
    out: list[str] = []

    def code(x: Node) -> None:
        inner = collapse(x.text())
        if inner:
            out.append(f"`{inner}`")

    def visit(x: Node) -> None:
        for c in x.children:
            if isinstance(c, str):
                out.append(c)
            elif not stripped(c):
                if c.tag == "br":
                    out.append(" ")
                elif c.tag == "code":
                    code(c)
                elif c.tag != "img":
                    visit(c)

    if n.tag == "code":
        code(n)
        return "".join(out)
    visit(n)
    return collapse("".join(out))


def visible_text(n: Node) -> str:
    """Every text below that isn't boilerplate, a space after each; the element itself is not judged."""
    out: list[str] = []

    def visit(x: Node) -> None:
        for c in x.children:
            if isinstance(c, str):
                out.append(c + " ")
            elif not stripped(c):
                visit(c)

    visit(n)
    return "".join(out)


def main_content(root: Node) -> Node:
    """main, else the longest article that isn't boilerplate, else what has the role, else the body, else all."""
    body = root.first(lambda n: n.tag == "body") or root
    found = body.first(lambda n: n.tag == "main")
    if found:
        return found
    articles = [n for n in body.elements() if n.tag == "article" and not stripped(n)]
    if articles:
        return articles[0] if len(articles) == 1 else max(articles, key=lambda n: len(collapse(visible_text(n))))
    return body.first(lambda n: n.attrs.get("role") == "main") or body


def rows_of(table: Node) -> list[list[Node]]:
    """Cells of the table's own rows."""
    out: list[list[Node]] = []

    def visit(n: Node) -> None:
        for c in n.children:
            if isinstance(c, Node) and c.tag != "table":
                if c.tag == "tr":
                    out.append([x for x in c.children if isinstance(x, Node) and x.tag in ("th", "td")])
                else:
                    visit(c)

    visit(table)
    return out


def header_row(rows: list[list[Node]]) -> int:
    """The first row of two or more cells that are all header cells, or -1."""
    return next((i for i, r in enumerate(rows) if len(r) >= 2 and all(c.tag == "th" for c in r)), -1)


def is_pair(row: list[Node]) -> bool:
    return [c.tag for c in row] == ["th", "td"]


def table_kind(table: Node, rows: list[list[Node]]) -> str:
    """infobox (key and value rows), data (a header row and two more) or layout."""
    nested = any(n.tag == "table" for n in table.elements() if n is not table)
    if nested or not any(c.tag == "th" for r in rows for c in r) or max(map(len, rows)) < 2:
        return "layout"
    pairs = sum(map(is_pair, rows))
    if pairs >= 4 or pairs / len(rows) >= 0.8:
        return "infobox"
    return "data" if header_row(rows) >= 0 and len(rows) >= 3 else "layout"


class Block(NamedTuple):
    kind: str
    text: str | None = None
    level: int | None = None
    id: str | None = None
    lang: str | None = None
    ref: int | None = None


class Table(NamedTuple):
    kind: str
    dom_id: str | None
    caption: str | None
    heading: str | None
    rows: list[list[Node]]


class Content:
    """Blocks, tables and definition pairs below an element, in document order."""

    def __init__(self, main: Node):
        self.blocks: list[Block] = []
        self.tables: list[Table] = []
        self.pairs: list[tuple[str, str]] = []
        self._last: str | None = None
        self._flow(main.children)

    def _para(self, text: str) -> None:
        t = collapse(text)
        if t:
            self.blocks.append(Block("para", t))

    def _flow(self, nodes: list[Node | str]) -> None:
        loose: list[str] = []
        for c in nodes:
            if isinstance(c, str):
                loose.append(c)
            elif not stripped(c):
                if c.tag in _BLOCKS or c.tag in _CONTAINERS or _holds_block(c):
                    self._para("".join(loose))
                    loose = []
                    if c.tag in _BLOCKS:
                        getattr(self, "_" + ("heading" if c.tag in _HEADINGS else c.tag))(c)
                    else:
                        self._flow(c.children)
                else:
                    loose.append(f" {inline(c)} ")
        self._para("".join(loose))

    def _heading(self, n: Node) -> None:
        # an unclosed heading holds what follows it: the blocks among its children go on as usual
        split = next((i for i, c in enumerate(n.children) if isinstance(c, Node) and (c.tag in _BLOCKS or c.tag in _CONTAINERS)), len(n.children))
        text = collapse("".join(c if isinstance(c, str) else "" if stripped(c) else f" {inline(c)} " for c in n.children[:split]))
        if text:
            self._last = text
            self.blocks.append(Block("heading", text, int(n.tag[1]), n.attrs.get("id")))
        self._flow(n.children[split:])

    def _p(self, n: Node) -> None:
        self._para(inline(n))

    def _hr(self, n: Node) -> None:
        pass

    def _pre(self, n: Node) -> None:
        code = n.first(lambda x: x.tag == "code") or n
        lang = _LANGUAGE.search(f"{code.attrs.get('class', '')} {n.attrs.get('class', '')}")
        self.blocks.append(Block("code", _TAIL.sub("", n.text().lstrip("\n")), lang=lang.group(1) if lang else None))

    def _ul(self, n: Node) -> None:
        lines = _list_lines(n, 0)
        if lines:
            self.blocks.append(Block("list", "\n".join(lines)))

    _ol = _ul

    def _blockquote(self, n: Node) -> None:
        t = inline(n)
        if t:
            self.blocks.append(Block("quote", f"> {t}"))

    def _figure(self, n: Node) -> None:
        img, cap = n.first(lambda x: x.tag == "img"), n.first(lambda x: x.tag == "figcaption")
        line = " — ".join(x for x in (collapse(img.attrs.get("alt", "")) if img else "", inline(cap) if cap else "") if x)
        if line:
            self.blocks.append(Block("figure", f"figure: {line}"))

    def _img(self, n: Node) -> None:
        alt = collapse(n.attrs.get("alt", ""))
        if alt:
            self.blocks.append(Block("figure", f"figure: {alt}"))

    def _table(self, n: Node) -> None:
        rows = rows_of(n)
        kind = table_kind(n, rows) if rows else "layout"
        cap = n.first(lambda x: x.tag == "caption")
        self.tables.append(Table(kind, n.attrs.get("id"), inline(cap) if cap else None, self._last, rows))
        if kind == "layout":
            for r in rows:
                self._para(" ".join(map(inline, r)))
        elif kind == "data":
            self.blocks.append(Block("tableref", ref=len(self.tables) - 1))

    def _dl(self, n: Node) -> None:
        key: str | None = None
        for c in n.children:
            if isinstance(c, Node) and c.tag == "dt":
                key = inline(c)
            elif isinstance(c, Node) and c.tag == "dd" and key is not None:
                self.pairs.append((key, inline(c)))
                key = None



def _holds_block(n: Node) -> bool:
    return any(c.tag in _BLOCKS or c.tag in _CONTAINERS or _holds_block(c) for c in n.children if isinstance(c, Node) and not stripped(c))


def _list_lines(n: Node, depth: int) -> list[str]:
    lines: list[str] = []
    for li in n.children:
        if not isinstance(li, Node) or li.tag != "li" or stripped(li):
            continue
        nested = [c for c in li.children if isinstance(c, Node) and c.tag in ("ul", "ol")]
        own = collapse("".join(c if isinstance(c, str) else "" if c in nested or stripped(c) else f" {inline(c)} " for c in li.children))
        if own:
            lines.append("  " * depth + "- " + own)
        for sub in nested:
            lines += _list_lines(sub, depth + 1)
    return lines
