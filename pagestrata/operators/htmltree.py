"""Lenient HTML tree: a stack parser over the standard tokeniser.

Start tags close what they imply (CLOSED_BY), end tags close up to the nearest open
element of that name, nothing is ever inserted, and the end of input closes the
rest.  Children are Node objects and plain strings; neighbouring text is one string.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base basefont br col command embed frame hr img input isindex keygen link meta param source track wbr".split())
_PARAGRAPH_ENDERS = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul"
_FORM = frozenset("button datalist input optgroup option select textarea".split())
#: Which elements, while they are the innermost open one, a start tag closes.
CLOSED_BY: dict[str, frozenset[str]] = {
    **{t: frozenset({"p"}) for t in _PARAGRAPH_ENDERS.split()},
    **{t: _FORM for t in "button datalist input output select textarea".split()},
    "tr": frozenset({"td", "th", "tr"}),
    "th": frozenset({"th"}),
    "td": frozenset({"td", "th", "thead"}),
    "body": frozenset({"head", "link", "script"}),
    "li": frozenset({"li"}),
    "option": frozenset({"option"}),
    "optgroup": frozenset({"optgroup", "option"}),
    **{t: frozenset({"dd", "dt"}) for t in ("dd", "dt")},
    **{t: frozenset({"rp", "rt"}) for t in ("rp", "rt")},
    **{t: frozenset({"tbody", "thead"}) for t in ("tbody", "tfoot")},
}
#: White space as ECMAScript sees it; Python's and Java's classes differ from it.
WS = "\\t\\n\\x0b\\x0c\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_WIDE = re.compile("[\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")
WS_CHARS = "".join(chr(c) for c in [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])


def collapse(text: str) -> str:
    """White-space runs to one space, none at the ends."""
    # most of a text's white space is single spaces, which this leaves alone
    if not text.isascii():
        text = _WIDE.sub(" ", text)
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip(" ")


def collapse_ends(text: str) -> str:
    return text.strip(WS_CHARS)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "_stripped")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self._stripped: bool | None = None

    def elements(self) -> Iterator[Node]:
        """This element's descendants and itself, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.elements() if test(n)), None)

    def text(self) -> str:
        """All text below, as it stands."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        HTMLParser.__init__(self)
        self.root = Node("#document", {}, None)
        self.open = [self.root]
        self.joins = False  # whether the next text belongs to the one before it

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = CLOSED_BY.get(tag)
        if closes:
            while self.open[-1].tag in closes:
                self.open.pop()
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        node = Node(tag, own, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
        self.joins = False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # a slash closes an element only inside svg and math
        if tag not in VOID and any(n.tag in ("svg", "math") for n in self.open):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        self.joins = False
        if tag in VOID:
            if tag == "br":
                self.open[-1].children.append(Node("br", {}, self.open[-1]))
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
        if tag == "p":
            self.handle_starttag("p", [])
            self.open.pop()

    def handle_data(self, data: str) -> None:
        into = self.open[-1].children
        if self.joins and into and isinstance(into[-1], str):
            into[-1] += data
        else:
            into.append(data)
        self.joins = True

    def handle_comment(self, data: str) -> None:
        self.joins = False

    handle_decl = handle_pi = unknown_decl = handle_comment


def parse(html: str) -> Node:
    """The document's tree, whatever the markup."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root
