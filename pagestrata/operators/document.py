"""From a page's HTML to its layered document: metadata, facts, tables and chunks, as one nested row.

This is the one step that runs in Python, once for each page.  What is sequential
within a page (ids, packing, duplicate keys) happens here; rendering, budgets,
warnings, indexes and everything across pages are Spark columns over the row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plain as P
from .extract import Block, Content, header_row, inline, is_pair, main_content, stripped, visible_text
from .htmltree import WS, Node, collapse, collapse_ends, parse

CHUNK_LIMIT = 1200
PACK_LIMIT = 500
SUMMARY_LIMIT = 160
THIN = 200
HEAVY_SCRIPT = 2000

SCHEMA = (
    "page_id long, ok boolean, error string, html_units int, main_text string, script_chars int, thin boolean, fallback boolean, paragraphs int, html_ids array<string>, "
    "title string, summary string, type string, url string, lang string, updated string, series_prev string, series_next string, "
    "facts array<struct<key: string, value: string>>, tables array<struct<id: string, cols: array<string>, rows: array<array<string>>>>, "
    "chunks array<struct<id: string, summary: string, tags: array<string>, anchor: string, text: string>>"
)
_STR = pa.string()
_ARROW = pa.schema(
    [("page_id", pa.int64()), ("ok", pa.bool_()), ("error", _STR), ("html_units", pa.int32()), ("main_text", _STR), ("script_chars", pa.int32()), ("thin", pa.bool_()), ("fallback", pa.bool_()), ("paragraphs", pa.int32()), ("html_ids", pa.list_(_STR))]
    + [(c, _STR) for c in "title summary type url lang updated series_prev series_next".split()]
    + [
        ("facts", pa.list_(pa.struct([("key", _STR), ("value", _STR)]))),
        ("tables", pa.list_(pa.struct([("id", _STR), ("cols", pa.list_(_STR)), ("rows", pa.list_(pa.list_(_STR)))]))),
        ("chunks", pa.list_(pa.struct([("id", _STR), ("summary", _STR), ("tags", pa.list_(_STR)), ("anchor", _STR), ("text", _STR)]))),
    ]
)

# == metadata


class Head:
    """Lookups over the whole page, all from one walk."""

    def __init__(self, root: Node):
        self.ids: dict[str, None] = {}
        self.script_chars = 0
        self.first: dict[str, Node] = {}
        self.meta: dict[str, str] = {}
        self.links: dict[str, str] = {}
        self.json_ld: list[Any] = []
        self.time: str | None = None
        self.h1: Node | None = None
        for n in root.elements():
            a, t = n.attrs, n.tag
            if a.get("id"):
                self.ids[a["id"]] = None
            if t == "a" and a.get("name"):
                self.ids[a["name"]] = None
            elif t == "script":
                text = n.text()
                self.script_chars += len(text) + (500 if a.get("src") else 0)
                if a.get("type", "").lower() == "application/ld+json":
                    self._json(text)
            elif t == "meta":
                for k in (a.get("name"), a.get("property")):
                    if k is not None:
                        self.meta.setdefault(k, collapse_ends(a.get("content", "")))
            elif t == "link":
                for rel in re.split(f"[{WS}]+", a.get("rel", "").lower()):
                    self.links.setdefault(rel, collapse_ends(a.get("href", "")))
            elif t == "time" and self.time is None and "datetime" in a:
                self.time = a["datetime"]
            elif t in ("html", "title"):
                self.first.setdefault(t, n)
            elif t == "h1" and self.h1 is None and not stripped(n):
                self.h1 = n

    def _json(self, text: str) -> None:
        def refuse(x: str) -> None:
            raise ValueError(x)

        try:
            got = json.loads(text, parse_constant=refuse)
        except (ValueError, RecursionError):
            return
        if isinstance(got, list):
            self.json_ld += got
        elif isinstance(got, dict):
            self.json_ld.append(got)

    def get(self, *keys: str) -> str | None:
        """Content of the first of the keys that has any."""
        return next((self.meta[k] for k in keys if self.meta.get(k)), None)


def _parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; what has no scheme is all path."""
    if not url:
        return "", ""
    try:
        u = urlsplit(url)
        host = u.hostname or ""
    except ValueError:
        return "", url
    if not u.scheme:
        return "", url
    return host.lower(), u.path or ("/" if host else "")


_LD_TYPES = {"Product": "product", "BlogPosting": "blog", "Article": "article", "NewsArticle": "article", "TechArticle": "docs"}


def page_type(head: Head, url: str | None, paragraphs: int) -> str:
    """product, blog, article, docs, reference or other: by JSON-LD, then by og:type, then by the URL, then by length."""
    for root in head.json_ld:
        t = root.get("@type") if isinstance(root, dict) else None
        t = t[0] if isinstance(t, list) and t else t
        if isinstance(t, str):
            if t in _LD_TYPES:
                return _LD_TYPES[t]
            break
    host, path = _parts(url)
    og = (head.get("og:type") or "").lower()
    if og == "product":
        return "product"
    if og == "article":
        return "blog" if head.get("author", "article:author") and re.search(r"/20[0-9]{2}(?:/|$)", path) else "article"
    if host.startswith("docs.") or re.search("/(?:docs|documentation|guide)", path):
        return "docs"
    for pattern, kind in (("/(?:reference|api|glossary)/", "reference"), ("/(?:blog|posts)/", "blog"), ("/product", "product")):
        if re.search(pattern, path):
            return kind
    return "article" if paragraphs >= 3 else "other"


# == facts


def _js(x: Any) -> str:
    """A JSON scalar as ECMAScript prints it."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        if x == int(x) and abs(x) < 1e21:
            return str(int(x))
        return re.sub(r"e([+-])0+", r"e\1", repr(x))
    return str(x)


def _keys(d: dict[str, Any]) -> list[str]:
    """Keys in ECMAScript's order: array indexes ascending, then the rest as written."""
    index = [k for k in d if re.fullmatch("0|[1-9][0-9]{0,9}", k) and int(k) < 2**32 - 1]
    return sorted(index, key=int) + [k for k in d if k not in index]


def _short(value: str) -> str:
    return re.sub(r"^https?://(?:www\.)?schema\.org/(?=.)", "", value)


def flatten(node: Any, prefix: str = "", depth: int = 0) -> Iterator[tuple[str, str]]:
    """Dotted keys and values of a JSON-LD tree, at most four levels down."""
    if depth > 4 or node is None:
        return
    if isinstance(node, dict):
        for k in _keys(node):
            v = node[k]
            if k.startswith("@"):
                if k == "@type" and isinstance(v, str) and prefix:
                    yield f"{prefix}.type", v
            else:
                yield from flatten(v, f"{prefix}.{k}" if prefix else k, depth + 1)
    elif isinstance(node, list):
        if all(isinstance(v, (str, int, float)) and not isinstance(v, bool) for v in node):
            yield prefix, ", ".join(_short(_js(v)) for v in node)
        elif len(node) <= 3:
            for i, v in enumerate(node, 1):
                yield from flatten(v, f"{prefix}.{i}", depth + 1)
    else:
        yield prefix, _short(_js(node))


def facts(head: Head, content: Content) -> list[dict[str, str]]:
    """Key and value pairs from JSON-LD, meta tags, definition lists and infoboxes, in this order; a repeated key gets a number unless it repeats the key's first value."""
    raw = [kv for root in head.json_ld for kv in flatten(root)]
    published, modified = P.iso_date(head.get("article:published_time")), P.iso_date(head.get("article:modified_time"))
    raw += [(k, v) for k, v in (("author", head.get("author")), ("published", published), ("modified", modified)) if v]
    raw += [(k, v) for k, v in content.pairs if k and v]
    for t in content.tables:
        if t.kind == "infobox":
            raw += [(k, v) for k, v in ((inline(r[0]), inline(r[1])) for r in t.rows if is_pair(r)) if k and v]
    out: list[dict[str, str]] = []
    count: dict[str, int] = {}
    first: dict[str, str] = {}
    for k, v in raw:
        k = collapse(k).lower().replace(":", "-")
        k = collapse_ends(k[:64]) if len(k) > 64 else k
        v = P.truncate_at_word(collapse(v).replace("\\", "\\\\"), 200)
        if not k or not v:
            continue
        if k not in count:
            count[k] = 1
            first.setdefault(k, v)
            out.append({"key": k, "value": v})
        elif first[k] != v:
            count[k] += 1
            numbered = f"{k}-{count[k]}"
            first.setdefault(numbered, v)
            out.append({"key": numbered, "value": v})
    return out


def tables(content: Content) -> tuple[list[dict[str, Any]], dict[int, str]]:
    """Data tables of two rows or more as wide as their header, and their ids by place."""
    out, ids, slugs, unnamed = [], {}, P.Slugs(), 0
    for i, t in enumerate(content.tables):
        if t.kind != "data":
            continue
        at = header_row(t.rows)
        cols = [P.slugify(inline(c)) for c in t.rows[at]]
        rows = [[inline(c) for c in r] for j, r in enumerate(t.rows) if j != at and len(r) == len(cols)]
        if len(rows) < 2:
            continue
        name = next((x for x in (t.dom_id, t.caption, t.heading) if x is not None), None)
        if name is None:
            unnamed += 1
            name = f"table-{unnamed}"
        ids[i] = slugs.claim(P.slugify(name))
        out.append({"id": ids[i], "cols": cols, "rows": rows})
    return out, ids


# == chunks


def render(blocks: list[Block], boundary: int, ids: dict[int, str]) -> str:
    parts = []
    for b in blocks:
        if b.kind == "heading":
            parts.append("#" * min(b.level + 3 - boundary, 6) + " " + b.text)
        elif b.kind == "code":
            parts.append(f"```{b.lang or ''}\n{b.text}\n```")
        elif b.kind == "tableref":
            if b.ref in ids:
                parts.append(f"table: {ids[b.ref]}")
        else:
            parts.append(b.text)
    return "\n\n".join(parts)


def summarize(blocks: list[Block], ids: dict[int, str]) -> str:
    """The first opening sentence of 50 characters, else the first at all, else of a list, a figure, code or a table."""
    openings = [P.first_sentence(b.text.removeprefix("> ")) for b in blocks if b.kind in ("para", "quote")]
    if openings:
        return P.truncate_at_word(next((s for s in openings if len(s) >= 50), openings[0]), SUMMARY_LIMIT)
    for b in blocks:
        if b.kind == "list":
            return P.truncate_at_word(P.first_sentence(re.sub(f"^[{WS}]*- ", "", b.text.split("\n")[0])), SUMMARY_LIMIT)
    for b in blocks:
        if b.kind == "figure":
            return P.truncate_at_word(b.text.removeprefix("figure: "), SUMMARY_LIMIT)
        if b.kind == "code":
            return P.truncate_at_word(b.text.split("\n")[0], SUMMARY_LIMIT)
        if b.kind == "tableref" and b.ref in ids:
            return f"See table: {ids[b.ref]}"
    return ""


_NAME = regex.compile(r"\p{Lu}[\p{N}\p{L}'’-]*(?:[" + WS + r"]+\p{Lu}[\p{N}\p{L}'’-]*)+")
_ARTICLE = re.compile(f"^(?:The|An|A)[{WS}]+")
_SPACE = re.compile(f"[{WS}]")


def tags(text: str, heading: str | None) -> list[str]:
    """Slugs of up to four capitalised phrases, the most frequent first, then by first place."""
    count: dict[str, int] = {}
    for m in _NAME.finditer(text):
        phrase = _ARTICLE.sub("", m.group())
        if _SPACE.search(phrase) and phrase != heading and len(phrase) <= 48:
            count[phrase] = count.get(phrase, 0) + 1
    ranked = sorted(count, key=lambda p: -count[p])  # stable: first place decides among equals
    return list(dict.fromkeys(map(P.slugify, ranked)))[:4]


def chunks(all_blocks: list[Block], html_ids: dict[str, None], ids: dict[int, str]) -> tuple[list[dict[str, Any]], bool]:
    """The page's chunks at its boundary headings (h2, else h3, else h4), and whether for want of them paragraphs were packed."""
    blocks = list(all_blocks)
    h1 = next((i for i, b in enumerate(blocks) if b.kind == "heading" and b.level == 1), None)
    title_id = blocks.pop(h1).id if h1 is not None else None
    levels = {b.level for b in blocks if b.kind == "heading"}
    boundary = next((x for x in (2, 3, 4) if x in levels), None)
    if boundary is None:
        return packed(blocks, ids), bool(blocks)

    def split(heading: str | None, hid: str | None, body: list[Block], level: int) -> list[tuple[str | None, str | None, list[Block]]]:
        out, cur = [], (heading, hid, [])
        for b in body:
            if b.kind == "heading" and b.level == level:
                out.append(cur)
                cur = (b.text, b.id, [])
            else:
                cur[2].append(b)
        return [*out, cur]

    parts = []
    for heading, hid, body in split(None, title_id, blocks, boundary):
        large = P.units(render(body, boundary, ids)) > CHUNK_LIMIT
        parts += split(heading, hid, body, boundary + 1) if large else [(heading, hid, body)]
    slugs, out = P.Slugs(), []
    for i, (heading, hid, body) in enumerate(parts):
        if not body and heading is None:
            continue
        intro = i == 0 and heading is None
        anchor = title_id if intro else hid
        text = render(body, boundary, ids)
        out.append(
            {
                "id": "intro" if intro else slugs.claim(hid if P.valid_id(hid) else P.slugify("section" if heading is None else heading)),
                "summary": summarize(body, ids) or heading or "",
                "tags": tags(text, heading),
                "anchor": f"#{anchor}" if anchor and anchor in html_ids else None,
                "text": text,
            }
        )
    return out, False


def packed(blocks: list[Block], ids: dict[int, str]) -> list[dict[str, Any]]:
    """Blocks in order, packed greedily up to the limit."""
    groups: list[list[Block]] = []
    size = 0
    for b in blocks:
        n = P.units(render([b], 2, ids))
        if not groups or (size > 0 and size + n > PACK_LIMIT):
            groups.append([])
            size = 0
        groups[-1].append(b)
        size += n
    out = []
    for i, g in enumerate(groups, 1):
        text = render(g, 2, ids)
        out.append({"id": f"part-{i}", "summary": summarize(g, ids), "tags": tags(text, None), "anchor": None, "text": text})
    return out


# == pages


def build(html: str, url: str | None = None) -> dict[str, Any]:
    """The nested row of one page; ``ok`` is false and ``error`` set where there is no document."""
    row: dict[str, Any] = {"ok": False, "error": None, "html_units": P.units(html)}
    try:
        root = parse(html)
        head, main = Head(root), main_content(root)
        content = Content(main)
        main_text = P.normalize(visible_text(main))
    except (RecursionError, AssertionError, ValueError):
        return row | {"error": "PARSE_FAILURE"}
    thin = len(main_text) < THIN
    row |= {"main_text": main_text, "script_chars": head.script_chars, "thin": thin, "html_ids": list(head.ids), "paragraphs": sum(b.kind == "para" for b in content.blocks)}
    if thin and head.script_chars > HEAVY_SCRIPT:
        return row | {"error": "EMPTY_EXTRACTION"}
    page_url = head.links.get("canonical") or head.get("og:url") or url
    title = head.get("og:title")
    if title is None:
        title = collapse(head.first["title"].text()) if "title" in head.first else collapse(inline(head.h1)) if head.h1 else "Untitled"
    title = collapse(title)
    data_tables, ids = tables(content)
    parts, fallback = chunks(content.blocks, head.ids, ids)
    said = head.get("description", "og:description")
    lead = parts[0]["summary"] if parts else ""
    summary = P.truncate_at_word(collapse(said), 200) if said else P.truncate_at_word(P.first_sentence(lead), 200) if lead else title
    html_tag = head.first.get("html")
    return row | {
        "ok": True,
        "fallback": fallback,
        "title": title,
        "summary": summary,
        "type": page_type(head, page_url, row["paragraphs"]),
        "url": page_url,
        "lang": (collapse_ends(html_tag.attrs.get("lang", "")) or None) if html_tag else None,
        "updated": P.iso_date(head.get("article:modified_time")) or P.iso_date(head.get("article:published_time")) or P.iso_date(head.time),
        "series_prev": head.links.get("prev") or None,
        "series_next": head.links.get("next") or None,
        "facts": facts(head, content),
        "tables": data_tables,
        "chunks": parts,
    }


def documents(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", with_html: bool = False) -> DataFrame:
    """One nested row (SCHEMA, and html as it was if asked for) for each page; failures stay as rows.  A null page counts as an empty one."""
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    small = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"), url.alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [build(h or "", u) | {"page_id": i} for i, h, u in zip(*(c.to_pylist() for c in part.columns))]
                out = pa.RecordBatch.from_pylist(rows, _ARROW)
                yield out.append_column("html", part.column(1)) if with_html else out

    return small.mapInArrow(run, SCHEMA + ", html string" * with_html)
