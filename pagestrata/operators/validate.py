"""Documents read back and checked against their pages.

parse_document() reads the Markdown rendering by its line grammar; findings() holds
it against the page: structure, version, table of contents, freshness, anchors,
header budget, facts, and whether each sentence is grounded in the page.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plain as P
from .extract import main_content, visible_text
from .htmltree import Node, collapse_ends, parse
from .render import CAP, FORMAT, TARGET

META = frozenset("hash lang series-next series-prev type updated url".split())
FINDINGS = "page_id long, ord int, level string, code string, message string"
_ENTRY = re.compile(r"- (?P<id>[^:\s]+)(?:: (?P<said>.*))?")
_GROUP = re.compile(r"- toc-[0-9]+: .+ \([0-9]+ chunks\)")
_UNSEEN = frozenset("head iframe noscript script style svg template title".split())


def split_cells(line: str) -> list[str]:
    """Cells of a table row: split at bars that aren't escaped, trimmed, unescaped."""
    cells, at = [[]], 0
    while at < len(line):
        step = 2 if line[at] == "\\" and at + 1 < len(line) else 1
        if line[at] == "|":
            cells.append([])
        else:
            cells[-1].append(line[at : at + step])
        at += step
    plain = {"\\\\": "\\", "\\|": "|", "\\n": "\n"}
    return [re.sub(r"\\[\\|n]", lambda m: plain[m.group()], collapse_ends("".join(c))) for c in cells]


def parse_document(md: str, format_name: str = FORMAT) -> dict[str, Any]:
    """The parts of a Markdown rendering, with what is wrong with it as (line, message)."""
    lines = md.split("\n")
    errors: list[tuple[int, str]] = []
    doc: dict[str, Any] = {"version": None, "title": None, "summary": None, "meta": {}, "toc": [], "grouped": False, "kv": [], "tables": [], "chunks": [], "header": "", "errors": errors}
    mark = re.fullmatch(rf"<!-- {re.escape(format_name)} ([0-9]+)\.([0-9]+) -->", lines[0])
    if mark:
        doc["version"] = (int(mark.group(1)), int(mark.group(2)))
    else:
        errors.append((1, "the first line is no version marker"))
    starts = [i for i, x in enumerate(lines) if x.startswith("## ")]
    if not starts:
        errors.append((1, "there are no sections"))
        return doc
    _head(doc, lines, starts[0])
    seen = set()
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        name, body = collapse_ends(lines[a][3:]), lines[a + 1 : b]
        if name == "toc":
            seen.add(name)
            doc["header"] = "\n".join(lines[:b]).rstrip("\n")
            for x in filter(None, body):
                entry = _ENTRY.fullmatch(x)
                if _GROUP.fullmatch(x):
                    doc["grouped"] = True
                elif entry:
                    doc["toc"].append(entry.groups())
                else:
                    errors.append((a + 1, f"no table-of-contents entry: {x[:60]}"))
        elif re.fullmatch("toc [0-9]+", name):
            doc["toc"] += [m.groups() for m in map(_ENTRY.fullmatch, body) if m]
        elif name == "facts":
            seen.add(name)
            _facts(doc, body, a + 2)
        elif name.startswith("chunk "):
            _chunk(doc, collapse_ends(name[6:]), body, a + 1)
        else:
            errors.append((a + 1, f"section of no known kind: {name}"))
    errors += [(1, f"there is no section {s}") for s in ("toc", "facts") if s not in seen]
    return doc


def _head(doc: dict[str, Any], lines: list[str], end: int) -> None:
    errors, meta = doc["errors"], doc["meta"]
    for i, x in enumerate(lines[1:end], 2):
        pair = re.fullmatch("([-a-z]+): (.+)", x)
        if not x:
            continue
        if x.startswith("# ") and doc["title"] is None:
            doc["title"] = x[2:]
        elif x.startswith("> ") and doc["summary"] is None:
            doc["summary"] = x[2:]
        elif pair and pair.group(1) in META:
            if pair.group(1) in meta:
                errors.append((i, f"metadata given twice: {pair.group(1)}"))
            meta[pair.group(1)] = pair.group(2)
        else:
            errors.append((i, f"not a line of a header: {x[:60]}"))
    errors += [(1, f"there is no {k}") for k in ("title", "summary") if doc[k] is None]
    errors += [(1, f"there is no metadata {k}") for k in ("type", "hash") if k not in meta]
    if "hash" in meta and not re.fullmatch("sha256:[a-f0-9]{16}", meta["hash"]):
        errors.append((1, "the hash is not sha256 and 16 hexadecimal digits"))


def _facts(doc: dict[str, Any], body: list[str], first: int) -> None:
    errors, table = doc["errors"], None
    for no, x in enumerate(body, first):
        if not x:
            continue
        if x.startswith("@table "):
            if table:
                errors.append((no, "a table begins inside another"))
            table = {"id": collapse_ends(x[7:]), "cols": [], "rows": [], "bad": [], "line": no}
        elif x == "@end":
            if table is None:
                errors.append((no, "a table ends that didn't begin"))
                continue
            errors += [(table["line"], f"table {table['id']} has too few {k}") for k in ("cols", "rows") if len(table[k]) < 2]
            doc["tables"].append(table)
            table = None
        elif table is not None and x.startswith("cols: "):
            table["cols"] = split_cells(x[6:])
        elif table is not None:
            cells = split_cells(x)
            if len(table["cols"]) >= 2 and len(cells) != len(table["cols"]):
                table["bad"].append(no)
            table["rows"].append(cells)
        else:
            pair = re.fullmatch("- ([^:]+): (.*)", x)
            if pair:
                doc["kv"].append((*pair.groups(), no))
            else:
                errors.append((no, f"not a line of facts: {x[:60]}"))
    if table is not None:
        errors.append((table["line"], "a table doesn't end"))


def _chunk(doc: dict[str, Any], cid: str, body: list[str], line: int) -> None:
    c: dict[str, Any] = {"id": cid, "summary": None, "tags": [], "anchor": None, "declared": False}
    for n, x in enumerate([*body, ""]):
        key, _, value = x.partition(": ")
        if not x.startswith(("summary: ", "tags: ", "anchor: ")):
            break
        if key == "tags":
            c["tags"] = value.split(", ")
        elif key == "summary":
            c["summary"] = value
        else:
            c["declared"], c["anchor"] = True, None if value == "none" else value
    if c["summary"] is None:
        doc["errors"].append((line, f"chunk {cid} has no summary"))
    if not c["declared"]:
        doc["errors"].append((line, f"chunk {cid} declares no anchor"))
    c["text"] = "\n".join(body[n:]).strip("\n")
    doc["chunks"].append(c)


# == grounding

_BEFORE, _AFTER = re.compile(r" ([)\].,;:!?])"), re.compile(r"([(\[]) ")
_PREFIXES = re.compile("(?:figure: )?(?:> )?(?:#+ )?(?:- )?")


def canonical(text: str) -> str:
    s = P.normalize(text.replace("`", ""))  # its white space is single spaces
    return _AFTER.sub(r"\1", _BEFORE.sub(r"\1", s)).lower()


def page_texts(root: Node) -> tuple[str, str]:
    """What a reader sees of a page, boilerplate included, and what its metadata says."""
    seen: list[str] = []
    said: list[str] = []

    def visit(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                seen.append(c + " ")
            elif c.tag not in _UNSEEN and c.attrs.get("aria-hidden") != "true" and "hidden" not in c.attrs:
                visit(c)

    visit(root)
    for n in root.elements():
        said += [n.attrs[k] for k in "alt content datetime title value".split() if n.attrs.get(k)]
        if n.tag == "script" and "ld+json" in n.attrs.get("type", ""):
            said.append(re.sub(r'["{}\[\]]', " ", n.text()))
        elif n.tag in ("title", "caption"):
            said.append(n.text())
    return "".join(seen), " ".join(said)


def runs(words: list[str], n: int = 4) -> set[str]:
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def _windows(words: list[str]) -> set[tuple[str, ...]]:
    """As runs() of four, each as a tuple."""
    return set(zip(words, words[1:], words[2:], words[3:]))


def statements(doc: dict[str, Any]) -> Iterator[tuple[str, str, bool]]:
    """Every sentence of a document, where it stands, and whether metadata may ground it; in the order of checking."""
    if doc["title"]:
        yield doc["title"], "title", True
    for s in P.sentences(doc["summary"] or ""):
        yield s, "summary", True
    for c in doc["chunks"]:
        where = f"chunk {c['id']}"
        for s in P.sentences(c["summary"] or ""):
            yield s, f"{where} summary", False
        code: list[str] | None = None
        for x in c["text"].split("\n"):
            if x.startswith("```"):
                if code is not None:
                    yield " ".join(code), f"{where} code", False
                code = [] if code is None else None
            elif code is not None:
                code.append(x)
            elif x.startswith("figure: "):
                for part in x[8:].split(" — "):
                    yield part, f"{where} figure", True
            elif x and not x.startswith("table: "):
                for s in P.sentences(x):
                    yield s, where, False
    for k, v, _ in doc["kv"]:
        yield v, f"fact {k}", True
    for t in doc["tables"]:
        for row in t["rows"]:
            for cell in row:
                yield cell, f"table {t['id']}", True


def findings(html: str, md: str, format_name: str = FORMAT, shortest: int = 15) -> list[tuple[str, str, str]]:
    """(level, code, message) of all that a document's check finds, in a fixed order."""
    out: list[tuple[str, str, str]] = []
    doc = parse_document(md, format_name)
    error, warning = (lambda c, m: out.append(("error", c, m))), (lambda c, m: out.append(("warning", c, m)))
    for line, message in doc["errors"]:
        error("STRUCTURE", f"line {line}: {message}")
    if doc["version"] and doc["version"][0] != 0:
        error("VERSION_UNSUPPORTED", f"major version {doc['version'][0]}")
    root = parse(html)
    main_text = visible_text(main_content(root))
    ids = {n.attrs["id"] for n in root.elements() if n.attrs.get("id")} | {n.attrs["name"] for n in root.elements() if n.tag == "a" and n.attrs.get("name")}
    listed, present = [t[0] for t in doc["toc"]], [c["id"] for c in doc["chunks"]]
    if listed != present:
        error("TOC_CHUNK_MISMATCH", f"listed: {', '.join(listed)}; present: {', '.join(present)}")
    fresh = "sha256:" + hashlib.sha256(P.normalize(main_text).encode("utf-8", "surrogatepass")).hexdigest()[:16]
    if doc["meta"].get("hash") and doc["meta"]["hash"] != fresh:
        error("HASH_STALE", f"{doc['meta']['hash']} is of another text than the page's, {fresh}")
    for c in doc["chunks"]:
        if c["anchor"] is None:
            if c["declared"]:
                warning("ANCHOR_NONE", f"chunk {c['id']}")
        elif c["anchor"].removeprefix("#") not in ids:
            error("ANCHOR_BROKEN", f"chunk {c['id']}: the page has no {c['anchor']}")
    size = P.units(doc["header"])
    if size > CAP:
        error("HEADER_OVER_CAP", f"{size} units of {CAP}")
    elif size > TARGET:
        warning("HEADER_OVER_TARGET", f"{size} units of {TARGET}")
    for t in doc["tables"]:
        for no in t["bad"]:
            error("FACTS_MALFORMED", f"line {no}: table {t['id']} has {len(t['cols'])} columns")
    for k, _, no in doc["kv"]:
        if not k.strip() or len(k) > 64:
            error("FACTS_MALFORMED", f"line {no}: key {k[:30]}")
    seen, said = map(canonical, page_texts(root))
    main, page_runs = canonical(main_text), None
    for raw, where, from_meta in statements(doc):
        if raw.startswith("See table: "):
            continue
        s = collapse_ends(canonical(raw[_PREFIXES.match(raw).end() :]).removesuffix("…"))
        if len(s) < shortest:
            continue
        if s in seen:
            if s not in main:
                warning("NAV_LEAK", f'{where}: only in boilerplate: "{raw[:60]}"')
        elif not (from_meta and s in said):
            own = _windows(s.split(" "))
            if page_runs is None:
                page_runs = _windows(seen.split(" "))
            if own and len(own & page_runs) / len(own) >= 0.6:
                warning("DIVERGENT_FUZZY", f'{where}: only roughly in the page: "{raw[:60]}"')
            else:
                error("DIVERGENT_CONTENT", f'{where}: not in the page: "{raw[:80]}"')
    return out


def validate(pages: DataFrame, documents: DataFrame, id_col: str = "page_id", html_col: str = "html", md_col: str = "md", format_name: str = FORMAT) -> DataFrame:
    """(page_id, ord, level, code, message): the findings of each page that has a document; null texts count as empty."""
    pairs = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).join(documents.select(F.col(id_col).cast("long").alias("page_id"), F.col(md_col).alias("md")), "page_id")
    return findings_of(pairs, format_name)


def findings_of(pairs: DataFrame, format_name: str = FORMAT) -> DataFrame:
    """The findings of rows (page_id, html, md)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for i, h, m in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    try:
                        got = findings(h or "", m or "", format_name)
                    except RecursionError:
                        got = [("error", "STRUCTURE", "line 1: the page is nested too deeply")]
                    rows += [(i, n, *f) for n, f in enumerate(got)]
                cols = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["page_id", "ord", "level", "code", "message"])

    return pairs.select("page_id", "html", "md").mapInArrow(run, FINDINGS)


def verdicts(found: DataFrame, checked: DataFrame, id_col: str = "page_id", strict: bool = False) -> DataFrame:
    """(page_id, errors, warnings, passed) of every page checked; warnings fail it only if strict."""
    n = found.groupBy("page_id").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    out = checked.select(F.col(id_col).cast("long").alias("page_id")).join(n, "page_id", "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("passed", (F.col("errors") == 0) & ((F.col("warnings") == 0) if strict else F.lit(True)))


def broken_anchors(anchors: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of anchors (page_id, chunk_id, anchor) without a row of ids (page_id, html_id) to match: a left anti join."""
    wanted = anchors.where("anchor is not null").withColumn("html_id", F.regexp_replace("anchor", "^#", ""))
    return wanted.join(ids.select("page_id", "html_id"), ["page_id", "html_id"], "left_anti").select("page_id", "chunk_id", "anchor")
