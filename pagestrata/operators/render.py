"""Renderings of documents: header, Markdown, JSON, split files and the token report.

All are columns over the nested rows of operators.document, so that what isn't
asked for costs nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FORMAT = "pagestrata"
VERSION = "0.1"
TARGET, CAP = 100, 150
GROUP, GROUPED_ABOVE = 50, 100
ESTIMATE = "approximate (quarter of the UTF-8 bytes)"


def _lit(x: str) -> Column:
    return F.lit(x)


def toc_description(summary: Column) -> Column:
    """The first six words, at most 48 characters."""
    six = F.array_join(F.slice(F.split(summary, " "), 1, 6), " ")
    return T.truncate_at_word(F.regexp_replace(six, f"[{T.WS},;:.]+$", ""), 48)


def _groups() -> Column:
    n = F.ceil(F.size("chunks") / GROUP).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct((i + 1).alias("n"), F.slice("chunks", i * GROUP + 1, GROUP).alias("c")))


def _toc(mode: str) -> Column:
    if mode == "grouped":
        return F.transform(_groups(), lambda g: F.concat(_lit("- toc-"), g["n"].cast("string"), _lit(": "), g["c"][0]["id"], _lit(" … "), F.element_at(g["c"], -1)["id"], _lit(" ("), F.size(g["c"]).cast("string"), _lit(" chunks)")))
    if mode == "ids":
        return F.transform("chunks", lambda c: F.concat(_lit("- "), c["id"]))
    return F.transform("chunks", lambda c: F.when(c["summary"] == "", F.concat(_lit("- "), c["id"])).otherwise(F.concat(_lit("- "), c["id"], _lit(": "), toc_description(c["summary"]))))


def header_in(mode: str, format_name: str = FORMAT) -> Column:
    """The header with its table of contents in one mode: full, ids or grouped."""
    named = [("url", "url"), ("lang", "lang"), ("updated", "updated"), ("series-prev", "series_prev"), ("series-next", "series_next")]
    meta = [F.concat(_lit("type: "), F.col("type")), *[F.when(F.col(c) != "", F.concat(_lit(f"{k}: "), F.col(c))) for k, c in named], F.concat(_lit("hash: "), F.col("hash"))]
    lines = [_lit(f"<!-- {format_name} {VERSION} -->"), F.concat(_lit("# "), F.col("title")), _lit(""), F.concat(_lit("> "), F.col("summary")), _lit(""), *meta, _lit(""), _lit("## toc")]
    return F.concat_ws("\n", *lines, F.when(F.size("chunks") > 0, F.array_join(_toc(mode), "\n")))


def facts_section() -> Column:
    kv = F.transform("facts", lambda f: F.concat(_lit("- "), f["key"], _lit(": "), F.replace(f["value"], _lit("\n"), _lit("\\n"))))

    def cells(x: Column) -> Column:
        return F.array_join(F.transform(x, T.escape_cell), "|")

    tables = F.flatten(F.transform("tables", lambda t: F.concat(F.array(F.concat(_lit("@table "), t["id"]), F.concat(_lit("cols: "), cells(t["cols"]))), F.transform(t["rows"], cells), F.array(_lit("@end")))))
    return F.array_join(F.concat(F.array(_lit("## facts")), kv, tables), "\n")


def chunk_section(c: Column) -> Column:
    head = F.concat_ws(
        "\n",
        F.concat(_lit("## chunk "), c["id"]),
        F.concat(_lit("summary: "), c["summary"]),
        F.when(F.size(c["tags"]) > 0, F.concat(_lit("tags: "), F.array_join(c["tags"], ", "))),
        F.concat(_lit("anchor: "), F.coalesce(c["anchor"], _lit("none"))),
    )
    return F.when(c["text"] == "", head).otherwise(F.concat(head, _lit("\n\n"), c["text"]))


def _sub_tocs() -> Column:
    def line(c: Column) -> Column:
        return F.when(c["summary"] == "", F.concat(_lit("- "), c["id"])).otherwise(F.concat(_lit("- "), c["id"], _lit(": "), T.truncate_at_word(c["summary"], 80)))

    some = F.transform(_groups(), lambda g: F.array_join(F.concat(F.array(F.concat(_lit("## toc "), g["n"].cast("string"))), F.transform(g["c"], line)), "\n"))
    return F.when(F.col("toc_mode") == "grouped", some).otherwise(F.array().cast("array<string>"))


def with_header(docs: DataFrame, format_name: str = FORMAT) -> DataFrame:
    """docs with hash, toc_mode, header and header_units; the first mode within the cap is taken, grouped if there are many chunks or none fits."""
    d = docs.withColumn("hash", T.content_hash("main_text"))
    full, ids = header_in("full", format_name), header_in("ids", format_name)
    d = d.withColumns({"__full": full, "__ids": ids})
    mode = F.when(F.size("chunks") > GROUPED_ABOVE, "grouped").when(T.units("__full") <= CAP, "full").when(T.units("__ids") <= CAP, "ids").otherwise("grouped")
    d = d.withColumn("toc_mode", F.when(F.col("ok"), mode))
    header = F.when(F.col("toc_mode") == "full", F.col("__full")).when(F.col("toc_mode") == "ids", F.col("__ids")).when(F.col("toc_mode") == "grouped", header_in("grouped", format_name))
    return d.withColumn("header", header).withColumn("header_units", T.units("header")).drop("__full", "__ids")


def markdown() -> Column:
    """The whole document; over with_header()."""
    sections = F.concat(F.array("header"), _sub_tocs(), F.array(facts_section()), F.transform("chunks", chunk_section))
    return F.when(F.col("ok"), F.concat(F.array_join(sections, "\n\n"), _lit("\n")))


def split_files() -> Column:
    """File name to content of the split layout; over with_header()."""

    def entry(name: Column, text: Column) -> Column:
        return F.struct(name.alias("key"), F.concat(text, _lit("\n")).alias("value"))

    files = F.concat(
        F.array(entry(_lit("_header.md"), F.col("header")), entry(_lit("facts.md"), facts_section())),
        F.transform(_sub_tocs(), lambda s, i: entry(F.concat(_lit("_toc-"), (i + 1).cast("string"), _lit(".md")), s)),
        F.transform("chunks", lambda c: entry(F.concat(c["id"], _lit(".md")), chunk_section(c))),
    )
    return F.when(F.col("ok"), F.map_from_entries(files))


def plain_view() -> Column:
    """Chunk texts below ruled ids."""
    return F.array_join(F.transform("chunks", lambda c: F.concat(_lit("── "), c["id"], _lit(" ───\n"), c["text"])), "\n\n")


_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _quoted(c: Column) -> Column:
    """A string as JSON, null as null: the two marks and the control characters are escaped, nothing else."""
    s = F.replace(F.replace(c, _lit("\\"), _lit("\\\\")), _lit('"'), _lit('\\"'))
    lines, rest = s, s
    for code in range(32):
        x = chr(code)
        rest = F.replace(rest, _lit(x), _lit(_ESCAPES.get(x, f"\\u{code:04x}")))
    for x in "\t\n\r":
        lines = F.replace(lines, _lit(x), _lit(_ESCAPES[x]))
    s = F.when(c.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"), rest).when(c.rlike("[\t\n\r]"), lines).otherwise(s)
    return F.coalesce(F.concat(_lit('"'), s, _lit('"')), _lit("null"))


def _json_list(items: Column, depth: int) -> Column:
    """An array of JSON texts as a list whose brackets stand ``depth`` indents in."""
    inner, outer = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    return F.when(F.size(items) == 0, _lit("[]")).otherwise(F.concat(_lit("[" + inner), F.array_join(items, "," + inner), _lit(outer + "]")))


def _json_object(fields: dict[str, Column], depth: int) -> Column:
    inner, outer = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    parts = [x for i, (k, v) in enumerate(fields.items()) for x in (_lit(("," if i else "{") + inner + f'"{k}": '), v)]
    return F.concat(*parts, _lit(outer + "}"))


def json_text(format_name: str = FORMAT) -> Column:
    """The canonical JSON rendering: fixed key order, two-space indents, as json.dumps writes it; over with_header()."""

    def strings(items: Column, depth: int) -> Column:
        return _json_list(F.transform(items, _quoted), depth)

    def listed(items: Column, depth: int, f) -> Column:
        return _json_list(F.transform(items, f), depth)

    names = "title summary type url lang updated series_prev series_next hash".split()

    def body(q: Column) -> Column:
        said = dict(zip(names, (q[i] for i in range(len(names)))))
        return _json_object(
            {
                format_name: _lit(json.dumps(VERSION)),
                **{k: said[k] for k in names[:6]},
                "series": _json_object({"prev": said["series_prev"], "next": said["series_next"]}, 1),
                "hash": said["hash"],
                "toc": listed(F.col("chunks"), 1, lambda c: _json_object({k: _quoted(c[k]) for k in ("id", "summary")}, 2)),
                "facts": _json_object(
                    {
                        "kv": listed(F.col("facts"), 2, lambda f: _json_object({k: _quoted(f[k]) for k in ("key", "value")}, 3)),
                        "tables": listed(F.col("tables"), 2, lambda t: _json_object({"id": _quoted(t["id"]), "cols": strings(t["cols"], 4), "rows": listed(t["rows"], 4, lambda r: strings(r, 5))}, 3)),
                    },
                    1,
                ),
                "chunks": listed(F.col("chunks"), 1, lambda c: _json_object({"id": _quoted(c["id"]), "summary": _quoted(c["summary"]), "tags": strings(c["tags"], 3), "anchor": _quoted(c["anchor"]), "text": _quoted(c["text"])}, 2)),
            },
            0,
        )

    # the page's own strings are quoted once, in a lambda's variable
    quoted = F.transform(F.array(*names), _quoted)
    return F.when(F.col("ok"), F.concat(F.transform(F.array(quoted), body)[0], _lit("\n")))


def warnings() -> Column:
    """Array of (code, message); over with_header()."""

    def w(code: str, message: Column) -> Column:
        return F.struct(_lit(code).alias("code"), message.alias("message"))

    none = F.array().cast("array<struct<code:string,message:string>>")
    parts = [
        F.when(F.col("thin") & F.col("ok"), F.array(w("THIN_PAGE", _lit("hardly any content was found")))).otherwise(none),
        F.when(F.col("fallback"), F.array(w("NO_HEADINGS", _lit("without headings, paragraphs were packed into numbered parts")))).otherwise(none),
        F.coalesce(F.transform(F.filter("chunks", lambda c: c["anchor"].isNull()), lambda c: w("NO_ANCHOR", F.concat(_lit("no anchor in the page for chunk "), c["id"]))), none),
        F.when(F.col("header_units") > TARGET, F.array(w("HEADER_OVER_TARGET", F.concat(_lit("units of the header: "), F.col("header_units").cast("string"))))).otherwise(none),
    ]
    return F.concat(*parts)


def rendered(docs: DataFrame, format_name: str = FORMAT) -> DataFrame:
    """docs with hash, header, md, split and warnings."""
    return with_header(docs, format_name).withColumns({"md": markdown(), "split": split_files(), "warnings": warnings()})


def token_report(docs: DataFrame, counter=None) -> DataFrame:
    """(page_id, basis, raw_html, sibling, header_only, facts, chunk_tokens, saved_percent): sizes of each layer.

    ``counter`` is a Spark function of a string column that counts tokens; without it
    the estimate is used.  It never influences content.
    """
    count = counter or T.units
    d = with_header(docs).where("ok").withColumn("md", markdown())
    raw = F.col("html_units")
    return d.select(
        "page_id",
        F.lit("given counter" if counter else ESTIMATE).alias("basis"),
        raw.alias("raw_html"),
        count(F.col("md")).alias("sibling"),
        count(F.col("header")).alias("header_only"),
        count(facts_section()).alias("facts"),
        F.transform("chunks", lambda c: F.struct(c["id"].alias("id"), T.units(c["text"]).alias("tokens"))).alias("chunk_tokens"),
    ).withColumn("saved_percent", F.when(F.col("raw_html") > 0, T.saved_percent("sibling", "raw_html")))
