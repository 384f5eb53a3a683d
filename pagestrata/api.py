"""The library's front: one page or a table of pages in, documents out; token counters plug in here."""

from __future__ import annotations

from collections.abc import Callable
from html import escape
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import document, rank, render, validate
from .sources import files


def token_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """A Spark function of any str -> int callable, for reports only; content never depends on it."""

    def column(c: Column) -> Column:
        return F.arrow_udf(lambda t: pa.array([None if x is None else int(count(x)) for x in t.to_pylist()], pa.int32()), "int")(c)

    return column


def convert_pages(pages: DataFrame, format_name: str = render.FORMAT) -> DataFrame:
    """(page_id, url, html) to documents with header, md, json, split, warnings; pages that fail stay as rows with ``error``."""
    return render.rendered(document.documents(pages), format_name).withColumn("json", render.json_text(format_name))


def convert(spark: SparkSession, html: str, url: str | None = None, counter: Callable[[Column], Column] | None = None, format_name: str = render.FORMAT) -> dict[str, Any]:
    """One page's document as a dict, with its token report."""
    page = files.page(spark, html, url)
    row = convert_pages(page, format_name).first().asDict(recursive=True)
    if row["ok"]:
        d = document.documents(page)
        row["report"] = (render.token_report(d, counter) if counter else render.token_report(d)).first().asDict(recursive=True)
    return row


def check(spark: SparkSession, html: str, md: str, format_name: str = render.FORMAT) -> dict[str, Any]:
    """Findings of one document against its page."""
    found = [dict(zip(("level", "code", "message"), f)) for f in validate.findings(html, md, format_name)]
    return {"findings": found, "errors": sum(f["level"] == "error" for f in found), "warnings": sum(f["level"] == "warning" for f in found)}


def two_hop(spark: SparkSession, html: str, question: str) -> dict[str, Any]:
    """What a reader of one page fetches for a question: the header, then the chosen chunks."""
    d = document.documents(files.page(spark, html))
    q = spark.createDataFrame([(0, 1, question)], "page_id long, question_id long, question string")
    chosen = [r.chunk_id for r in rank.answer_chunks(d, q).orderBy("rank").collect()]
    row = render.with_header(d).select("header", F.map_from_entries(F.transform("chunks", lambda c: F.struct(c["id"], render.chunk_section(c)))).alias("sections")).first()
    return {"header": row.header, "chunks": {c: row.sections[c] for c in chosen}}


def saved_percent(raw: Column, sent: Column) -> Column:
    return F.when(raw > 0, T.saved_percent(sent, raw)).otherwise(F.lit(0.0))


def link_tag(path: str) -> str:
    """The element by which a page names its document."""
    attributes = {"href": escape(path), "rel": "alternate", "type": "text/llm+markdown"}
    return "<link " + " ".join(f'{k}="{v}"' for k, v in attributes.items()) + ">"
