"""Site-level results: index, sibling paths, discovery, usage figures and prices."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.render import FORMAT, VERSION

MOST_SAVED = 5_000_000
#: (model, label, dollars for a million input tokens): an example table; pass your own.
PRICES = [("large", "Large model", 5.0), ("medium", "Medium model", 3.0), ("small", "Small model", 1.0)]


def sibling_path(path: Column | str, extension: str = ".llm.md") -> Column:
    """The path of a page's document: its .html or .htm replaced."""
    return F.concat(F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"\.html?$", ""), F.lit(extension))


def site_index(docs: DataFrame, json_too: bool = False, split_too: bool = False) -> DataFrame:
    """(url, md, json, split, title, hash, updated) of all documents that have a URL, by URL."""
    d = docs.where("ok and url is not null")
    path = F.regexp_replace("url", r"[?#].*$", "")
    optional = lambda on, ext: (sibling_path(path, ext) if on else F.lit(None)).cast("string")
    return d.select("url", sibling_path(path).alias("md"), optional(json_too, ".llm.json").alias("json"), optional(split_too, ".llm/").alias("split"), "title", T.content_hash("main_text").alias("hash"), "updated").orderBy("url")


def index_text(rows: list[dict], format_name: str = FORMAT) -> str:
    """The index as JSON text; rows must be in order."""
    return json.dumps({format_name: VERSION, "pages": rows}, ensure_ascii=False, indent=2) + "\n"


def discover(pages: DataFrame, index: DataFrame, links: DataFrame) -> DataFrame:
    """(url, md, found_by): where each page's document is: in the index, else by its link element, else by the naming rule."""
    d = pages.select("url").join(index.select("url", F.col("md").alias("a")), "url", "left").join(links.select("url", F.col("href").alias("b")), "url", "left")
    by = F.when(F.col("a").isNotNull(), "index").when(F.col("b").isNotNull(), "link").otherwise("name")
    return d.select("url", F.coalesce("a", "b", sibling_path(F.regexp_replace("url", r"[?#].*$", ""))).alias("md"), by.alias("found_by"))


def stale(built: DataFrame, current: DataFrame) -> DataFrame:
    """Pages (url, hash) whose content is no longer what their document was built from."""
    return built.select("url", F.col("hash").alias("built")).join(current.select("url", F.col("hash").alias("current")), "url").where("built <> current")


def savings(saved: DataFrame, col: str = "saved") -> DataFrame:
    """(conversions, tokens_saved): each conversion counts 0 to 5,000,000 whole tokens."""
    one = F.least(F.greatest(F.floor(col), F.lit(0)), F.lit(MOST_SAVED))
    return saved.agg(F.count("*").alias("conversions"), F.coalesce(F.sum(one), F.lit(0)).alias("tokens_saved"))


def prices(spark, rows: list[tuple[str, str, float]] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or PRICES, "model string, label string, dollars_per_million double")


def dollars_saved(saved: DataFrame, price_rows: DataFrame, col: str = "saved", requests: int = 1000) -> DataFrame:
    """saved × models with ``dollars``: what so many requests save that each send so many fewer tokens."""
    return saved.crossJoin(F.broadcast(price_rows)).withColumn("dollars", F.col(col) * requests * F.col("dollars_per_million") / 1_000_000)


def size_table(report: DataFrame, key: str = "page_id") -> DataFrame:
    """Sizes by page and in total (key null), with how many times smaller document and header are, by grouping sets."""
    r = report.groupingSets([[key], []], key).agg(F.sum("raw_html").alias("raw"), F.sum("sibling").alias("sibling"), F.sum("header_only").alias("header"), F.grouping(key).alias("total"))
    return r.withColumns({"sibling_times": T.round_half_up(F.col("raw") / F.col("sibling"), 1), "header_times": T.round_half_up(F.col("raw") / F.col("header"), 0)})
