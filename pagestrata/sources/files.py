"""Files: pages, documents and split folders in; renderings, split folders, indexes, reports and archives out."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.site import sibling_path

#: Folders and files that a scan for pages passes over: dependencies, hidden ones, and documents already built.
_PASSED = r"(^|/)(node_modules|\.[^/]*|[^/]*\.llm)(/|$)|\.llm\.[^/]*$"


def _relative(root: str) -> Column:
    path = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"), "%20", " ")
    return F.substring(path, len(os.path.abspath(root).rstrip("/")) + 2, 1_000_000)


def html_pages(spark: SparkSession, *inputs: str, base_url: str | None = None) -> DataFrame:
    """(page_id, rel, url, html) of all .html and .htm files below the inputs, each a folder or a file.

    page_id numbers the relative paths by hash, so that it doesn't depend on the other files.
    """
    out = None
    for x in inputs:
        if os.path.isdir(x):
            d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.htm*").text(x, wholetext=True).withColumn("rel", _relative(x))
            d = d.where(F.col("rel").rlike(r"\.html?$") & ~F.col("rel").rlike(_PASSED))
        else:
            d = spark.read.text(x, wholetext=True).withColumn("rel", F.lit(os.path.basename(x)))
        d = d.select("rel", F.col("value").alias("html"))
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no input")
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), "rel") if base_url else F.lit(None).cast("string")
    return out.select(F.xxhash64("rel").alias("page_id"), "rel", url.alias("url"), "html")


def page(spark: SparkSession, html: str, url: str | None = None) -> DataFrame:
    """One page given as a string."""
    return spark.createDataFrame([(0, url, html)], "page_id long, url string, html string")


def documents_in(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, rel, md) of all .llm.md files below a folder; rel is the page's path without its extension."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.llm.md").text(root, wholetext=True).withColumn("rel", _relative(root))
    return d.select(F.xxhash64("rel").alias("page_id"), F.regexp_replace("rel", r"\.llm\.md$", "").alias("rel"), F.col("value").alias("md"))


def split_documents_in(spark: SparkSession, root: str) -> DataFrame:
    """(rel, md) put together from split folders (*.llm/): header, numbered sub-contents in numeric order, facts, chunks in the order of the contents."""
    # Spark's own readers pass over names that begin with an underscore, so the folders are listed here and read by the tasks
    rows = [(os.path.relpath(d, root).removesuffix(".llm"), d) for d, _, _ in os.walk(root) if d.endswith(".llm")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rel, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names = sorted(n for n in os.listdir(folder) if n.endswith(".md"))
                texts = []
                for n in names:
                    with open(os.path.join(folder, n), encoding="utf-8", newline="") as x:
                        texts.append(x.read().rstrip("\n"))
                yield pa.RecordBatch.from_arrays([pa.array([rel] * len(names), pa.string()), pa.array([n[:-3] for n in names], pa.string()), pa.array(texts, pa.string())], names=["rel", "name", "text"])

    folders = spark.createDataFrame(rows, "rel string, folder string").repartition(max(1, min(len(rows), 1000)))
    f = folders.mapInArrow(read, "rel string, name string, text string")
    toc = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").rlike("^_header$|^_toc-"), F.struct(F.coalesce(F.regexp_extract("name", r"^_toc-(\d+)$", 1).try_cast("int"), F.lit(0)).alias("n"), "text")))), lambda x: F.regexp_extract_all(x["text"], F.lit(r"(?m)^- ([^\s:]+)"), 1)))
    order = f.groupBy("rel").agg(toc.alias("ids"))
    sub = F.regexp_extract("name", r"^_toc-(\d+)$", 1).try_cast("int")
    section = F.when(F.col("name") == "_header", 0).when(sub.isNotNull(), 1).when(F.col("name") == "facts", 2).otherwise(3)
    at = F.struct(section.alias("section"), F.coalesce(sub, F.array_position("ids", F.col("name")).cast("int")).alias("n"))
    parts = f.join(order, "rel").select("rel", at.alias("at"), "name", "text")
    return parts.groupBy("rel").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "text"))), lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("md"))


def pairs_in(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, rel, html, md) of all pages below a folder whose document stands beside them: an inner join on the derived path."""
    pages = html_pages(spark, root).withColumn("stem", sibling_path("rel", ""))
    return pages.join(documents_in(spark, root).select(F.col("rel").alias("stem"), "md"), "stem").select("page_id", "rel", "html", "md")


def write_texts(files: DataFrame, out: str) -> int:
    """Writes rows (path, content) as files below out, each task its own; returns how many there are.

    Writing is by rename, so that a task that is run again leaves whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                to = os.path.normpath(os.path.join(out, path))
                if os.path.commonpath([os.path.abspath(out), os.path.abspath(to)]) != os.path.abspath(out):
                    raise ValueError(f"path leaves the folder: {path}")
                os.makedirs(os.path.dirname(to), exist_ok=True)
                part = f"{to}.{os.getpid()}.part"
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
                os.replace(part, to)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def output_files(rendered: DataFrame, json_too: bool = False, split_too: bool = False) -> DataFrame:
    """(path, content) of what is to be written for rows (rel, md, json?, split?)."""
    out = rendered.where("md is not null").select(sibling_path("rel").alias("path"), F.col("md").alias("content"))
    if json_too:
        out = out.unionByName(rendered.where("json is not null").select(sibling_path("rel", ".llm.json").alias("path"), F.col("json").alias("content")))
    if split_too:
        s = rendered.select("rel", F.explode("split").alias("name", "content"))
        out = out.unionByName(s.select(F.concat(sibling_path("rel", ".llm/"), "name").alias("path"), "content"))
    return out


def titles_file(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of a text file's lines, in order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ord", "value"))


def zip_archive(files: dict[str, str]) -> bytes:
    """A ZIP file of stored (uncompressed) entries, the same bytes for the same files."""
    body, directory = b"", b""
    for name, content in files.items():
        n, data = name.encode(), content.encode()
        fields = struct.pack("<HHHHHIIIHH", 20, 0x0800, 0, 0, 0x21, zlib.crc32(data), len(data), len(data), len(n), 0)
        directory += b"PK\x01\x02" + struct.pack("<H", 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, len(body)) + n
        body += b"PK\x03\x04" + fields + n + data
    return body + directory + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(files), len(files), len(directory), len(body), 0)


def zipped(split: Column) -> Column:
    """The archive of each row's split files, by name."""
    return F.arrow_udf(lambda m: pa.array([None if x is None else zip_archive(dict(sorted(x))) for x in m.to_pylist()], pa.binary()), "binary")(split)


def safe_name(title: str) -> str:
    return re.sub("/", "_", title)
