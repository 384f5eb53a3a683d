"""Command line: generate documents from pages, validate them, rank chunks for a question.

python -m pagestrata.cli generate INPUT... [--quiet] [--site-index] [--split] [--base-url URL] [--out DIR] [--json]
python -m pagestrata.cli validate PAGE_OR_DIR [DOCUMENT_OR_SPLIT_DIR] [--json] [--strict]
python -m pagestrata.cli rank PAGE QUESTION

``generate -`` reads one page from standard input and writes its document to standard
output.  Exit codes: 0 all well; of generate 1 nothing found and 2 a page without a
document; of validate 1 errors found and 2 nothing found.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import document, rank, render, validate
from .plans import site
from .sources import files


def session() -> SparkSession:
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [here, os.environ.get("PYTHONPATH")]))
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def built(pages: DataFrame, json_too: bool = False, split_too: bool = False) -> DataFrame:
    """Rows (page_id, ok, error, ..., md, json, split) of pages."""
    d = render.with_header(document.documents(pages)).withColumn("md", render.markdown())
    d = d.withColumn("json", render.json_text() if json_too else F.lit(None).cast("string"))
    return d.withColumn("split", render.split_files() if split_too else F.lit(None).cast("map<string,string>"))


def generate(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.inputs == ["-"]:
        row = built(files.page(spark, sys.stdin.read(), args.base_url), args.json).first()
        if not row.ok:
            print(row.error, file=sys.stderr)
            return 2
        sys.stdout.write(row.json if args.json else row.md)
        return 0
    missing = [x for x in args.inputs if not os.path.exists(x)]
    if missing:
        print(f"not found: {', '.join(missing)}", file=sys.stderr)
        return 1
    pages = files.html_pages(spark, *args.inputs, base_url=args.base_url)
    rows = pages.select("page_id", "rel").join(built(pages, args.json, args.split), "page_id").persist()
    out = args.out or (args.inputs[0] if os.path.isdir(args.inputs[0]) else os.path.dirname(os.path.abspath(args.inputs[0])))
    n = rows.count()
    if n == 0:
        print("no pages found", file=sys.stderr)
        return 1
    files.write_texts(files.output_files(rows, args.json, args.split), out)
    if args.site_index:
        # one small row for each page: an index is one file by its nature
        d = rows.where("ok").select(F.coalesce("url", "rel").alias("url"), site.sibling_path("rel").alias("md"), (site.sibling_path("rel", ".llm.json") if args.json else F.lit(None)).alias("json"), (site.sibling_path("rel", ".llm/") if args.split else F.lit(None)).alias("split"), "title", "hash", "updated").orderBy("url")
        to = os.path.join(out, ".well-known", f"{render.FORMAT}.json")
        os.makedirs(os.path.dirname(to), exist_ok=True)
        with open(to, "w", encoding="utf-8") as f:
            f.write(site.index_text([r.asDict() for r in d.toLocalIterator()]))
    failed = rows.where("not ok").select("rel", "error")
    for r in failed.toLocalIterator():
        print(f"{r.rel}: {r.error}", file=sys.stderr)
    if not args.quiet:
        sizes = rows.where("ok").select("rel", F.col("html_units").alias("raw_html"), F.expr("cast(ceil(octet_length(md) / 4) as int)").alias("sibling"), F.col("header_units").alias("header_only"))
        for r in site.size_table(sizes, "rel").orderBy("total", "rel").toLocalIterator():
            if not r.total or n > 1:
                print(f"{'TOTAL' if r.total else r.rel}: {r.raw} raw, {r.sibling} document ({r.sibling_times:.1f}x), {r.header} header ({r.header_times:.0f}x)")
    return 2 if failed.count() else 0


def check(args: argparse.Namespace, spark: SparkSession) -> int:
    if os.path.isdir(args.page) and not args.document:
        pairs = files.pairs_in(spark, args.page)
    elif args.document and os.path.isfile(args.page) and os.path.exists(args.document):
        with open(args.page, encoding="utf-8", errors="replace") as f:
            html = f.read()
        if os.path.isdir(args.document):
            folder = os.path.abspath(args.document)
            got = files.split_documents_in(spark, os.path.dirname(folder)).where(F.col("rel") == os.path.basename(folder).removesuffix(".llm")).first()
            md = got.md if got else ""
        else:
            with open(args.document, encoding="utf-8") as f:
                md = f.read()
        pairs = spark.createDataFrame([(0, os.path.basename(args.page), html, md)], "page_id long, rel string, html string, md string")
    else:
        print("give a folder, or a page and its document", file=sys.stderr)
        return 2
    found = validate.findings_of(pairs).join(pairs.select("page_id", "rel"), "page_id").persist()
    verdict = validate.verdicts(found, pairs, strict=args.strict).agg(F.count("*"), F.sum("errors"), F.sum("warnings"), F.count_if(~F.col("passed"))).first()
    if verdict[0] == 0:
        print("no documents found", file=sys.stderr)
        return 2
    rows = found.orderBy("rel", "ord").toLocalIterator()
    if args.json:
        print(json.dumps({"errors": verdict[1], "warnings": verdict[2], "findings": [{k: r[k] for k in ("rel", "level", "code", "message")} for r in rows]}, ensure_ascii=False, indent=2))
    else:
        for r in rows:
            print(f"{r.level} {r.code} {r.rel}: {r.message}")
        print(f"{verdict[0]} documents, {verdict[1]} errors, {verdict[2]} warnings")
    return 1 if verdict[3] else 0


def ask(args: argparse.Namespace, spark: SparkSession) -> int:
    with open(args.page, encoding="utf-8", errors="replace") as f:
        d = document.documents(files.page(spark, f.read()))
    q = spark.createDataFrame([(0, 1, args.question)], "page_id long, question_id long, question string")
    rows = rank.answer_chunks(d, q).orderBy("rank").collect()
    for r in rows:
        print(f"{r['rank']}. {r.chunk_id} {r.score:.4f}")
    return 0 if rows else 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pagestrata")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate")
    g.add_argument("inputs", nargs="+")
    g.add_argument("--out")
    g.add_argument("--base-url")
    for flag in "--quiet --site-index --json --split".split():
        g.add_argument(flag, action="store_true")
    v = sub.add_parser("validate")
    v.add_argument("page")
    v.add_argument("document", nargs="?")
    v.add_argument("--json", action="store_true")
    v.add_argument("--strict", action="store_true")
    r = sub.add_parser("rank")
    r.add_argument("page")
    r.add_argument("question")
    args = p.parse_args(argv)
    return {"generate": generate, "validate": check, "rank": ask}[args.command](args, session())


if __name__ == "__main__":
    sys.exit(main())
