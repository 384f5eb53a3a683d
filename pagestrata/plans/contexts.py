"""The benchmark: questions, context conditions, an offline answerer, and aggregates of its trials."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rank
from ..operators.htmltree import WS_CHARS

CONDITIONS = tuple("raw-html markdown llmstxt two-hop".split())
LONGEST = 400_000
RUNS = 3
PER_ARTICLE = 8
#: Dollars for a million tokens.
PRICE_IN, PRICE_OUT = 3.0, 15.0
_NO_QUESTION = ("author", "image", "mainentity", "modified", "name", "published", "sameas", "type", "url")


# == questions


def titles(lines: DataFrame, most: int | None = None, text_col: str = "value", order_col: str = "ord") -> DataFrame:
    """(ord, title): lines that aren't blank or comments, in order, the first ``most``."""
    out = lines.select(F.col(order_col).alias("ord"), F.trim(text_col).alias("title")).where((F.col("title") != "") & ~F.col("title").startswith("#")).orderBy("ord")
    return out if most is None else out.limit(most)


def fact_questions(docs: DataFrame, most: int = PER_ARTICLE) -> DataFrame:
    """(page_id, question_id, article, question, gold): the first facts of each page as questions."""
    f = docs.where("ok").select("page_id", "title", F.posexplode("facts").alias("ord", "f")).select("page_id", "title", "ord", F.trim("f.key").alias("key"), F.trim("f.value").alias("gold"))
    good = f.where(~F.col("key").isin(*_NO_QUESTION) & ~F.col("key").contains(".") & (F.length("gold") >= 2) & ~F.col("gold").startswith("http"))
    first = good.withColumn("question_id", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).where(F.col("question_id") <= most)
    return first.select("page_id", "question_id", F.col("title").alias("article"), F.concat(F.lit("What is the "), "key", F.lit(" of "), "title", F.lit("?")).alias("question"), "gold")


def external_questions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Questions from outside (question, answer, title) whose title is known: a left semi join."""
    return rows.join(known.select("title"), "title", "left_semi").select(F.col("title").alias("article"), "question", F.col("answer").alias("gold"))


def reachable(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """questions with ``reachable``: whether the answer stands in the page or its document (page_id, html, md)."""
    gold = F.lower("gold")
    both = questions.join(texts.select("page_id", "html", "md"), "page_id")
    return both.withColumn("reachable", F.contains(F.lower("html"), gold) | F.contains(F.lower("md"), gold)).drop("html", "md")


# == contexts


def truncated(c: Column, most: int = LONGEST) -> tuple[Column, Column]:
    over = F.length(c) > most
    return F.when(over, F.concat(F.substring(c, 1, most), F.lit("\n[truncated]"))).otherwise(c), over


_HIDDEN = frozenset("noscript script style template".split())
_BREAKS = frozenset("article br div li p section tr".split())


class _Flat(HTMLParser):
    """Tags dropped, headings marked, boilerplate kept."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.hidden = 0
        super().__init__()

    def handle_starttag(self, name, _attributes):
        if name in _HIDDEN:
            self.hidden += 1
        elif name in ("h1", "h2", "h3", "h4"):
            self.parts.append("\n\n" + "#" * int(name[1]) + " ")
        elif name in _BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, name):
        self.hidden -= name in _HIDDEN and self.hidden > 0

    def handle_data(self, piece):
        if self.hidden == 0:
            self.parts.append(piece)


def flat_markdown(html: str) -> str:
    p = _Flat()
    p.feed(html)
    return re.sub("\n\n\n+", "\n\n", re.sub("[\t ]+", " ", "".join(p.parts))).strip()


def markdown_baseline(html: Column) -> Column:
    """The page as plain Markdown, boilerplate and all."""
    return F.arrow_udf(lambda h: pa.array((None if (t := x.as_py()) is None else flat_markdown(t) for x in h), pa.string()), "string")(html)


def sections(md: Column | str) -> Column:
    """The sections of a Markdown rendering, split before each second-level heading."""
    return F.split(md, "\n(?=## )")


def parsed(rendered: DataFrame, md_col: str = "md", keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, title, header, facts, chunk_sections) as array of (id, text), from Markdown alone, and the columns to keep."""
    s = F.transform(sections(F.col(md_col)), lambda x: F.rtrim(x, F.lit(WS_CHARS)))
    d = rendered.select("page_id", F.regexp_extract(md_col, r"(?m)^# (.+)$", 1).alias("title"), s.alias("s"), *keep)
    rest = F.slice("s", 2, 1_000_000)
    return d.select(
        "page_id",
        "title",
        F.array_join(F.concat(F.slice("s", 1, 1), F.filter(rest, lambda x: x.startswith("## toc"))), "\n").alias("header"),
        F.coalesce(F.element_at(F.filter(rest, lambda x: x.startswith("## facts")), -1), F.lit("")).alias("facts"),
        F.transform(F.filter(rest, lambda x: x.startswith("## chunk ")), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^## chunk ([^\n]*)", 1)).alias("id"), x.alias("text"))).alias("chunk_sections"),
        *keep,
    )


def link_digest() -> Column:
    """Title, summary and section ids; over parsed()."""
    summary = F.regexp_extract("header", r"(?m)^> (.+)$", 1)
    ids = F.transform("chunk_sections", lambda c: F.concat(F.lit("- "), c["id"]))
    return F.array_join(F.concat(F.array(F.concat(F.lit("# "), "title"), F.lit(""), F.concat(F.lit("> "), summary), F.lit(""), F.lit("## Sections")), ids), "\n")


def page_contexts(rows: DataFrame) -> DataFrame:
    """(page_id, fields of asked, condition, context, truncated) of every question of rows (page_id, html, md, asked) under every condition.

    asked is an array of (question_id, question, ...).  All is made within the row: no join, no shuffle.
    Only the two-hop context depends on the question.
    """
    p = parsed(rows, keep=("html", "asked")).withColumns({"plain": markdown_baseline(F.col("html")), "digest": link_digest()})
    chunks = F.transform("chunk_sections", lambda c: F.named_struct(F.lit("id"), c["id"], F.lit("tokens"), T.terms_with_marks(c["text"]), F.lit("text"), c["text"]))
    per_page = p.select("page_id", "html", "plain", "digest", "header", "facts", chunks.alias("cs"), F.explode("asked").alias("q"))
    best = rank.best_chunks(F.col("cs"), rank.question_terms(F.col("q.question"), T.terms_with_marks), ("text",))
    texts = F.concat(F.array("header", "facts"), F.transform(best, lambda x: x["text"]))
    two = F.array_join(F.filter(texts, lambda x: x != ""), "\n\n")
    under = F.array(*[F.struct(F.lit(n).alias("condition"), c.alias("context")) for n, c in zip(CONDITIONS, (F.col("html"), F.col("plain"), F.col("digest"), two))])
    text, over = truncated(F.col("x.context"))
    return per_page.select("page_id", "q", F.explode(under).alias("x")).select("page_id", "q.*", "x.condition", text.alias("context"), over.alias("truncated"))


def contexts(pages: DataFrame, rendered: DataFrame, questions: DataFrame) -> DataFrame:
    """(page_id, question_id, condition, context, truncated) of every question under every condition."""
    asked = questions.groupBy("page_id").agg(F.collect_list(F.struct("question_id", "question")).alias("asked"))
    rows = pages.select("page_id", "html").join(rendered.select("page_id", "md"), "page_id").join(asked, "page_id")
    return page_contexts(rows).select("page_id", "question_id", "condition", "context", "truncated")


# == answers

Provider = Callable[[str, str], tuple[str, int, int]]
UNKNOWN = "I don't know."
ANSWER = "Reply from the context alone and briefly; if it holds no answer, say: I don't know."
_STOP = frozenset("how the was what when where which who".split())


def prompt(run: int, question: str, context: str) -> str:
    return "\n".join((f"[run {run}]", f"QUESTION: {question}", "", "CONTEXT:", context))


def best_line(question: str, context: str) -> str:
    """The line of most telling question words, each weighing the inverse of the lines it stands in; the first among equals."""
    words = [w for w in re.findall("[0-9a-z]{3,}", question.lower()) if w not in _STOP]
    lines = context.strip().splitlines()
    low = [x.lower() for x in lines]
    weight = {w: 1.0 / max(1, sum(w in x for x in low)) for w in words}
    best, at = 0.0, None
    for i, x in enumerate(low):
        score = sum(weight[w] for w in words if w in x)
        if score > best:
            best, at = score, i
    return "" if at is None else lines[at]


def offline_answer(run: int, question: str, context: str) -> tuple[str, int, int]:
    """(answer, tokens in, tokens out) without any model; tokens are a quarter of the characters."""
    line = best_line(question, context)
    return line.strip() or UNKNOWN, len(prompt(run, question, context)) // 4, len(line) // 4


def _plain(c: Column) -> Column:
    """Letters and digits alone, as answers are compared."""
    return F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", " "))


def graded(answer: Column, gold: Column) -> Column:
    """Whether the answer holds the gold answer, letters and digits alone being compared."""
    return (gold != "") & F.contains(_plain(answer), _plain(gold))


def trials(asked: DataFrame, runs: int = RUNS, answerer: Callable[[int, str, str], tuple[str, int, int]] = offline_answer) -> DataFrame:
    """Trials of rows (page_id, article, question_id, question, gold, condition, context, truncated), each run anew."""

    def answer(question: pa.Array, context: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("run", pa.int32()), ("answer", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64())]))
        return pa.array((all_runs(q.as_py() or "", c.as_py() or "") for q, c in zip(question, context)), kind)

    def all_runs(question: str, context: str) -> list[dict]:
        got = ((r, answerer(r, question, context)) for r in range(1, runs + 1))
        return [{"run": r, "answer": a, "input_tokens": i, "output_tokens": o} for r, (a, i, o) in got]

    # a text is sent once for all its runs
    ask = F.arrow_udf(answer, "array<struct<run int, answer string, input_tokens long, output_tokens long>>").asNondeterministic()
    # and graded once for each of its different answers
    known = F.transform(F.array_distinct(F.transform("a", lambda x: x["answer"])), lambda x: F.struct(x.alias("answer"), graded(x, F.col("gold")).alias("correct")))
    out = asked.withColumn("a", ask("question", "context")).withColumn("known", known)
    out = out.select(*"condition article question gold truncated known".split(), F.explode("a").alias("a"))
    correct = F.get(F.filter("known", lambda x: x["answer"].eqNullSafe(F.col("a.answer"))), F.lit(0))["correct"]
    return out.select("condition", "article", "question", "a.run", "gold", "truncated", "a.answer", "a.input_tokens", "a.output_tokens", correct.alias("correct"))


def cached_trials(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with an answer in the cache, by key, and those without one."""
    return requests.join(cache, "key"), requests.join(cache.select("key"), "key", "left_anti")


def request_key(provider: Column, system: Column, text: Column) -> Column:
    return F.sha2(F.to_json(F.struct(text.alias("prompt"), provider.alias("provider"), system.alias("system"))), 256)


# == aggregates


def mean_ci(c: Column | str) -> tuple[Column, Column]:
    """Mean and the half width of its 95 % interval; 0 below two values."""
    return F.coalesce(F.avg(c), F.lit(0.0)), F.coalesce(F.lit(1.96) * F.stddev_samp(c) / F.sqrt(F.count(c)), F.lit(0.0))


def trial_summary(t: DataFrame, by_article: bool = True) -> DataFrame:
    """One row for each condition, and one for each condition and article if asked for (article null in the former), by grouping sets."""
    acc, acc_ci = mean_ci(F.col("correct").cast("double"))
    tok, tok_ci = mean_ci(F.col("input_tokens").cast("double"))
    n_right = F.count_if("correct")
    cost = F.sum("input_tokens") / 1e6 * PRICE_IN + F.sum("output_tokens") / 1e6 * PRICE_OUT
    sets = t.groupingSets([["condition"], ["condition", "article"]], "condition", "article") if by_article else t.groupBy("condition")
    out = sets.agg(
        F.count("*").alias("trials"),
        acc.alias("accuracy_mean"),
        acc_ci.alias("accuracy_ci95"),
        tok.alias("input_tokens_mean"),
        tok_ci.alias("input_tokens_ci95"),
        (F.sum("input_tokens") / F.nullif(n_right, F.lit(0))).alias("tokens_per_correct"),
        (cost / F.nullif(n_right, F.lit(0))).alias("dollars_per_correct"),
        F.count_if("truncated").alias("truncated_trials"),
        *([F.grouping("article").alias("all_articles")] if by_article else []),
    )
    return out if by_article else out.select("condition", F.lit(None).cast("string").alias("article"), *out.columns[1:], F.lit(1).alias("all_articles"))


def run_counts(t: DataFrame) -> DataFrame:
    """(articles, questions): distinct articles, sorted, and the number of distinct questions."""
    return t.agg(F.array_sort(F.collect_set("article")).alias("articles"), F.count_distinct("article", "question").alias("questions"))
