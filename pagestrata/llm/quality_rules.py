"""Operator 5: line-first cleaning.

Punctuation, navigation and boilerplate rules judge each line; lines that fail are
removed, and documents that lose too much of their text are rejected.  All of it is
built-in array and string functions: one pass, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A document that loses more than this share of its characters is rejected.
MOST_LOST = 0.5
#: Separators between items that make a line navigation.
NAV_BARS = 3
BOILERPLATE = (
    "cookie policy|privacy policy|terms of (use|service)|all rights reserved|enable javascript|javascript is disabled"
    "|subscribe to our newsletter|sign up for our newsletter|click here to|share this (page|article)|skip to (main )?content|back to top|log ?in to comment"
)
_BREAK = "\n"


def line_rule(line: Column) -> Column:
    """The rule that a line fails, or null: 'punctuation', 'navigation' or 'boilerplate' (in order of test: navigation, boilerplate, punctuation)."""
    marks = F.length(line) - F.length(F.translate(line, "#$%&*!~^=<>{}[]\\@|_", ""))
    bars = F.length(line) - F.length(F.translate(line, "|", ""))
    return (
        F.when(bars >= NAV_BARS, F.lit("navigation"))
        .when(F.lower(line).rlike(BOILERPLATE), F.lit("boilerplate"))
        .when(marks * 10 > F.length(line), F.lit("punctuation"))
        .when(~line.rlike("[A-Za-z0-9\\x{80}-\\x{10FFFF}]"), F.lit("punctuation"))
    )


def _fails(rule: str):
    return lambda x: x["rule"] == rule


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """(doc_id, lines, navigation, boilerplate, punctuation, kept_chars, kept, clean_text) of every row: how many lines failed each rule, and the text without them, null where the document is rejected.

    Blank lines are dropped and count in no rule.  Null, empty or blank texts have no
    lines and are rejected (clean_text null); null ids are kept as null, repeated rows
    give repeated results, other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", _BREAK), lambda x: F.length(F.trim(x)) > 0)
    judged = d.select("doc_id", F.transform(lines, lambda x: F.struct(x.alias("line"), line_rule(x).alias("rule"))).alias("j"))
    good = judged.select(
        "doc_id",
        F.size("j").alias("lines"),
        *[F.size(F.filter("j", _fails(r))).alias(r) for r in ("navigation", "boilerplate", "punctuation")],
        F.aggregate("j", F.lit(0), lambda a, x: a + F.length(x["line"])).alias("all_chars"),
        F.array_join(F.transform(F.filter("j", lambda x: x["rule"].isNull()), lambda x: x["line"]), _BREAK).alias("rest"),
        (F.lit(0) + F.aggregate("j", F.lit(0), lambda a, x: a + F.when(x["rule"].isNull(), F.length(x["line"])).otherwise(0))).alias("kept_chars"),
    )
    kept = (F.col("kept_chars") > 0) & (F.col("kept_chars") >= (1 - most_lost) * F.col("all_chars"))
    return good.select("doc_id", "lines", "navigation", "boilerplate", "punctuation", "kept_chars", kept.alias("kept"), F.when(kept, F.col("rest")).alias("clean_text"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x, ' ')) > 0) AS l FROM documents),
judged AS (
  SELECT doc_id, l, list_transform(l, lambda x: CASE
      WHEN length(x) - length(replace(x, '|', '')) >= {NAV_BARS} THEN 'navigation'
      WHEN regexp_matches(lower(x), '{BOILERPLATE}') THEN 'boilerplate'
      WHEN (length(x) - length(regexp_replace(x, '[#$%&*!~^=<>{{}}\\[\\]\\\\@|_]', '', 'g'))) * 10 > length(x) THEN 'punctuation'
      WHEN NOT regexp_matches(x, '[A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]') THEN 'punctuation' ELSE 'none' END) AS r FROM lines),
counted AS (
  SELECT doc_id, len(l) AS lines,
    len(list_filter(r, lambda x: x = 'navigation')) AS navigation, len(list_filter(r, lambda x: x = 'boilerplate')) AS boilerplate, len(list_filter(r, lambda x: x = 'punctuation')) AS punctuation,
    coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS all_chars,
    list_transform(list_filter(list_zip(l, r), lambda x: x[2] = 'none'), lambda x: x[1]) AS good FROM judged)
SELECT doc_id, CAST(lines AS INT) AS lines, CAST(navigation AS INT) AS navigation, CAST(boilerplate AS INT) AS boilerplate, CAST(punctuation AS INT) AS punctuation,
  CAST(coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS INT) AS kept_chars,
  coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) > 0 AND coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) >= {1 - MOST_LOST} * all_chars AS kept,
  CASE WHEN coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) > 0 AND coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) >= {1 - MOST_LOST} * all_chars
    THEN array_to_string(good, chr(10)) END AS clean_text
FROM counted
"""
