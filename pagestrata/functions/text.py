"""Text helpers as Spark columns (JVM-side); functions.plain has them in Python.

Lengths count code points.  Input is taken to be in NFC, as the parsing step leaves it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import plain

#: White space as ECMAScript sees it, for Java's regular expressions.
WS = r"\t\n\x0B\f\r    -     　﻿"
SENTENCE_END = f"(?<=[!?.…。．！？])[{WS}]+"
_C = Column | str


def _col(c: _C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: _C) -> Column:
    """White-space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), f"[{WS}]+", " "))


def units(c: _C) -> Column:
    """Budget units: a quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(_col(c)) / 4).cast("int")


def truncate_at_word(c: _C, most: int) -> Column:
    """At most ``most`` characters, cut at a space beyond the half, with an ellipsis if cut."""
    c = _col(c)
    head = F.substring(c, 1, most)
    back = F.instr(F.reverse(head), " ")
    cut = F.when((back > 0) & (most - back > most * 0.5), F.substring(head, F.lit(1), F.lit(most) - back)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(cut, f"[{WS},;:]+$", ""), F.lit("…")))


def sentences(c: _C) -> Column:
    """Sentences of a prose string, as an array."""
    return F.filter(F.split(collapse(c), SENTENCE_END), lambda s: s != "")


def first_sentence(c: _C) -> Column:
    return F.split(collapse(c), SENTENCE_END, 2)[0]


def iso_date(c: _C) -> Column:
    """The first date of the form dddd-dd-dd, or null."""
    return F.nullif(F.regexp_extract(_col(c), "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))


def slugify(c: _C) -> Column:
    s = F.regexp_replace(F.lower(_col(c)), f"[{WS}/–—·]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^\p{N}\p{L}_-]+", ""), "-{2,}", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    head = F.substring(s, 1, 64)
    back = F.instr(F.reverse(head), "-")
    s = F.when(F.length(s) <= 64, s).when((back > 0) & (64 - back > 32), F.substring(head, F.lit(1), F.lit(64) - back)).otherwise(head)
    return F.when(s == "", F.lit("section")).otherwise(s)


def valid_id(c: _C) -> Column:
    c = _col(c)
    return F.coalesce(c.rlike(r"^[\p{N}\p{L}][\p{N}\p{L}_-]{0,63}\z") & ~c.rlike(r"^part-[0-9]+\z"), F.lit(False))


def dedupe_slugs(slugs: _C, reserved: tuple[str, ...] = plain.RESERVED) -> Column:
    """The slugs of an array in order, each given once: a taken or reserved one gets the next free number; nulls stay.

    A number depends on all that was given before, so it is one pass in Python over each array, in linear time.
    """

    def run(arrays: pa.Array) -> pa.Array:
        out = []
        for x in arrays:
            given, s = x.as_py(), plain.Slugs(reserved)
            out.append(None if given is None else [v if v is None else s.claim(v) for v in given])
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(_col(slugs))


def content_hash(c: _C) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(_col(c), 256), 1, 16))


def escape_cell(c: _C) -> Column:
    return F.replace(F.replace(F.replace(_col(c), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("\\n"))


def unescape_cell(c: _C) -> Column:
    """Inverse of escape_cell; other backslashes stay."""
    hidden = F.replace(_col(c), F.lit("\\\\"), F.lit("\u0001"))
    return F.replace(F.replace(F.replace(hidden, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")), F.lit("\u0001"), F.lit("\\"))


def shingles(c: _C, n: int = 4) -> Column:
    """Distinct runs of n space-separated words."""
    # the words are bound once as a lambda's variable; named outside, they would be split anew for each run
    def runs(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(F.split(_col(c), " ")), runs)[0]


def canonical(c: _C) -> Column:
    """The form in which sentences are matched: no backticks, no space before closing or after opening marks, lower case."""
    s = collapse(F.replace(_col(c), F.lit("`"), F.lit("")))
    s = F.regexp_replace(s, f"[{WS}]+([)\\].,;:!?])", "$1")
    return F.lower(F.regexp_replace(s, f"([(\\[])[{WS}]+", "$1"))


def round_half_up(c: _C, places: int) -> Column:
    """Rounding as floor(x + 0.5) on the scaled value."""
    return F.floor(_col(c) * 10**places + 0.5) / 10**places


def saved_percent(sent: _C, raw: _C) -> Column:
    """By how many percent ``sent`` is less than ``raw``, to one place.

    The share is scaled once: times 100 and then times 10 falls short of a half where times 1000 reaches it.
    """
    return F.floor((1 - _col(sent) / _col(raw)) * 1000 + 0.5) / 10


def terms(c: _C) -> Column:
    """Lower-cased runs of letters and digits longer than one character."""
    return F.filter(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{N}\p{L}]+"), 0), lambda t: F.length(t) > 1)


def terms_with_marks(c: _C) -> Column:
    """The other tokeniser: underscores and apostrophes belong to words."""
    return F.filter(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{N}\p{L}_']+"), 0), lambda t: F.length(t) > 1)
