"""Operator 8: secret scans by password guess cost.

Values that stand in a credential's context (``token = "..."``) or have the shape of
a well-known key are found with one JVM-side expression.  A dynamic programme then segments each value into dictionary
words, dates, repeats, keyboard walks and brute-force spans at the least number of
guesses an attacker needs; a value that is hard to guess is a live secret, one that
is cheap is a placeholder.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe

#: Least log10 of guesses of a secret; 2**40 is about 10**12.
LEAST_GUESSES = 12.0
#: A credential's name with separator and optional quote, or nothing before a value of a well-known shape; group 1 is the name and group 2 the value.  It starts at the word that makes it a credential's, whatever stands before that, so that no text is looked at twice.
_NAMED = r"""((?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credential)s?)["']?\s*+(?:=>|:=|=|:)\s*+["']?"""
_SHAPED = r"\b(?=(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{30}|xox[abpr]-[0-9A-Za-z]|sk_live_[0-9A-Za-z]|AIza[0-9A-Za-z_-]{30})"
#: A value after a quote goes to the next such quote on the line that has no backslash before it; any other goes to a blank, quote or angle bracket, without a delimiter at its end.  Each part repeats a single character class, which the JVM matches without a stack.
_QUOTED = "|".join(rf"""(?<={q})(?!(?:[^{q}\\\r\n]|\\.){{0,5}}{q})[^\r\n]{{6,}}?(?=(?<!\\){q})""" for q in "\"'")
CONTEXT = rf"""(?i)(?:{_NAMED}|{_SHAPED})({_QUOTED}|[^\s"'<>]{{5,}}[^\s"'<>,;|])"""
_HINT = r"(?i)passw|pwd|passphrase|secret|token|key|credential|akia|asia[0-9a-z]{16}|gh[pousr]_|xox[abpr]-|sk_live_|aiza"
SCHEMA_FINDING = "array<struct<key string, hash string, n_chars int, guesses double, secret boolean>>"

_WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login abc123 secret changeme default example test user guest root pass token placeholder sample dummy none null true false your here "
    "api key access private public value string insert replace todo xxx foo bar baz hello world love sunshine princess football baseball shadow superman batman iloveyou trustno1 hunter summer winter spring autumn "
    "company database server client service account redacted hidden masked demo staging production development local remote temp temporary fake mock"
).split()
#: The passwords tried first; dictionary() adds the words of a language.
RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(_WORDS))}
_LEET = str.maketrans("4@301!5$7", "aaeoiisst")
_ROWS = ["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
_NEXT: dict[str, set[str]] = {}
for _r, _row in enumerate(_ROWS):
    for _i, _c in enumerate(_row):
        for _dr, _di in ((0, -1), (0, 1), (1, -1), (1, 0), (-1, 0), (-1, 1)):
            if 0 <= _r + _dr < len(_ROWS) and 0 <= _i + _di < len(_ROWS[_r + _dr]):
                _NEXT.setdefault(_c, set()).add(_ROWS[_r + _dr][_i + _di])
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")


def _alphabet(s: str) -> int:
    """Characters that a brute force must try for each place of s."""
    if re.fullmatch(r"[0-9]+", s):
        return 10
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return 16
    return max(2, 10 * bool(re.search(r"[0-9]", s)) + 26 * bool(re.search(r"[a-z]", s)) + 26 * bool(re.search(r"[A-Z]", s)) + 33 * bool(re.search(r"[^0-9a-zA-Z]", s)))


def dictionary(path: str | None = bpe.VOCAB) -> dict[str, int]:
    """Rank of each word: first the common passwords, then the words of three letters or more of a tokenizer's ranks file, which come by frequency; without a path, the passwords only."""
    found = dict(RANK)
    if path is not None:
        with open(path, "rb") as f:
            for line in f:
                word = base64.b64decode(line.split()[0]).strip().lower() if line.strip() else b""
                if len(word) >= 3 and word.isalpha() and word.isascii():
                    found.setdefault(word.decode(), len(found) + 1)
    return found


def _repeats(s: str) -> list[tuple[int, int, tuple[int, int, int], float]]:
    """(place, size, run, log10 guesses of the block) of every block that follows itself; blocks of one run are equal and follow each other, and those that are repetitions themselves are left to their parts, which cost less.

    A run of a longer block and its like holds a 17-gram that comes again so far on, at a
    place that is a multiple of the block's size less 16; other sizes are passed over.
    So are places in a run of a part of the block that is longer than the block, as such a
    run ends where that of the block does.
    """
    n, out = len(s), []
    code = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    h = np.zeros(max(0, n - 16), np.uint64)
    for k in range(17 if n > 16 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : n - 16 + k].astype(np.uint64)
    most = n // 2 if len(np.unique(h)) < len(h) else min(16, n // 2)
    whole = n
    runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in range(1, most + 1):
        if size >= 2 * whole:  # all of it repeats a smaller block
            break
        if size > 16:
            seen = np.flatnonzero(h[: len(h) - size : size - 16] == h[size :: size - 16]) * (size - 16)
            for q, (x, y) in runs.items():
                if not len(seen):
                    break
                if size % q == 0:
                    k = np.searchsorted(x, seen, "right") - 1
                    seen = seen[(k < 0) | (seen >= y[np.maximum(k, 0)] + q - size)]
            if not len(seen):
                continue
        unequal = np.flatnonzero(code[size:] != code[:-size])
        edge = np.concatenate([[-1], unequal, [n - size]])
        on = np.diff(edge) - 1 >= size
        if not on.any():
            continue
        lo, hi = edge[:-1][on] + 1, edge[1:][on]  # characters lo to hi equal those size places on
        if hi[0] - lo[0] == n - size:
            whole = min(whole, size)
        parts, new = [(q, x, y) for q, (x, y) in runs.items() if size % q == 0], False
        for a, b in zip(lo.tolist(), hi.tolist()):
            at = np.arange(a, b - size + 1)
            for q, x, y in parts:
                k = np.searchsorted(x, at, "right") - 1
                at = at[(k < 0) | (y[np.maximum(k, 0)] - at < size - q)]
            new |= bool(len(at))
            cost = size * math.log10(_alphabet(s[a : a + size]))  # the blocks of a run have the same characters
            for i in at.tolist():
                if size > 1 or b - i >= 2:  # three characters at least
                    out.append((i, size, (size, a, i % size), cost))
        if new:
            runs[size] = lo, hi
    return out


def _spans(s: str, words: dict[str, int]) -> list[tuple[int, int, float]]:
    """(start, end, log10 guesses) of every word, date and keyboard walk in s."""
    low, out, n = s.lower(), [], len(s)
    plain = low.translate(_LEET)
    longest = max(map(len, words), default=0)
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for text, extra in ((low, 0.0), (plain, 0.6)):
                rank = words.get(text[i:j])
                if rank:
                    out.append((i, j, math.log10(rank) + extra + (0.0 if s[i:j] == low[i:j] else 0.6)))
    for i in range(n):
        m = _DATE.match(s, i)
        if m:
            out.append((i, m.end(), math.log10(365 * 150) if m.end() - i > 4 else math.log10(150)))
    i = 0
    while i < n - 2:
        j = i + 1
        while j < n and (low[j] in _NEXT.get(low[j - 1], ()) or abs(ord(low[j]) - ord(low[j - 1])) == 1 and low[j].isalnum()):
            j += 1
        if j - i >= 3:
            out.append((i, j, math.log10(47 * (j - i)) + 0.3 * (j - i)))
        i = max(i + 1, j - 1)
    return out


def guesses(value: str, words: dict[str, int] = RANK) -> float:
    """log10 of the guesses of the cheapest segmentation; 0 for the empty value."""
    if len(value.lower()) != len(value):  # letters that become two in lower case
        value = value.translate({ord(c): "?" for c in value if len(c.lower()) != 1})
    n = len(value)
    per = math.log10(_alphabet(value)) if n else 0.0
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in _spans(value, words):
        ending[j].append((i, cost))
    again: list[list[tuple[int, int, tuple[int, int, int], float]]] = [[] for _ in range(n + 1)]
    for i, size, run, cost in _repeats(value):
        again[i + max(2 * size, 3)].append((i, size, run, cost))
    # of each run, the places from which its blocks may cost least, in order, and with ever greater cost of what is before them
    held: dict[tuple[int, int, int], list[tuple[int, float]]] = {}
    # best[j][b]: the prefix of length j; b: whether it ends in a brute-force span, which goes on at no cost of a new segment
    seg = math.log10(2)
    best = [[0.0, math.inf]] + [[math.inf, math.inf] for _ in range(n)]
    for j in range(1, n + 1):
        best[j][1] = min(best[j - 1][1], best[j - 1][0] + seg) + per
        for i, cost in ending[j]:
            best[j][0] = min(best[j][0], min(best[i]) + cost + seg)
        for i, size, run, cost in again[j]:
            before, least, places = min(best[i]), math.inf, held.get(run, [])
            while places and places[-1][1] >= before:
                places.pop()
            held[run] = []
            for at, g in [*places, (i, before)]:
                # an earlier place that costs no more now never will, as the logarithms of the times come closer
                if g + math.log10((j - at) // size) < least:
                    least = g + math.log10((j - at) // size)
                    held[run].append((at, g))
            best[j][0] = min(best[j][0], least + cost + seg)
    return round(min(best[n]), 6)


class Judge:
    """guesses() under a dictionary, remembering values of up to 256 characters."""

    def __init__(self, words: dict[str, int]) -> None:
        self.words = words
        self.known: dict[str, float] = {}

    def __call__(self, value: str) -> float:
        g = self.known.get(value)
        if g is None:
            g = guesses(value, self.words)
            if len(value) <= 256:
                if len(self.known) >= 10_000:
                    self.known.clear()
                self.known[value] = g
        return g

    def __reduce__(self):
        return Judge, (self.words,)


def _values(text: Column) -> Column:
    """Array of [key, value] of the credential contexts of a text."""
    return F.when(text.rlike(_HINT), F.arrays_zip(F.regexp_extract_all(text, F.lit(CONTEXT), 1).alias("key"), F.regexp_extract_all(text, F.lit(CONTEXT), 2).alias("value")))


def scan(docs: DataFrame, words: dict[str, int] = RANK, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_GUESSES) -> DataFrame:
    """(doc_id, ord, key, hash, n_chars, guesses, secret): every value in a credential's context, with its guess cost (log10) and whether it is a secret.

    key is the word that makes it a credential's.  Values leave the operator only as
    hashes.  ord counts a document's values from 0.  Null and empty texts have none; null
    ids are kept as null; repeated rows give repeated results; texts and values are taken
    whole, however long; empty tables give no rows; other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), _values(F.col(text_col).cast("string")).alias("v")).where(F.size("v") > 0)
    judged = Judge(words)
    judge = F.arrow_udf(lambda v: _findings(v, judged, least), SCHEMA_FINDING).asNondeterministic()
    return d.select("doc_id", F.posexplode_outer(judge("v")).alias("ord", "f")).where("f is not null").select("doc_id", "ord", "f.*")


def _findings(values: pa.Array, judged: Judge, least: float) -> pa.Array:
    out = []
    for row in values.to_pylist():
        found = []
        for x in row or []:
            g = judged(x["value"])
            found.append({"key": (x["key"] or "").lower() or "key by shape", "hash": hashlib.sha256(x["value"].encode("utf-8", "surrogatepass")).hexdigest()[:16], "n_chars": len(x["value"]), "guesses": g, "secret": g >= least})
        out.append(found)
    kind = pa.list_(pa.struct([("key", pa.string()), ("hash", pa.string()), ("n_chars", pa.int32()), ("guesses", pa.float64()), ("secret", pa.bool_())]))
    return pa.array(out, kind)


_CONTEXT = re.compile(CONTEXT.replace("(?i)", ""), re.I | re.A)


def mask(text: str | None, judged: Callable[[str], float] = guesses, least: float = LEAST_GUESSES) -> str | None:
    """The text with [SECRET] in the place of every hard-to-guess value in a credential's context."""
    if text is None:
        return None
    parts, at = [], 0
    for m in _CONTEXT.finditer(text):
        if judged(m.group(2)) >= least:
            parts += [text[at : m.start(2)], "[SECRET]"]
            at = m.end(2)
    return "".join([*parts, text[at:]]) if parts else text


def redact(docs: DataFrame, words: dict[str, int] = RANK, text_col: str = "text", chars_col: str = "n_chars", least: float = LEAST_GUESSES) -> DataFrame:
    """docs with every secret masked and chars_col, where there is one, counted anew; only texts with a credential's context go through Python.

    Null and empty texts and all other columns stay as they were; every row, repeated or
    not, gives one row; empty tables stay empty.
    """
    judged = Judge(words)
    masked = F.arrow_udf(lambda t: pa.array([mask(x, judged, least) for x in t.to_pylist()], pa.string()), "string").asNondeterministic()
    text = F.col(text_col).cast("string")
    hit = F.coalesce(text.rlike(CONTEXT), F.lit(False))
    new = "masked"
    while new in docs.columns:
        new += "_"
    out = docs.withColumn(new, masked(F.when(hit, text))).withColumn(text_col, F.coalesce(new, text))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col(new).isNotNull(), F.length(text_col).cast(kind)).otherwise(F.col(chars_col)))
    return out.select(*docs.columns)
