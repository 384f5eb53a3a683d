"""Operator 9: licence scans.

An Aho-Corasick automaton finds identifier tags and notice phrases in one pass over
a text; a shunting-yard parser turns the expression after a tag into postfix form
and evaluates its and/or/with over the known licences.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as K

SCHEMA = "doc_id long, source string, expression string, licenses array<string>, category string, first_char int, occurrences int"
TAG = "spdx-license-identifier:"
#: Category of each licence, from the freest: an `or` takes the freer side, an `and` the stricter.
ORDER = ["public-domain", "permissive", "weak-copyleft", "strong-copyleft", "non-commercial", "proprietary", "unknown"]
KNOWN = {
    "CC0-1.0": "public-domain", "Unlicense": "public-domain", "0BSD": "public-domain", "WTFPL": "public-domain", "MIT-0": "public-domain", "PDDL-1.0": "public-domain", "blessing": "public-domain",
    "MIT": "permissive", "Apache-2.0": "permissive", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "ISC": "permissive", "Zlib": "permissive", "CC-BY-4.0": "permissive", "BSL-1.0": "permissive",
    "Apache-1.1": "permissive", "Artistic-2.0": "permissive", "PostgreSQL": "permissive", "Python-2.0": "permissive", "PSF-2.0": "permissive", "NCSA": "permissive", "X11": "permissive", "curl": "permissive", "libpng-2.0": "permissive", "UPL-1.0": "permissive", "AFL-3.0": "permissive", "BSD-3-Clause-Clear": "permissive", "BSD-4-Clause": "permissive", "PHP-3.01": "permissive", "Ruby": "permissive", "TCL": "permissive", "Unicode-3.0": "permissive", "Vim": "permissive", "W3C": "permissive", "ZPL-2.1": "permissive", "FTL": "permissive", "ICU": "permissive", "HPND": "permissive", "MS-PL": "permissive", "MulanPSL-2.0": "permissive", "BlueOak-1.0.0": "permissive", "CC-BY-1.0": "permissive", "CC-BY-2.0": "permissive", "CC-BY-2.5": "permissive", "CC-BY-3.0": "permissive", "OFL-1.1": "permissive", "ODC-By-1.0": "permissive", "CDLA-Permissive-2.0": "permissive",
    "LGPL-2.0": "weak-copyleft", "MPL-1.1": "weak-copyleft", "EPL-1.0": "weak-copyleft", "CDDL-1.0": "weak-copyleft", "CDDL-1.1": "weak-copyleft", "CPL-1.0": "weak-copyleft", "IPL-1.0": "weak-copyleft", "MS-RL": "weak-copyleft", "CC-BY-SA-2.0": "weak-copyleft", "CC-BY-SA-2.5": "weak-copyleft", "CC-BY-SA-3.0": "weak-copyleft", "ODbL-1.0": "weak-copyleft", "APSL-2.0": "weak-copyleft", "LPPL-1.3c": "weak-copyleft", "EUPL-1.1": "weak-copyleft",
    "GPL-1.0": "strong-copyleft", "AGPL-1.0": "strong-copyleft", "EUPL-1.2": "strong-copyleft", "OSL-3.0": "strong-copyleft", "SSPL-1.0": "strong-copyleft", "CECILL-2.1": "strong-copyleft", "GFDL-1.2": "strong-copyleft", "GFDL-1.3": "strong-copyleft", "Sleepycat": "strong-copyleft", "QPL-1.0": "strong-copyleft",
    "CC-BY-NC-2.0": "non-commercial", "CC-BY-NC-3.0": "non-commercial", "CC-BY-NC-SA-3.0": "non-commercial", "CC-BY-NC-ND-3.0": "non-commercial", "CC-BY-ND-4.0": "proprietary", "PolyForm-Noncommercial-1.0.0": "non-commercial", "BUSL-1.1": "proprietary", "Elastic-2.0": "proprietary",
    "LGPL-2.1": "weak-copyleft", "LGPL-3.0": "weak-copyleft", "MPL-2.0": "weak-copyleft", "EPL-2.0": "weak-copyleft", "CC-BY-SA-4.0": "weak-copyleft",
    "GPL-2.0": "strong-copyleft", "GPL-3.0": "strong-copyleft", "AGPL-3.0": "strong-copyleft",
    "CC-BY-NC-4.0": "non-commercial", "CC-BY-NC-SA-4.0": "non-commercial", "CC-BY-NC-ND-4.0": "non-commercial", "LicenseRef-Proprietary": "proprietary",
}
#: Exceptions that make the licence before `with` one step freer.
EXCEPTIONS = {"classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "linux-syscall-note", "autoconf-exception-3.0", "bison-exception-2.2", "autoconf-exception-2.0", "classpath-exception-1.0", "font-exception-2.0", "freertos-exception-2.0", "gcc-exception-2.0", "gpl-cc-1.0", "openvpn-openssl-exception", "qt-gpl-exception-1.0", "u-boot-exception-2.0", "wxwindows-exception-3.1", "gpl-3.0-linking-exception", "lgpl-3.0-linking-exception", "ocaml-lgpl-linking-exception", "fltk-exception", "mif-exception", "libtool-exception"}
PHRASES = {
    "apache license, version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0",
    "mit license": "MIT", "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "gnu general public license, version 3": "GPL-3.0", "gnu general public license version 3": "GPL-3.0", "gnu general public license v3": "GPL-3.0",
    "gnu general public license, version 2": "GPL-2.0", "gnu general public license version 2": "GPL-2.0",
    "gnu lesser general public license, version 3": "LGPL-3.0", "gnu lesser general public license version 3": "LGPL-3.0", "gnu lesser general public license, version 2.1": "LGPL-2.1", "gnu lesser general public license version 2.1": "LGPL-2.1",
    "gnu affero general public license": "AGPL-3.0", "mozilla public license, version 2.0": "MPL-2.0", "mozilla public license version 2.0": "MPL-2.0", "eclipse public license 2.0": "EPL-2.0",
    "redistribution and use in source and binary forms": "BSD-3-Clause", "bsd 3-clause": "BSD-3-Clause", "bsd 2-clause": "BSD-2-Clause", "isc license": "ISC", "zlib license": "Zlib", "boost software license": "BSL-1.0",
    "cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0", "cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0", "cc by-nc 4.0": "CC-BY-NC-4.0", "cc by-sa 4.0": "CC-BY-SA-4.0", "cc by 4.0": "CC-BY-4.0",
    "creative commons attribution 4.0": "CC-BY-4.0", "creative commons attribution-sharealike 4.0": "CC-BY-SA-4.0", "creative commons attribution-noncommercial 4.0": "CC-BY-NC-4.0",
    "cc0 1.0": "CC0-1.0", "released into the public domain": "Unlicense", "all rights reserved": "LicenseRef-Proprietary",
}
_LOWER = {k.lower(): k for k in KNOWN}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")
_EXPRESSION = re.compile(r"[ \t]*((?:[A-Za-z0-9.+()-]+[ \t]*)+)")


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order by shunting-yard (with binds before and, and before or); None if malformed, as where with meets a parenthesis."""
    strength = {"or": 1, "and": 2, "with": 3}
    out, stack, operand, last = [], [], True, ""
    for token in _TOKEN.findall(expression):
        op, before, last = token.lower(), last, token.lower()
        if before == "with" and op == "(" or op == "with" and before == ")":
            return None
        if op in strength:
            if operand:
                return None
            while stack and stack[-1] != "(" and strength[stack[-1]] >= strength[op]:
                out.append(stack.pop())
            stack.append(op)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def normal(token: str) -> str:
    """A licence identifier in its known spelling, without -only, -or-later and +."""
    t = re.sub(r"(-only|-or-later|\+)$", "", token, flags=re.I)
    return _LOWER.get(t.lower(), t)


def evaluate(expression: str) -> tuple[list[str], str]:
    """Licences named by an expression, each once and in order of their places, and the category it comes to; ([], 'unknown') if malformed.

    ``with`` stands between one licence and one exception; anything else is malformed.
    """
    order = postfix(expression)
    if order is None:
        return [], "unknown"
    # of each operand its category and the licences in it; a lone name is an operand that with can take
    stack: list[tuple[int, list[str], bool]] = []
    for token in order:
        op = token.lower()
        if op == "with":
            (_, right, single), (a, left, plain) = stack.pop(), stack.pop()
            if not (single and plain):
                return [], "unknown"
            freer = right[0].lower() in EXCEPTIONS and ORDER.index("weak-copyleft") <= a <= ORDER.index("strong-copyleft")
            stack.append((a - freer, [f"{left[0]} WITH {right[0]}"], False))
        elif op in ("and", "or"):
            (b, right, _), (a, left, _) = stack.pop(), stack.pop()
            stack.append((max(a, b) if op == "and" else min(a, b), left + right, False))
        else:
            name = normal(token)
            stack.append((ORDER.index(KNOWN.get(name, "unknown")), [name], True))
    return list(dict.fromkeys(stack[-1][1])), ORDER[stack[-1][0]]


def tag_expression(rest: str) -> str:
    """The longest well-formed expression at the start of what follows a tag on its line."""
    m = _EXPRESSION.match(rest)
    tokens = _TOKEN.findall(m.group(1)) if m else []
    best, depth = 0, 0
    for k, t in enumerate(tokens):
        depth += (t == "(") - (t == ")")
        joined = k and tokens[k - 1].lower() not in ("and", "or", "with", "(") and t.lower() not in ("and", "or", "with", ")")
        if depth < 0 or joined:
            break
        if depth == 0 and t != "(" and t.lower() not in ("and", "or", "with"):
            best = k + 1
    return " ".join(tokens[:best]).replace("( ", "(").replace(" )", ")")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, licence in {**PHRASES, TAG: ""}.items():
        a.add_word(phrase, (phrase, licence))
    a.make_automaton()
    return a


def findings(text: str, a: ahocorasick.Automaton) -> list[tuple[str, str, list[str], str, int, int]]:
    """(source, expression, licences, category, first character, occurrences) of a text, by first occurrence."""
    low = text.lower()
    whole = text if len(low) == len(text) else low
    out: dict[tuple[str, str], list] = {}
    # phrases may be wrapped: every run of white space is matched as one blank
    flat = " ".join(low.split())
    hits = list(a.iter(flat))
    place, at, n = [], [], 0
    if hits:
        for m in re.finditer(r"\S+", low):
            place.append(n)
            at.append(m.start())
            n += m.end() - m.start() + 1

    def original(k: int) -> int:
        w = bisect_right(place, k) - 1
        return at[w] + k - place[w]

    for end, (phrase, licence) in hits:
        start = end - len(phrase) + 1
        before, after = flat[start - 1 : start], flat[end + 1 : end + 2]
        start, end = original(start), original(end)
        if licence:
            if before.isalnum() or after.isalnum():
                continue
            key, value = ("notice", licence), ([licence], KNOWN[licence])
        else:
            expression = tag_expression(whole[end + 1 :].split("\n", 1)[0] if len(whole) - end < 4096 else whole[end + 1 : whole.find("\n", end + 1) if "\n" in whole[end + 1 :] else None])
            if not expression:
                continue
            key, value = ("tag", expression), evaluate(expression)
        if key in out:
            out[key][5] += 1
        else:
            out[key] = [*key, *value, start, 1]
    return [tuple(v) for v in sorted(out.values(), key=lambda v: (v[4], v[0], v[1]))]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, expression, licenses, category, first_char, occurrences): one row for each different notice or tag expression of a document.

    Matching ignores case and takes any run of white space as a blank; offsets count characters of the lower-cased text from 0.
    Null and empty texts have no findings; texts are taken whole, however long; null ids
    are kept as null; repeated rows give repeated results; malformed expressions have no
    licences and category unknown; empty tables give no rows; other columns are not read.
    """
    kept: list[ahocorasick.Automaton] = []

    def f(part: pa.RecordBatch) -> pa.RecordBatch:
        if not kept:
            kept.append(automaton())
        ids, rows = [], []
        for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            found = findings(text, kept[0]) if text else []
            rows += found
            ids += [i] * len(found)
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=["doc_id", "source", "expression", "licenses", "category", "first_char", "occurrences"])

    return K.map_steps(K.ids_and_text(docs, id_col, text_col), f, SCHEMA)
