"""Text helpers in plain Python, for the parsing step; functions.text has them as Spark columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import regex

from ..operators.htmltree import WS, collapse

RESERVED = ("facts", "intro", "toc")
_CUT_TAIL = re.compile(f"[{WS},;:]+$")
_SENTENCE = re.compile(f"(?<=[!?.…。．！？])[{WS}]+")
_DATE = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2})")
_JOINT = re.compile(f"[{WS}/–—·]+")
_NOT_ID = regex.compile(r"[^\p{N}\p{L}_-]+")
_ID = regex.compile(r"[\p{N}\p{L}][\p{N}\p{L}_-]{0,63}")
_PART = re.compile(r"part-[0-9]+")


def units(text: str) -> int:
    """Budget units: a quarter of the UTF-8 bytes, rounded up."""
    return (len(text.encode("utf-8", "surrogatepass")) + 3) // 4


def normalize(text: str) -> str:
    return collapse(unicodedata.normalize("NFC", text))


def truncate_at_word(text: str, most: int) -> str:
    """At most ``most`` characters, cut at a space beyond the half, with an ellipsis if cut."""
    if len(text) <= most:
        return text
    head = text[:most]
    space = head.rfind(" ")
    return _CUT_TAIL.sub("", head[:space] if space > most * 0.5 else head) + "…"


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(collapse(text)) if s]


def first_sentence(text: str) -> str:
    return _SENTENCE.split(collapse(text), maxsplit=1)[0]


def iso_date(value: str | None) -> str | None:
    m = _DATE.search(value) if value else None
    return m.group(1) if m else None


def slugify(text: str) -> str:
    s = _NOT_ID.sub("", _JOINT.sub("-", unicodedata.normalize("NFC", text).lower()))
    s = re.sub("-{2,}", "-", s).strip("-")
    if len(s) > 64:
        dash = s[:64].rfind("-")
        s = s[:dash] if dash > 32 else s[:64]
    return s or "section"


def valid_id(value: str | None) -> bool:
    return bool(value) and _ID.fullmatch(value) is not None and not _PART.fullmatch(value)


class Slugs:
    """Gives each slug once: a taken or reserved one gets the next free number."""

    def __init__(self, taken: Iterable[str] = RESERVED):
        self.last = dict.fromkeys(taken, 1)

    def claim(self, slug: str) -> str:
        if slug not in self.last:
            self.last[slug] = 1
            return slug
        n = self.last[slug] + 1
        while f"{slug}-{n}" in self.last:
            n += 1
        self.last[slug] = n
        self.last[f"{slug}-{n}"] = 1
        return f"{slug}-{n}"
