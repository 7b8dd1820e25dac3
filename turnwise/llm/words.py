"""Words of whole texts as UTF-8 bytes: maximal runs of letters A-Z and a-z, digits and characters beyond ASCII; only A-Z are lower-cased."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: The same words for Spark's regular expressions, after A-Z have been lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text that are split at once.
SEGMENT = 1 << 20
_find = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_spans = re.compile(rb"[0-9A-Za-z\x80-\xff]+").finditer
_other = re.compile(rb"[^0-9A-Za-z\x80-\xff]").search


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The words in order, in lists of those of about SEGMENT bytes; a word is never cut."""
    at = 0
    while at < len(raw):
        end = at + SEGMENT
        if end < len(raw):
            gap = _other(raw, end)
            end = gap.end() if gap else len(raw)
        yield _find(raw[at:end].lower())
        at = end


def spans(raw: bytes) -> Iterator[tuple[int, int]]:
    """Where each word begins and ends, in bytes."""
    return (m.span() for m in _spans(raw))
