"""Tokenizer ids remembered by piece of a text.

A byte-pair tokenizer first splits a text into pieces and never merges across
them, so a text's ids are its pieces' ids in a row, and a piece that comes again
needs no second encoding. Where white space always parts pieces and is in none, what
stands between it is remembered too and is cut into pieces once. Texts outside Latin-1, where composing characters and
classes of characters need more than a short pattern, and texts that may spell a
special token are given to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from array import array

#: Pieces, and words between white space, that a worker remembers in each of two generations; characters of the longest that it remembers.
REMEMBERED, WORDS, LONGEST = 150_000, 500_000, 128
#: Where Python's split() parts a text but the pieces don't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_L = re.escape("".join(c for c in map(chr, range(256)) if c.isalpha()))
_N = "".join(c for c in map(chr, range(256)) if c.isnumeric())
_S = r"\t\n\x0b\x0c\r \x85\xa0"
#: The split patterns of the two public tokenizers, spelt out for Latin-1.
WORD_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"
BYTE_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_workers: dict[str, PieceIds] = {}


def _byte_characters() -> dict[int, str]:
    """For each character of Latin-1 the characters that byte-level vocabularies write for its UTF-8 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(256)}


class _Memory(dict):
    """The ids of pieces; of one that isn't known they come from the older generation, or are made."""

    def __init__(self, old: dict[str, bytes], make):
        super().__init__()
        self.old, self.make = old, make

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece) or self.make(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class PieceIds:
    """A tokenizer with a memory; ``encode`` gives each text's ids as little-endian bytes of type ``kind``.

    ``apart``: white space always parts pieces and is in none.
    """

    def __init__(self, path: str, pattern: str, lower: bool, apart: bool = False):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.find, self.lower, self.apart = re.compile(pattern).findall, lower, apart
        self.kind = "<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.merge, self.written = self.model.model.tokenize, _byte_characters()
        self.direct = self._merges_alone()
        self.young = _Memory({}, self._make)
        self.words = _Memory({}, self._pieces)

    def _merges_alone(self) -> bool:
        """Whether the merges alone, on a piece's bytes as they are written, give what the whole tokenizer gives."""
        known = [c for c in map(chr, range(256)) if self.find(c) == [c] and not (self.lower and c != c.lower())]
        known += [c + d for c in known for d in ("a", "\xe9", "!", "~") if self.find(c + d) == [c + d]]
        return self._encode(known) == [self._merged(p) for p in known]

    def _merged(self, piece: str) -> bytes:
        written = piece if piece.isalnum() and piece.isascii() else piece.translate(self.written)
        return array(self.code, [t.id for t in self.merge(written)]).tobytes()

    def _make(self, piece: str) -> bytes:
        return self._merged(piece) if self.direct else self._encode([piece])[0]

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.young.__getitem__, self.find(text)))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        found: list[bytes | None] = []
        for t in texts:
            try:
                t.encode("latin-1")
            except UnicodeEncodeError:
                found.append(None)
                continue
            if "<|" in t:
                found.append(None)
                continue
            if len(self.young) > REMEMBERED:
                self.young.old = {}
                self.young = _Memory(self.young, self._make)
            if len(self.words) > WORDS:
                self.words.old = {}
                self.words = _Memory(self.words, self._pieces)
            t = t.lower() if self.lower else t
            if self.apart and not any(c in t for c in _SEPARATORS):
                found.append(b"".join(map(self.words.__getitem__, t.split())))
            else:
                found.append(self._pieces(t))
        odd = iter(self._encode([t for t, p in zip(texts, found, strict=True) if p is None]))
        return [next(odd) if p is None else p for p in found]


def piece_ids(tokenizer: str | None, name: str, pattern: str, lower: bool, apart: bool = False) -> PieceIds:
    """The worker's own tokenizer, kept from task to task; ``name`` is the public file meant where no path is given."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(name)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if tokenizer not in _workers:
        _workers[tokenizer] = PieceIds(tokenizer, pattern, lower, apart)
    return _workers[tokenizer]
