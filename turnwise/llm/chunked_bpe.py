"""Byte-pair encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the bytes cuts a text where the content says so, hence equal
passages of different documents give equal chunks; a worker encodes each chunk
once and keeps its ids, from document to document and from task to task, as long
as they fit in a memory of fixed size. Where two chunks meet, a stretch from a
certain word boundary before the cut to one after it is encoded again; if it
begins with the ids of the left chunk's piece there and ends with those of the
right chunk's, it replaces what both had between. Where they don't agree, the
two chunks become one, which is encoded and meets its neighbours again, until all
that meet agree, at the worst in one chunk. Chunks in which no such boundary lies
go with their neighbours. So the ids are those of the text encoded in one go.

A certain boundary is a single space between two other characters that aren't
white space: every pre-tokenizer of this family starts a piece there, whatever
comes before or after. Null text is the empty text and has no ids; very long
texts are more chunks; rows that repeat an id, or have none, stay separate rows;
columns other than doc_id and text are never read, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, whole_text
from .pieces import BYTE_PIECES, PieceIds, piece_ids

#: A chunk ends where this many bits of the rolling hash are zero: 1 KiB on average.
CUT_BITS = 10
#: Bytes that a chunk has at least.
LEAST_CHUNK = 256
#: Bytes that the chunks of each of a worker's two generations take.
CHUNK_CACHE = 24 << 20
#: Documents encoded at once.
BLOCK = 400
_WINDOW = 16
_SURE = re.compile(r"(?<=\S) (?=\S)")


def _load(tokenizer: str | None) -> PieceIds:
    return piece_ids(tokenizer, "byte_bpe_50k.json", BYTE_PIECES, False)


def cuts(raw: bytes, bits: int = CUT_BITS, least: int = LEAST_CHUNK) -> list[int]:
    """Where the chunks of a text's bytes begin (0 first) and end."""
    b = np.frombuffer(raw, np.uint8)
    out = [0]
    if len(b) > least:
        h, p, width = (b.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761), 0x01000193, 1
        h ^= h >> np.uint32(15)
        while width < _WINDOW:
            g = h.copy()
            g[width:] += h[:-width] * np.uint32(pow(p, width, 1 << 32))
            h, width = g, width * 2
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x85EBCA6B)
        hits = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
        for at in hits.tolist():
            if at < _WINDOW or at - out[-1] < least:
                continue
            while at < len(b) and b[at] & 0xC0 == 0x80:  # only between characters
                at += 1
            if at < len(b):
                out.append(at)
    return [*out, len(b)]


class _Chunk:
    """A chunk with its ids, and its ends: text up to the second certain boundary from either side, and the ids of the outermost piece there."""

    __slots__ = ("text", "ids", "head", "tail", "last", "first", "head_n", "tail_n")

    def __init__(self, text: str):
        self.text, self.ids, self.head, self.tail = text, None, None, None
        self.last = self.first = None  # the piece that ends the head, and the one that begins the tail
        sure = [m.start() for _, m in zip(range(2), _SURE.finditer(text), strict=False)]
        back: list[int] = []
        a = text.rfind(" ")
        while a > 0 and len(back) < 2:
            if a + 1 < len(text) and not text[a + 1].isspace() and not text[a - 1].isspace():
                back.append(a)
            a = text.rfind(" ", 0, a)
        if len(sure) == 2 and len(back) == 2 and back[1] >= sure[1]:
            self.head, self.tail = text[: sure[1]], text[back[1] :]
            self.last, self.first = text[sure[0] : sure[1]], text[back[1] : back[0]]

    def size(self) -> int:
        return 200 + 3 * len(self.text) + (self.ids.nbytes if self.ids is not None else 0)


class Memory:
    """The chunks of a worker, the younger and the older ones."""

    def __init__(self, room: int = CHUNK_CACHE):
        self.young: dict[bytes, _Chunk] = {}
        self.old: dict[bytes, _Chunk] = {}
        self.room, self.held, self.hits = room, 0, 0

    def get(self, key: bytes) -> _Chunk | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        self.hits += found is not None
        return found

    def put(self, key: bytes, chunk: _Chunk) -> None:
        if self.held > self.room:
            self.young, self.old, self.held = {}, self.young, 0
        self.young[key] = chunk
        self.held += chunk.size()


_memories: dict[str, Memory] = {}


def _encode(model: PieceIds, chunks: list[_Chunk]) -> None:
    texts = [t for c in chunks for t in ((c.text, c.head, c.tail, c.last, c.first) if c.head is not None else (c.text,))]
    found = iter(np.frombuffer(x, model.kind) for x in model.encode(texts))
    for c in chunks:
        c.ids = next(found)
        if c.head is not None:
            c.head_n, c.tail_n, c.last, c.first = len(next(found)), len(next(found)), next(found), next(found)


def _row(raw: bytes, memory: Memory, new: list[_Chunk]) -> list[_Chunk]:
    """The chunks of a text; those without certain boundaries go with the next one, the last with those before."""
    at = cuts(raw)
    row: list[_Chunk] = []
    held = b""
    for a, b in zip(at, at[1:], strict=False):
        held += raw[a:b]
        chunk = memory.get(held)
        if chunk is None:
            chunk = _Chunk(held.decode())
            if chunk.head is not None or b == len(raw):
                memory.put(held, chunk)
                new.append(chunk)
        if chunk.head is None and b < len(raw):
            continue
        row.append(chunk)
        held = b""
    if len(row) > 1 and row[-1].head is None:
        row = [_Chunk("".join(c.text for c in row))]
        new.append(row[0])
    return row


def encode_block(model: PieceIds, texts: list[str], memory: Memory) -> list[np.ndarray]:
    """The ids of each text; ``memory`` holds the chunks met so far."""
    new: list[_Chunk] = []
    rows = [_row(t.encode(), memory, new) for t in texts]
    _encode(model, new)
    joints: dict[tuple[int, int], np.ndarray] = {}  # by the chunks that meet,
    kept = [c for row in rows for c in row]  # which live as long as it does
    waiting = list(range(len(rows)))
    while waiting:
        meets = {(id(a), id(b)): a.tail + b.head for r in waiting for a, b in zip(rows[r], rows[r][1:], strict=False) if (id(a), id(b)) not in joints}
        joints |= zip(meets, (np.frombuffer(x, model.kind) for x in model.encode(list(meets.values()))), strict=True)
        again, merged = [], []
        for r in waiting:
            out: list[_Chunk] = []
            for c in rows[r]:
                if out and not _agree(joints.get((id(out[-1]), id(c))), out[-1], c):
                    kept.append(out[-1])
                    out[-1] = _Chunk(out[-1].text + c.text)  # it meets the next chunk in the round after
                    merged.append(out[-1])
                else:
                    out.append(c)
            if len(out) < len(rows[r]):
                again.append(r)
                rows[r] = out if all(c.head is not None for c in out) or len(out) < 2 else [_Chunk("".join(c.text for c in out))]
                merged += [c for c in rows[r] if c.ids is None and c not in merged]
        _encode(model, merged)
        kept += merged
        waiting = again
    out = []
    for row in rows:
        parts: list[np.ndarray] = []
        for k, c in enumerate(row):
            parts.append(c.ids[c.head_n if k else 0 : len(c.ids) - (c.tail_n if k + 1 < len(row) else 0)])
            if k + 1 < len(row):
                parts.append(joints[id(c), id(row[k + 1])])
        out.append(np.concatenate(parts).astype("<u4") if parts else np.array([], "<u4"))
    return out


def _agree(joint: np.ndarray | None, a: _Chunk, b: _Chunk) -> bool:
    """Whether the stretch begins with the ids of the left chunk's piece there and ends with those of the right one's."""
    if joint is None:  # one of them was joined in this round
        return a.ids is None or b.ids is None
    return len(joint) >= len(a.first) + len(b.last) and np.array_equal(joint[: len(a.first)], a.first) and np.array_equal(joint[len(joint) - len(b.last) :], b.last)


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each whole text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _load(tokenizer)
        memory = _memories.setdefault(tokenizer or "", Memory())
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = part.column("text").to_pylist()
                ids = encode_block(model, texts, memory)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``encoded`` with ``text``, decoded from ``ids`` with special tokens kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _load(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = [np.frombuffer(x.as_py(), "<u4").tolist() for x in part.column("ids")]
                texts = model.model.decode_batch(ids, skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    plain = encoded.select("doc_id", "n_tokens", "ids")
    return plain.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary, text string")
