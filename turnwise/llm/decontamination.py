"""Benchmark decontamination: training documents that hold passages of test items.

The windows of the items (``size`` consecutive words; an item with fewer words
is one window) become a set of word numbers that is sent to every task; each
document's words are numbered by the items' vocabulary, and only where as many
words in a row are known is the stretch looked up. Equal numbers are equal
words, so a hit needs no further comparison. Documents are read once and never
shuffled.

The set is counted before it is sent: beyond MOST_WINDOWS rows of (window, item)
the windows are dealt to blocks, and the documents pass from block to block with
what has been found so far.

Null and empty texts have no words. Very long texts are split a stretch at a
time. Rows that repeat a doc_id, or have none, are rows of their own, as are
equal rows. An item without an id marks words but isn't counted or named; items
that share an id count once. No items leave every document as it is; with no
documents the result is empty. Columns keep their names and values, whatever
they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy
from .words import LOWER, PATTERN, UPPER, spans, words

#: (window, item) rows that are sent to every task at once.
MOST_WINDOWS = 500_000
_HITS = "array<struct<at:int,n:int,item:string>>"


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """(words, item): the different windows of each of ``items`` (item_id, text)."""
    said = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(PATTERN), F.lit(0))
    rows = items.select(F.col("item_id").cast("string").alias("item"), said.alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (size - 1), F.lit(1)))
    return rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, size))).alias("words")).distinct()


class _Known:
    """A block of windows by the numbers of their words."""

    def __init__(self, rows: list):
        self.numbers = {w: i for i, w in enumerate(sorted({w.encode() for r in rows for w in r["words"]}), 1)}
        self.windows: dict[bytes, list] = {}
        for r in rows:
            key = np.array([self.numbers[w.encode()] for w in r["words"]], np.int32).tobytes()
            self.windows.setdefault(key, []).append(r["item"])
        self.sizes = sorted({len(k) // 4 for k in self.windows})

    def find(self, raw: bytes) -> tuple[int, list[tuple[int, int, str | None]]]:
        """The number of words, and (at, n, item) for each occurrence of a window."""
        get = self.numbers.get
        ids = [np.fromiter(map(get, some, repeat(0)), np.int32, len(some)) for some in words(raw)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        found = []
        known = np.append(0, np.cumsum(ids != 0, dtype=np.int64))
        for n in self.sizes:
            for at in np.flatnonzero(known[n:] - known[:-n] == n).tolist():
                found += [(at, n, item) for item in self.windows.get(ids[at : at + n].tobytes(), ())]
        return len(ids), found


def _scan(rows: DataFrame, block: list, keep_text: bool) -> DataFrame:
    """``rows`` (doc, text, hits) with the hits of a block of windows added, and ``n_words``."""
    sent = rows.sparkSession.sparkContext.broadcast(_Known(block))
    names = ["doc", "text"] if keep_text else ["doc"]
    hit = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("item", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            counts, hits = [], []
            for text, before in zip(batch.column("text").cast(pa.binary()), batch.column("hits"), strict=True):
                n, found = known.find(text.as_py() or b"")
                counts.append(n)
                hits.append((before.as_py() or []) + [{"at": a, "n": b, "item": c} for a, b, c in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(counts, pa.int64()), pa.array(hits, hit)], [*names, "n_words", "hits"])

    doc = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc {doc}, {'text string, ' * keep_text}n_words long, hits {_HITS}")


def _found(docs: DataFrame, columns: list[str], items: DataFrame, size: int, most: int, keep_text: bool) -> DataFrame:
    """(doc[, text], n_words, hits) of every document; doc holds ``columns``."""
    asked = materialise(windows(items, size), "windows")
    blocks = max(1, -(-asked.count() // most))
    rows = docs.select(F.struct(*columns).alias("doc"), "text", F.expr(f"cast(null as {_HITS})").alias("hits"))
    for b in range(blocks):
        block = (asked.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == b) if blocks > 1 else asked).collect()  # about ``most`` rows
        last = b + 1 == blocks
        rows = _scan(rows, block, keep_text or not last)
        if not last:
            rows = materialise(rows, "scanned")
    return rows


def _covered(hits: Column) -> Column:
    """The places of all words in any occurrence."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1))))


def scan(docs: DataFrame, items: DataFrame, size: int = 10, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated): the words of each document, those in any window, and the items whose windows occur, as sorted strings."""
    rows = _found(docs, ["doc_id"], items, size, most_windows, False)
    named = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h["item"]), lambda x: x.isNotNull())))
    return rows.select(F.col("doc.doc_id").alias("doc_id"), "n_words", F.size(_covered(F.col("hits"))).cast("long").alias("n_hit"), named.alias("items"), (F.size("hits") > 0).alias("contaminated"))


def without_documents(docs: DataFrame, items: DataFrame, size: int = 10, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The documents that hold no window."""
    return _found(docs, docs.columns, items, size, most_windows, False).where(F.size("hits") == 0).select("doc.*")


def without_spans(docs: DataFrame, items: DataFrame, size: int = 10, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The documents without their hit words: each run of them goes, from its first word's start to its last one's end; n_chars follows, other columns stay."""

    def cut(raw: bytes, hits: list) -> bytes:
        hit = {p for h in hits for p in range(h["at"], h["at"] + h["n"])}
        out, at, run = [], 0, None
        for k, (a, b) in enumerate(spans(raw)):
            if k in hit:
                run = (run[0] if run else a, b)
            elif run:
                out.append(raw[at : run[0]])
                at, run = run[1], None
        if run:
            out.append(raw[at : run[0]])
            at = run[1]
        return b"".join(out) + raw[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t.as_py() if not h.as_py() else cut(t.as_py(), h.as_py()) for t, h in zip(batch.column("text").cast(pa.binary()), batch.column("hits"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.binary()).cast(pa.string()), batch.column("hits")], ["doc", "text", "hits"])

    rows = _found(docs, docs.columns, items, size, most_windows, True).select("doc", "text", "hits")
    rows = rows.mapInArrow(tidy(run), f"doc {rows.schema['doc'].dataType.simpleString()}, text string, hits {_HITS}")
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("hits") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return rows.select(*(changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


#: ``scan`` in DuckDB's SQL.
SQL = r"""
WITH said AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM asked WHERE len(w) > 0)),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM said, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, p.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM places) p JOIN windows x ON x.t = p.t AND x.n = p.n),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM said LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
