"""Ranked lexical search of a stated set of items over all documents, by a threshold-seeded join.

The documents are read once; of each the index keeps its length and how often it
holds each term that an item asks for. For every term the k-th largest impact is
stored: k documents hold the term with at least that impact, so an item's k-th
score is at least the largest of its terms' stored impacts (times the term's
repeats in the item). That seeds the item's threshold. With an item's terms in
the order of their largest possible parts, the terms from which on the sum of
the largest parts (the suffix bound) stays below the threshold can't bring a
document into the best k by themselves: they generate no candidates. The other
terms are joined with the index; a candidate whose parts so far and suffix bound
together stay below the threshold goes, the rest are scored exactly. The
threshold of a task rises as its own k-th scores do. Documents that reach the
threshold just are kept, so ties are decided by the id and nothing is lost.

Only an item's k best of each task are shuffled, however common a term is. What
is sent to every task, the items' terms with their bounds, is counted first and
kept below MOST_TERMS rows; more items than that are searched in blocks.

Null and empty texts have no terms: such documents don't count, and such items
find nothing. Rows that repeat an id are documents of their own; ids that are
null come last among equal scores. Equal rows of the items count once, rows that
share an id but not the text are ranked apart. Very long texts are split a
stretch at a time. Columns other than the id and the text are never read,
whatever their names. With no documents or no items the result is empty.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import empty, materialise, settled, tidy
from .words import LOWER, PATTERN, UPPER, words

#: (item, term) rows that are sent to every task at once.
MOST_TERMS = 400_000
# Fixed values of the score: the scale of an impact and of a term's weight, and the two parts of the length's influence in hundredths.
SCALE, WEIGHT, FLAT, SLOPE = 1_000_000_000, 1000, 25, 75
_RESULT = "item_id {}, rank int, doc_id long, score long"
_NO_ID = np.iinfo(np.int64).max


@dataclass
class Asked:
    """Items and their terms, each item's from the largest possible part to the smallest."""

    starts: np.ndarray  # by item: where its terms begin, and a last end
    terms: np.ndarray
    repeats: np.ndarray
    after: np.ndarray  # by place: the sum of the largest parts from there to the item's end
    floor: np.ndarray  # by item: what its k-th score is at least
    weights: np.ndarray  # by term


def _asked_terms(items: DataFrame) -> DataFrame:
    """(item, term, repeats) of (item, text)."""
    term = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(PATTERN), F.lit(0)))
    return items.select("item", term.alias("term")).groupBy("item", "term").agg(F.count("*").alias("repeats"))


def _index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with any term: its terms with repeats, and those asked for with their number."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            keep, lengths, sizes, terms, tfs = [], [], [], [], []
            for row, text in enumerate(batch.column("text").cast(pa.binary())):
                n, held = 0, Counter()
                for some in words(text.as_py() or b""):
                    n += len(some)
                    held.update(map(get, some))
                held.pop(None, None)
                if n:
                    keep.append(row)
                    lengths.append(n)
                    sizes.append(len(held))
                    terms += held.keys()
                    tfs += held.values()
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, terms array<int>, tfs array<int>")


def _postings(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's postings by term and place: the terms, the documents' places, and the impacts before the terms' weights."""
    sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(batch.num_rows), sizes)
    term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
    m = FLAT + (SLOPE * batch.column("n").to_numpy() * n_docs) // n_terms
    impact = (SCALE * tf) // (1000 * tf + 8 * m[doc])
    order = np.argsort(term, kind="stable")
    return term[order], doc[order], impact[order]


def _first_of_each(groups: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their group; equal groups stand together."""
    begins = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)
    place = np.arange(len(groups)) - np.repeat(begins, np.diff(np.append(begins, len(groups))))
    return place < k


def _impacts(index: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(term, impact, docs): of each task the k largest impacts of each term, and with the first of them the task's documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, impacts, held = np.zeros(0, np.int64), np.zeros(0, np.int64), Counter()
        for batch in batches:
            term, _, impact = _postings(batch, n_docs, n_terms)
            names, counts = np.unique(term, return_counts=True)
            held.update(dict(zip(names.tolist(), counts.tolist(), strict=True)))
            terms, impacts = np.append(terms, term), np.append(impacts, impact)
            order = np.lexsort((-impacts, terms))
            terms, impacts = terms[order], impacts[order]
            keep = _first_of_each(terms, k)
            terms, impacts = terms[keep], impacts[keep]
        docs = np.where(_first_of_each(terms, 1), [held[t] for t in terms.tolist()], 0) if len(terms) else impacts
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(impacts), pa.array(docs.astype(np.int64))], ["term", "impact", "docs"])

    return index.select("n", "terms", "tfs").mapInArrow(tidy(run), "term int, impact long, docs long")


def _seeded(rows: list, n_docs: int, stats: dict[int, tuple[int, int, int]], n_vocabulary: int, n_items: int, k: int) -> Asked:
    """Bounds and thresholds of (item, term, repeats) rows from each term's documents, largest and k-th impact."""
    df, top, kth = (np.array([stats.get(t, (0, 0, 0))[i] for t in range(n_vocabulary)], np.int64) for i in range(3))
    weights = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    item, term, repeats = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    most = repeats * weights[term] * top[term]
    order = np.lexsort((term, -most, item))
    item, term, repeats, most = item[order], term[order], repeats[order], most[order]
    starts = np.searchsorted(item, np.arange(n_items + 1))
    total = np.append(0, np.cumsum(most))
    after = total[starts[1:]][item] - total[:-1]
    floor = np.zeros(n_items, np.int64)
    np.maximum.at(floor, item, repeats * weights[term] * kth[term])  # no k documents hold a term whose k-th impact is 0
    return Asked(starts, term, repeats, after, floor, weights)


def _score_batch(batch: pa.RecordBatch, asked: Asked, by_term: tuple[np.ndarray, np.ndarray], n_docs: int, n_terms: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, places, scores) of the batch's documents that may be among an item's best: all those that reach its threshold."""
    term, doc, impact = _postings(batch, n_docs, n_terms)
    part = asked.weights[term] * impact
    names, first = np.unique(term, return_index=True)
    ends = np.append(first, len(term)).tolist()
    where = dict(zip(names.tolist(), zip(ends, ends[1:], strict=False), strict=False))
    starts, items = by_term
    for i in np.unique(np.concatenate([items[starts[t] : starts[t + 1]] for t in where] or [items[:0]])).tolist():
        a, b = asked.starts[i], asked.starts[i + 1]
        least = max(int(floor[i]), 1)
        leading = a + int(np.count_nonzero(asked.after[a:b] >= least))  # the terms that generate candidates
        total = np.zeros(batch.num_rows, np.int64)
        for p in range(a, leading):
            if at := where.get(int(asked.terms[p])):
                rows = slice(*at)
                total[doc[rows]] += asked.repeats[p] * part[rows]
        found = np.flatnonzero(total)
        rest = asked.after[leading] if leading < b else 0
        found = found[total[found] + rest >= least]
        score = total[found]
        for p in range(leading, b):
            if len(found) and (at := where.get(int(asked.terms[p]))):
                rows = slice(*at)
                near = np.minimum(np.searchsorted(doc[rows], found), at[1] - at[0] - 1)
                score += np.where(doc[rows][near] == found, asked.repeats[p] * part[rows][near], 0)
        enough = score >= least
        if enough.any():
            yield i, found[enough], score[enough]


def _best(index: DataFrame, asked: Asked, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each task the k best documents of each item that can be among the k best of all."""
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        floor, kept = asked.floor.copy(), {}
        leads = asked.after >= np.maximum(np.repeat(asked.floor, np.diff(asked.starts)), 1)
        owner = np.repeat(np.arange(len(floor)), np.diff(asked.starts))
        order = np.argsort(asked.terms[leads], kind="stable")
        by_term = np.searchsorted(asked.terms[leads][order], np.arange(len(asked.weights) + 1)), owner[leads][order]
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            for i, rows, score in _score_batch(batch, asked, by_term, n_docs, n_terms, floor):
                scores, names = np.append(kept[i][0], score) if i in kept else score, np.append(kept[i][1], ids[rows]) if i in kept else ids[rows]
                order = np.lexsort((names, -scores))[:k]
                kept[i] = scores[order], names[order]
                if len(order) == k:
                    floor[i] = max(floor[i], scores[order[-1]])
        out = [(i, int(d), int(s)) for i, (scores, names) in kept.items() for s, d in zip(scores, names, strict=True)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array([None if d == _NO_ID else d for d in columns[1]], pa.int64()), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(tidy(run), "item int, doc_id long, score long")


def _search_block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of a block of (item, term, repeats)."""
    schema = "item long, rank int, doc_id long, score long"
    asked = terms.collect()  # about MOST_TERMS rows
    if not asked:
        return empty(docs.sparkSession, schema)
    vocabulary = {t: i for i, t in enumerate(sorted({r["term"].encode() for r in asked}))}
    numbers = {x: i for i, x in enumerate(sorted({r["item"] for r in asked}))}
    index = materialise(_index(docs, vocabulary), "search-index")
    n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return empty(docs.sparkSession, schema)
    largest = materialise(_impacts(index, n_docs, n_terms, k), "impacts")
    ranked = largest.withColumn("at", F.row_number().over(W.Window.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("at") <= k)
    stored = ranked.groupBy("term").agg(F.max("impact").alias("top"), F.max(F.when(F.col("at") == k, F.col("impact"))).alias("kth"))
    counts = largest.groupBy("term").agg(F.sum("docs").alias("df"))
    stats = {r["term"]: (r["df"], r["top"], r["kth"] or 0) for r in counts.join(stored, "term").collect()}  # a row for each term asked for
    rows = [(numbers[r["item"]], vocabulary[r["term"].encode()], r["repeats"]) for r in asked]
    seeded = _seeded(rows, n_docs, stats, len(vocabulary), len(numbers), k)
    best = materialise(_best(index, seeded, n_docs, n_terms, k), "best")
    place = F.row_number().over(W.Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = docs.sparkSession.createDataFrame(list(numbers.items()), "name long, item int")
    top = best.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "item")  # at most MOST_TERMS rows
    return top.select(F.col("name").alias("item"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, most_terms: int = MOST_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each of ``items`` (item_id, text) with a score above 0.

    ``docs`` has doc_id, a whole number, and text. Equal scores go by ascending doc_id.
    """
    spark = docs.sparkSession
    kind = items.select("item_id").schema["item_id"].dataType.simpleString()

    def made() -> DataFrame:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
        listed = materialise(items.select("item_id", "text").distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
        terms = materialise(_asked_terms(listed), "item-terms")
        blocks = max(1, -(-terms.count() // most_terms))
        found = None
        for b in range(blocks):
            some = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else terms
            best = materialise(_search_block(rows, some, k), "found")
            found = best if found is None else found.unionByName(best)
        return found.join(listed.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")

    return settled(spark, "ranked-search", made)


#: The same search in DuckDB's SQL: every document scored for every item.
SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, corpus GROUP BY 1),
asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""
