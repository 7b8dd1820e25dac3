"""Similarity join of documents on word n-grams: MinHash banding, exact verification.

A text is the set of its runs of ``n`` lower-cased, white-space separated words
(of all its words, if it has fewer). Sets get ``bands`` x ``rows`` minimum
hashes, numbers chosen for the recall wanted at the threshold; sets that agree
on all rows of a band meet in a shuffle on the band's hash and are linked to the
smallest set that they meet. The clusters these links make hold every candidate
pair, and inside a cluster all pairs are verified on the full sets, in blocks of
bounded size, by counting common n-grams in matrix products. Two sets whose
Jaccard similarity is at least the threshold are linked; documents with the same
set are one vertex, and linked vertices share a class.

No pair is ever a row: blocks give each vertex's number of links and local class
only. Null and empty texts have no n-grams and match nothing; repeated rows are
copies; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, parts, settled, tidy, whole_text

#: Vertices of a cluster that are compared at once: two such blocks are all that a task holds.
BLOCK = 256
#: n-grams that one matrix product covers.
COLUMNS = 4096
WORD_CACHE = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float, recall: float, rows: int = 5) -> tuple[int, int]:
    """The bands and rows that find a pair at the threshold with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of words, remembered up to WORD_CACHE words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes in a row, and where each text's begin (one more for the end)."""
        import xxhash

        if len(self.known) > WORD_CACHE:
            self.known = {}
        words = [t.lower().split() for t in texts]
        known = self.known
        for w in set().union(*words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=at[1:])
        flat = np.fromiter((h for w in words for h in map(known.__getitem__, w)), np.uint64, int(at[-1]))
        return flat, at


def shingle_sets(words: Words, texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted different n-gram hashes of each text."""
    flat, at = words.hashes(texts)
    run = flat.copy()
    for k in range(1, min(n, len(flat))):
        run[: len(flat) - k] = _mix(run[: len(flat) - k] * _MIX + flat[k:] + np.uint64(k))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(run[a : b - n + 1]))
        elif b > a:  # fewer words than n: all of them are its only n-gram
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in flat[a:b]:
                    h = _mix((h * _MIX + x).reshape(1))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.array([], np.uint64))
    return out


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(row, doc_id, key, size, bands): each text's set by a 128-bit key, its size and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                sets = shingle_sets(words, part.column("text").to_pylist(), n)
                keys = [set_key(s) if len(s) else None for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                found = np.zeros((len(full), bands * rows), np.uint64)
                if full:
                    grams = np.concatenate([sets[i] for i in full])
                    grams = _mix(grams)
                    starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
                    for k, seed in enumerate(seeds):
                        h = grams * seed
                        h ^= h >> np.uint64(29)
                        found[:, k] = np.minimum.reduceat(h, starts)
                key = np.arange(1, bands + 1, dtype=np.uint64)[None] * np.uint64(0xD6E8FEB86659FD93) + np.zeros((len(full), 1), np.uint64)
                for r in range(rows):
                    key = _mix(key * _MIX + found[:, r::rows][:, :bands])
                hashes: list = [None] * part.num_rows
                for i, k in zip(full, key.view(np.int64), strict=True):
                    hashes[i] = k
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(hashes, pa.list_(pa.int64()))],
                    ["row", "doc_id", "key", "size", "bands"],
                )

    rows_in = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows_in.mapInArrow(tidy(run), "row long, doc_id long, key binary, size int, bands array<long>")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set on the left shares with each on the right."""
    if len(left) * len(right) <= 36:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left]).reshape(len(left), len(right))
    every = np.concatenate([*left, *right])
    names, place, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    keep = count[place] > 1
    column, owner = shared[place[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        block = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        block[owner[a:b], column[a:b] - c] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return np.rint(out).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, one key after the other, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in keys], 1)
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(k[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def verify(members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(node, n_links, local): links found in each block pair, and the smallest vertex reached by them there.

    ``members`` has (root, i, j, mine, node, grams): a vertex of cluster ``root``
    in block ``mine``, sent to the pair of blocks i <= j.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["root", "i", "j"]):
            node = group.column("node").to_numpy()
            _, first = np.unique(node, return_index=True)  # a repeated row comes once
            group = group.take(first)
            node, mine = group.column("node").to_numpy(), group.column("mine").to_numpy()
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("grams")]
            size = np.array([len(s) for s in sets])
            a = np.flatnonzero(mine == i)
            b = np.flatnonzero(mine == j)
            if not len(a) or not len(b):
                continue
            both = common_counts([sets[x] for x in a], [sets[x] for x in b])
            either = size[a][:, None] + size[b][None] - both
            linked = both * denominator >= either * numerator
            if i == j:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(node), np.int64)
            links[a] += linked.sum(1)
            if i != j:
                links[b] += linked.sum(0)
            local = np.arange(len(node))
            p, q = np.nonzero(linked)
            p, q = a[p], b[q]
            while True:  # the smallest vertex reached, by halving paths
                low = local.copy()
                np.minimum.at(low, p, local[q])
                np.minimum.at(low, q, local[p])
                low = low[low]
                if (low == local).all():
                    break
                local = low
            keep = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[keep]), pa.array(links[keep]), pa.array(node[local[keep]])], ["node", "n_links", "local"]
            )

    keyed = members.repartition(parts(members.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return keyed.mapInArrow(tidy(run), "node long, n_links long, local long")


def classes(
    docs: DataFrame, n: int = 5, numerator: int = 4, denominator: int = 5, recall: float = 0.9999, block: int = BLOCK
) -> DataFrame:
    """One row per document: row, doc_id, set_id, class_id, n_links.

    The similarity wanted is numerator / denominator. ``set_id`` is the smallest
    doc_id with the same set of n-grams, ``class_id`` the smallest of the class,
    ``n_links`` the number of other sets that are similar enough.
    """
    return settled(docs.sparkSession, "ngram-classes", lambda: _classes(docs, n, numerator, denominator, recall, block))


def _classes(docs: DataFrame, n: int, numerator: int, denominator: int, recall: float, block: int) -> DataFrame:
    bands, rows = banding(numerator / denominator, recall)
    sketches = materialise(sketch(docs, n, bands, rows), "minhash")
    sets = sketches.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("set_id"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("_any")
    )
    sets = materialise(sets, "sets")
    bands_of = sketches.join(sets.select("node"), F.col("row") == F.col("node"), "left_semi").select(
        F.col("row").alias("node"), F.explode("bands").alias("band")
    )
    met = bands_of.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = bands_of.join(met, "band").where(F.col("node") != F.col("least")).select(F.col("node").alias("a"), F.col("least").alias("b"))
    clusters = materialise(components(stars, "candidates"), "clusters")
    sized = clusters.groupBy("root").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    placed = (
        clusters.join(sized, "root")
        .withColumn("blocks", blocks)
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(sets, "node")
        .select("root", "node", "blocks", "mine", "key", F.col("_any").alias("doc"))
    )
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), whole_text().alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = shingle_sets(words, part.column("text").to_pylist(), n)
                same = [set_key(s) == k.as_py() for s, k in zip(found, part.column("key"), strict=True)]
                take = pa.array(np.flatnonzero(same))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(take) for c in ("root", "node", "blocks", "mine")), pa.array([s.tobytes() for s, ok in zip(found, same, strict=True) if ok], pa.binary())],
                    ["root", "node", "blocks", "mine", "grams"],
                )

    full = placed.hint("merge").join(texts, "doc").drop("doc").mapInArrow(tidy(gather), "root long, node long, blocks int, mine int, grams binary")
    sent = full.select("root", "node", "mine", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "grams"
    )
    found = materialise(verify(sent, numerator, denominator), "links")
    linked = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("local").alias("b")), "classes")
    named = (
        sets.join(linked, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    )
    least = named.groupBy("root").agg(F.min("set_id").alias("class_id"))
    named = named.join(least, "root").select("key", "set_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return sketches.select("row", "doc_id", "key").join(named, "key", "left").select(
        "row", "doc_id", F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents without those that have an earlier one (smaller doc_id) in their class."""
    found = classes(docs, **how)
    first = found.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id"))).select("doc_id").distinct()
    kept = docs.join(first.hint("merge"), docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")
    return kept
