"""Approximate nearest neighbours by inner product: multi-index hashing.

Vectors get one more component that makes their lengths equal, so that the
largest inner product is the nearest direction; they are centred and turned by a
rotation learned so that the signs lose little (alternating between signs and
the orthogonal map that fits them best), and the signs are the code. The rows are
dealt by their hash into slices, each row once. In a slice the codes are split
into substrings of a byte, and each substring has its own index: the rows in the
order of the byte, and where each of its values begins. With m substrings and a
Hamming radius of R = m * r + a (a < m), a code within R of a query's has a byte
within r of the query's among the first a + 1, or one within r - 1 among the
others (pigeonhole). So a query looks up the values in those balls around its
bytes, which retrieves every such code; by the whole code's distance those beyond
R go, by the earlier bytes' distances those found before, and only what is left,
each row once, is ranked by inner products of the original vectors in double
precision. ``reranked`` tells of each query how many those were.

The rotation and the radius are fitted on at most ``sample`` rows, those with the
smallest hash of their id; every row is indexed. The queries are a set of their
own: each goes to every slice, in whose task blocks of queries pass by the index
and leave their best rows, never the pairs. So the rows move once, and what moves
besides is the queries times the slices, whose number follows the cluster's,
within LEAST to SLICE rows a slice. Queries for which the
radius holds fewer rows than wanted search again without a radius. Vectors that
are null, zero or hold null or non-finite components take no part, nor do rows
with a null vec_id; vectors of different lengths have no inner product and are an
error (ValueError); ties go to the smaller vec_id; copies of a vector are rows like
others; rows that repeat a vec_id are candidates each, no row with the query's
own vec_id is, and as a query the smallest of its vectors counts; columns other
than vec_id and embedding are never read, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialise, parts, tidy

BITS, SUBSTRINGS = 64, 8
#: Pairs whose codes are compared together or that wait to be ranked, queries that pass by together, and rows that a slice has at most, and that are worth one.
PAIRS, QUERIES, SLICE, LEAST = 1 << 18, 1024, 1 << 17, 1 << 11
_OUT = "query_id long, vec_id long, score double, reranked long"
#: All bytes by how many bits they have, and how many have at most so many.
_MASKS = np.argsort(np.bitwise_count(np.arange(256, dtype=np.uint8)), kind="stable").astype(np.uint8)
_BALL = np.searchsorted(np.sort(np.bitwise_count(np.arange(256, dtype=np.uint8))), np.arange(9), side="right")


@dataclass
class Coder:
    """Turns vectors into codes: longest length, centre and rotation, and the radius to search."""

    longest: float
    centre: np.ndarray
    turn: np.ndarray
    radius: int = BITS

    def extended(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def codes(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        """Queries have no extra component: only their direction counts."""
        if queries:
            length = np.sqrt((x**2).sum(1, keepdims=True))
            x = np.concatenate([x * self.longest / length, np.zeros((len(x), 1))], 1)
        else:
            x = self.extended(x)
        signs = (x - self.centre) @ self.turn > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u8")[:, 0]


def learn(sample: np.ndarray, longest: float, k: int = 20, recall: float = 0.97, rounds: int = 40) -> Coder:
    """Fit the rotation and the radius that holds ``recall`` of the sample's own neighbours."""
    coder = Coder(longest, np.zeros(sample.shape[1] + 1), np.zeros((sample.shape[1] + 1, BITS)))
    if len(sample) < 2:
        coder.turn = np.random.default_rng(7).normal(size=coder.turn.shape)
        return coder
    x = coder.extended(sample)
    coder.centre = x.mean(0)
    x = x - coder.centre
    _, _, axes = np.linalg.svd(x, full_matrices=True)
    draw = np.random.default_rng(7)
    axes = axes.T[:, :BITS]
    if axes.shape[1] < BITS:  # fewer dimensions than bits: random directions fill up
        axes = np.concatenate([axes, draw.normal(size=(axes.shape[0], BITS - axes.shape[1]))], 1)
    flat = x @ axes
    turn, _ = np.linalg.qr(draw.normal(size=(BITS, BITS)))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    coder.turn = axes @ turn
    ask = sample[:256]
    near = ask @ sample.T
    near[np.arange(len(ask)), np.arange(len(ask))] = -np.inf
    best = np.argsort(-near, 1)[:, : min(k, len(sample) - 1)]
    apart = np.bitwise_count(coder.codes(ask, True)[:, None] ^ coder.codes(sample)[best])
    coder.radius = int(np.quantile(apart, recall, method="higher"))
    return coder


def _bytes(codes: np.ndarray) -> np.ndarray:
    """The substrings of codes, one column each."""
    return np.ascontiguousarray(codes, "<u8").view(np.uint8).reshape(-1, SUBSTRINGS)


class Best:
    """The k best rows so far of each query of a block, and how many rows were ranked for it."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.row, self.score = np.array([], np.int64), np.array([], np.int64), np.array([])
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.reranked = np.zeros(len(ids), np.int64)
        self.least = np.full(len(ids), -np.inf)

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        """Rows ``row`` (ids) of the queries at the places ``query``."""
        self.reranked += np.bincount(query, minlength=len(self.ids))
        good = score >= self.least[query]
        self.waiting.append((query[good], row[good], score[good]))
        if sum(len(w[0]) for w in self.waiting) >= PAIRS:
            self.settle()

    def settle(self) -> None:
        """Rank what waits among the best so far."""
        query, row, score = (np.concatenate(c) for c in zip((self.query, self.row, self.score), *self.waiting, strict=True))
        self.waiting.clear()
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        kept = place < self.k
        self.query, self.row, self.score = query[kept], row[kept], score[kept]

    def batch(self) -> pa.RecordBatch:
        """A query's count stands in its first row."""
        self.settle()
        first = np.arange(len(self.query)) == np.searchsorted(self.query, self.query)
        ranked = np.where(first, self.reranked[self.query], 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[self.query]), pa.array(self.row), pa.array(self.score), pa.array(ranked)], ["query_id", "vec_id", "score", "reranked"]
        )


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the vectors that take part."""
    v = F.col("embedding")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(v.isNotNull()).where(good).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull())


class Index:
    """A slice's rows in the order of each substring, and where each value of it begins."""

    def __init__(self, coder: Coder, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.codes = ids, x, coder.codes(x)
        self.parts = _bytes(self.codes)
        self.orders = [np.argsort(self.parts[:, j], kind="stable").astype(np.int32) for j in range(SUBSTRINGS)]
        self.begins = [np.searchsorted(self.parts[o, j], np.arange(257)) for j, o in enumerate(self.orders)]

    def look_up(self, j: int, value: int, radius: int) -> np.ndarray:
        """The rows whose substring ``j`` is within ``radius`` of ``value``."""
        near = _MASKS[: _BALL[radius]] ^ np.uint8(value)
        order, begins = self.orders[j], self.begins[j]
        return np.concatenate([order[begins[v] : begins[v + 1]] for v in near.tolist()])

    def best(self, coder: Coder, ids: np.ndarray, x: np.ndarray, radius: int, k: int) -> pa.RecordBatch:
        """The k best rows of each of a block of queries."""
        found, codes = Best(ids, k), coder.codes(x, True)
        parts = _bytes(codes)
        least, more = divmod(radius, SUBSTRINGS)
        within = [least if j <= more else least - 1 for j in range(SUBSTRINGS)]
        for j in range(SUBSTRINGS):
            if within[j] < 0:
                continue
            for value in np.unique(parts[:, j]).tolist():
                asked, rows = np.flatnonzero(parts[:, j] == value), self.look_up(j, value, within[j])
                step = max(1, PAIRS // max(1, len(asked)))
                for at in range(0, len(rows), step):
                    self._rank(found, ids, codes, x, asked, rows[at : at + step], j, within, radius)
        return found.batch()

    def _rank(self, found: Best, ids, codes, x, asked, rows, j: int, within: list[int], radius: int) -> None:
        """Rank those of ``rows`` that no earlier substring has found."""
        differ = codes[asked][:, None] ^ self.codes[rows]
        q, r = np.nonzero((np.bitwise_count(differ) <= radius) & (ids[asked][:, None] != self.ids[rows]))
        if j:
            apart = np.bitwise_count(_bytes(differ[q, r])[:, :j])
            new = (apart > np.array(within[:j])).all(1)
            q, r = q[new], r[new]
        if len(q):
            q, r = asked[q], rows[r]
            found.add(q, self.ids[r], (self.x[r] * x[q]).sum(1))


def search(vectors: DataFrame, is_query, k: int = 20, sample: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score, reranked): each query's k nearest rows other than itself, and how many rows were compared as vectors.

    ``is_query`` is a condition on vec_id; queries and rows are the same table.
    """
    rows = materialise(usable(vectors), "vectors")
    spark = rows.sparkSession
    lengths = F.min(F.size("v")), F.max(F.size("v"))
    longest, n, shortest, dims = rows.agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), F.count("*"), *lengths).first()
    if shortest != dims:
        raise ValueError(f"vectors of {shortest} to {dims} components have no inner product")
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()  # at most `sample` rows
    coder = learn(np.array([r["v"] for r in some], float).reshape(-1, dims or 1), longest or 1.0, k)
    slices = max(1, -(-n // SLICE), min(parts(spark), -(-n // LEAST)))

    def run(asked: DataFrame, radius: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
        there = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(slices)).cast("int").alias("slice"), F.lit(0).alias("kind"), "vec_id", "v")
        stream = there.unionByName(asked.select(every.alias("slice"), F.lit(1).alias("kind"), "vec_id", "v"))
        stream = stream.repartition(slices, "slice").sortWithinPartitions("slice", "kind")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []  # of the slice's rows, or of queries that wait
            index, now = None, (-1, -1)

            def together() -> tuple[np.ndarray, np.ndarray]:
                ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
                held.clear()
                return ids, x

            for batch in batches:
                key = np.stack([batch.column(c).to_numpy() for c in ("slice", "kind")], 1)
                ids, x = batch.column("vec_id").to_numpy(), batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
                for a, b in zip(edges, edges[1:], strict=False):
                    if a == b:
                        continue
                    this = int(key[a][0]), int(key[a][1])
                    if this != now:
                        if held and now[1] == 0:
                            index = Index(coder, *together())
                        elif held:
                            yield index.best(coder, *together(), radius, k)
                        if this[1] == 1 and this[0] != now[0]:  # a slice without rows
                            index = None
                        now = this
                    if now[1] == 1 and index is None:
                        continue
                    step = b - a if now[1] == 0 else QUERIES
                    for at in range(a, b, step):
                        held.append((ids[at : min(at + step, b)].copy(), x[at : min(at + step, b)].copy()))
                        if now[1] == 1 and sum(len(h[0]) for h in held) >= QUERIES:
                            yield index.best(coder, *together(), radius, k)
            if held and now[1] == 1:
                yield index.best(coder, *together(), radius, k)

        return stream.mapInArrow(tidy(meet), _OUT)

    def first(found: DataFrame) -> DataFrame:
        order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("reranked", F.sum("reranked").over(W.Window.partitionBy("query_id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "reranked")

    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    near = materialise(first(run(queries, coder.radius)), "near")
    full = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = materialise(queries.join(full, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return near
    return near.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(first(run(short, BITS)))
