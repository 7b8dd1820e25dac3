"""Quality classifier: a generalised additive model with pairwise interactions.

Numbers are measured on every whole text, cut into bins, and each feature gets a
lookup table learned by cyclic boosting: shallow trees are fitted to one feature
at a time on the loss's gradients summed by bin, with a small step, round after
round. The pairs of features with the most left to explain then get
two-dimensional tables in the same way. A score is the logistic of the sum of
the tables' entries, added up for whole batches.

The model is fitted on the driver from at most ``max_rows`` labelled rows (a
documented bound: those with the smallest hash of their id); measuring and
scoring cover all documents. Null and empty texts have all-zero measures and a
score like any other; a fit without labels of both kinds scores the prior.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, whole_text

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for on are as with by this be was or from an at "
    "de la le et les des en un une du que qui est pour dans par sur au avec pas "
    "der die und das den von zu mit ist im für auf dem nicht ein eine als auch sich "
    "el y los las por con una su para se del lo no".split()
)
FEATURES = (
    "chars", "words", "word_chars", "longest_word", "different_words", "top_word", "repeats", "function_words",
    "lines", "line_words", "repeated_lines", "sentence_words", "letters", "capitals", "digits", "odd_signs", "bars",
    "stops", "commas", "spaces", "other_bytes", "entropy", "symbol_words", "top_pair",
)
_LETTERS = np.r_[65:91, 97:123]
_ODD = np.frombuffer(b"*#$%&@<>{}[]~^=+_\\/", np.uint8)


def measure_one(text: str) -> list[float]:
    """The numbers of one whole text, in the order of FEATURES."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode(), np.uint8)
    count = np.bincount(raw, minlength=256)
    share = count[count > 0] / raw.size
    n = len(words)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = Counter(zip(words, words[1:], strict=False))
    ends = count[46] + count[33] + count[63]
    of = lambda x: float(x) / raw.size
    return [
        float(np.log1p(len(text))), float(np.log1p(n)), len(text) / n, float(np.log1p(max(map(len, words)))),
        len(seen) / n, max(seen.values()) / n, sum(map(eq, words, words[1:])) / n,
        sum(seen[w] for w in FUNCTION_WORDS & seen.keys()) / n,
        float(np.log1p(len(lines))), n / len(lines), 1 - len(set(lines)) / len(lines), n / (ends + 1.0),
        of(count[_LETTERS].sum()), of(count[65:91].sum()), of(count[48:58].sum()), of(count[_ODD].sum()), of(count[124]),
        of(ends), of(count[44]), of(count[32] + count[10] + count[9]), of(count[128:].sum()),
        float(-(share * np.log2(share)).sum()),
        sum(c for w, c in seen.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?") / n,
        max(pairs.values()) / (n - 1) if n > 1 else 0.0,
    ]


def _measures(texts: pa.Array) -> np.ndarray:
    return np.array([measure_one(t.as_py() or "") for t in texts], np.float32).reshape(-1, len(FEATURES))


def measure(docs: DataFrame) -> DataFrame:
    """The docs' other columns with one float for each feature of the text."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _measures(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), *(pa.array(found[:, i]) for i in range(len(FEATURES)))], [*others, *FEATURES]
            )

    schema = ", ".join([*(f"{c} {dict(docs.dtypes)[c]}" for c in others), *(f"{x} float" for x in FEATURES)])
    return docs.select(*others, whole_text().alias("text")).mapInArrow(tidy(run), schema)


@dataclass
class AdditiveModel:
    """Tables over bins: ``base`` + one table a feature + one a pair of features."""

    cuts: list[np.ndarray]
    base: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for i, t in enumerate(self.single):
            z += t[b[:, i]]
        for i, j, t in self.pairs:
            z += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> np.ndarray:
    """A shallow tree on gradients summed by bin; the step of each bin."""
    out = np.full(len(g), -g.sum() / (h.sum() + ridge))
    if depth and len(g) > 1:
        lg, lh = g.cumsum()[:-1], h.cumsum()[:-1]
        rg, rh = g.sum() - lg, h.sum() - lh
        gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + ridge) + rg**2 / (rh + ridge), -1)
        k = int(gain.argmax())
        if gain[k] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
            out[: k + 1] = _leaves(g[: k + 1], h[: k + 1], depth - 1, least, ridge)
            out[k + 1 :] = _leaves(g[k + 1 :], h[k + 1 :], depth - 1, least, ridge)
    return out


def _leaves_2d(g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> np.ndarray:
    """The same over a grid, cutting whichever axis gains more."""
    out = np.full(g.shape, -g.sum() / (h.sum() + ridge))
    if not depth:
        return out
    best, whole = None, g.sum() ** 2 / (h.sum() + ridge) + 1e-9
    for axis in (0, 1):
        lg, lh = g.sum(1 - axis).cumsum()[:-1], h.sum(1 - axis).cumsum()[:-1]
        rg, rh = g.sum() - lg, h.sum() - lh
        gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + ridge) + rg**2 / (rh + ridge), -1)
        if len(gain) and gain.max() > whole and (best is None or gain.max() > best[0]):
            best = gain.max(), axis, int(gain.argmax()) + 1
    if best:
        cut = [(slice(None, best[2]), slice(None)), (slice(best[2], None), slice(None))]
        for part in cut if best[1] == 0 else [c[::-1] for c in cut]:
            out[part] = _leaves_2d(g[part], h[part], depth - 1, least, ridge)
    return out


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 250, step: float = 0.08, depth: int = 2,
    n_pairs: int = 10, pair_bins: int = 12, pair_rounds: int = 80, least: float = 3.0, ridge: float = 1.0,
) -> AdditiveModel:
    """Cyclic boosting of one-feature trees, then of trees over the most promising pairs."""
    y = y.astype(float)
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.array([]) for i in range(x.shape[1])]
    model = AdditiveModel(cuts, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts])
    model.coarse = [np.minimum(np.arange(len(c) + 1) * pair_bins // (len(c) + 1), pair_bins - 1) for c in cuts]
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    z = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, t in enumerate(model.single):
            if len(t) > 1:
                g, h = slopes()
                move = step * _leaves(np.bincount(b[:, i], g, len(t)), np.bincount(b[:, i], h, len(t)), depth, least, ridge)
                t += move
                z += move[b[:, i]]
    c = np.stack([k[b[:, i]] for i, k in enumerate(model.coarse)], 1)
    g, h = slopes()
    size = pair_bins * pair_bins

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, i] * pair_bins + c[:, j], v, size).reshape(pair_bins, pair_bins)

    def promise(i: int, j: int) -> float:
        gg, hh = grid(i, j, g), grid(i, j, h)
        return float(-(gg * _leaves_2d(gg, hh, 3, least, ridge)).sum())

    ranked = sorted(((promise(i, j), i, j) for i in range(len(cuts)) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((pair_bins, pair_bins))) for _, i, j in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h = slopes()
            move = step * _leaves_2d(grid(i, j, g), grid(i, j, h), 3, least, ridge)
            t += move
            z += move[c[:, i], c[:, j]]
    return model


def held_out_rule(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 30_000) -> AdditiveModel:
    """Fit on ``labels.quality`` of at most ``max_rows`` documents, never of those with crc32(doc_id) mod 4 = 2."""
    marks = labels.where(F.col("quality").isNotNull() & ~held_out_rule()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows rows
    sample = measure(rows.select("quality", "text")).toPandas()
    return fit(sample[list(FEATURES)].to_numpy(np.float32), sample["quality"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 30_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; see train()."""
    model = train(docs, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                score = model.score(_measures(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    scored = rows.mapInArrow(tidy(run), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out_rule().alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 30_000) -> DataFrame:
    """The documents whose score reaches the threshold, dropped where they are read: no text is shuffled."""
    model = train(docs, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield part.filter(pa.array(model.score(_measures(part.column("text"))) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
