"""Mixture-controlled packing of token streams into fixed windows.

Each source is a queue of its documents' tokens. Every window takes from every
queue its target share of the window; what rounding leaves over or short is that
queue's deficit and is carried to the next windows, across task boundaries. As
the carried deficit makes the tokens served after ``w`` windows equal the
rounded target of ``w`` windows, the state before any window has a closed form,
and tasks cut their own documents without running the windows in turn.

Null text is the empty text (it still has its end id); null source is the source
''; repeated ids stay separate rows, in the order of their rows; very long texts are tokenised
whole and cut over as many windows as they need; other columns are never read,
whatever their names; an empty table gives no pieces. Sources that no target
names and that are too small to get one token a window share one queue, so there
are at most ``window`` + 1 queues and one for each target, whatever the number of sources.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, parts, tidy, whole_text
from .pieces import WORD_PIECES, piece_ids

#: Documents tokenised, and given their shares, at once.
BLOCK = 256
#: Windows whose shares are worked out together, and bytes of such blocks that a task keeps.
STEP, KEPT = 32, 16 << 20
#: Pieces that are sent on together, and bytes of their ids.
PIECES, PIECE_BYTES = 4096, 4 << 20


def tokenise(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """(row, doc_id, source, n, ids): the ids of each whole text and the end id, two bytes an id where they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = piece_ids(tokenizer, "word_bpe_49k.json", WORD_PIECES, True, True)
        end = np.array([end_id], words.kind).tobytes()
        wide = np.dtype(words.kind).itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = [x + end for x in words.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("source"), pa.array([len(x) // wide for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["row", "doc_id", "source", "n", "ids"],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        whole_text().alias("text"),
    )
    return rows.mapInArrow(tidy(run), "row long, doc_id long, source string, n long, ids binary")


class Schedule:
    """How many tokens each queue has given before any window.

    Queues with ``targets`` other than their totals run in phases: in each one
    the queues that still have tokens share the windows in proportion to their
    targets, and it lasts for the whole windows that all of them can fill; one
    window then takes the rest of the queue that ran short.
    """

    def __init__(self, totals: list[int], targets: list[float] | None = None, window: int = 4096):
        self.window, self.phases = window, []
        self.kept: dict[tuple[int, int], np.ndarray] = {}
        left, at = [int(x) for x in totals], 0
        served = [0] * len(left)
        while any(left):
            wanted = left if targets is None else [int(round(t * (1 << 32))) if n else 0 for t, n in zip(targets, left, strict=True)]
            if not any(wanted):
                wanted = left
            total = sum(wanted)
            if wanted == left:
                tokens = total
            else:
                tokens = min(n * total // w for n, w in zip(left, wanted, strict=True) if w) // window * window
                if not tokens:  # a queue has less than its share of one window
                    short = min((i for i, w in enumerate(wanted) if w), key=lambda i: left[i] * total / wanted[i])
                    others = sum(left) - left[short]
                    room = min(window - left[short], others)
                    give = [0 if i == short else n * room // max(others, 1) for i, n in enumerate(left)]
                    give[short] = left[short]
                    for i in sorted(range(len(left)), key=lambda i: give[i] - left[i]):
                        give[i] += min(window - sum(give), left[i] - give[i]) if sum(give) < window else 0
                    wanted, total, tokens = give, sum(give), sum(give)
            self.phases.append((at, tokens, wanted, total, list(served)))
            given = self._served(self.phases[-1], np.array([tokens]))[0]
            served = [int(a + b) for a, b in zip(served, given, strict=True)]
            left = [int(n - g) for n, g in zip(left, given, strict=True)]
            at += -(-tokens // window)
        self.n_windows = at

    def _served(self, phase, tokens: np.ndarray) -> np.ndarray:
        """(len(tokens), queues): the largest-remainder shares of the first ``tokens`` tokens of a phase."""
        _, _, wanted, total, _ = phase
        big = max(int(tokens.max(initial=0)), 1) * max(wanted) >= 1 << 62
        x = tokens.astype(object if big else np.int64)[:, None]
        whole = x * np.array(wanted, object if big else np.int64)[None]
        base, rest = whole // total, whole % total
        more = (tokens - base.sum(1)).astype(np.int64)
        order = np.argsort(-rest, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None], 1)
        return base.astype(np.int64) + (rank < more[:, None])

    def _edges(self, k: int, first: int, last: int) -> np.ndarray:
        """The shares before the windows first..last of phase ``k``, from blocks of windows that are kept."""
        blocks = []
        _, tokens, _, _, _ = self.phases[k]
        for block in range(first // STEP, last // STEP + 1):
            found = self.kept.get((k, block))
            if found is None:
                found = self._served(self.phases[k], np.minimum(np.arange(block * STEP, (block + 1) * STEP) * self.window, tokens))
                if (len(self.kept) + 1) * found.nbytes > KEPT:
                    self.kept.clear()
                self.kept[k, block] = found
            blocks.append(found)
        whole = np.concatenate(blocks) if len(blocks) > 1 else blocks[0]
        at = first // STEP * STEP
        return whole[first - at : last + 1 - at]

    def prepare(self, queues: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
        """Work out at once the shares around both ends of many documents; which ones is told in floating point, and pieces() makes those that are missing."""
        for k, (_, tokens, wanted, total, before) in enumerate(self.phases):
            share, shift = np.array(wanted, float)[queues], np.array(before, float)[queues]
            some = share > 0
            per = total / (self.window * share[some])
            ends = np.concatenate([(begins[some] - shift[some]) * per - 2, (begins[some] + lengths[some] - shift[some]) * per + 3])
            last = -(-tokens // self.window)
            blocks = np.unique(ends[(ends > -2) & (ends < last + 3)].clip(0, last).astype(np.int64) // STEP)
            blocks = [b for b in blocks.tolist() if (k, b) not in self.kept]
            size = STEP * len(wanted) * 8
            if not blocks or 2 * len(blocks) * size > KEPT:
                continue
            if (len(self.kept) + len(blocks)) * size > KEPT:
                self.kept.clear()
            at = (np.array(blocks)[:, None] * STEP + np.arange(STEP)[None]).ravel()
            found = self._served(self.phases[k], np.minimum(at * self.window, tokens))
            self.kept.update(((k, b), x) for b, x in zip(blocks, found.reshape(len(blocks), STEP, -1), strict=True))

    def pieces(self, queue: int, begin: int, length: int) -> list[tuple[int, int, int, int]]:
        """(start in the run, length, window, offset in the window) of a queue's tokens from ``begin``."""
        out = []
        end = begin + length
        for k, phase in enumerate(self.phases):
            at, tokens, wanted, total, before = phase
            after = self.phases[k + 1][4][queue] if k + 1 < len(self.phases) else None
            a, b = max(begin, before[queue]), end if after is None else min(end, after)
            if a >= b or not wanted[queue]:
                continue
            a, b = a - before[queue], b - before[queue]
            step = self.window * wanted[queue]
            n = -(-tokens // self.window)
            first, last = max(0, a * total // step - 2), min(n - 1, b * total // step + 2)
            edges = self._edges(k, first, last + 1)
            mine = edges[:, queue]
            i, j = int(np.searchsorted(mine, a, "right")) - 1, int(np.searchsorted(mine, b, "left"))
            near = edges[i : j + 1]
            ahead = (near[1:, :queue] - near[:-1, :queue]).sum(1).tolist()
            mine = near[:, queue].tolist()
            for w in range(j - i):
                s, e = max(a, mine[w]), min(b, mine[w + 1])
                if s < e:
                    out.append((s + before[queue] - begin, e - s, at + first + i + w, ahead[w] + s - mine[w]))
        return out


def queue_starts(tokens: DataFrame) -> DataFrame:
    """(row, queue, begin): the place of each document's first token in its queue, in the order of doc_id.

    Running sums are taken inside range-dealt tasks and raised by what the tasks
    before hold of the same queue: one row a task and queue.
    """
    spark = tokens.sparkSession
    placed = (
        tokens.select("queue", "doc_id", "n", "row")
        .repartitionByRange(parts(spark), "queue", "doc_id", "row")
        .sortWithinPartitions("queue", "doc_id", "row")
        .withColumn("at", F.monotonically_increasing_id())
    )
    placed = materialise(placed, "queues").withColumn("task", F.shiftright("at", 33))
    held = placed.groupBy("queue", "task").agg(F.sum("n").alias("held"))
    base = held.select(
        "queue", "task",
        F.expr("coalesce(sum(held) over (partition by queue order by task rows between unbounded preceding and 1 preceding), 0)").alias("base"),
    )
    inside = placed.withColumn(
        "inside",
        F.expr("coalesce(sum(n) over (partition by task, queue order by at rows between unbounded preceding and 1 preceding), 0)"),
    )
    return inside.join(F.broadcast(base), ["queue", "task"]).select(  # at most tasks + queues rows
        "row", F.col("queue").alias("queue"), (F.col("base") + F.col("inside")).alias("begin")
    )


def pack(
    docs: DataFrame,
    window: int = 4096,
    targets: dict[str, float] | None = None,
    tokenizer: str | None = None,
    end_id: int = 2,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (4 bytes each; only if ``with_ids``), ids_crc32, doc_tokens, sequence_id, offset.

    ``targets`` gives the sources' shares of each window; by default the
    corpus's own, so that all queues end together. A source that ``targets``
    names has a queue of its own, however small it is; those that it doesn't
    name come when the named ones have run out. Only the last window, or the
    last of a phase, may be short.
    """
    tokens = materialise(tokenise(docs, tokenizer, end_id), "tokens")
    sizes = tokens.groupBy("source").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") * F.lit(window) >= F.lit(total)
    if targets:
        large = large | F.col("source").isin(*targets)
    # at most `window` rows and one a target
    own = [(r["source"], r["n"]) for r in sizes.where(large).orderBy(F.desc("n"), "source").collect()] if total else []
    rest = total - sum(n for _, n in own)
    shared = len(own) if rest and (rest * window >= total or targets) else 0
    counts = [n for _, n in own]
    if rest and shared == len(own):
        counts.append(rest)
    elif rest:
        counts[0] += rest
    wanted = None
    if targets is not None:
        wanted = [float(targets.get(s, 0.0)) for s, _ in own] + [0.0] * (len(counts) - len(own))
    schedule = Schedule(counts, wanted, window)
    names = tokens.sparkSession.createDataFrame([(s, i) for i, (s, _) in enumerate(own)], "source string, queue int")
    queued = tokens.join(F.broadcast(names), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(shared)))  # bounded as `own`
    starts = queue_starts(queued)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        raws: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(v, pa.int64()) for v in (zip(*held, strict=True) if held else [[]] * len(columns))]
            if with_ids:
                return pa.RecordBatch.from_arrays([*arrays, pa.array(raws, pa.binary())], [*columns, "ids"])
            return pa.RecordBatch.from_arrays(arrays, columns)

        for part in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            named = [part.column(c) for c in ("doc_id", "n", "queue", "begin", "ids")]
            schedule.prepare(*(named[i].to_numpy(zero_copy_only=False) for i in (2, 3, 1)))
            for row, (doc, n, queue, begin) in enumerate(zip(*(c.to_pylist() for c in named[:4]), strict=True)):
                raw = named[4][row].as_buffer()
                ids = memoryview(np.frombuffer(raw, "<u2" if raw.size == 2 * n else "<u4").astype("<u4")).cast("B")  # never empty: there is the end id
                for start, length, at, offset in schedule.pieces(queue, begin, n):
                    piece = ids[4 * start : 4 * (start + length)]
                    held.append((doc, start, length, zlib.crc32(piece), n, at, offset))
                    if with_ids:
                        raws.append(bytes(piece))
                        size += len(piece)
                    if len(held) >= PIECES or size >= PIECE_BYTES:
                        yield flush()
                        held.clear()
                        raws.clear()
                        size = 0
        if held:
            yield flush()

    schema = ", ".join(f"{c} long" for c in columns) + (", ids binary" if with_ids else "")
    return tokens.select("row", "doc_id", "n", "ids").join(starts.hint("merge"), "row").select("doc_id", "n", "queue", "begin", "ids").mapInArrow(tidy(cut), schema)
