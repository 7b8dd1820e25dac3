"""Exact removal of repeated byte strings: suffix sorting by bucket-pointer refinement.

Texts are UTF-8 bytes (null: empty). A byte goes if a string of ``depth`` bytes
that covers it also starts in a document with a smaller doc_id, judged on the
input. Sorting every suffix of the corpus together would move each byte many
times, so the sort is sparse and exact:

1. Every string of ``depth`` bytes holds a sampled suffix: the one whose first
   ``q`` bytes have the smallest hash, which equal strings choose alike. The
   strings that share a sampled suffix are its stretch. Sampled suffixes go to
   buckets by their first ``q`` bytes.
2. A bucket is refined by the identifiers of the q-grams at later offsets of the
   stretch. Members that stay together have equal stretches: all but those of the
   smallest document go. Buckets with one member, or of one document, are done.
3. The buckets that fell apart send their stretches, those of one document for each refined bucket.
   Bucket-pointer refinement sorts all suffixes in them: positions are ordered by
   their first eight bytes; a position's pointer is the end of its bucket in that
   order; buckets with more than one member are sorted again on the pointers of
   their members at offset 8, then 16, then ``depth`` - 32, each time with the
   pointers just updated. Positions with one pointer at full depth start equal
   strings, and all but those of the smallest document go.

Tasks first combine what they hold, so copies of a passage reach a bucket once
for each block of documents, and no two documents are ever paired. Rows that
repeat an id don't count as smaller than each other; texts shorter than
``depth`` stay whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, parts, tidy, whole_text

DEPTH, Q = 50, 20
#: Bytes of texts that are hashed at once, that are combined before they are sent, and that make a bucket.
PIECE, BLOCK, BUCKET = 1 << 20, 12 << 20, 16 << 20
_U = np.uint64
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_STEP = 0x9E3779B97F4A7C15
_ENTRY = "bucket int, kind int, docs binary, a binary, h binary, s binary, n binary"
_REPLY = "grp int, kind int, bucket int, docs binary, s binary, n binary"
_DOC = np.dtype([("doc", "<i8"), ("hash", "<i8"), ("grp", "<i4"), ("count", "<i4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_ids(b: np.ndarray, q: int) -> np.ndarray:
    """An identifier of the q bytes that start at each place (places near the end are of no use)."""
    n, width, h = len(b), 1, _BYTE[b]
    by_width = {1: h}

    def joined(left: np.ndarray, at: int, right: np.ndarray, size: int) -> np.ndarray:
        out = left * _U(pow(_STEP, size, 1 << 64))
        out[: max(n - at, 0)] += right[at:]
        return out

    while width * 2 <= q:
        h = joined(h, width, h, width)
        width *= 2
        by_width[width] = h
    rest = q - width
    while rest:
        size = 1 << (rest.bit_length() - 1)
        h = joined(h, width, by_width[size], size)
        width, rest = width + size, rest - size
    return _mix(h)


def stretches(b: np.ndarray, starts: np.ndarray, depth: int = DEPTH, q: int = Q):
    """Of each sampled suffix: where its stretch begins, how long it is, its bucket's and its refined bucket's identifier.

    ``starts`` has where each document begins in ``b``, and the end.
    """
    none = np.array([], np.int64)
    n = len(b)
    last = starts[1:] - depth
    fits = last >= starts[:-1]
    if not fits.any():
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    ids, wide = gram_ids(b, q), depth - q + 1
    bits = _U(max(28, n.bit_length()))
    least = (ids >> bits << bits) | np.arange(n, dtype=np.uint64)  # the smallest, the leftmost of equals
    k = 1
    while k < wide:
        shift = min(k, wide - k)
        least[: n - shift] = np.minimum(least[: n - shift], least[shift:])
        k += shift
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, starts[:-1][fits], 1)
    np.add.at(inside, last[fits] + 1, -1)
    x = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    at = (least[x] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    new = np.ones(len(x), bool)
    new[1:] = (at[1:] != at[:-1]) | (x[1:] != x[:-1] + 1)
    first = np.flatnonzero(new)
    s, p = x[first], at[first]
    end = x[np.append(first[1:], len(x)) - 1] + depth
    name = _mix(ids[end - q] + (p - s).astype(np.uint64) + ((end - s).astype(np.uint64) << _U(8)))
    for k in range((2 * depth) // q, -1, -1):
        name = _mix(name * _U(5) + ids[np.minimum(s + k * q, end - q)])
    return s, end - s, ids[p], name


def bucket_pointers(b: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(places, pointers): for every place with ``depth`` bytes left in its stretch, the pointer of its bucket."""
    n = len(b)
    left = np.repeat(begin + size, size) - np.arange(n)
    key = b.astype(np.uint64)
    for k in (1, 2, 4):
        more = np.zeros(n, np.uint64)
        more[: n - k] = key[k:]
        key = (key << _U(8 * k)) | more
    live = np.flatnonzero(left >= 8)
    pointer = np.full(n, -1, np.int64)

    def point(places: np.ndarray, keys: np.ndarray, base: np.ndarray | None) -> np.ndarray:
        """Sort ``places`` by ``keys`` and point each to the end of its bucket; the places that share one."""
        order = np.argsort(keys, kind="stable")
        places, keys = places[order], keys[order]
        edge = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
        count = np.diff(np.append(-1, edge))
        if base is None:
            ends = edge
        else:  # inside each old bucket the pointers go up to the old one
            old = base[order]
            whole = np.flatnonzero(np.append(old[1:] != old[:-1], True))
            ends = old[edge] - whole[np.searchsorted(whole, edge)] + edge
        pointer[places] = np.repeat(ends, count)
        return places[np.repeat(count > 1, count)]

    shared = point(live, key[live], None)
    reached = 8
    for reach in (16, 32, depth):
        if reach <= reached:
            continue
        offset = reach - reached
        shared = shared[left[shared] >= reach]
        base = pointer[shared]
        later = pointer[shared + offset]
        # order by (own pointer, pointer at the later offset): both are below 2**31 for what a task holds
        shared = point(shared, (base.astype(np.uint64) << _U(32)) | later.astype(np.uint64), base)
        reached = reach
    places = np.flatnonzero(left >= depth)
    return places, pointer[places]


def _pack_docs(doc: np.ndarray, digest: np.ndarray, grp: np.ndarray, owner: np.ndarray) -> bytes:
    """The documents of a run of entries ordered by document, with the number of entries of each."""
    edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.array([], np.int64)
    out = np.zeros(len(edge), _DOC)
    who = owner[edge]
    out["doc"], out["hash"], out["grp"], out["count"] = doc[who], digest[who], grp[who], np.diff(np.append(edge, len(owner)))
    return out.tobytes()


def _squeeze(x: np.ndarray, kind: str) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(x, prepend=0).astype(kind).tobytes())


def _widen(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind), dtype=np.int64)


def _runs(owner: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches as maximal runs, ordered by owner and place."""
    if not len(s):
        return owner, s, n
    order = np.lexsort((s, owner))
    owner, s, e = owner[order], s[order], (s + n)[order]
    far = s.max() + n.max() + 1
    top = np.maximum.accumulate(e + owner * far) - owner * far
    new = np.append(True, (owner[1:] != owner[:-1]) | (s[1:] > top[:-1]))
    first = np.flatnonzero(new)
    return owner[first], s[first], top[np.append(first[1:], len(s)) - 1] - s[first]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [f[0] for f in fields]
    )


def _keyed(docs: DataFrame, groups: int) -> DataFrame:
    text = whole_text()
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("hash"), F.encode(text, "UTF-8").alias("raw"),
    )
    return keyed.withColumn("grp", F.pmod(F.xxhash64("doc", "hash"), F.lit(groups)).cast("int"))


def sampled(keyed: DataFrame, buckets: int, depth: int, q: int) -> DataFrame:
    """Step 1: entries by bucket, combined in blocks; kind 1 has runs that a block settles itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = serial = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc", "hash", "grp", "raw")), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= BLOCK:
                    yield block(held, serial)
                    held, size, serial = [], 0, serial + 1
        if held:
            yield block(held, serial)

    def block(rows: list[tuple[int, int, int, bytes]], serial: int) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0])  # the smallest document comes first
        doc, digest, grp = (np.array([r[i] for r in rows], t) for i, t in ((0, np.int64), (1, np.int64), (2, np.int32)))
        found = []
        at = 0
        while at < len(rows):
            to, size = at, 0
            while to < len(rows) and (to == at or size + len(rows[to][3]) <= PIECE):
                size += len(rows[to][3])
                to += 1
            starts = np.zeros(to - at + 1, np.int64)
            np.cumsum([len(r[3]) for r in rows[at:to]], out=starts[1:])
            s, n, a, h = stretches(np.frombuffer(b"".join(r[3] for r in rows[at:to]), np.uint8), starts, depth, q)
            owner = np.searchsorted(starts, s, "right") - 1
            found.append((owner + at, s - starts[owner], n, a, h))
            at = to
        owner, s, n, a, h = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(_mix(a ^ _mix(h)), kind="stable")
        new = np.append(True, (a[order][1:] != a[order][:-1]) | (h[order][1:] != h[order][:-1])) if len(order) else np.array([], bool)
        first = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(order))))
        again = np.zeros(len(order), bool)
        again[order] = doc[owner[order]] > doc[owner[first]]
        out = []
        if again.any():
            o, rs, rn = _runs(owner[again], s[again], n[again])
            out.append(((serial * 7919 + int(doc[0])) % buckets, 1, _pack_docs(doc, digest, grp, o), b"", b"", _squeeze(rs, "<i4"), _squeeze(rn, "<i4")))
        keep = np.flatnonzero(~again)
        bucket = (a[keep] % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keep, bucket = keep[order], bucket[order]
        edge = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist(), len(bucket)] if len(bucket) else [0]
        for i, j in zip(edge, edge[1:], strict=False):
            some = keep[i:j]
            short = lambda x, k: x.view(np.uint8).reshape(-1, 8)[:, :k].tobytes()
            # five bytes of the bucket's and six of the refined bucket's identifier tell them apart inside a bucket
            out.append((int(bucket[i]), 0, _pack_docs(doc, digest, grp, owner[some]), short(np.ascontiguousarray(_mix(a[some])), 5), short(np.ascontiguousarray(h[some]), 6), _squeeze(s[some], "<i4"), _squeeze(n[some], "<i2")))
        return _table(out, _ENTRY)

    return keyed.select("doc", "hash", "grp", "raw").mapInArrow(tidy(run), _ENTRY)


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of each value of ``key``, which come one after the other."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _replies(doc: np.ndarray, owner: np.ndarray, s: np.ndarray, n: np.ndarray, kind: int, bucket: int) -> list[tuple]:
    """Rows for each group of documents; ``doc`` are _DOC rows, ``owner`` points into them."""
    if not len(owner):
        return []
    order = np.lexsort((s, owner, doc["grp"][owner]))
    owner, s, n = owner[order], s[order], n[order]
    grp = doc["grp"][owner]
    edge = [*np.flatnonzero(np.append(True, grp[1:] != grp[:-1])).tolist(), len(grp)]
    return [
        (int(grp[i]), kind, bucket, _pack_docs(doc["doc"], doc["hash"], doc["grp"], owner[i:j]), _squeeze(s[i:j], "<i4"), _squeeze(n[i:j], "<i4"))
        for i, j in zip(edge, edge[1:], strict=False)
    ]


def _five(raw: list[bytes], k: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, k)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :k] = x
    return out.view("<u8")[:, 0]


def settle(entries: DataFrame) -> DataFrame:
    """Step 2: kind 0 replies are runs that go, kind 1 stretches whose bytes are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "bucket"):
            bucket, out = rows[0]["bucket"], []
            for r in rows:
                if r["kind"] == 1:
                    doc = np.frombuffer(r["docs"], _DOC)
                    out += _replies(doc, np.repeat(np.arange(len(doc)), doc["count"]), _widen(r["s"], "<i4"), _widen(r["n"], "<i4"), 0, bucket)
            rows = [r for r in rows if r["kind"] == 0]
            if rows:
                doc = np.concatenate([np.frombuffer(r["docs"], _DOC) for r in rows])
                owner = np.repeat(np.arange(len(doc)), doc["count"])
                s = np.concatenate([_widen(r["s"], "<i4") for r in rows])
                n = np.concatenate([_widen(r["n"], "<i2") for r in rows])
                a, h = _five([r["a"] for r in rows], 5), _five([r["h"] for r in rows], 6)
                who = doc["doc"][owner]
                order = np.lexsort((who, h, a))
                a, h, owner, s, n, who = a[order], h[order], owner[order], s[order], n[order], who[order]
                new_a = np.append(True, a[1:] != a[:-1])
                new_h = new_a | np.append(True, h[1:] != h[:-1])
                first = np.flatnonzero(new_h)
                part = np.cumsum(new_h) - 1
                go = who > who[first][part]
                out += _replies(doc, *_runs(owner[go], s[go], n[go]), 0, bucket)
                whole = (np.cumsum(new_a) - 1)[first]
                edges = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
                low, high = np.minimum.reduceat(who[first], edges), np.maximum.reduceat(who[first], edges)
                # of a bucket with more than one document, the stretches of each part's smallest document
                ask = (low < high)[whole][part] & ~go
                out += _replies(doc, owner[ask], s[ask], n[ask], 1, bucket)
            if out:
                yield _table(out, _REPLY)

    n = parts(entries.sparkSession)
    return entries.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), _REPLY)


def _met(replies: DataFrame, keyed: DataFrame) -> DataFrame:
    """Each group's replies, then its documents."""
    names = [f.split()[0] for f in _REPLY.split(", ")]
    lit = {"kind": F.lit(9), "bucket": F.lit(-1)}
    none = F.lit(None).cast("binary")
    there = keyed.select("grp", lit["kind"].alias("kind"), lit["bucket"].alias("bucket"), none.alias("docs"), none.alias("s"), none.alias("n"), "doc", "hash", "raw")
    blank = replies.select(*names, F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("hash"), none.alias("raw"))
    return blank.unionByName(there).repartition(parts(keyed.sparkSession), "grp").sortWithinPartitions("grp", "kind")


class _Marks:
    """The replies of a group of documents, by document."""

    def __init__(self):
        self.held: list[tuple] = []
        self.at: dict | None = None

    def add(self, row: dict) -> None:
        doc = np.frombuffer(row["docs"], _DOC)
        owner = np.repeat(np.arange(len(doc)), doc["count"])
        s = _widen(row["s"], "<i4")
        self.held.append((doc["doc"][owner], doc["hash"][owner], s, _widen(row["n"], "<i4"), np.full(len(s), row["bucket"])))

    def of(self, doc: int, digest: int) -> tuple | None:
        if self.at is None:
            self.at = {}
            if self.held:
                d, x, s, n, b = (np.concatenate(c) for c in zip(*self.held, strict=True))
                order = np.lexsort((s, x, d))
                d, x, s, n, b = (c[order] for c in (d, x, s, n, b))
                edge = [*np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (x[1:] != x[:-1]))).tolist(), len(d)] if len(d) else [0]
                for i, j in zip(edge, edge[1:], strict=False):
                    self.at[int(d[i]), int(x[i])] = s[i:j], n[i:j], b[i:j]
        return self.at.get((doc, digest))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Marks, dict]]:
    """Each document with the replies of its group."""
    marks, grp = _Marks(), None
    for batch in batches:
        for row in batch.to_pylist():
            if row["grp"] != grp:
                marks, grp = _Marks(), row["grp"]
            if row["kind"] == 9:
                yield marks, row
            else:
                marks.add(row)


def asked(replies: DataFrame, keyed: DataFrame) -> DataFrame:
    """The stretches asked for, by bucket, with their bytes in ``a``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc = np.array([(d, x, g, 0) for d, x, g, *_ in held], _DOC)
            owner = np.repeat(np.arange(len(held)), [len(r[3]) for r in held])
            s, n, bucket = (np.concatenate([r[i] for r in held]) for i in (3, 4, 5))
            text = [raw[i : i + k] for *_, ss, nn, _, raw in held for i, k in zip(ss.tolist(), nn.tolist(), strict=True)]
            order = np.argsort(bucket, kind="stable")
            edge = [*np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])).tolist(), len(order)]
            out = []
            for i, j in zip(edge, edge[1:], strict=False):
                some = order[i:j]
                out.append((int(bucket[some[0]]), 0, _pack_docs(doc["doc"], doc["hash"], doc["grp"], owner[some]), b"".join(text[k] for k in some), b"", _squeeze(s[some], "<i4"), _squeeze(n[some], "<i2")))
            return _table(out, _ENTRY)

        for marks, row in _documents(batches):
            if (found := marks.of(row["doc"], row["hash"])) is not None:
                held.append((row["doc"], row["hash"], row["grp"], *found, row["raw"]))
                size += len(found[0])
                if size > 100_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return _met(replies, keyed).mapInArrow(tidy(run), _ENTRY)


def refine(stretch_rows: DataFrame, depth: int) -> DataFrame:
    """Step 3: the runs that go by bucket-pointer refinement inside each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "bucket"):
            doc = np.concatenate([np.frombuffer(r["docs"], _DOC) for r in rows])
            owner = np.repeat(np.arange(len(doc)), doc["count"])
            s = np.concatenate([_widen(r["s"], "<i4") for r in rows])
            n = np.concatenate([_widen(r["n"], "<i2") for r in rows])
            begin = np.cumsum(n) - n
            b = np.frombuffer(b"".join(r["a"] for r in rows), np.uint8)
            places, pointer = bucket_pointers(b, begin, n, depth)
            stretch = np.searchsorted(begin, places, "right") - 1
            who = doc["doc"][owner[stretch]]
            order = np.argsort(pointer, kind="stable")
            edge = np.flatnonzero(np.append(True, pointer[order][1:] != pointer[order][:-1])) if len(order) else np.array([], np.int64)
            go = np.zeros(len(places), bool)
            if len(edge):
                least = np.minimum.reduceat(who[order], edge)
                go[order] = who[order] > np.repeat(least, np.diff(np.append(edge, len(order))))
            hit = stretch[go]
            out = _replies(doc, *_runs(owner[hit], s[hit] + places[go] - begin[hit], np.full(len(hit), depth)), 0, rows[0]["bucket"])
            if out:
                yield _table(out, _REPLY)

    n = parts(stretch_rows.sparkSession)
    return stretch_rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), _REPLY)


def removed(docs: DataFrame, depth: int = DEPTH, q: int = Q) -> tuple[DataFrame, DataFrame]:
    """(replies, keyed documents): all runs that go, by group of documents."""
    spark = docs.sparkSession
    size = docs.select(F.octet_length("text").alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = max(parts(spark), -(-size // BUCKET))
    keyed = _keyed(docs, buckets)
    replies = materialise(settle(sampled(keyed, buckets, depth, q)), "repeats")
    wanted = asked(replies.where("kind = 1"), keyed)
    refined = materialise(refine(wanted, depth), "refined")
    return replies.where("kind = 0").unionByName(refined), keyed


def cleaned(docs: DataFrame, depth: int = DEPTH, q: int = Q) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each document's remaining bytes and what went."""
    replies, keyed = removed(docs, depth, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            doc = [None if r[0] == -(1 << 63) else r[0] for r in held]
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), *(pa.array([r[i] for r in held], pa.int64()) for i in (1, 2, 3)), pa.array([r[4] for r in held], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

        for marks, row in _documents(batches):
            raw, found = row["raw"], marks.of(row["doc"], row["hash"])
            if found is None:
                held.append((row["doc"], len(raw), 0, 0, raw))
            else:
                _, s, n = _runs(np.zeros(len(found[0]), np.int64), found[0], found[1])
                kept, at = [], 0
                for i, k in zip(s.tolist(), n.tolist(), strict=True):
                    kept.append(raw[at:i])
                    at = i + k
                held.append((row["doc"], len(raw), int(n.sum()), len(s), b"".join([*kept, raw[at:]])))
            if len(held) >= 1000:
                yield flush()
                held = []
        if held:
            yield flush()

    return _met(replies, keyed).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
