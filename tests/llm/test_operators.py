"""Each operator against a brute-force version or an exact round trip, on a table of awkward documents."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from turnwise.llm import (
    bloom_fingerprint,
    chunked_bpe,
    hilbert_shards,
    line_dedup,
    mixture_packing,
    multi_index_hashing,
    ngram_join,
    pieces,
    pii_bootstrap,
    quality_gam,
    suffix_dedup,
)
from turnwise.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, n int, rank int, shard int, text_hash string, spans string"


def _docs(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    rows = [
        (i if ids is None else ids[i], t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else "hot", len(t or ""), "x", 1, 2, 3, 4, "h", "s")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def _awkward(n=120, seed=1):
    draw = random.Random(seed)
    words = ["the", "of", "alpha", "beta", "Gamma", "delta.", "x1", "émile", "größe", "zeta,", "eta", "theta", "iota", "kappa"]
    pool = [" ".join(draw.choice(words) + str(draw.randint(0, 40)) for _ in range(60)) for _ in range(8)]
    out = [None, "", " ", "\n\n", "one", "long " * 9000, "y" * 3000]
    for _ in range(n):
        lines = []
        for _ in range(draw.randint(1, 5)):
            base = draw.choice(pool).split()
            at = draw.randint(0, 30)
            line = base[at : at + draw.randint(3, 40)]
            if draw.random() < 0.5:
                line[draw.randrange(len(line))] = f"new{draw.randint(0, 999)}"
            lines.append(" ".join(line))
        out.append("\n".join(lines))
    return out + out[10:30]  # copies


@pytest.fixture(scope="module")
def texts():
    return _awkward()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return _docs(spark, texts).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, [])


def test_hilbert_index_is_a_path(spark):
    from pyspark.sql import functions as F

    cells = spark.range(64).select(F.array(*(F.shiftright("id", 2 * i).bitwiseAND(F.lit(3)).cast("int") for i in range(3))).alias("c"))
    rows = sorted((r.h, tuple(r.c)) for r in cells.withColumn("h", hilbert_index(3, 2)).collect())
    assert [h for h, _ in rows] == list(range(64))
    assert all(sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1 for (_, a), (_, b) in zip(rows, rows[1:], strict=False))


def hilbert_index(n, bits):
    from pyspark.sql import functions as F

    return hilbert_shards.hilbert_index(F.col("c"), n, bits)


def test_shards_are_even_and_gapless(docs, texts, empty):
    rows = hilbert_shards.shard(docs, 8).collect()
    assert len(rows) == len(texts)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    assert hilbert_shards.shard(empty, 8).count() == 0


def test_written_shards_hold_every_row(docs, texts, tmp_path, spark):
    twice = docs.unionByName(docs.where("doc_id < 9")).unionByName(_docs(spark, ["no id", None], ids=[None, None]))
    placed = hilbert_shards.shard(twice, 4)
    column = hilbert_shards.write_shards(twice, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert column == "shard_1" and sorted(back.columns) == sorted([*docs.columns, column])
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in twice.collect())
    assert {r[column]: r["count"] for r in back.groupBy(column).count().collect()} == {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}


def test_shards_follow_the_curve_and_prune(spark):
    draw = random.Random(4)
    rows = [(i, "x" * draw.randint(0, 500), draw.choice(["de", "en", "fr", "es"]), f"source-of-documents-{draw.randint(0, 15):02d}") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    placed = hilbert_shards.shard(docs, 16)
    got = sorted(placed.collect(), key=lambda r: (r.shard, r.slot))
    assert all(a.curve <= b.curve for a, b in zip(got, got[1:], strict=False)) and len({r.curve for r in got}) > 200
    ranges = hilbert_shards.prunable(placed).collect()
    sources = [sum(r.min_source <= f"source-of-documents-{k:02d}" <= r.max_source for r in ranges) for k in range(16)]
    langs = [sum(r.min_lang <= k <= r.max_lang for r in ranges) for k in ("de", "en", "es", "fr")]
    assert sum(sources) / 16 < 10 and sum(langs) / 4 < 10  # of 16 shards; without the curve nearly all


def test_quality_separates_junk(spark):
    draw = random.Random(3)
    good = [" ".join(draw.choice("the of and walk talk house tree".split()) for _ in range(40)) + "." for _ in range(150)]
    junk = ["*** $$$ | " * draw.randint(3, 30) for _ in range(150)]
    docs = _docs(spark, good + junk + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(0, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_gam.classify(docs, labels).collect()}
    assert len(rows) == 302 and all(0 <= r.score <= 1 for r in rows.values())
    held = [r for r in rows.values() if r.held_out and r.doc_id < 300]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    assert np.mean([r.predicted == (r.doc_id < 150) for r in held]) > 0.97
    kept = quality_gam.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}


def test_quality_without_labels_or_documents(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_gam.classify(docs, none).select("score").distinct().count() == 1
    assert quality_gam.classify(empty, none).count() == 0


def test_pairwise_model_learns_an_interaction():
    x = np.random.default_rng(0).uniform(size=(3000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality_gam.fit(x, y, rounds=20, pair_rounds=80)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def _repeats(rows, depth=50):
    first = {}
    enc = [(i, (t or "").encode()) for i, t in rows]
    for i, b in enc:
        for x in range(len(b) - depth + 1):
            k = b[x : x + depth]
            first[k] = min(i, first.get(k, i))
    out = {}
    for i, b in enc:
        gone = bytearray(len(b))
        for x in range(len(b) - depth + 1):
            if first[b[x : x + depth]] < i:
                gone[x : x + depth] = b"\1" * depth
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone, strict=True) if not g)
    return out


def test_repeated_byte_strings_go(docs, texts, empty):
    want = _repeats(list(enumerate(texts)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.cleaned(docs).collect()}
    assert got == want and any(w[1] for w in want.values())
    assert suffix_dedup.cleaned(empty).count() == 0


def test_bucket_pointers_equal_strings():
    draw = random.Random(5)
    parts = ["".join(draw.choice("ab") for _ in range(draw.randint(50, 80))).encode() for _ in range(40)] * 2
    b, size = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
    begin = np.cumsum(size) - size
    places, pointer = suffix_dedup.bucket_pointers(b, begin, size)
    by_string, by_pointer = defaultdict(set), defaultdict(set)
    for p, q in zip(places.tolist(), pointer.tolist(), strict=True):
        by_string[bytes(b[p : p + 50])].add(p)
        by_pointer[q].add(p)
    assert sorted(map(sorted, by_string.values())) == sorted(map(sorted, by_pointer.values()))


def _lines(texts):
    rows = []
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            rows.append((i, k, frozenset(w for w in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if w)))
    gone = defaultdict(list)
    for j, (i, k, s) in enumerate(rows):
        if s and any(e and 5 * len(s & e) >= 4 * len(s | e) for _, _, e in rows[:j]):
            gone[i].append(k)
    return gone


def test_lines_that_match_earlier_ones_go(docs, texts, empty):
    want = _lines(texts)
    for r in line_dedup.report(docs).collect():
        assert (r.removed or []) == want.get(r.doc_id, []) and r.n_lines == len((texts[r.doc_id] or "").split("\n"))
    cleaned = line_dedup.without_repeats(docs)
    assert cleaned.columns == docs.columns
    for r in cleaned.collect():
        gone = set(want.get(r.doc_id, []))
        assert r.text == (texts[r.doc_id] if not gone else "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in gone))
    assert line_dedup.report(empty).count() == 0 and line_dedup.without_repeats(empty).count() == 0


def test_similar_lines_of_one_large_group_settle(spark):
    draw = random.Random(7)
    base = [f"w{k}" for k in range(30)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(30)] = f"z{draw.randint(0, 9999)}"
        texts.append(" ".join(w))
    want = _lines(texts)
    got = {r.doc_id: r.removed or [] for r in line_dedup.report(_docs(spark, texts)).collect()}
    assert got == {i: want.get(i, []) for i in range(150)}


def test_fingerprints(docs, texts, empty):
    split = lambda t: {p for p in re.split(r"\n|(?<=[.!?]) ", t) if p}
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    seen = {}
    order = sorted(range(len(texts)), reverse=True)
    rows = {r.doc_id: r for r in bloom_fingerprint.edited_pairs(docs).collect()}
    for at, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r = rows[i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(split(own), split(edited))) and r.near_next == pytest.approx(like(split(own), split(after)))
        assert seen.setdefault(own, r.fingerprint) == r.fingerprint
    assert bloom_fingerprint.edited_pairs(empty).count() == 0


def test_likeness_reads_only_the_strings(docs):
    rows = bloom_fingerprint.edited_pairs(docs).select("fingerprint", "edited_fingerprint", "near_edited").collect()
    again = bloom_fingerprint.likeness(*(bloom_fingerprint.from_text([r[i] for r in rows]) for i in (0, 1)))
    assert again.tolist() == [r.near_edited for r in rows]


def test_peeling_recovers_what_differs():
    cases = [(range(0, 900), range(40, 930)), (range(5), range(3, 700)), ([], range(60)), (range(300), range(1000, 1300)), ([], []), (range(20000), range(10, 20000))]
    draw = np.random.default_rng(1).integers(0, 1 << bloom_fingerprint.DIGEST, 20000, dtype=np.uint64)
    sides = []
    for side in (0, 1):
        keys = [draw[list(c[side])] if len(c[side]) else np.array([], np.uint64) for c in cases]
        sides.append(bloom_fingerprint.sketch(np.concatenate(keys), np.repeat(np.arange(len(cases)), [len(k) for k in keys]), len(cases)))
    held = [set(c[0]) for c in cases]
    k, o, good = sides[0].peel()
    assert good.all() and all(set(k[o == i].tolist()) == {int(draw[x]) for x in h} for i, h in enumerate(held))
    for got, (a, b) in zip(bloom_fingerprint.likeness(*sides), cases, strict=True):
        x, y = set(a), set(b)
        assert got == (1.0 if not x | y else pytest.approx(len(x & y) / len(x | y)))


def test_the_next_text_is_not_sketched_again(monkeypatch):
    made, real = [], bloom_fingerprint.sketch
    monkeypatch.setattr(bloom_fingerprint, "sketch", lambda k, o, n: made.append(n) or real(k, o, n))
    own = [[1, 2, 3], [4], [], [5, 6], [5, 7]]
    after = [*own[1:4], [5, 9], [5, 8, 7]]  # the last two aren't those of the following row
    columns = {"doc_id": [1] * 5, "n_chars": [1] * 5, "edited_sha256": [""] * 5} | {c: pa.array(v, pa.list_(pa.int64())) for c, v in (("own", own), ("changed", own), ("next", after))}
    got = pa.Table.from_batches(bloom_fingerprint._fingerprinted(iter([pa.RecordBatch.from_pydict(columns)])))
    assert got["near_next"].to_pylist() == [len({*a} & {*b}) / len({*a} | {*b}) for a, b in zip(own, after, strict=True)]
    assert sum(made) == 5 + 5 + 2


def test_next_of_wide_sparse_and_null_ids(spark):
    ids = [-(2**62) - 5, 2**62 + 9, 5, None, *range(40, 90), 2**40]
    texts = [f"text {i} of a few words" for i in range(len(ids))]
    rows = {r.doc_id: r.next_text for r in bloom_fingerprint.with_next(_docs(spark, texts, ids=ids)).collect()}
    order = sorted(zip(ids, texts, strict=True), key=lambda p: (p[0] is not None, p[0] or 0), reverse=True)
    assert rows == {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}


def _base(t):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            ok = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_entities(spark, empty):
    draw = random.Random(3)
    parts = ["a", "é", "@", "b.c", ".", "12", " ", "-", "+1 ", "(4)", "4111 1111 1111 1111 ", "999.1.2.3", "1.2.3.4", "00255", "%", "\n", "x@y.zz"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(300)] + ["1" * 30000, "a." * 20000 + "@b" + ".c" * 20000, "", None]
    for r in pii_bootstrap.report(_docs(spark, texts)).collect():
        want = _base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(","))  or not want
    assert pii_bootstrap.report(empty).count() == 0


def test_confident_contexts_discover(spark):
    texts = [f"please call tel +1 555 222 {1000 + k} today" for k in range(40)] + ["please call tel 0044x5552 today", "take 3 apples"]
    rows = {r.doc_id: r for r in pii_bootstrap.report(_docs(spark, texts)).collect()}
    assert rows[40].spans == "phone:16:25" and rows[40].n_phone == 0 and rows[41].spans == ""
    masked = {r.doc_id: r.text for r in pii_bootstrap.masked(_docs(spark, texts)).collect()}
    assert masked[40] == "please call tel <PHONE> today" and masked[0] == "please call tel <PHONE> today" and masked[41] == texts[41]


def test_what_is_found_finds_more(spark):
    texts = [f"please call tel +1 555 222 {1000 + k} today" for k in range(400)]
    texts += [f"please call tel q{k}x7 today" for k in range(20)] + [f"my handset code q{k}x7 rings" for k in range(20)] + ["my handset code zz9unseen rings"]
    far = "a" * 200
    texts += [f"{far} +1 555 333 {1000 + k}" for k in range(40)] + [f"{far} 77z9"] + [f"{far}b w{k}7" for k in range(3)]
    rows = {r.doc_id: r.spans for r in pii_bootstrap.report(_docs(spark, texts)).collect()}
    assert all(rows[400 + k].startswith("phone:16:") for k in range(20)) and all(rows[420 + k].startswith("phone:16:") for k in range(20))
    assert rows[440] == "phone:16:25" and rows[481] == "phone:201:205" and rows[482] == ""


def test_contexts_find_secrets_that_no_pattern_knows(spark):
    """Seeds are lower-case digests; what else stands after the words they stand after is found, decoys are not."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abdeghinorstu") for _ in range(draw.randint(2, 9)))
    hexa = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(38)) + "a7"
    texts, want = [], {}
    for i in range(600):
        before, after = (" ".join(word() for _ in range(draw.randint(3, 12))) for _ in range(2))
        hidden = {0: hexa().upper(), 1: "zQ-" + str(draw.getrandbits(40)), 2: f"wq{i}"}.get(i % 20)
        if i % 3 == 2:  # no secrets: versions, decoys of cards, years
            texts.append(f"{before} {draw.choice(['version 2.0', '4310000000000000', 'in 1987', 'room 12b'])} {after}")
            continue
        token = hidden or hexa()
        texts.append(f'{before} token = "{token}" {after}')
        want[i] = f"secret:{len(before) + 10}:{len(before) + 10 + len(token)}"
    rows = {r.doc_id: r for r in pii_bootstrap.report(_docs(spark, texts)).collect()}
    assert {i: r.spans for i, r in rows.items() if r.spans} == want


def test_planted_secrets_and_nothing_else(spark):
    """On the given documents the method finds the planted tokens (156 of 166 are seeds, the others stand in upper case), and what it adds are planted tokens."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    planted = {(i, m.start(1), m.end(1)) for i, t in text.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t, re.I)}
    base, added = set(), set()
    for r in pii_bootstrap.report(docs).collect():
        for kind, a, b in (s.split(":") for s in r.spans.split(",") if s):
            (added if kind == "secret" else base).add((r.doc_id, int(a), int(b)))
        assert len([s for s in r.spans.split(",") if s and not s.startswith("secret")]) == r.n_email + r.n_ip + r.n_card + r.n_phone
    print("planted", len(planted), "added", len(added), "both", len(planted & added))
    assert len(planted & added) / len(planted) >= 0.95 and len(planted & added) / len(added) >= 0.95


def _tokens(texts, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(name))
    return model, [np.array(e.ids, "<u4") for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing(docs, texts, empty):
    _, ids = _tokens(texts, "word_bpe_49k.json")
    ids = [np.append(x, 2).astype("<u4") for x in ids]
    rows = mixture_packing.pack(docs).collect()
    windows, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        want = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(want.tobytes()) and bytes(r.ids) == want.tobytes() and r.doc_tokens == len(ids[r.doc_id])
        windows[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append((r.start, r.length))
    for parts in [*windows.values(), *seen.values()]:
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
    sizes = [sum(n for _, n in w) for w in windows.values()]
    assert sorted(sizes)[1:] == [4096] * (len(sizes) - 1)
    assert all(sum(n for _, n in seen[i]) == len(x) for i, x in enumerate(ids))
    assert mixture_packing.pack(empty).count() == 0


@pytest.mark.parametrize("targets", [None, [3, 1, 1], [0, 1, 1], [1, 0, 0]])
def test_schedules_serve_everything(targets):
    totals = [5000, 12345, 777]
    s = mixture_packing.Schedule(totals, targets, 64)
    at = defaultdict(list)
    for q, n in enumerate(totals):
        got = s.pieces(q, 0, n)
        assert sum(p[1] for p in got) == n
        for _, n_, w, o in got:
            at[w].append((o, n_))
    for parts in at.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 64
    if targets == [3, 1, 1]:
        first = [sum(p[1] for p in s.pieces(q, 0, n) if p[2] < 10) for q, n in enumerate(totals)]
        assert first == [384, 128, 128]


@pytest.mark.parametrize("size", [600, 2400])
def test_nearest_neighbours(spark, size):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(size, 16)).astype(np.float32)
    x[50:90] = x[10]  # copies
    odd = [(size, None, 0), (size + 1, [0.0] * 16, 0), (size + 2, [float("nan")] * 16, 0), (size + 4, [None] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<float>, slice int")
    from pyspark.sql import functions as F

    found = defaultdict(list)
    for r in multi_index_hashing.search(df, F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = total = 0
    full = x.astype(float)
    for q in range(0, size, 20):
        score = (full * full[q]).sum(1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(size), -score))[:20]
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert all(s == pytest.approx(score[v], abs=1e-9) for _, v, s in got)
        hit += len(set(best) & {v for _, v, _ in got})
        total += 20
    assert hit / total >= 0.9
    assert multi_index_hashing.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = multi_index_hashing.search(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0)
    assert few.count() == 4
    with pytest.raises(ValueError):
        multi_index_hashing.search(df.union(spark.createDataFrame([(size, [1.0] * 3, 0)], df.schema)), F.col("vec_id") % 20 == 0)


def test_repeated_ids_of_vectors(spark):
    """Rows that repeat an id are candidates each; as a query the smallest of its vectors counts, whatever their order."""
    from pyspark.sql import functions as F

    x = np.random.default_rng(5).normal(size=(30, 4)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, [-9.0, 0.0, 0.0, 1.0]), (7, [9.0, 0.0, 0.0, -1.0]), (7, [9.0, 0.0, 0.0, -1.0])]
    runs = [multi_index_hashing.search(spark.createDataFrame(r, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5).collect() for r in (rows, rows[::-1])]
    others = [(sum(a * b for a, b in zip([-9.0, 0.0, 0.0, 1.0], v, strict=True)), i) for i, v in rows if i != 0]
    want = [i for _, i in sorted(others, key=lambda o: (-o[0], o[1]))[:5]]
    for got in runs:
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == want


def test_probing_retrieves_every_code_within_the_radius_once():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(900, 24))
    coder = multi_index_hashing.learn(x[:300], float(np.sqrt((x**2).sum(1)).max()))
    ids = np.arange(900) * 3
    index, ask = multi_index_hashing.Index(coder, ids, x), x[:40]
    for radius in (0, 5, 8, 15, 21, 27, 64):
        got = index.best(coder, ids[:40], ask, radius, 900).to_pydict()
        apart = np.bitwise_count(coder.codes(ask, True)[:, None] ^ coder.codes(x)) <= radius
        want = {(int(ids[q]), int(ids[r])) for q, r in zip(*np.nonzero(apart), strict=True) if q != r}
        pairs = list(zip(got["query_id"], got["vec_id"], strict=True))
        assert len(pairs) == len(set(pairs)) == sum(got["reranked"]) and set(pairs) == want


def test_chunks_encode_as_whole_texts(docs, texts, empty):
    odd = ["a <|endoftext|> b" * 200, "日本 é " * 400, " " * 4000, "\x1c a" * 700]
    model, ids = _tokens(texts + odd, "byte_bpe_50k.json")
    ours = chunked_bpe._load(None)
    for bits, least in ((10, 256), (5, 16)):
        cuts, chunked_bpe.cuts.__defaults__ = chunked_bpe.cuts.__defaults__, (bits, least)
        got = chunked_bpe.encode_block(ours, [t or "" for t in texts + odd], chunked_bpe.Memory())
        chunked_bpe.cuts.__defaults__ = cuts
        assert all(np.array_equal(a, b) for a, b in zip(ids, got, strict=True))
    for r in chunked_bpe.decode(chunked_bpe.encode(docs)).collect():
        assert bytes(r.ids) == ids[r.doc_id].tobytes() and r.n_tokens == len(ids[r.doc_id])
        assert r.text == model.decode(ids[r.doc_id].tolist(), skip_special_tokens=False)
    assert chunked_bpe.encode(empty).count() == 0


def test_remembered_texts_without_boundaries_go_on():
    draw = random.Random(3)
    long = "".join(draw.choice("abcdefghij0123456789") for _ in range(9000))
    at = chunked_bpe.cuts(long.encode())
    assert len(at) > 2
    model = chunked_bpe._load(None)
    every = [long[: at[1]], long, long[: at[1]] + " and some more words" * 200]
    got = chunked_bpe.encode_block(model, every, chunked_bpe.Memory())
    assert all(np.array_equal(np.frombuffer(w, model.kind), g) for w, g in zip(model.encode(every), got, strict=True))


def test_chunks_are_shared_and_joined_until_they_agree(monkeypatch):
    draw = random.Random(6)
    model = chunked_bpe._load(None)
    words = lambda n: " ".join(f"w{draw.randint(0, 9999)}" for _ in range(n))
    passage = words(3000)
    every = [words(50) + " " + passage + " " + words(50) for _ in range(20)]
    want = [np.frombuffer(x, model.kind) for x in model.encode(every)]
    memory = chunked_bpe.Memory()
    got = [chunked_bpe.encode_block(model, [t], memory)[0] for t in every]
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True)) and memory.hits > 15 * len(passage) / 2000
    agree, asked = chunked_bpe._agree, []

    def doubtful(joint, a, b):
        asked.append(joint is not None)
        return agree(joint, a, b) and (joint is None or len(asked) % 3 > 0)

    monkeypatch.setattr(chunked_bpe, "_agree", doubtful)
    got = chunked_bpe.encode_block(model, every, chunked_bpe.Memory())
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True)) and sum(asked) > 100
    small = chunked_bpe.Memory(room=2000)
    assert all(np.array_equal(a, b) for a, b in zip(want, chunked_bpe.encode_block(model, every, small), strict=True)) and small.held < 20_000


def _classes(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    reps = sorted(i for s, i in first.items() if s)
    up = {i: i for i in reps}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = Counter()
    for a in reps:
        for b in reps:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (first[s], root(first[s]), links[first[s]]) if s else (i, i, 0) for i, s in enumerate(sets)}


def test_similar_documents_share_a_class(spark, docs, texts, empty):
    draw = random.Random(9)
    base = [f"w{draw.randint(0, 5000)}" for _ in range(120)]
    near = []
    for _ in range(60):
        w = list(base)
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(120)] = f"z{draw.randint(0, 99)}"
        near.append(" ".join(w))
    every = texts + near
    want = _classes(every)
    for block in (256, 16):
        got = {r.doc_id: (r.set_id, r.class_id, r.n_links) for r in ngram_join.classes(_docs(spark, every), block=block).collect()}
        assert got == want
    kept = {r.doc_id for r in ngram_join.one_of_each(_docs(spark, every)).collect()}
    assert kept == {i for i, (_, c, _) in want.items() if c == i}
    assert ngram_join.classes(empty).count() == 0


def test_slices_of_a_few_words(spark):
    every = ["one two three four five six"[:k] for k in (3, 7, 13, 18, 23, 27)]
    alone = [ngram_join.shingle_sets(ngram_join.Words(), [t], 5)[0] for t in every]
    together = ngram_join.shingle_sets(ngram_join.Words(), every, 5)
    assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))
    for n in range(2, 6):
        assert all(len(ngram_join.shingle_sets(ngram_join.Words(), [t], n)[0]) == max(1, len(t.split()) - n + 1) for t in every)
    docs = _docs(spark, every[1:3]).repartition(2, "doc_id")
    want = _classes(every[1:3])
    assert {r.doc_id: (r.set_id, r.class_id, r.n_links) for r in ngram_join.classes(docs).collect()} == want


def test_rows_that_repeat_an_id(spark):
    docs = _docs(spark, ["same text of more than five words here", "other words that do not match at all"] * 2, ids=[7, 8, 7, 8])
    assert ngram_join.classes(docs).count() == 4
    assert line_dedup.report(docs).where("n_removed > 0").count() == 0
    assert suffix_dedup.cleaned(docs).where("n_removed > 0").count() == 0
    assert mixture_packing.pack(docs).count() >= 4
    assert hilbert_shards.shard(docs, 8).count() == 4
    assert bloom_fingerprint.edited_pairs(docs).count() == 4


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: root(i) for i in up if i not in alone}


def test_targets_of_small_sources_hold(spark):
    texts = [" ".join(["word"] * 900)] * 8 + ["tiny words"] * 40
    rows = [(i, t, "big" if i < 8 else "tiny" if i < 30 else "other") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixture_packing.pack(docs, window=64, targets={"big": 0.5, "tiny": 0.5}, with_ids=False).collect()
    tiny = sum(r.length for r in got if 8 <= r.doc_id < 30)
    early = [r for r in got if r.sequence_id < tiny // 32]
    assert sum(r.length for r in early if 8 <= r.doc_id < 30) == tiny // 32 * 32
    assert sum(r.length for r in got if r.doc_id >= 30) and not any(r.doc_id >= 30 for r in early)


@pytest.mark.parametrize("name, pattern, lower", [("word_bpe_49k.json", pieces.WORD_PIECES, True), ("byte_bpe_50k.json", pieces.BYTE_PIECES, False)])
def test_pieces_are_merged_alone(name, pattern, lower, monkeypatch):
    """New pieces are given to the merges alone, and to the whole tokenizer only in texts outside Latin-1; the ids are the tokenizer's own, also when memory turns over."""
    import public_tokenizers

    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    words = pieces.PieceIds(public_tokenizers.path(name), pattern, lower)
    r = random.Random(5)
    texts = ["".join(chr(r.randrange(256)) if r.random() < 0.3 else r.choice("abcAB' st'sd.,12\n\t\x1d\xa0\x85\xe9") for _ in range(r.randrange(60))) for _ in range(400)]
    texts += ["", " ", "caf\xe9's  \xc9T\xc9", "<|endoftext|> a", "\u4e2d\u6587 text", "e\u0301"]
    whole, asked = words._encode(texts), []
    real = words._encode
    monkeypatch.setattr(words, "_encode", lambda t: asked.extend(t) or real(t))
    assert words.encode(texts) == whole == words.encode(texts[::-1])[::-1]
    assert set(asked) == set(texts[-3:])


def test_words_are_cut_into_pieces_once(monkeypatch):
    """Words between white space are remembered whole, long ones are not; the ids are the tokenizer's own, also at odd separators and when memory turns over."""
    import public_tokenizers

    words = pieces.PieceIds(public_tokenizers.path("word_bpe_49k.json"), pieces.WORD_PIECES, True, True)
    texts = ["L'\xe9t\xe9 don't stop, 3.14!", "a\x1cb\x1db \x1e\x1fc\x85d\xa0e\x0bf\x0cg\x00h", "", " \n", "<|x|> a", "你 a", "x" * 500 + " it's IT'S it's"]
    wanted = words._encode(texts)
    assert words.encode(texts) == wanted and max(map(len, words.words)) <= pieces.LONGEST >= max(map(len, words.young))
    cut, find = [], words.find
    words.find = lambda t: cut.append(t) or find(t)
    assert words.encode([texts[0]] * 3) == [wanted[0]] * 3 and not cut
    monkeypatch.setattr(pieces, "WORDS", 3)
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    assert words.encode(texts * 2) == wanted * 2


def test_shares_are_prepared_for_many_documents_at_once(monkeypatch):
    """Prepared shares are those made one by one, and documents within two blocks of windows need no others; phases and queues that ran out included."""
    for totals, targets in (([40_000, 70_000, 9_000], None), ([40_000, 70_000, 9_000, 0], [0.6, 0.2, 0.2, 0.0])):
        plain, s = mixture_packing.Schedule(totals, targets, 64), mixture_packing.Schedule(totals, targets, 64)
        docs = [(q, b, min(500, t - b)) for q, t in enumerate(totals) for b in range(0, t, 500)]
        wanted = [plain.pieces(*d) for d in docs]
        s.prepare(*map(np.array, zip(*docs, strict=True)))
        made, served = [], s._served
        monkeypatch.setattr(s, "_served", lambda *a, served=served, made=made: made.append(a) or served(*a))
        assert [s.pieces(*d) for d in docs] == wanted and not made
    monkeypatch.setattr(mixture_packing, "KEPT", 1)
    s.prepare(*map(np.array, zip(*docs, strict=True)))
    assert [s.pieces(*d) for d in docs] == wanted
