"""Ranked search, the filter audit and decontamination against brute force, on awkward documents and items."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tests.llm.test_operators import _awkward, _docs
from turnwise.llm import decontamination, filter_audit, ranked_search

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEM = "item_id long, text string, doc_id int, item string, rank int"


def _words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


@pytest.fixture(scope="module")
def texts():
    found = _awkward(80, 5)
    passage = " ".join(found[12].split()[:25])
    return found + ["Émile GRÖSSE É " + passage, passage.upper() + "!", "x " * 30 + passage.replace(" ", ", "), "A\x00b_c-d é", "#1 " * 210]


@pytest.fixture(scope="module")
def docs(spark, texts):
    ids = [None if i == 3 else 7 if i in (20, 21, 22) else i for i in range(len(texts))]
    return _docs(spark, texts, ids).cache(), ids


@pytest.fixture(scope="module")
def items(spark, texts):
    said = [(1, " ".join(texts[12].split()[:25])), (2, "alpha1 the of"), (3, None), (4, ""), (5, "nowhere to be seen " * 4), (1, " ".join(texts[12].split()[:25])), (6, texts[30]), (10, "Émile GRÖSSE É"), (None, " ".join(texts[40].split()[2:20])), (7, texts[30])]
    return spark.createDataFrame([(*r, 1, "i", 2) for r in said], ITEM), said


def _best(texts, ids, said, k):
    docs = [(d, Counter(_words(t))) for d, t in zip(ids, texts, strict=True) if _words(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in set(said):
        scores = []
        for d, c in docs:
            m = 25 + 75 * sum(c.values()) * n // total
            weight = lambda w: math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
            s = sum(q * weight(w) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, q in Counter(_words(text)).items() if c[w])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "most"), [(10, 400_000), (3, 20), (1, 1)])
def test_search_agrees_with_scoring_everything(spark, docs, items, texts, k, most):
    got = ranked_search.search(docs[0], items[0], k, most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == _best(texts, docs[1], items[1], k)


def test_search_prunes_and_counts_every_tie(spark):
    """Many equal documents of a common word, few of a rare one: the common word generates no candidates, ties go by id."""
    rows = [(i, "common filler text" if i % 2 else "common") for i in range(600)] + [(600 + i, "common rare") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = ranked_search.search(docs, spark.createDataFrame([(1, "common rare rare")], "item_id long, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(600, 610)) and len({r.score for r in got}) == 1
    vocabulary = {b"common": 0, b"rare": 1}
    index = ranked_search._index(docs, vocabulary).collect()
    n, total = len(index), sum(r.n for r in index)
    stats = {r.term: r for r in ranked_search._impacts(spark.createDataFrame(index, "doc_id long, n long, terms array<int>, tfs array<int>").coalesce(1), n, total, 10).groupBy("term").agg({"docs": "sum", "impact": "min"}).collect()}
    seeded = ranked_search._seeded([(0, 0, 1), (0, 1, 2)], n, {t: (r["sum(docs)"], r["min(impact)"], r["min(impact)"]) for t, r in stats.items()}, 2, 1, 10)
    assert seeded.terms.tolist() == [1, 0] and seeded.after[1] < seeded.floor[0] <= seeded.after[0]


def test_search_of_nothing(spark, docs, items):
    assert ranked_search.search(docs[0].limit(0), items[0]).count() == 0
    assert ranked_search.search(docs[0], items[0].limit(0)).count() == 0


def _hits(texts, said, size):
    wins = {}
    for item, text in said:
        w = _words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(item)
    for t in texts:
        w = _words(t)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        yield len(w), hit, sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize(("size", "most"), [(10, 500_000), (4, 10)])
def test_scan_agrees_with_looking_everywhere(spark, docs, items, texts, size, most):
    got = sorted((tuple(r) for r in decontamination.scan(docs[0], items[0], size, most).collect()), key=str)
    want = [(d, n, len(hit), found, bool(hit)) for d, (n, hit, found) in zip(docs[1], _hits(texts, items[1], size), strict=True)]
    assert got == sorted(want, key=str) and any(w[4] for w in want)


def test_removal_of_spans_and_documents(spark, docs, items, texts):
    dirty = [bool(h) for _, h, _ in _hits(texts, items[1], 10)]
    kept = decontamination.without_documents(docs[0], items[0])
    assert kept.columns == docs[0].columns and kept.count() == dirty.count(False)
    cut = decontamination.without_spans(docs[0], items[0])
    assert cut.schema.names == docs[0].schema.names and dict(cut.dtypes) == dict(docs[0].dtypes)
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in cut.collect()), key=str)
    want = []
    for d, t, (_, hit, _) in zip(docs[1], texts, _hits(texts, items[1], 10), strict=True):
        out, at, run = "", 0, None
        for k, m in enumerate(WORD.finditer(t or "")):
            if k in hit:
                run = (run[0] if run else m.start(), m.end())
            elif run:
                out, at, run = out + t[at : run[0]], run[1], None
        if run:
            out, at = out + t[at : run[0]], run[1]
        want.append((d, t if t is None else out + t[at:], len(t or "") if not hit else len(out + t[at:])))
    assert got == sorted(want, key=str)


def test_scan_of_nothing(spark, docs, items):
    assert decontamination.scan(docs[0].limit(0), items[0]).count() == 0
    clean = decontamination.scan(docs[0], items[0].limit(0)).collect()
    assert len(clean) == docs[0].count() and not any(r.contaminated for r in clean)


def _judged(texts, ids):
    for i, t in zip(ids, texts, strict=True):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u in zip(ids, texts, strict=True))
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), smaller)
        yield {f for f, x in zip("ABCDE", tests, strict=True) if x}


def test_audit_agrees_with_every_order(spark, docs, texts):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, len(texts), 3)] + [(6, 1, 1), (None, 1, 1)]
    got = filter_audit.audit(filter_audit.verdicts(docs[0], spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    rows = list(zip(docs[1], (r.lang or "" for r in docs[0].collect()), _judged(texts, docs[1]), strict=True))
    want, removals = {}, Counter()
    for part in {p for _, p, _ in rows}:
        for order in permutations("ABCDE"):
            left = [(d, f) for d, p, f in rows if p == part]
            for step, x in enumerate(order, 1):
                out, stay = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                every = [f for _, p, f in rows if p == part]
                want[part, "".join(order), step] = [len(stay), len(out), sum(x in f for f in every) - len(out), sum(f == {x} for f in every), sum(d in good for d, _ in out), sum(d in toxic for d, _ in out)]
                removals[part, x] += len(out)
                left = stay
    assert len(got) == len(want) == 1200
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] == want[r.part, r.filter_order, r.step]
        assert r.filter == r.filter_order[r.step - 1] and r.shapley == removals[r.part, r.filter]


def test_audit_of_nothing_and_too_much(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.verdicts(docs[0].limit(0), labels)).count() == 0
    with pytest.raises(ValueError, match="1 to 7 filters"):
        filter_audit.audit(docs[0], tuple("ABCDEFGH"))
