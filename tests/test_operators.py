"""Operators on hand-computed cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as X
from turnwise.operators import asking, catalogs, retrieval, scoring, semantic, state
from turnwise.plans import replay, variants
from turnwise.sources import views as V


def _catalog(spark, rows):
    return spark.createDataFrame(rows, "ord long, " + V.CATALOG_SCHEMA)


@pytest.fixture()
def shop(spark):
    make = lambda i, title, cats, price, n: (i, f"P{i}", title, [title], None, price, ["root", "Women", cats], {"Color": title.split()[0], "Material": "cotton"}, 4.0, n, "S")
    return _catalog(spark, [make(0, "red shirt", "Shirts", 5.0, 10.0), make(1, "blue shirt", "Shirts", None, 500.0), make(2, "green boots", "Boots", None, 0.0)])


def test_profile(shop):
    got = {r.field: (r.present, r.missing, r.coverage) for r in catalogs.profile(shop, ("price", "title", "description")).collect()}
    assert got == {"price": (1, 2, 0.333333), "title": (3, 0, 1.0), "description": (0, 3, 0.0)}


def test_gazetteer(shop):
    got = {(r.slot, r.term): r.support for r in catalogs.gazetteer(shop, {"color": "Color"}).collect()}
    assert got == {("category", "shirt"): 2, ("category", "boot"): 1, ("color", "red"): 1, ("color", "blue"): 1, ("color", "green"): 1}


def test_conflicts(spark):
    df = spark.createDataFrame([("color", "silver", 3), ("material", "silver", 1), ("size", "small", 2), ("style", "small", 9)], "slot string, term string, support long")
    assert {(r.slot, r.term) for r in catalogs.resolve_conflicts(df).collect()} == {("material", "silver"), ("size", "small")}


def test_longest_match_wins(spark):
    words = spark.createDataFrame([("category", "running shoe", 1), ("category", "shoe", 5), ("department", "men", 1)], "slot string, term string, support long")
    said = spark.createDataFrame([("looking for men's running shoes",), ("blackberry",)], "m string")
    got = {(r.m, r.slot, r.term) for r in catalogs.extract_slots(said, words, "m", "m").collect()}
    assert got == {("looking for men's running shoes", "category", "running shoe"), ("looking for men's running shoes", "department", "men")}


def test_bm25_and_rerank(spark, shop):
    texts = V.field_texts(shop)
    q = spark.createDataFrame([("q", "red"), ("q", "shirt"), ("none", "zzz")], "query string, term string")
    got = retrieval.bm25(q, texts, 10).orderBy("rank").collect()
    assert [(r.query, r.ord) for r in got] == [("q", 0), ("q", 1)]
    pool = retrieval.bm25(q, texts, 10).select("query", "ord", "rank", F.array(F.lit("red"), F.lit("shirt")).alias("terms"))
    plain = retrieval.rerank(pool, texts, 10, popularity=0, price=0).orderBy("rank").collect()
    assert [(r.ord, r.score) for r in plain] == [(0, 8.0), (1, 4.0)]
    assert retrieval.rerank(pool, texts, 10, popularity=5, price=0).orderBy("rank").first().ord == 1


def test_union_keeps_the_first_pool_ahead(spark):
    a = spark.createDataFrame([("q", 5, 1), ("q", 6, 2)], "query string, ord long, rank int")
    b = spark.createDataFrame([("q", 6, 1), ("q", 7, 2), ("r", 1, 1)], "query string, ord long, rank int")
    got = {(r.query, r.ord): r["rank"] for r in retrieval.union_pool(a, b).collect()}
    assert got == {("q", 5): 1, ("q", 6): 2, ("q", 7): 3, ("r", 1): 1}
    assert [r.ord for r in retrieval.rrf([a, b], 3).where("query = 'q'").orderBy("rank").collect()] == [6, 5, 7]


def test_terms_of_any_length(spark, shop):
    long = "one two three four five six"
    both = shop.withColumn("title", F.when(F.col("ord") < 2, F.concat(F.lit(long + " "), "title")).otherwise(F.col("title")))
    terms = spark.createDataFrame([(long,), ("two three four five six red shirt",), ("shirt",), (long + " boot",)], "term string")
    assert {r.term: r.support for r in catalogs.term_support(both, terms).collect()} == {long: 2, "two three four five six red shirt": 1, "shirt": 2, long + " boot": 0}
    words = spark.createDataFrame([("category", long, 1), ("category", "six", 1)], "slot string, term string, support long")
    said = spark.createDataFrame([(f"I want {long} now",)], "m string")
    assert [r.term for r in catalogs.extract_slots(said, words, "m", "m").collect()] == [long]


def _said(spark, *turns):
    return spark.createDataFrame([("s", "buying", t, m) for t, m in turns], "sample_id string, scenario_type string, turn int, message string")


def test_ledger(spark):
    words = spark.createDataFrame([("category", "belt", 1), ("color", "black", 1), ("color", "red", 1), ("style", "casual", 1)], "slot string, term string, support long")
    said = _said(spark, (1, "belts closure black"), (3, "casual"), (4, "Actually, ignore my earlier preference. red"))
    got = {r.token: r.status for r in state.entries(state.hear(said, words)).collect()}
    want = {"belts": "active", "closure": "revoked", "black": "superseded", "casual": "active", "red": "active"}
    assert {k: got[k] for k in want} == want
    again = _said(spark, (1, "belts closure"), (2, "Actually, ignore my earlier preference. red"), (3, "closure"))
    assert {r.token: r.status for r in state.entries(state.hear(again, words)).collect()}["closure"] == "active"
    assert [r.token for r in state.projection(state.entries(state.hear(again, words))).orderBy("place").collect()][:2] == ["belts", "closure"]


def _colors(spark):
    return spark.createDataFrame([("color", "black", 1), ("color", "red", 1), ("color", "blue", 1)], "slot string, term string, support long")


def test_gains_and_changes(spark):
    said = _said(spark, (1, "red shoe"), (2, "red"), (3, "shoe"), (4, "blue"))
    assert [(r.gained, r.stuck_for) for r in state.gains(state.hear(said, _colors(spark))).orderBy("turn").collect()] == [(2, 0), (0, 1), (0, 2), (1, 0)]
    terms = state.turn_terms(said, state.active_by_turn(state.hear(said, _colors(spark))))
    assert [r.dead for r in state.changes(terms).orderBy("turn").collect()] == [False, True, True, False]
    ranked = spark.createDataFrame([("s", 2, 5), ("s", 3, None)], "sample_id string, turn int, rank int")
    assert [r.dead for r in state.changes(terms, ranked).orderBy("turn").collect()] == [False, False, True, False]


def test_overrides_drop_and_date_anew(spark):
    said = _said(spark, (1, "closure black"), (2, "Actually, ignore my earlier preference. red"), (3, "closure"))
    active = state.active_by_turn(state.hear(said, _colors(spark)))
    terms = state.turn_terms(said, active)
    lost = {r.turn: r.lost for r in state.changes(terms).collect()}
    assert lost[1] == "" and set(lost[2].split(",")) == {"closure", "black"} and lost[3] == ""
    assert {(r.arrived, r.last) for r in state.arrivals(active).collect() if r.token == "closure"} == {(1, 1), (3, 3)}
    assert {r.turn: r.gained for r in state.gains(state.hear(said, _colors(spark))).collect()}[3] == 1
    assert {r.turn: r.required for r in terms.collect()} == {1: ["black"], 2: ["red"], 3: ["red"]}
    diff = {(r.turn, r.term): r.change for r in state.slot_diff(active, said).collect()}
    assert diff == {(1, "black"): "new", (2, "black"): "dropped", (2, "red"): "new", (3, "red"): "kept"}
    assert {r.route for r in state.routes(state.hear(said, _colors(spark))).collect()} == {"buying"}
    reasons = {r.term: r.reason for r in state.dispositions(state.hear(said, _colors(spark))).collect()}
    assert reasons == {"black": "slot_replaced_by_message"}


def test_slot_model(spark):
    words = spark.createDataFrame([("category", "belt", 1), ("color", "black", 1), ("style", "casual", 1)], "slot string, term string, support long")
    said = _said(spark, (1, "belts closure black"), (2, "casual"), (3, "Actually, ignore my earlier preference. wide"))
    got = {r.turn: r.terms for r in state.slot_model(state.hear(said, words)).collect()}
    assert got[1] == ["belts", "closure", "black"] and got[2] == [*got[1], "casual"]
    assert set(got[3]) == {"belt", "casual", "actually", "ignore", "earlier", "preference", "wide"}


def test_questions(spark):
    turns = spark.createDataFrame([("s", t, "q", n) for t, n in ((1, 0), (2, 0), (3, 1), (4, 2), (5, 0))], "sample_id string, turn int, query string, stuck_for int")
    orders = spark.createDataFrame([("q", ["color", "size", "brand"])], "pool string, attributes array<string>")
    assert [r.ask for r in replay.questions(turns, orders).orderBy("turn").collect()] == ["color", "size", "other", "material", "brand"]
    assert [r.ask for r in replay.questions(turns, orders, None).orderBy("turn").collect()] == ["color", "size", "brand", None, None]
    other = spark.createDataFrame([("q", ["other"])], "pool string, attributes array<string>")
    assert [r.ask for r in replay.questions(turns, other, None).orderBy("turn").collect()] == ["other"] * 5


def test_latent_index(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["red cotton shirt", "blue cotton shirt", "steel hammer tool", "iron hammer tool", "", None])], "i long, text string")
    model = semantic.fit(texts)
    vectors = semantic.project(model, texts, "i")
    assert sum(r.v is None for r in vectors.collect()) == 2
    asked = spark.createDataFrame([("a", "cotton shirt"), ("b", "hammer"), ("c", "unknown")], "q string, text string")
    got = semantic.search(model, asked, vectors, 2, "q").collect()
    assert {r.query: None for r in got}.keys() == {"a", "b"}
    assert {r.id for r in got if r.query == "a"} == {0, 1} and {r.id for r in got if r.query == "b"} == {2, 3}
    assert semantic.project(semantic.fit(texts.limit(0)), texts, "i").where("v is not null").count() == 0


def test_latent_index_sends_as_much_however_many_files(spark, tmp_path, monkeypatch):
    """A round's tasks, each of which sends a whole matrix, are as many as run at once, and equal brute force; rows that share an id are one text."""
    rows = [(i, " ".join(f"w{(i * j) % 17}_é the" for j in range(1 + i % 5)) if i % 11 else None) for i in range(60)]
    texts = spark.createDataFrame(rows, "i long, text string")
    texts.repartition(40).write.parquet(str(tmp_path / "texts"))
    times = semantic._times

    def counted(vectors, idf, matrix):
        got = times(vectors, idf, matrix)
        x = np.zeros((0, len(idf)))
        for r in vectors.collect():
            v = np.zeros(len(idf))
            v[r["at"]] = np.array(r["n"]) * idf[r["at"]] * r["scale"]
            x = np.vstack([x, v])
        assert np.allclose(np.linalg.norm(x, axis=1), 1) and np.allclose(got, x.T @ (x @ matrix))
        return got

    monkeypatch.setattr(semantic, "_times", counted)
    monkeypatch.setattr(semantic, "OFTEN", 3)
    monkeypatch.setattr(semantic, "STRETCH", 2)
    read = spark.read.parquet(str(tmp_path / "texts"))
    ran, coalesce = [], type(read).coalesce
    monkeypatch.setattr(type(read), "coalesce", lambda df, n: ran.append(n) or coalesce(df, n))
    model = semantic.fit(read, dimensions=4)
    assert max(ran) <= spark.sparkContext.defaultParallelism and "the" not in model.terms
    known = {r[0]: r[1] for r in rows}
    count = {t: sum((known[i] or "").split().count(t) for i in known) for t in model.terms}
    assert model.terms == sorted(count, key=lambda t: (-count[t], t))
    twice = semantic.project(model, texts.union(texts.limit(3)), "i")
    assert twice.count() == 60 and all((r.v is None) == (known[r.id] is None) for r in twice.collect())


def test_many_queries_go_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "id long, v array<double>")
    asked = rows.select(F.col("id").alias("query"), "v")
    whole = {tuple(r) for r in retrieval.cosine_topk(asked, rows, 3).collect()}
    monkeypatch.setattr(retrieval, "QUERY_VECTORS", 7)
    assert {tuple(r) for r in retrieval.cosine_topk(asked, rows, 3).collect()} == whole
    first = retrieval.bm25(spark.createDataFrame([("q", "red"), ("q", "shirt")], "query string, term string"), V.field_texts(_plain_shop(spark)), 5).collect()
    monkeypatch.setattr(retrieval, "ASKED_ROWS", 0)
    again = retrieval.bm25(spark.createDataFrame([("q", "red"), ("q", "shirt")], "query string, term string"), V.field_texts(_plain_shop(spark)), 5).collect()
    assert sorted(first) == sorted(again) and first


def _plain_shop(spark):
    rows = [(i, f"P{i}", t, ["root", "x", t], [t], {"Brand": "b"}, None, None, float(i), 1.0, "s") for i, t in enumerate(["red shirt", "blue shirt", "red hat", "bag"])]
    return spark.createDataFrame(rows, "ord long, " + V.CATALOG_SCHEMA.replace("title string, features array<string>, description array<string>, price double, categories array<string>", "title string, categories array<string>, features array<string>").replace("details map<string,string>, ", "details map<string,string>, description array<string>, price double, "))


def test_ledger_gains(spark):
    words = spark.createDataFrame([("color", "black", 1), ("color", "red", 1)], "slot string, term string, support long")
    said = _said(spark, (1, "belts closure black"), (2, "belts"), (3, "Actually, ignore my earlier preference. red"), (4, "closure red"), (5, "closure"))
    got = {r.turn: r.gained for r in state.ledger_gains(state.hear(said, words)).collect()}
    fresh = len({"actually", "ignore", "my", "earlier", "preference", "red"} - set(X.STOPWORDS))
    assert got == {1: 3, 3: fresh, 4: 1}


def test_attribute_orders(spark):
    pools = spark.createDataFrame([("p", i, ["cotton", c, "shirt"]) for i, c in enumerate(["red", "blue", "green"])], "pool string, item int, tokens array<string>")
    order = asking.attribute_order("candidate", pools).first().attributes
    assert order[0] == "color" and len(order) == 9
    skewed = [("p", i, [("cotton", "silk", "wool")[0 if i < 98 else i - 97], ("red", "blue")[i % 2]]) for i in range(100)]
    rows = spark.createDataFrame(skewed, "pool string, item int, tokens array<string>")
    assert asking.attribute_order("candidate", rows).first().attributes[0] == "material"
    assert asking.attribute_order("entropy", rows).first().attributes[0] == "color"
    with pytest.raises(ValueError):
        asking.attribute_order("guess", pools)


def test_metrics(spark):
    rows = [("a", "buying", 3, 2, True), ("b", "buying", 1, None, True), ("c", "x", 2, 1, False), ("c", "x", 4, 4, True)]
    facts = scoring.session_facts(spark.createDataFrame(rows, "sample_id string, scenario_type string, turn int, rank int, applied boolean"))
    got = {r.scenario_type: r for r in scoring.summarise(facts, "scenario_type").collect()}
    assert (got["buying"].hit_rate, got["buying"].mrr, got["buying"].mttc, got["buying"].efficiency, got["buying"].score) == (0.5, 0.25, 7.0, 0.4, 0.405)
    assert got["x"].mttc == 4.0 and got["all"].sample_count == 3


def test_recall(spark):
    ranks = spark.createDataFrame([("a", 1), ("a", 25), ("b", None), ("b", 75)], "scenario_type string, rank int")
    got = {(r.scenario_type, r.cutoff): r.recall for r in scoring.recall(ranks, (10, 50, 100), "scenario_type").collect()}
    assert (got["all", 10], got["all", 50], got["all", 100]) == (0.25, 0.5, 0.75) and got["b", 50] == 0.0


def test_split_sizes(spark):
    rows = [(f"s{i}", i, "a" if i < 5 else "b" if i < 8 else "c") for i in range(10)]
    got = scoring.split(spark.createDataFrame(rows, "sample_id string, index long, stratum string"), 4, "seed").where("part = 'validation'")
    assert {r.stratum: r["count"] for r in got.groupBy("stratum").count().collect()} == {"a": 2, "b": 1, "c": 1}


def test_masks(spark, shop):
    targets = spark.createDataFrame([("P0",), ("P1",)], "parent_asin string")
    plan = {r.field: r for r in scoring.mask_plan(shop, targets, ("price", "title")).collect()}
    assert (plan["price"].desired, plan["price"].original, plan["price"].masks, plan["title"].masks) == (1, 1, 0, 0)
    only = spark.createDataFrame([("P0",)], "parent_asin string")
    masks = scoring.masked_ids(shop, only, ("price",), "fixed")
    out = scoring.apply_masks(shop, masks, ("price",))
    assert {r.parent_asin: r.price for r in out.collect()} == {"P0": None, "P1": None, "P2": None}
    assert all(r.violations == 0 for r in scoring.mask_violations(shop, out, masks, ("price",), only).collect())


def test_latency_places(spark):
    df = spark.createDataFrame([("g", float(v)) for v in range(1, 101)], "g string, v double")
    r = scoring.latency(df, "g", "v").first()
    assert (r.n, r.mean, r.median, r.p95, r.p99, r.largest) == (100, 50.5, 50.5, 96.0, 100.0, 100.0)


def test_publishing_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    V.publish_jsonl(spark.range(3), path)

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        V.publish_jsonl(spark.range(5), path, refuse)
    assert spark.read.json(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_missing_vocabulary_is_empty(spark, tmp_path):
    assert V.read_gazetteer(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "g.json").write_text('{"color": {"red": 2}, "x": 5}')
    assert [tuple(r) for r in V.read_gazetteer(spark, str(tmp_path / "g.json")).collect()] == [("color", "red", 2)]


def test_variants_are_built_once_and_checked(spark, tmp_path):
    source, dataset, stress, manifest = (str(tmp_path / x) for x in ("official", "sessions", "stress", "manifest"))
    rows = [(f"P{i}", f"title {i}", [f"f{i}"] if i % 2 else [], 5.0 if i < 3 else None) for i in range(10)]
    spark.createDataFrame(rows, "parent_asin string, title string, features array<string>, price double").write.json(source)
    spark.createDataFrame([(f"s{i}", (f"P{i}",)) for i in range(4)], "sample_id string, ground_truth struct<parent_asin:string>").write.json(dataset)
    both = variants.resolve(spark, source, dataset, stress, manifest)
    assert set(both) == {"official", "coverage_stress"} and variants.is_current(spark, source, dataset, stress, manifest)
    told = V.read_json(spark, manifest)["fields"]["price"]
    assert (told["desired_target_present"], told["original_target_present"], told["masked_count"]) == (1, 3, 2)
    assert both["coverage_stress"].where("price is not null").count() == 1 and both["coverage_stress"].count() == 10
    assert not variants.is_current(spark, source, dataset, stress, manifest, seed="another")
    assert list(variants.resolve(spark, source, dataset, stress, manifest, "official")) == ["official"]
    with pytest.raises(ValueError):
        variants.build(spark, source, dataset, source, manifest)
    with pytest.raises(ValueError):
        variants.resolve(spark, source, dataset, stress, manifest, "none")
    spark.createDataFrame([("s9", ("P99",))], "sample_id string, ground_truth struct<parent_asin:string>").write.mode("append").json(dataset)
    assert not variants.is_current(spark, source, dataset, stress, manifest)
    with pytest.raises(ValueError, match="missing target P99"):
        variants.build(spark, source, dataset, stress, manifest)


def test_folding(spark):
    df = spark.createDataFrame([("Café über Naïve e\u0301tude Ærø 12",)], "t string")
    assert df.select(X.index_tokens(F.col("t")).alias("x")).first().x == ["cafe", "uber", "naive", "etude", "ærø".replace("ø", "ø"), "12"]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Many splits of two files, with blank lines, a last line without an end, and ids that come again."""
    lines = [f'{{"parent_asin": "P{i % 50}", "title": "line {i} {"x" * (i % 90)}"}}' if i % 11 else "" for i in range(1, 1200)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines[:700]) + "\n")
    (tmp_path / "in" / "b.jsonl").write_text("\n".join(lines[700:]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = V.read_jsonl(spark, str(tmp_path / "in"), "parent_asin string, title string", "line")
        assert rows.rdd.getNumPartitions() > 10
        got = {r.line: r.title.split()[1] for r in rows.collect()}
        assert got == {i: str(i) for i in range(1, 1200) if i % 11}
        last = {r.parent_asin: r.line for r in V.catalog_index(rows, "line").collect()}
        assert last == {f"P{i % 50}": i for i in range(1, 1200) if i % 11}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_reordered_output_is_refused(spark, tmp_path, monkeypatch):
    source, dataset, stress, manifest = (str(tmp_path / x) for x in ("official", "sessions", "stress", "manifest"))
    rows = [(f"P{i * 37 % 40}", f"title {i}", 5.0 if i < 3 else None) for i in range(40)]
    spark.createDataFrame(rows, "parent_asin string, title string, price double").coalesce(1).write.json(source)
    spark.createDataFrame([("s1", ("P1",)), ("s2", ("P1",))], "sample_id string, ground_truth struct<parent_asin:string>").write.json(dataset)
    with pytest.raises(ValueError, match="duplicate target"):
        variants.build(spark, source, dataset, stress, manifest)
    spark.createDataFrame([("s1", ("P1",))], "sample_id string, ground_truth struct<parent_asin:string>").write.mode("overwrite").json(dataset)
    told = variants.build(spark, source, dataset, stress, manifest)
    assert (told["distinct_target_count"], told["matched_target_count"], told["invariants"]["order_preserved"]) == (1, 1, True)
    assert [r.parent_asin for r in V.read_jsonl(spark, stress, order="line").orderBy("line").collect()] == [r[0] for r in rows]
    plain = V.write_in_order
    monkeypatch.setattr(V, "write_in_order", lambda df, path, by: plain(df.withColumn(by, -F.col(by)), path, by))
    with pytest.raises(ValueError, match="order_preserved"):
        variants.build(spark, source, dataset, str(tmp_path / "other"), str(tmp_path / "m2"))
    assert not (tmp_path / "other").exists()


def test_pruned_index_opens_few_blocks_and_loses_nothing(spark):
    """Against scoring everything, with ties, blocks of one kind of product, and a word that all products hold."""
    kinds = ["red shirt", "blue shirt", "red hat", "green bag", "steel bolt", "blue bolt"]
    rows = [(i, f"P{i}", f"{kinds[i % 6]} common", [kinds[i % 6]], "f" * (i % 3), "", "s", "") for i in range(3000)]
    texts = spark.createDataFrame(rows, "ord long, parent_asin string, title string, categories array<string>, features string, details string, store string, description string").withColumn("categories", F.array_join("categories", " "))
    asked = spark.createDataFrame([(q, t) for q in ("red hat common", "bolt", "common", "none") for t in q.split()], "query string, term string")
    index = retrieval.build_index(texts)
    parts = {}
    for r in index.parts.collect():
        parts.setdefault(r.term, {})[r.ord] = r.part
    for k in (1, 7, 200):
        got = {}
        for r in retrieval.search_index(index, asked, k).collect():
            got.setdefault(r.query, []).append((r.rank, r.ord, r.score))
        for q in ("red hat common", "bolt", "common"):
            every = {}
            for t in q.split():
                for o, p in parts[t].items():
                    every[o] = every.get(o, 0.0) + p
            want = sorted((-round(s, 9), o) for o, s in every.items())[:k]
            assert [(r, o) for r, o, _ in sorted(got[q])] == [(i, o) for i, (_, o) in enumerate(want, 1)]
        assert "none" not in got
    told = retrieval.opened(index, asked.where("query <> 'common'"), 7).first()
    assert 0 < told.opened < told.pairs / 2


def test_variants_share_an_index_but_not_their_statistics(spark):
    shop = _plain_shop(spark)
    bare = shop.withColumn("title", F.lit("bag")).withColumn("features", F.array(F.lit("red"))).where("ord < 3")
    asked = spark.createDataFrame([("s", "buying", "P0", "red shirt", ["red", "shirt"], ["red shirt"], [])], "sample_id string, scenario_type string, target string, query string, terms array<string>, phrases array<string>, required array<string>")
    got = {r.variant: r for r in variants.evaluate({"a": shop, "b": bare}, asked).where("scenario_type = 'all'").collect()}
    assert (got["a"].hit_rate, got["a"].mrr) == (1.0, 1.0) and (got["b"].hit_rate, got["b"].sample_count) == (1.0, 1)
    alone = retrieval.bm25(spark.createDataFrame([("q", "red")], "query string, term string"), V.field_texts(bare), 5).collect()
    texts = variants.stacked({"a": shop, "b": bare})
    both = retrieval.search_index(retrieval.build_index(texts, by="variant"), spark.createDataFrame([("q", "b\x1fred")], "query string, term string"), 5).collect()
    assert sorted((r.ord, r.score) for r in alone) == sorted(((r.ord - 1) // 2, r.score) for r in both)


def test_conflicts_override_whatever_the_sentence(spark):
    """Against a fold in plain code, over random sessions."""
    import random

    words = [("color", "black"), ("color", "red"), ("style", "casual"), ("style", "formal"), ("category", "belt"), ("category", "hat"), ("size", "wide")]
    table = spark.createDataFrame([(*w, 1) for w in words], "slot string, term string, support long")
    draw = random.Random(3)
    phrase = "Actually, ignore my earlier preference. "
    rows = [(f"s{s}", t, (phrase if draw.random() < 0.15 else "") + " ".join(draw.sample([w for _, w in words], draw.randint(0, 3)) + ["thing"])) for s in range(60) for t in range(1, 6)]
    said = spark.createDataFrame(rows, "sample_id string, turn int, message string")
    want = set()
    for s in {r[0] for r in rows}:
        held = {}
        for _, turn, message in sorted(r for r in rows if r[0] == s):
            now = {(slot, w) for slot, w in words if w in message.split()}
            named = {slot for slot, _ in now}
            clash = any(slot in {h for h, _ in held} and (slot, w) not in held for slot, w in now)
            if clash or message.startswith("Actually"):
                want.add((s, turn))
                held = {k: at for k, at in held.items() if k[0] not in named and (k[0] == "category" or at > 1)}
            for k in now:
                held.setdefault(k, turn)
    heard = state.hear(said, table, "conflict")
    assert {tuple(r) for r in heard.overrides.collect()} == want and len(want) > 60
    plain = state.hear(said, table)
    assert plain.overrides.count() < len(want) and state.entries(heard).where("status <> 'active'").count() > state.entries(plain).where("status <> 'active'").count()
    with pytest.raises(ValueError, match="no trigger"):
        state.hear(said, table, "mood")


def test_rejected_products_give_way(spark):
    best = [("q", i, f"P{i}", 10.0 - i, i) for i in range(1, 7)] + [("r", i, f"P{i}", 5.0, i) for i in range(1, 4)]
    got = replay.Retrieved(
        spark.createDataFrame([("s", t, "q" if t < 5 else "r", n) for t, n in ((1, 0), (2, 1), (3, 2), (4, 0), (5, 1))] + [("u", 1, "q", 1), ("u", 2, "none", 1)], "sample_id string, turn int, query string, stuck_for int"),
        spark.createDataFrame([(q, o, r) for q, o, _, _, r in best], "query string, ord long, rank int"),
        spark.createDataFrame(best, "query string, ord long, parent_asin string, score double, rank int"), None,
    )
    times, want = {}, {}
    for turn, query, stuck in ((1, "q", 0), (2, "q", 1), (3, "q", 2), (4, "q", 0), (5, "r", 1)):
        ranked = sorted((-(s - 2.5 * times.get(o, 0) * (stuck >= 1)), r, o) for q, o, _, s, r in best if q == query)
        want["s", turn] = [o for _, _, o in ranked[:2]]
        for o in want["s", turn]:
            times[o] = times.get(o, 0) + 1
    want |= {("u", 1): [1, 2], ("u", 2): []}
    assert {(r.sample_id, r.turn): r.shown for r in replay.shown(got, 2.5, 1, 2).collect()} == want
    assert want["s", 2] != want["s", 1]


def test_expected_value_counts_the_silent(spark):
    """Nine of ten say cotton: two values would tell less than a value and silence."""
    rows = [("p", i, ["cotton"] if i else ["thing"]) for i in range(10)] + [("q", i, ["red"]) for i in range(3)] + [("r", i, [["red", "blue"][i % 2], "hiking"] if i < 4 else ["red"]) for i in range(8)]
    got = {r.pool: r.attributes for r in asking.attribute_order("expected_value", spark.createDataFrame(rows, "pool string, item int, tokens array<string>")).collect()}
    assert got["p"][0] == "material" and got["q"] == list(asking.DEFAULT_ORDER)
    assert got["r"][:2] == ["use_case", "color"]  # four of eight against two of eight


def test_stems_widen_a_query(spark):
    df = spark.createDataFrame([(["shoes", "red", "glasses", "red"],)], "t array<string>")
    assert df.select(X.with_stems(F.col("t")).alias("x")).first().x == ["shoes", "red", "glasses", "shoe", "glass"]


def test_dense_search_refuses_and_leaves_out(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", None), ("d", [0.0, 0.0]), (None, [1.0, 0.0])], "id string, v array<double>")
    asked = spark.createDataFrame([("q", [3.0, 0.0]), ("z", None)], "query string, v array<double>")
    assert [tuple(r) for r in retrieval.cosine_topk(asked, rows, 3).orderBy("rank").collect()] == [("q", "a", 1.0, 1), ("q", "b", 1.0, 2), ("q", "d", 0.0, 3)]
    assert retrieval.cosine_topk(asked.limit(0), rows, 3).count() == 0
    with pytest.raises(Exception, match="another length"):
        retrieval.cosine_topk(asked, rows.withColumn("v", F.array(F.lit(1.0))), 3).collect()


def test_conversations_are_worked_out_once(spark):
    """Sessions of one conversation share its ledger; one more turn, another order or a null makes another conversation."""
    said = {"a": ["red shirt", "blue"], "b": ["red shirt", "blue"], "c": ["blue", "red shirt"], "d": ["red shirt", "blue", None]}
    rows = [(s, [(i, m) for i, m in enumerate(v, 1)]) for s, v in said.items()]
    shared = state.share(spark.createDataFrame(rows, "sample_id string, course array<struct<turn:int,message:string>>"))
    assert shared.messages.select("sample_id").distinct().count() == 3
    words = spark.createDataFrame([("color", "red", 1), ("color", "blue", 1)], "slot string, term string, support long")
    got = {}
    for r in state.each_session(state.entries(state.hear(shared.messages, words)), shared.sessions).collect():
        got.setdefault(r.sample_id, set()).add((r.token, r.slot, r.status, r.first_turn))
    assert got["a"] == got["b"] == got["d"] == {("red", "color", "active", 1), ("shirt", None, "active", 1), ("blue", "color", "active", 2)}
    assert got["c"] == {("blue", "color", "active", 1), ("red", "color", "active", 2), ("shirt", None, "active", 2)}


def test_copies_of_products_cost_no_more_and_are_all_found(spark, monkeypatch):
    """An index of the first of equal texts gives what an index of all gives, with few queries and with many; every copy is counted."""
    kinds = ["red shirt", "blue shirt", "red hat", "green bag", "steel bolt", "blue bolt", "red red hat"]
    rows = [(i, f"P{i}", kinds[i * i % 7] + " common", kinds[i % 3], "", "", "s", "") for i in range(400)]
    texts = spark.createDataFrame(rows, "ord long, parent_asin string, title string, categories string, features string, details string, store string, description string")
    asked = spark.createDataFrame([(q, t) for q in ("red hat common", "hat red common unknown", "bolt", "none") for t in q.split()], "query string, term string")
    told = lambda df: sorted((r.query, r["rank"], r.ord, r.score) for r in df.collect())
    for k in (1, 7, 150):
        every = told(retrieval.search_index(retrieval.build_index(texts), asked, k))
        assert told(retrieval.bm25(asked, texts, k)) == every and every
        with monkeypatch.context() as m:
            m.setattr(retrieval, "QUERIES", 1)
            assert told(retrieval.bm25(asked, texts, k)) == every
    held = lambda q: sum(any(t in f"{r[2]} {r[3]}".split() for t in q.split()) for r in rows)
    assert {r.query: r.n for r in retrieval.match_counts(asked, texts).collect()} == {q: held(q) for q in ("red hat common", "hat red common unknown", "bolt")}


def test_sessions_are_shared_by_card(spark, sf_dir):
    """Sessions told by the number of their card have the conversations that they have when each carries its own messages."""
    dealt = V.dealt(spark, sf_dir)
    assert dealt.kinds.count() < dealt.sessions.count()
    by = ("card", "scenario_type")
    shared = state.share(V.coursed(dealt.kinds).select(*by, "course"), dealt.sessions.select("sample_id", *by), by)
    assert set(shared.sessions.columns) == {"conversation", "sample_id"}
    got = {(r.sample_id, r.turn, r.message) for r in state.each_session(shared.messages, shared.sessions).collect()}
    assert got == {(r.sample_id, r.turn, r.message) for r in V.messages(spark, sf_dir).collect()} and got


def test_vocabulary_counts_every_copy(spark, shop):
    """A catalog in which products are repeated has their terms, each counted as often; a row may stand for several products."""
    thrice = V.union_all([shop, shop.withColumn("parent_asin", F.concat("parent_asin", F.lit("b"))), shop.withColumn("parent_asin", F.concat("parent_asin", F.lit("c")))])
    told = lambda df: {(r.slot, r.term): r.support for r in df.collect()}
    once = told(catalogs.gazetteer(shop, {"color": "Color"}))
    assert told(catalogs.gazetteer(thrice, {"color": "Color"})) == {k: 3 * n for k, n in once.items()} == told(catalogs.gazetteer(shop.withColumn("n", F.lit(3)), {"color": "Color"}))


def test_latent_index_of_copies(spark, shop):
    """Fitted and projected once for equal texts, a latent index finds what one of every product finds, each copy with its place."""
    texts = V.field_texts(V.union_all([shop.withColumns({"ord": F.col("ord") + 3 * i, "parent_asin": F.concat("parent_asin", F.lit(f"-{i}"))}) for i in range(1, 4)]).where("ord <> 9"))
    index = replay.latent(texts)
    assert index.vectors.count() == 3
    whole = texts.select("ord", F.concat_ws(" ", *V.FIELDS).alias("text"))
    every = semantic.fit(whole)
    assert (index.model.terms, index.model.idf) == (every.terms, every.idf)
    asked = spark.createDataFrame([("red shirt", ["red", "shirt"], [], []), ("boots", ["boots"], [], [])], "query string, terms array<string>, required array<string>, phrases array<string>")
    near = semantic.search(every, asked.select("query", F.array_join("terms", " ").alias("text")), semantic.project(every, whole, "ord"), 4, "query")
    found, best = replay.retrieve(asked, texts, "dense", pool=4, k=4, model=index)
    told = lambda df, c: sorted((r.query, r["rank"], r[c]) for r in df.collect())
    assert told(found, "ord") == told(near, "id") and len(told(found, "ord")) == 8
    assert {(r.query, r.ord) for r in best.collect()} == {(r.query, r.ord) for r in found.collect()}


def test_orders_read_only_what_tells(spark):
    """The words that tell an attribute give the orders that all tokens give; a product without any still counts."""
    rows = [("p", 1, "red cotton shirt red".split()), ("p", 2, "blue wool hat".split()), ("p", 3, ["plain"]), ("r", 1, ["plain"])]
    pools = spark.createDataFrame(rows, "pool string, item long, tokens array<string>")
    short = pools.withColumn("tokens", asking.telling(F.col("tokens")))
    assert [len(r.tokens) for r in short.orderBy("pool", "item").collect()] == [2, 2, 0, 0]
    for policy in ("candidate", "entropy", "expected_value"):
        told = lambda df, p=policy: sorted((r.pool, *r.attributes) for r in asking.attribute_order(p, df).collect())
        assert told(short) == told(pools)


def _sent(df):
    """Whether a join of the plan sends a side to every task."""
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_no_side_of_the_state_is_broadcast(spark):
    words = spark.createDataFrame([("category", "belt", 1), ("color", "black", 1)], "slot string, term string, support long")
    courses = spark.createDataFrame([(i, [(1, "I'm looking for black belts"), (2, "Actually, ignore my earlier preference. What I need is: belts.")]) for i in range(3)], "sample_id long, course array<struct<turn:int,message:string>>")
    said = state.share(courses)
    heard = state.hear(said.messages, words)
    active = state.active_by_turn(heard)
    terms = state.turn_terms(said.messages, active)
    derived = {"mentions": heard.mentions, "entries": state.entries(heard), "active": active, "terms": terms, "changes": state.changes(terms), "gains": state.gains(heard), "routes": state.routes(heard), "weights": state.recency_weights(active, 0.5), "kept": state.dispositions(heard), "diff": state.slot_diff(active, said.messages), "sessions": state.each_session(terms, said.sessions)}
    assert [k for k, df in derived.items() if _sent(df)] == []
    assert {(r.turn, r.terms[0]) for r in state.each_session(terms, said.sessions).collect()} == {(1, "black"), (2, "belts")}


def test_no_side_of_a_replay_is_broadcast(spark, shop):
    turns = spark.createDataFrame([(1, 1, "q", 0)], "sample_id long, turn int, query string, stuck_for int")
    best = spark.createDataFrame([("q", 0, "P0", 1.0, 1)], "query string, ord long, parent_asin string, score double, rank int")
    pool = best.select("query", "ord", "rank")
    got = replay.Retrieved(turns, pool, best, V.field_texts(shop))
    ranked = replay.ranked(turns, got, spark.createDataFrame([(1, "P0")], "sample_id long, target string"))
    orders = spark.createDataFrame([("q", ["color"])], "pool string, attributes array<string>")
    reranked = retrieval.rerank(pool.withColumn("terms", F.array(F.lit("red"))), retrieval.among(got.texts, pool), 1)
    assert not any(_sent(df) for df in (ranked, replay.questions(turns, orders), replay.shown(got), reranked))
    assert [(r.turn, r["rank"]) for r in ranked.collect()] == [(1, 1)]
