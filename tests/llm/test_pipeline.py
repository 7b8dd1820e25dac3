"""The pipeline, stage by stage, against brute force; each stage keeps to the columns of documents."""

import corpus_pipeline
import duckdb

from tests.llm.test_operators import _base, _classes
from turnwise.llm import line_dedup, queries


def test_stages_agree_with_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    (_, keep), (_, lines), (_, one), (_, mask), (_, pack) = corpus_pipeline.STAGES
    good = keep(spark, docs, sf_dir).cache()
    assert good.columns == columns and 0 < good.count() < docs.count()

    kept = lines(spark, good, sf_dir).cache()
    db = duckdb.connect()
    db.register("good", good.select("doc_id", "text").toPandas())
    gone = {}
    for d, k in db.sql("WITH " + line_dedup.SQL_REMOVED.format(docs="good") + " SELECT doc_id, line_no FROM removed").fetchall():
        gone.setdefault(d, set()).add(k)
    want = {}
    for r in good.collect():
        left = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone.get(r.doc_id, ()))
        if r.doc_id not in gone or left.strip():
            want[r.doc_id] = left
    assert {r.doc_id: r.text for r in kept.collect()} == want and kept.columns == columns

    single = one(spark, kept, sf_dir).cache()
    ids = sorted(want)
    classes = _classes([want[i] for i in ids])
    assert {r.doc_id for r in single.collect()} == {ids[i] for i, (_, c, _) in classes.items() if c == i}

    masked = mask(spark, single, sf_dir).cache()
    assert masked.columns == columns
    for r in masked.collect():
        assert not _base(r.text)

    packed = pack(spark, masked, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in masked.collect()}


def test_stages_take_awkward_tables(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 20000, "en", "a", 100000), (3, "word " * 20000, "en", "a", 100000)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).collect()


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(queries.QUERIES) <= set(names)
