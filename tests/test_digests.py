"""Digests of any size against hashlib, and figures of runs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from turnwise.plans import profile
from turnwise.sources import digests


def _tree(values, fan):
    level, out = [hashlib.sha256(v or b"").hexdigest() for v in values], {}
    depth = 0
    while level:
        out |= {(depth, i): d for i, d in enumerate(level)}
        if len(level) == 1:
            break
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        depth += 1
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 4, 64, 65, 300])
def test_tree(spark, n):
    values = [None if i % 7 == 3 else f"é{i // 2}" for i in range(n)]
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "at long, v string").repartition(3)
    nodes = digests.tree(df, digests.leaf(F.col("v")), "at", 4)
    want = _tree([v.encode() if v else b"" for v in values], 4)
    assert {(r.level, r.node): r.digest for r in nodes.collect()} == want
    assert digests.root(nodes) == (want[max(want)] if want else None)


def test_files_in_any_splits(spark, tmp_path):
    lines = [f"{i} " + "x" * (i % 90) for i in range(5000)]
    path = tmp_path / "a.txt"
    path.write_text("\n".join(lines) + "\n")
    roots, before = set(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1g", "20k", "7000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            roots.add(digests.root(digests.file_tree(spark, str(path), 64)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = _tree([x.encode() for x in lines], 64)
    assert roots == {want[max(want)]}
    lines[777] += "!"
    other = tmp_path / "b.txt"
    other.write_text("\n".join([*lines, *("more" for _ in range(200))]) + "\n")
    rows = digests.changed(digests.file_tree(spark, str(path), 64), digests.file_tree(spark, str(other), 64), 64)
    assert sorted(map(tuple, rows.collect())) == [(769, 832)] + [(a, a + 63) for a in range(4993, 5200, 64)]


def test_profile_of_a_run(spark):
    df = spark.range(200000).select((F.col("id") % 5000).alias("k"), F.rand(3).alias("v"))
    got = profile.measure(df.groupBy("k").agg(F.sum("v").alias("v")))
    assert got.rows == 5000 and got.stages >= 2 and got.tasks >= 2 and got.seconds > 0
    assert got.task_seconds > 0 and got.cpu_seconds > 0 and got.shuffled > 0 and got.peak_memory > 0
    assert got.projected(4, 25.0) == pytest.approx(4 * got.seconds + 25) and got.per_row() > 0
    again = profile.measure(spark.range(0).select("id"))
    assert again.rows == 0 and again.per_row() == 0.0


def test_profile_counts_what_is_made_on_the_way(spark, tmp_path):
    def make():
        spark.range(1000).repartition(3).write.parquet(str(tmp_path / "step"))
        return spark.read.parquet(str(tmp_path / "step"))

    assert profile.measure_made(spark, make).stages > profile.measure(spark.read.parquet(str(tmp_path / "step"))).stages
