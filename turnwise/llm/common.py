"""Helpers shared by the training-data operators.

Nothing here holds rows on the driver: the helpers cut lineage by writing
tables to the shared folder, number rows globally without a single-task sort,
and label connected components with joins.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables that are only needed until the operator that is running has its result, innermost last.
_scopes: list[list[str]] = []
#: Rows of a task hold their position below this many bits of monotonically_increasing_id().
_ROW_BITS = 33
_REMOVAL = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``; only where that is
    unset (local tests) a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    made = tempfile.mkdtemp(prefix="turnwise-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(made)
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def _shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Have Spark remove a query's shuffle files when the query ends."""
    before = spark.conf.get(_REMOVAL, None)
    spark.conf.set(_REMOVAL, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVAL)
        else:
            spark.conf.set(_REMOVAL, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and lets later
    steps read only the columns they need. The table goes when the JVM ends,
    the shuffle files behind it as soon as it is written.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffle_files_removed(spark):
        df.write.option("compression", "zstd").parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    if _scopes:
        _scopes[-1].append(where)
    return spark.read.schema(df.schema).parquet(where)


def remove(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for where in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(spark, where)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Write the result of ``make`` and delete the tables that were only made for it."""
    _scopes.append([])
    try:
        result = make()
        inner = _scopes.pop()
        _scopes.append([])  # what follows belongs to the caller
        done = materialise(result, label)
        mine = _scopes.pop()
    except BaseException:
        inner, mine = _scopes.pop(), []
        for where in inner:
            _delete(spark, where)
        raise
    for where in inner:
        _delete(spark, where)
    if _scopes:
        _scopes[-1] += mine
    return done


def tidy(run):
    """``run`` for mapInArrow that gives the memory it has freed back to the system at its end: workers live on and wait for other tasks."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return tidied


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def number_rows(df: DataFrame, by: list[str], label: str, out: str = "rank") -> DataFrame:
    """Add the gapless 0-based position of each row in the order of ``by``.

    Rows are dealt by range, sorted inside tasks and written with their place in
    the task; the tasks' counts (one row a task) give the offsets. ``by`` must
    be unique for a reproducible order.
    """
    spark = df.sparkSession
    placed = (
        df.repartitionByRange(parts(spark), *by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = materialise(placed, label)
    task = F.shiftright("_at", _ROW_BITS)
    ends = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = ends.select(
        "_task",
        F.expr("sum(_n) over (order by _task rows between unbounded preceding and 1 preceding)").alias("_before"),
    )
    return (
        placed.withColumn("_task", task)
        .join(F.broadcast(before), "_task")  # one row for each task that wrote rows
        .withColumn(out, F.coalesce("_before", F.lit(0)) + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_task", "_at", "_before")
    )


def components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """Label the connected components of ``edges`` (``a``, ``b`` longs).

    Returns (``node``, ``root``): root is the smallest node of the component.
    Each round links every node's neighbours that are larger to the smallest
    neighbour, then the smaller ones (the "large star, small star" scheme): the
    number of rounds grows with the logarithm of the size, the rows never exceed
    the edges, and stars of any size are made with aggregates, not in one task.
    """
    links = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    links = materialise(links, label)

    def star(links: DataFrame, larger: bool) -> DataFrame:
        """Each node's neighbours (the larger ones, or it and the smaller ones) get linked to the smallest of them and it."""
        if larger:
            around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            around = links
        least = around.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        joined = around.join(least, "u")
        if larger:
            moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v"))
            )
        return moved.where(F.col("u") != F.col("v")).distinct()

    seen = None
    for _ in range(rounds):
        links = materialise(star(star(links, True), False), label)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components have not settled")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
