"""Digests of tables and files of any size: trees over numbered rows, worked out level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .steps import step
from .views import numbered_lines

#: Nodes that one node of the next level holds.
FAN = 1024


def leaf(value: Column) -> Column:
    """A row's own digest: the SHA-256 of its bytes; null has none of them."""
    return F.sha2(F.coalesce(value.cast("binary"), F.lit(b"")), 256)


def tree(rows: DataFrame, digest: Column, at: str, fan: int = FAN) -> DataFrame:
    """(level, node, digest): the tree over ``rows``, whose column ``at`` numbers them from 1 without gaps.

    A row's node is its ``digest``, level 0; a node above is the SHA-256
    of the digests of up to ``fan`` nodes in order, so the last level's only
    node stands for all rows. A group holds at most ``fan`` digests whatever the
    size, each level is written before the next, and there are as many levels as the
    number of rows has digits to the base ``fan``. No rows give no node.
    """
    level = step(rows.select(F.lit(0).alias("level"), (F.col(at) - 1).cast("long").alias("node"), digest.alias("digest")), "digests")
    levels, left = [level], level.count()
    while left > 1:
        inside = F.array_sort(F.collect_list(F.struct("node", "digest")))
        above = level.groupBy(F.expr(f"node div {fan}").alias("_node")).agg(F.sha2(F.array_join(F.transform(inside, lambda x: x["digest"]), "").cast("binary"), 256).alias("digest"))
        level = step(above.select(F.lit(len(levels)).alias("level"), F.col("_node").alias("node"), "digest"), "digests")
        levels.append(level)
        left = -(-left // fan)
    return reduce(DataFrame.unionByName, levels)


def file_tree(spark: SparkSession, path: str, fan: int = FAN) -> DataFrame:
    """The tree over the lines of a file, or of a folder's files in the order of their names, whatever its splits.

    Files of more than 2 GB are fine: no row holds more than a line. The bytes of
    the lines count, not how they end.
    """
    return tree(numbered_lines(spark, path), leaf(F.col("value")), "line", fan)


def root(nodes: DataFrame) -> str | None:
    """The digest that stands for all rows; None if there are none."""
    last = nodes.orderBy(F.desc("level")).first()
    return last["digest"] if last else None


def changed(first: DataFrame, second: DataFrame, fan: int = FAN) -> DataFrame:
    """(first_row, last_row) of the blocks of up to ``fan`` rows, numbered from 1, in which two trees differ.

    Only the level above the rows is compared; a block that one tree lacks differs.
    """
    level = lambda t, name: t.where("level = 1").select("node", F.col("digest").alias(name))
    both = level(first, "a").join(level(second, "b"), "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select((F.col("node") * fan + 1).alias("first_row"), ((F.col("node") + 1) * fan).alias("last_row"))
