"""Sharding by Hilbert-curve order (native).

Several metadata dimensions are quantised into 2**bits cells each, the cells'
index along an n-dimensional Hilbert curve orders the rows, and the order is cut
into runs of equal row count. Neighbours on the curve are neighbours in every
dimension, so the minima and maxima of a run's columns prune files for filters
on any of the dimensions. A text dimension counts by the rank of the whole value
among all different values, so values that begin alike are told apart.

Null metadata falls into the lowest cell; null text counts as no bytes; very long
texts count by their size; equal cells are ordered by ``doc_id`` (nulls first,
then by the text's check sum and size, for repeated ids); rows that repeat id and
text are rows like others; an empty table gives an empty result. Columns other
than doc_id, text and the dimensions are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialise, number_rows, whole_text

#: Dimensions of the documents table: name -> kind.
DIMENSIONS = {"lang": "text", "source": "text", "n_bytes": "number"}


def _numbered(df: DataFrame, name: str, kind: str, out: str) -> DataFrame:
    """``df`` with an order-preserving number of a dimension: the rank among all different values, for text."""
    if kind == "number":
        return df.withColumn(out, F.coalesce(F.col(name).cast("double"), F.lit(-1.0)))
    value = F.coalesce(F.col(name).cast("string"), F.lit(""))
    ranked = number_rows(df.select(value.alias("_value")).distinct(), ["_value"], "dimension-values", "_rank")
    return df.withColumn("_value", value).join(ranked, "_value").withColumn(out, F.col("_rank").cast("double")).drop("_value", "_rank")


def quantise(df: DataFrame, dimensions: dict[str, str], bits: int) -> DataFrame:
    """Add ``cells``: each dimension's cell, cut at quantiles of all rows.

    The cuts, at most 2**bits - 1 numbers a dimension, are the only thing that
    reaches the driver.
    """
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    valued = df
    for i, (n, k) in enumerate(dimensions.items()):
        valued = _numbered(valued, n, k, f"_d{i}")
    cuts = valued.agg(
        *(F.percentile_approx(f"_d{i}", shares, 20000).alias(f"c{i}") for i in range(len(dimensions)))
    ).first()

    def cell(i: int) -> Column:
        """A dimension of few values spreads them over the whole axis, so that the curve tells them apart as coarsely as others."""
        edges = sorted(set(cuts[i] or []))
        at = F.array(*map(F.lit, edges)).cast("array<double>")
        return F.floor(F.size(F.filter(at, lambda c: c < F.col(f"_d{i}"))) * F.lit((1 << bits) / (len(edges) + 1))).cast("int")

    return valued.withColumn("cells", F.array(*(cell(i) for i in range(len(dimensions))))).drop(
        *(f"_d{i}" for i in range(len(dimensions)))
    )


def hilbert_index(cells: Column, n: int, bits: int) -> Column:
    """The index of an n-dimensional cell (array<int>) along the Hilbert curve.

    Coordinates are turned into the curve's transposed form level by level
    (reflect or swap with the first axis), Gray-decoded, and their bits
    interleaved. Each level is a fold, so the expression stays small.
    """
    steps = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in (1 << k for k in range(bits - 1, 0, -1)) for i in range(n)))

    def put(x: Column, i: Column, v: Column) -> Column:
        return F.transform(x, lambda y, j: F.when(j == i, v).otherwise(y))

    def undo(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        p = q - 1
        first, here = F.get(x, F.lit(0)), F.get(x, i)
        swap = first.bitwiseXOR(here).bitwiseAND(p)
        flipped = put(x, F.lit(0), first.bitwiseXOR(p))
        swapped = F.transform(
            x, lambda y, j: F.when((j == 0) & (i == 0), y).when((j == 0) | (j == i), y.bitwiseXOR(swap)).otherwise(y)
        )
        return F.when(here.bitwiseAND(q) != 0, flipped).otherwise(swapped)

    axes = F.aggregate(steps, cells, undo)
    empty_ints = F.expr("cast(array() as array<int>)")
    gray = F.aggregate(
        axes, empty_ints,
        lambda done, x: F.concat(done, F.array(x.bitwiseXOR(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))))),
    )
    levels = F.array(*(F.lit(1 << k) for k in range(bits - 1, 0, -1)))
    turn = lambda g: F.aggregate(
        levels, F.lit(0),
        lambda t, q: F.when(F.element_at(g, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
    )
    turned = F.transform(F.array(F.struct(gray.alias("g"))), lambda s: F.transform(s["g"], lambda x: x.bitwiseXOR(turn(s["g"]))))[0]
    order = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(k).alias("k")) for k in range(bits - 1, -1, -1) for i in range(n)))
    return F.transform(
        F.array(F.struct(turned.alias("x"))),
        lambda s: F.aggregate(
            order, F.lit(0).cast("long"),
            lambda h, b: F.shiftleft(h, 1).bitwiseOR(F.expr("0L") + F.element_at(s["x"], b["i"]).bitwiseAND(F.element_at(F.array(*(F.lit(1 << j) for j in range(bits))), b["k"] + 1)).cast("boolean").cast("long")),
        ),
    )[0]


def shard(docs: DataFrame, n_shards: int = 8, dimensions: dict[str, str] | None = None, bits: int = 5) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, curve, rank, shard, slot and the dimensions.

    ``shard`` cuts the curve's order into ``n_shards`` runs whose row counts
    differ by at most one; ``slot`` is the place in the run, from 0.
    """
    dimensions = dimensions or DIMENSIONS
    text = whole_text()
    rows = docs.select(
        "doc_id",
        *(c for c in dimensions if c != "n_bytes"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = materialise(rows, "shard-metadata")  # the texts are read once
    rows = quantise(rows, dimensions, bits).withColumn("curve", hilbert_index(F.col("cells"), len(dimensions), bits))
    ranked = number_rows(rows.drop("cells"), ["curve", "doc_id", "text_crc32", "n_bytes"], "hilbert")
    total = ranked.count()
    low, more = divmod(total, n_shards)
    edge = more * (low + 1)  # the first shards take one row more
    place = F.when(F.col("rank") < edge, F.expr(f"rank div {low + 1}")).otherwise(
        F.lit(more) + F.expr(f"(rank - {edge}) div {max(low, 1)}")
    )
    return (
        ranked.withColumn("shard", place.cast("int"))
        .withColumn("slot", F.col("rank") - F.col("shard") * F.lit(low) - F.least("shard", F.lit(more)))
        .withColumn("size", F.col("n_bytes") + 1)
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> str:
    """Write every row of the documents with one folder a shard, ordered along the curve inside it; returns the name of the folders' column.

    That is ``shard``, with a number where the documents have such a column. Rows
    are told by id (null is an id like others), check sum and size of the text;
    rows that agree in all three take the places of these in any order.
    """
    column = next(c for c in ("shard", *(f"shard_{i}" for i in range(1, len(docs.columns) + 2))) if c not in docs.columns)
    same = lambda *keys: F.row_number().over(W.Window.partitionBy(*keys).orderBy(keys[-1]))
    text = whole_text()
    keyed = docs.withColumns({"_id": F.col("doc_id"), "_crc": F.crc32(text), "_bytes": F.octet_length(text).cast("long")})
    keyed = keyed.withColumn("_n", same("_id", "_crc", "_bytes"))
    where = placed.select(
        F.col("doc_id").alias("_at_id"), F.col("text_crc32").alias("_at_crc"), F.col("n_bytes").alias("_at_bytes"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")
    ).withColumn("_at_n", same("_at_id", "_at_crc", "_at_bytes"))
    met = F.col("_id").eqNullSafe(F.col("_at_id")) & (F.col("_crc") == F.col("_at_crc")) & (F.col("_bytes") == F.col("_at_bytes")) & (F.col("_n") == F.col("_at_n"))
    rows = keyed.join(where, met).repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    rows.select(*docs.columns, F.col("_shard").alias(column)).write.partitionBy(column).parquet(path)
    return column


def prunable(placed: DataFrame, dimensions: dict[str, str] | None = None) -> DataFrame:
    """The minimum and maximum of every dimension in each shard: what a reader prunes files by."""
    dimensions = dimensions or DIMENSIONS
    return placed.groupBy("shard").agg(
        F.count("*").alias("n_rows"),
        *(f(c).alias(f"{f.__name__}_{c}") for c in dimensions for f in (F.min, F.max)),
    )
