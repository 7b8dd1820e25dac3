"""How filters of documents interact: what each removes at every place of every order in which they can be applied.

The orders form a trie whose edges apply one filter to the survivors of those
before. Since a filter judges a document by itself, two prefixes of the same
filters leave the same survivors, whatever their order: the trie is walked depth
first, each set of filters that comes first is one persisted DataFrame of
survivors, kept only while filters are applied to it, and remembered by its set,
so that no set is worked out twice. At every edge the removals are counted from
the survivors. Of n filters that takes 2^n - 1 frames in place of n! n; at most
n of them are persisted at a time.

Texts are judged once; the frames hold each document's part, its verdicts and
its labels. They can be made again from a table in the shared folder if an
executor is lost.

Null text is the empty text; null parts are the empty string. Very long texts
are judged whole. Rows that repeat an id are documents of their own; a text is a
copy if an equal one has a smaller doc_id, so ties of the id and null ids make no
copies. Of repeated labels any that says 1 counts. A part without documents has
no rows, so an empty table gives an empty result. Columns other than doc_id,
text and lang are never read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, settled, whole_text

# The white space between words, the signs that a text mustn't hold, and the limits.
SPACE, SIGNS = " \t\n\x0b\f\r", "#$%&*|"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
#: A filter audit of more filters has too many orders to list.
MOST_FILTERS = 7
FILTERS = ("A", "B", "C", "D", "E")


def _bits(failing: dict[str, Column]) -> Column:
    """The failed filters as the bits of a number, the first filter's the lowest."""
    return sum((F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(failing.values())), F.lit(0))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic): for each document the filters of FILTERS that it fails, as bits, and its labels."""
    text = whole_text()
    trimmed = F.trim(text, F.lit(SPACE))
    split = F.split(trimmed, r"[\x20\x09-\x0D]+")
    counted = F.transform(F.array(split), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("k")))[0]
    said = F.when(trimmed != "", counted).otherwise(F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")))
    judged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), said.alias("said"),
        (100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > MOST_UPPER * F.length(text)).alias("upper"), F.rlike(text, F.lit(f"[{SIGNS}]")).alias("signs"),
    )
    judged = judged.select("doc_id", "part", "digest", (F.col("said.n") < LEAST_WORDS).alias("short"), (100 * F.col("said.k") < LEAST_DISTINCT * F.col("said.n")).alias("repeating"), "upper", "signs")
    judged = materialise(judged, "judged")
    copied = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    copied = materialise(copied, "copied")  # a join of two plain shuffles, of which Spark can split a hot text
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = judged.join(copied, "digest", "left").join(told, "doc_id", "left")
    bits = _bits({"A": F.col("short"), "B": F.col("repeating"), "C": F.col("upper"), "D": F.col("signs"), "E": F.col("doc_id") > F.col("first")})
    return rows.select("part", bits.alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _fails(i: int) -> Column:
    return F.col("fails").bitwiseAND(F.lit(1 << i)) != 0


def _count(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def edges(judged: DataFrame, n: int) -> DataFrame:
    """(part, prior, filter, survivors, removed, good_lost, toxic_lost): each filter applied to the survivors of each set of others (``prior``, as bits)."""
    counted: list[DataFrame] = []
    seen = set()

    def leaving(frame: DataFrame, prior: int, rest: list[int]) -> DataFrame:
        one = lambda i: F.struct(
            F.lit(i).alias("filter"), _count(_fails(i)).alias("removed"), _count(_fails(i) & F.col("good")).alias("good_lost"), _count(_fails(i) & F.col("toxic")).alias("toxic_lost")
        )
        per = frame.groupBy("part").agg(F.count("*").alias("survivors"), F.array(*map(one, rest)).alias("edges"))
        return per.select("part", F.lit(prior).alias("prior"), "survivors", F.explode("edges").alias("e")).select("part", "prior", "survivors", "e.*")

    def visit(frame: DataFrame, prior: int) -> None:
        seen.add(prior)
        rest = [i for i in range(n) if not prior >> i & 1]
        counted.append(materialise(leaving(frame, prior, rest), "edges"))
        for i in rest:
            after = prior | 1 << i
            if len(rest) > 1 and after not in seen:  # after the last filter nothing is counted
                survivors = frame.where(~_fails(i)).persist(StorageLevel.MEMORY_AND_DISK)
                visit(survivors, after)
                survivors.unpersist()

    visit(judged, 0)
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def audit(judged: DataFrame, names: tuple[str, ...] = FILTERS) -> DataFrame:
    """One row for each part, order and step of the filters ``names``: what the filter of that step does there.

    ``judged`` is (part, fails, good, toxic). Columns: part, filter_order, step,
    filter, kept, removed, redundant (fails it, but was removed earlier),
    unique_fails (fails it alone), good_lost, toxic_lost, and shapley, the filter's
    removals summed over all orders.
    """
    n = len(names)
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters, not {n}")
    spark = judged.sparkSession

    def made() -> DataFrame:
        table = materialise(judged, "verdicts")
        found = materialise(edges(table, n), "all-edges")
        one = lambda i: F.struct(F.lit(i).alias("filter"), _count(_fails(i)).alias("failing"), _count(F.col("fails") == 1 << i).alias("unique_fails"))
        totals = table.groupBy("part").agg(F.array(*map(one, range(n))).alias("t")).select("part", F.explode("t").alias("t")).select("part", "t.*")
        prior = [factorial(k) * factorial(n - 1 - k) for k in range(n)]  # orders in which k given filters come before a filter
        ways = F.array(*map(F.lit, prior))[F.bit_count("prior")]
        shares = found.groupBy("part", "filter").agg(F.sum(F.col("removed") * ways).alias("shapley"))
        steps = [("".join(names[i] for i in o), k + 1, o[k], sum(1 << i for i in o[:k])) for o in permutations(range(n)) for k in range(n)]
        orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter int, prior int"))  # n! n rows
        rows = totals.join(shares, ["part", "filter"], "left").join(orders, "filter").join(found, ["part", "filter", "prior"], "left")
        number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        return rows.select(
            "part", "filter_order", "step", F.array(*map(F.lit, names))[F.col("filter")].alias("filter"), (number("survivors") - number("removed")).alias("kept"), number("removed").alias("removed"),
            (F.col("failing") - number("removed")).cast("long").alias("redundant"), number("unique_fails").alias("unique_fails"), number("good_lost").alias("good_lost"),
            number("toxic_lost").alias("toxic_lost"), number("shapley").alias("shapley"),
        )

    return settled(spark, "audit", made)


def _sql() -> str:
    """``audit`` of ``verdicts`` in DuckDB's SQL, over groups of equal verdicts."""
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
    bit = lambda f: f"(1 << (ascii({f}) - 65))"
    return rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
judged AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS fails
  FROM words LEFT JOIN labels USING (doc_id)
),
groups AS (SELECT part, fails, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
orders AS (SELECT o, step, o[step] AS f, coalesce(list_sum(list_transform(string_split(left(o, step - 1), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE {bit('c')} END)), 0)::INTEGER AS prior FROM (VALUES {orders}) v(o), range(1, 6) r(step)),
counted AS (
  SELECT part, o AS filter_order, step, f AS filter,
    coalesce(sum(n) FILTER (fails & prior = 0 AND fails & {bit('f')} = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & prior = 0 AND fails & {bit('f')} <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (fails & prior <> 0 AND fails & {bit('f')} <> 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = {bit('f')}), 0) AS unique_fails,
    coalesce(sum(n) FILTER (fails & prior = 0 AND fails & {bit('f')} <> 0 AND good), 0) AS good_lost, coalesce(sum(n) FILTER (fails & prior = 0 AND fails & {bit('f')} <> 0 AND toxic), 0) AS toxic_lost
  FROM groups, orders GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted
"""


SQL = _sql()
