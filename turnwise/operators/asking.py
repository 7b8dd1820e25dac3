"""Which attribute to ask for next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.steps import step
from ..sources.views import union_all

# Attribute orders, what profile tags ask for, and the words that tell attributes apart.
DEFAULT_ORDER = ("material", "size", "style", "feature", "use_case", "color", "brand", "budget", "other")
PROFILE_MAP = {
    "material": "material", "fit": "size", "comfort": "feature", "durability": "feature",
    "style": "style", "weather": "use_case", "warmth": "use_case", "color": "color",
}
PATTERNS = {
    "material": X.MATERIALS,
    "color": X.COLORS,
    "size": ("xs", "small", "medium", "large", "xl", "xxl", "wide", "narrow"),
    "style": ("casual", "formal", "classic", "modern", "vintage", "slim", "relaxed", "sleeve", "neck"),
    "use_case": ("hiking", "running", "gym", "winter", "outdoor", "work", "travel", "sport"),
    "feature": ("waterproof", "lightweight", "breathable", "pocket", "stretch", "support", "durable", "comfortable", "washable"),
}
QUESTIONS = {
    "material": "Do you have a material preference?",
    "size": "Do you have any sizing or fit requirements?",
    "style": "What style or fit do you prefer?",
    "feature": "Which product feature matters most to you?",
    "use_case": "What will you mainly use it for?",
    "color": "Do you have a color preference?",
    "brand": "Do you have a preferred brand?",
    "budget": "What budget range should I use?",
    "other": "Is there another requirement I should prioritize?",
}
NO_QUESTION = "Here are the closest matches I found."
PATTERN_ORDER = ("material", "color", "size", "style", "use_case", "feature")


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def telling(tokens: Column) -> Column:
    """Those of the tokens that tell an attribute, each once: all that the orders read of a product."""
    return F.array_intersect(tokens, _array(sorted({w for words in PATTERNS.values() for w in words})))


def spreads(pools: DataFrame) -> DataFrame:
    """(pool, attribute, priority, coverage, distinct_spread, entropy_spread) of (pool, item, tokens) candidates."""
    spark = pools.sparkSession
    words = [(w, a, PATTERN_ORDER.index(a)) for a in PATTERN_ORDER for w in PATTERNS[a]]
    known = F.broadcast(spark.createDataFrame(words, "token string, attribute string, priority int"))  # a fixed word list
    hits = pools.select("pool", "item", F.explode(F.array_distinct("tokens")).alias("token")).join(known, "token")
    size = pools.groupBy("pool").agg(F.countDistinct("item").alias("items"))
    covered = hits.groupBy("pool", "attribute", "priority").agg(F.countDistinct("item").alias("covered"))
    values = hits.groupBy("pool", "attribute", "token").agg(F.count("*").alias("n"))
    total = values.groupBy("pool", "attribute").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    p = F.col("n") / F.col("total")
    entropy = values.join(total.hint("merge"), ["pool", "attribute"]).groupBy("pool", "attribute", "k").agg(F.sum(-p * F.log2(p)).alias("h"))
    return (
        covered.join(entropy.hint("merge"), ["pool", "attribute"]).join(size.hint("merge"), "pool").where(F.col("k") >= 2)
        .select(
            "pool", "attribute", "priority", (F.col("covered") / F.col("items")).alias("coverage"),
            ((F.col("k") - 1) / F.col("k")).alias("distinct_spread"), (F.col("h") / F.log2(F.col("k").cast("double"))).alias("entropy_spread"),
        )
    )


def grounded_order(pools: DataFrame, spread: str, measured: DataFrame | None = None) -> DataFrame:
    """(pool, attributes): the attributes by how evenly they split the pool, then the defaults; ``measured`` are the pools' spreads where they are known."""
    value = F.round(F.col("coverage") * F.col(spread), 9)
    rows = spreads(pools) if measured is None else measured
    best = rows.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct((-value).alias("s"), "priority", "attribute"))).alias("a"))
    every = pools.select("pool").distinct().join(best.hint("merge"), "pool", "left")
    found = F.coalesce(F.transform("a", lambda x: x["attribute"]), F.expr("cast(array() as array<string>)"))
    return every.select("pool", F.array_distinct(F.concat(found, _array(DEFAULT_ORDER))).alias("attributes"))


def expected_order(pools: DataFrame) -> DataFrame:
    """(pool, attributes): by the bits that an answer is expected to give, the none that know nothing of the attribute being an answer too.

    Each product stands for the first of an attribute's words that it holds, or for
    none. An attribute for which all products give one answer is left to the defaults.
    """
    spark = pools.sparkSession
    words = [(w, a, PATTERN_ORDER.index(a), i) for a in PATTERN_ORDER for i, w in enumerate(PATTERNS[a])]
    known = F.broadcast(spark.createDataFrame(words, "token string, attribute string, priority int, at int"))  # a fixed word list
    size = pools.groupBy("pool").agg(F.countDistinct("item").alias("items"))
    held = pools.select("pool", "item", F.explode(F.array_distinct("tokens")).alias("token")).join(known, "token")
    values = held.groupBy("pool", "item", "attribute", "priority").agg(F.min("at").alias("at")).groupBy("pool", "attribute", "priority", "at").agg(F.count("*").alias("n"))
    bits = lambda n: -(n / F.col("items")) * F.log2(n / F.col("items"))
    none = F.col("items") - F.col("known")
    gain = values.join(size.hint("merge"), "pool").groupBy("pool", "attribute", "priority", "items").agg(F.sum(bits(F.col("n"))).alias("h"), F.sum("n").alias("known"))
    gain = gain.withColumn("gain", F.round(F.col("h") + F.when(none > 0, bits(none)).otherwise(0.0), 9)).where("gain > 0")
    best = gain.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct((-F.col("gain")).alias("g"), "priority", "attribute"))).alias("a"))
    every = pools.select("pool").distinct().join(best.hint("merge"), "pool", "left")
    found = F.coalesce(F.transform("a", lambda x: x["attribute"]), F.expr("cast(array() as array<string>)"))
    return every.select("pool", F.array_distinct(F.concat(found, _array(DEFAULT_ORDER))).alias("attributes"))


def profile_order(tags: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in PROFILE_MAP.items() for x in kv))
    wanted = F.filter(F.transform(F.coalesce(tags, F.expr("cast(array() as array<string>)")), lambda t: F.try_element_at(names, F.lower(t))), lambda a: a.isNotNull())
    return F.array_distinct(F.concat(wanted, _array(DEFAULT_ORDER)))


def next_attribute(order: Column, asked: Column) -> Column:
    """The first of the order that hasn't been asked, or null; the order ('other') alone is asked again and again."""
    again = F.when((F.size(order) == 1) & (order[0] == "other"), F.lit("other"))
    return F.coalesce(again, F.try_element_at(F.array_except(order, asked), F.lit(1)))


def question(attribute: Column) -> Column:
    """The sentence that asks for an attribute; the one for null asks nothing."""
    names = F.create_map(*(F.lit(x) for kv in QUESTIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, attribute), F.lit(NO_QUESTION))


def stuck_attribute(stuck_for: Column) -> Column:
    """What to ask after stuck_for + 1 turns in a row without gain: an open question, then the default order round and round."""
    return F.when(stuck_for == 0, "other").otherwise(_array(DEFAULT_ORDER)[F.pmod(stuck_for - 1, F.lit(len(DEFAULT_ORDER))).cast("int")])


def attribute_order(policy: str, pools: DataFrame) -> DataFrame:
    """(pool, attributes) under a policy; ``profile`` reads a column ``tags``."""
    if policy in ("candidate", "entropy"):
        return grounded_order(pools, "distinct_spread" if policy == "candidate" else "entropy_spread")
    if policy == "expected_value":
        return expected_order(pools)
    if policy == "profile":
        return pools.groupBy("pool").agg(F.first("tags").alias("tags")).select("pool", profile_order(F.col("tags")).alias("attributes"))
    if policy == "fixed":
        return pools.select("pool").distinct().withColumn("attributes", _array(DEFAULT_ORDER))
    if policy == "other":
        return pools.select("pool").distinct().withColumn("attributes", _array(["other"]))
    raise ValueError(f"no policy {policy!r}: it is one of candidate, entropy, expected_value, profile, fixed, other")


def attribute_orders(policies: tuple[str, ...], pools: DataFrame) -> DataFrame:
    """(policy, pool, attributes) under several policies; what the grounded ones measure is measured once."""
    measured = step(spreads(pools), "spreads") if len({"candidate", "entropy"} & {*policies}) == 2 else None
    columns = {"candidate": "distinct_spread", "entropy": "entropy_spread"}
    orders = [grounded_order(pools, columns[p], measured) if p in columns else attribute_order(p, pools) for p in policies]
    return union_all([o.select(F.lit(p).alias("policy"), "pool", "attributes") for p, o in zip(policies, orders, strict=True)])
