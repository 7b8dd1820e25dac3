"""Session metrics, recall, latency, splits and coverage masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as X
from ..sources.steps import step
from ..sources.views import placed, rank_within

MAX_TURNS = 10
#: Fixed value: part of the hashed order in which values are masked.
MASK_VERSION = "coverage-stress-v1"


def session_facts(turns: DataFrame, *by: str) -> DataFrame:
    """([by, ]sample_id, scenario_type, hit, first_hit_turn, best_rank, reciprocal_rank) of (sample_id, scenario_type, turn, rank, applied).

    A hit counts once the session's override has been applied; later turns don't count.
    ``by`` names columns that tell sessions of the same id apart.
    """
    counts = F.col("rank").isNotNull() & (F.col("rank") <= 10) & F.col("applied")
    first = F.min(F.when(counts, F.struct("turn", "rank")))
    return turns.groupBy(*by, "sample_id", "scenario_type").agg(first.alias("f")).select(
        *by, "sample_id", "scenario_type", F.col("f").isNotNull().alias("hit"), F.col("f.turn").alias("first_hit_turn"),
        F.col("f.rank").alias("best_rank"), F.coalesce(1.0 / F.col("f.rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def _summary() -> list[Column]:
    return [
        F.count("*").alias("sample_count"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg(F.coalesce("first_hit_turn", F.lit(MAX_TURNS + 1))), 6).alias("mttc"),
    ]


def composite(metrics: DataFrame) -> DataFrame:
    """Adds efficiency and score, from the rounded parts."""
    efficiency = F.coalesce(F.least(F.greatest((MAX_TURNS + 1 - F.col("mttc")) / MAX_TURNS, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    rows = metrics.withColumn("efficiency", F.round(efficiency, 6))
    return rows.withColumn("score", F.round(0.5 * F.col("hit_rate") + 0.3 * F.col("mrr") + 0.2 * F.col("efficiency"), 6))


def summarise(facts: DataFrame, *by: str) -> DataFrame:
    """Metrics over all sessions and over each combination of ``by``, in one pass; 'all' stands for every value."""
    if not by:
        return composite(facts.agg(*_summary()))
    sets = [list(by), []] if len(by) == 1 else [list(by), [by[0]], []]
    grouped = facts.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(*_summary())
    return composite(grouped.select(*(F.coalesce(c, F.lit("all")).alias(c) for c in by), "sample_count", "hit_rate", "mrr", "mttc"))


def deltas(first: DataFrame, second: DataFrame, key: str, metrics: tuple[str, ...] = ("hit_rate", "mrr", "mttc", "efficiency", "score")) -> DataFrame:
    """(key, metric, delta): second less first where both have a value."""
    def long(df: DataFrame, name: str) -> DataFrame:
        rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics)))
        return df.select(key, rows.alias("r")).select(key, "r.*")

    both = long(first, "a").join(long(second, "b"), [key, "metric"]).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.select(key, "metric", F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def recall(ranks: DataFrame, cutoffs: tuple[int, ...], by: str) -> DataFrame:
    """(by, cutoff, sample_count, recall) overall ('all') and for each value."""
    hits = [F.avg(F.coalesce((F.col("rank") <= c).cast("double"), F.lit(0.0))).alias(f"_{c}") for c in cutoffs]
    grouped = ranks.groupingSets([[F.col(by)], []], by).agg(F.count("*").alias("sample_count"), *hits)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.round(f"_{c}", 6).alias("recall")) for c in cutoffs)))
    return grouped.select(F.coalesce(by, F.lit("all")).alias(by), "sample_count", rows.alias("r")).select(by, "sample_count", "r.cutoff", "r.recall")


def latency(times: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, median, p95, p99, largest): p95 and p99 are values that occurred, at place int(n f) from 0; the median is the mean of the middle two.

    Places come from counts of equal values and from range-dealt tasks, so no group is gathered.
    """
    counted = times.groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    dealt = counted.repartitionByRange(int(times.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, "v").sortWithinPartitions(group, "v")
    dealt = step(dealt.withColumn("_at", F.monotonically_increasing_id()), "values").withColumn("_task", F.shiftright("_at", 33))
    held = dealt.groupBy(group, "_task").agg(F.sum("c").alias("_n"))
    of = W.Window.partitionBy(group)
    earlier = F.sum("_n").over(of.orderBy("_task").rowsBetween(W.Window.unboundedPreceding, -1))
    base = held.select(group, "_task", F.coalesce(earlier, F.lit(0)).alias("_base"), F.sum("_n").over(of).alias("n"))  # at most tasks + groups rows
    inside = F.sum("c").over(W.Window.partitionBy("_task", group).orderBy("v"))
    placed = dealt.withColumn("_inside", inside).join(F.broadcast(base), [group, "_task"]).withColumn("upto", F.col("_base") + F.col("_inside"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    nearest = lambda f: at(F.least(F.col("n") - 1, F.floor(F.col("n") * f)))
    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    return placed.groupBy(group).agg(
        F.max("n").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 6).alias("mean"),
        F.round(middle, 6).alias("median"), nearest(0.95).alias("p95"), nearest(0.99).alias("p99"), F.max("v").alias("largest"),
    )


def projected(profile: DataFrame, construction: float, times: float = 4.0) -> DataFrame:
    """``profile`` with ``projected``: what ``times`` as many turns and the construction would take."""
    return profile.withColumn("projected", F.round(F.col("mean") * F.col("n") * times + construction, 6))


def split(samples: DataFrame, size: int, seed: str) -> DataFrame:
    """(sample_id, stratum, part) of (sample_id, index, stratum): validation by largest remainders and hashed order, the rest development."""
    strata = samples.groupBy("stratum").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.Window.partitionBy())
    quota = F.col("n") * F.lit(size) / F.col("total")
    strata = strata.withColumn("total", total).select("stratum", "n", F.floor(quota).alias("base"), F.round(quota - F.floor(quota), 9).alias("rest"))
    left = F.lit(size) - F.sum("base").over(W.Window.partitionBy())
    strata = strata.withColumn("left", left).withColumn("at", rank_within([], F.desc("rest"), F.col("stratum")))
    wanted = strata.select("stratum", (F.col("base") + (F.col("at") <= F.col("left")).cast("int")).alias("take"))
    digest = F.sha2(F.concat_ws("\0", F.lit(seed), F.col("sample_id").cast("string"), F.col("index").cast("string")), 256)
    rows = placed(samples.select("sample_id", "stratum", digest.alias("_digest")), "stratum", "_digest").join(F.broadcast(wanted), "stratum")  # one row a stratum
    return rows.select("sample_id", "stratum", F.when(F.col("place") <= F.col("take"), "validation").otherwise("development").alias("part"))


def trace_summary(turns: DataFrame) -> DataFrame:
    """(sample_id, turns, dead_turns, best_rank, override_turn, rank_before, rank_at) of (sample_id, turn, rank, dead, override)."""
    first = turns.where("override").groupBy("sample_id").agg(F.min("turn").alias("override_turn"))
    rows = turns.join(first.hint("merge"), "sample_id", "left")
    before = (F.col("turn") < F.col("override_turn")) & F.col("rank").isNotNull()
    return rows.groupBy("sample_id").agg(
        F.count("*").alias("turns"), F.count_if("dead").alias("dead_turns"), F.min("rank").alias("best_rank"), F.max("override_turn").alias("override_turn"),
        F.max(F.when(before, F.struct("turn", "rank")))["rank"].alias("rank_before"), F.max(F.when(F.col("turn") == F.col("override_turn"), F.col("rank"))).alias("rank_at"),
    ).fillna(0, ["best_rank", "override_turn", "rank_before", "rank_at"])


def _presence(products: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    kinds = dict(products.dtypes)
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), X.present(F.col(f), kinds[f]).alias("there")) for f in fields)))
    return products.select("parent_asin", rows.alias("r")).select("parent_asin", "r.field", "r.there")


def mask_plan(products: DataFrame, targets: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, catalog_present, coverage, desired, original, masks, shortfall): what brings the targets to the catalog's coverage."""
    rows = _presence(products, fields)
    whole = rows.groupBy("field").agg(F.sum(F.col("there").cast("long")).alias("catalog_present"), F.count("*").alias("n"))
    ours = rows.join(targets.select("parent_asin").distinct().hint("merge"), "parent_asin", "left_semi").groupBy("field").agg(
        F.sum(F.col("there").cast("long")).alias("original"), F.count("*").alias("t")
    )
    desired = F.bround(F.col("catalog_present") / F.col("n") * F.col("t"), 0).cast("long")
    return whole.join(ours, "field").withColumn("desired", desired).select(
        "field", "catalog_present", F.round(F.col("catalog_present") / F.col("n"), 6).alias("coverage"), "desired", "original",
        F.greatest(F.col("original") - F.col("desired"), F.lit(0)).alias("masks"), F.greatest(F.col("desired") - F.col("original"), F.lit(0)).alias("shortfall"),
    )


def masked_ids(products: DataFrame, targets: DataFrame, fields: tuple[str, ...], seed: str) -> DataFrame:
    """(field, parent_asin) of the values to take out, the first by a seeded hash."""
    rows = _presence(products, fields).where("there").join(targets.select("parent_asin").distinct().hint("merge"), "parent_asin", "left_semi")
    digest = F.sha2(F.concat_ws("\0", F.lit(MASK_VERSION), F.lit(seed), "field", "parent_asin"), 256)
    ranked = placed(rows.select("field", "parent_asin", digest.alias("_digest")), "field", "_digest")
    plan = F.broadcast(mask_plan(products, targets, fields).select("field", "masks"))  # one row a field
    return ranked.join(plan, "field").where(F.col("place") <= F.col("masks")).select("field", "parent_asin")


def apply_masks(products: DataFrame, masks: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The products with masked values emptied: null, or an empty list or map."""
    per = masks.groupBy("parent_asin").agg(F.collect_set("field").alias("_f"))
    joined = products.join(per.hint("merge"), "parent_asin", "left")
    kinds = dict(products.dtypes)

    def blank(f: str) -> Column:
        if kinds[f].startswith("array"):
            return F.expr(f"cast(array() as {kinds[f]})")
        if kinds[f].startswith("map"):
            return F.expr(f"cast(map() as {kinds[f]})")
        return F.lit(None).cast(kinds[f])

    gone = lambda f: F.coalesce(F.array_contains("_f", f), F.lit(False))
    return joined.select(*(F.when(gone(c), blank(c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in products.columns))


def mask_violations(before: DataFrame, after: DataFrame, masks: DataFrame, fields: tuple[str, ...], targets: DataFrame) -> DataFrame:
    """(invariant, violations): ids lost, added or repeated, values filled, changes outside the plan or the targets, masks not applied, wrong numbers of masks."""
    kinds = dict(before.dtypes)
    every = [c for c in before.columns if c != "parent_asin"]
    told = lambda f: F.to_json(F.struct(F.col(f).alias("v")))
    ours = lambda df, there, value: df.select(
        "parent_asin", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), X.present(F.col(f), kinds[f]).alias(there), told(f).alias(value)) for f in every))).alias("r")
    ).select("parent_asin", "r.*")
    both = ours(before, "was", "old").join(ours(after, "now", "new").hint("merge"), ["parent_asin", "field"], "full_outer")
    both = both.join(masks.select("field", "parent_asin").withColumn("planned", F.lit(True)).hint("merge"), ["parent_asin", "field"], "left")
    both = both.join(targets.select("parent_asin").distinct().withColumn("target", F.lit(True)).hint("merge"), "parent_asin", "left")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    planned, target = F.coalesce("planned", F.lit(False)), F.coalesce("target", F.lit(False))
    changed = F.col("old") != F.col("new")  # of rows that both have
    counts = both.agg(
        one(F.col("was").isNull() | F.col("now").isNull()).alias("identifiers_preserved"), one(~F.col("was") & F.col("now")).alias("nothing_filled"),
        one(target & changed & (~planned | ~F.col("field").isin(*fields))).alias("unplanned_unchanged"), one(planned & F.col("now")).alias("planned_masked"),
        one(~target & changed).alias("other_products_unchanged"),
    )
    twice = after.groupBy("parent_asin").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    plan = mask_plan(before, targets, fields).select("field", "masks", "original")
    left = _presence(after, fields).join(targets.select("parent_asin").distinct().hint("merge"), "parent_asin", "left_semi").groupBy("field").agg(F.sum(F.col("there").cast("long")).alias("left"))
    wrong = plan.join(left, "field", "left").agg(one(F.coalesce("left", F.lit(0)) != F.col("original") - F.col("masks")).alias("mask_counts"))
    counts = counts.join(twice).join(wrong).withColumn("identifiers_preserved", F.col("identifiers_preserved") + F.col("repeated")).drop("repeated")  # one row each
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("invariant"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations")) for c in counts.columns)))
    return counts.select(rows.alias("r")).select("r.*")


def clean_responses(responses: DataFrame, known: DataFrame, k: int = 10) -> DataFrame:
    """(session, turn, rank, parent_asin) of (session, turn, response as JSON): what can be used of each response.

    Recommendations may be ids or objects with an id; blank, repeated and unknown
    ones go, the first ``k`` stay. A response that can't be read recommends nothing.
    """
    listed = F.from_json(F.get_json_object("response", "$.recommendations"), "array<string>")
    each = responses.select("session", "turn", F.posexplode(listed).alias("at", "raw"))
    name = F.trim(F.when(F.startswith(F.ltrim("raw"), F.lit("{")), F.get_json_object("raw", "$.parent_asin")).otherwise(F.col("raw")))
    ids = each.select("session", "turn", "at", name.alias("parent_asin")).where("parent_asin <> ''")
    first = ids.join(known.select("parent_asin").hint("merge"), "parent_asin", "left_semi").groupBy("session", "turn", "parent_asin").agg(F.min("at").alias("at"))
    return first.withColumn("rank", rank_within(["session", "turn"], F.col("at"))).where(F.col("rank") <= k).select("session", "turn", "rank", "parent_asin")


def token_usage(responses: DataFrame) -> DataFrame:
    """One row: prompt_tokens, completion_tokens and total_tokens over all responses; only whole numbers from 0 count."""
    def of(key: str) -> Column:
        raw = F.get_json_object("response", f"$.usage.{key}")
        return F.coalesce(F.sum(F.when(F.rlike(raw, F.lit("^[0-9]+$")), raw.try_cast("long"))), F.lit(0)).alias(key)

    return responses.agg(of("prompt_tokens"), of("completion_tokens")).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
