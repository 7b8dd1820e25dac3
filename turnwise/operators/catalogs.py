"""Catalog profiling and vocabulary mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.steps import step
from ..sources.views import rank_within, union_all

# Fixed value: a term found for several slots stays in the first of these that has it; other slots come after.
PRECEDENCE = ("department", "material", "size", "category", "color", "style")
#: The key of a product's details that tells whom it is for.
DEPARTMENT = "Department"


def profile(products: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, present, missing, coverage) in one pass."""
    kinds = dict(products.dtypes)
    counts = products.agg(F.count("*").alias("n"), *(F.sum(X.present(F.col(f), kinds[f]).cast("long")).alias(f) for f in fields))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit(0)).alias("present")) for f in sorted(fields))))
    return counts.select("n", rows.alias("r")).select(
        "r.field", "r.present", (F.col("n") - F.col("r.present")).alias("missing"),
        F.when(F.col("n") > 0, F.round(F.col("r.present") / F.col("n"), 6)).otherwise(0.0).alias("coverage"),
    )


def _alike(products: DataFrame, *by: Column) -> DataFrame:
    """(by, n): each different value of the products with how many have it; a column ``n`` tells how many products a row stands for."""
    return products.groupBy(*by).agg((F.sum("n") if "n" in products.columns else F.count("*")).alias("n"))


def _numbers(rows: DataFrame, terms: Column) -> DataFrame:
    """(term, n): how many products the rows (n) with each of ``terms`` stand for."""
    return rows.select(F.explode(terms).alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n"))


def category_terms(products: DataFrame) -> DataFrame:
    """(term, n): in how many products' category paths, below root and department, each term stands."""
    below = F.slice("categories", 3, F.greatest(F.size("categories"), F.lit(1)))
    terms = F.array_distinct(F.flatten(F.transform(below, X.split_compound)))
    return _numbers(_alike(products, F.col("categories")), terms)


def attribute_terms(products: DataFrame, key: str) -> DataFrame:
    """(term, n): in how many products' details under ``key`` each term stands."""
    values = _alike(products, F.try_element_at("details", F.lit(key)).alias("value"))
    return _numbers(values, F.array_distinct(X.split_compound(F.col("value"))))


def search_text(products: DataFrame) -> Column:
    """The normalised title and features, with a space at both ends."""
    joined = F.concat_ws(" ", "title", F.array_join(F.coalesce("features", F.expr("cast(array() as array<string>)")), " "))
    return F.concat(F.lit(" "), X.normalize_term(joined), F.lit(" "))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), " "), lambda w: w != "")


def term_sizes(term: Column) -> Column:
    """Aggregate: the numbers of words that the terms have."""
    return F.collect_set(F.greatest(F.size(_words(term)), F.lit(1)))


def ngrams(haystack: Column, sizes: Column) -> Column:
    """All different runs of as many words as ``sizes`` holds."""
    def runs(w: Column) -> Column:
        fitting = F.filter(sizes, lambda n: n <= F.greatest(F.size(w), F.lit(1)))
        of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.array_distinct(F.flatten(F.transform(fitting, of)))

    return F.transform(F.array(_words(haystack)), runs)[0]  # the words are worked out once


def term_support(products: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, support): how many products hold each term as whole words; 0 for terms that none has.

    Whole-word containment is an equi-join on the texts' word runs, so it costs
    what the texts hold, not texts times terms. Runs have the lengths that the terms have,
    and products of the same text are counted together.
    """
    sizes = terms.agg(term_sizes(F.col("term")).alias("_n"))
    kinds = _alike(products, F.col("title"), F.col("features"))
    texts = kinds.select("n", search_text(kinds).alias("_text")).join(F.broadcast(sizes))  # one row
    runs = texts.select("n", F.explode(ngrams(F.col("_text"), F.col("_n"))).alias("term"))
    counted = runs.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("support"))
    return terms.select("term").distinct().join(counted, "term", "left").select("term", F.coalesce("support", F.lit(0)).alias("support"))


def departments(products: DataFrame, key: str = DEPARTMENT) -> DataFrame:
    values = _alike(products, F.try_element_at("details", F.lit(key)).alias("value"))
    return values.select(X.normalize_department(F.col("value")).alias("term"), "n").where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("n"))


def resolve_conflicts(terms: DataFrame) -> DataFrame:
    """Each term of (slot, term, support) in its first slot only."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("slot")), F.lit(0)), F.lit(99))
    return terms.withColumn("_at", rank_within(["term"], order, F.col("slot"))).where("_at = 1").drop("_at")


def gazetteer(products: DataFrame, keys: dict[str, str], top_n: int = 60) -> DataFrame:
    """(slot, term, support): departments, categories, and for each slot in ``keys`` its most frequent usable terms, by free-text support."""
    details = {k: F.try_element_at("details", F.lit(k)) for k in dict.fromkeys([DEPARTMENT, *keys.values()])}
    kinds = _alike(products, F.col("title"), F.col("features"), F.col("categories"), *(v.alias(f"_{i}") for i, v in enumerate(details.values())))
    told = F.create_map(*(c for i, k in enumerate(details) for c in (F.lit(k), F.col(f"_{i}"))))
    kinds = step(kinds.select("title", "features", "categories", told.alias("details"), "n"), "different-products")  # the catalog is read once
    known = [
        departments(kinds).select(F.lit("department").alias("slot"), "term", F.col("n").alias("support")),
        category_terms(kinds).select(F.lit("category").alias("slot"), "term", F.col("n").alias("support")),
    ]
    if keys:
        seeds = [attribute_terms(kinds, key).orderBy(F.desc("n"), "term").limit(top_n).select(F.lit(slot).alias("slot"), "term") for slot, key in keys.items()]
        wanted = step(union_all(seeds), "seeds")
        found = term_support(kinds, wanted.select("term")).where((F.col("support") > 0) & X.is_usable_term(F.col("term")))
        known.append(wanted.join(found, "term").select("slot", "term", "support"))
    return resolve_conflicts(union_all(known))


def gazetteer_summary(vocabulary: DataFrame, top: int = 15) -> DataFrame:
    """(slot, term_count, covered_items, top_terms)."""
    ranked = vocabulary.withColumn("at", rank_within(["slot"], F.desc("support"), F.col("term")))
    best = F.array_sort(F.collect_list(F.when(F.col("at") <= top, F.struct("at", "term"))))
    return ranked.groupBy("slot").agg(
        F.count("*").alias("term_count"), F.sum("support").alias("covered_items"), F.array_join(F.transform(best, lambda x: x["term"]), ",").alias("top_terms")
    )


def extract_slots(texts: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, slot, term): the vocabulary's terms in each text; a term inside a longer one of its slot that is there too is left out."""
    known = vocabulary.agg(F.collect_set(F.when(F.col("slot") == "material", F.col("term"))).alias("_m"), term_sizes(F.col("term")).alias("_n"))  # one row
    hay = F.concat(F.lit(" "), X.normalize_term(F.col(text)), F.lit(" "))
    there = texts.join(F.broadcast(known)).select(key, F.explode(ngrams(X.apply_aliases(hay, F.col("_m")), F.col("_n"))).alias("term"))
    hits = there.join(vocabulary.select("slot", "term"), "term")
    grouped = hits.groupBy(key, "slot").agg(F.collect_set("term").alias("hits"))
    inside = lambda a, b: F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))
    kept = F.filter("hits", lambda h: ~F.exists(F.col("hits"), lambda g: (g != h) & inside(h, g)))
    return grouped.select(key, "slot", F.explode(kept).alias("term"))
