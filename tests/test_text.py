"""Text functions on known cases."""

from pyspark.sql import functions as F

from turnwise.functions import text as X


def _each(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_tokens(spark):
    assert _each(spark, X.query_tokens, ["I'm looking for RED shoes, size 7 XL", "", "a I of", "café"]) == [["red", "shoes", "size", "xl"], [], [], ["caf"]]
    assert _each(spark, X.raw_tokens, ["A-b c", ""]) == [["a", "b", "c"], []]


def test_phrases(spark):
    assert _each(spark, lambda c: X.phrases(c, 3), ["one two three", "one", ""]) == [["one two", "two three", "one two three"], [], []]


def test_singular_forms(spark):
    words = ["dresses", "accessories", "scarves", "hoodies", "gloves", "boots", "glass", "gas", "watches", "boxes"]
    assert _each(spark, X.singular, words) == ["dress", "accessory", "scarf", "hoodie", "glove", "boot", "glass", "gas", "watch", "box"]


def test_compounds(spark):
    got = _each(spark, X.split_compound, ["Tops, Tees & Blouses", "Booties & Gloves", "Jackets and Coats", None])
    assert got == [["top", "tee", "blouse"], ["bootie", "glove"], ["jacket", "coat"], []]


def test_departments(spark):
    assert _each(spark, X.normalize_department, ["Women's", "Baby Girls (0-24M)", "unisex-adult", "garden", None]) == ["women", "girls", "unisex-adult", None, None]


def test_constraints(spark):
    values = ["under $40", "soft cotton", "Color: teal", "wide toe", "slim fit", "for hiking", "zipper", "budget around $5"]
    assert _each(spark, X.classify_constraint, values) == ["budget", "material", "color", "size", "style", "use_case", "feature", "budget"]


def test_coarse_category(spark):
    df = spark.createDataFrame([(["Clothing, Shoes & Jewelry", "Women", "Boots"],), (["Clothing"],), (None,), (["Only"],)], "c array<string>")
    assert [r.o for r in df.select(X.coarse_category(F.col("c")).alias("o")).collect()] == ["Women Boots", "clothing item", "clothing item", "Only"]


def test_overrides_and_refusals(spark):
    said = ["Actually, ignore my earlier preference. What I need is: red.", "I don't have a preference for size; please use your judgment.", "red"]
    assert _each(spark, X.is_override, said) == [True, False, False]
    assert _each(spark, X.is_no_preference, said) == [False, True, False]
    assert _each(spark, X.constraint_tokens, said)[1] == []


def test_stress_levels(spark):
    text = "I'm looking for Garden Hoses. A key requirement is: Coiled."
    assert _each(spark, X.strip_scaffold, [text]) == ["I'm looking for Garden Hoses. Coiled."]
    assert _each(spark, X.STRESS_LEVELS["L2_no_category"], [text]) == ["I'm looking for something. Coiled."]
    assert _each(spark, X.substitute_synonyms, ["Red boots and a Belt"]) == ["Red high footwear and a strap"]


def test_presence(spark):
    df = spark.createDataFrame([(None, None), ("  ", []), ("x", ["a"])], "s string, a array<string>")
    got = df.select(X.present(F.col("s"), "string").alias("s"), X.present(F.col("a"), "array<string>").alias("a")).collect()
    assert [tuple(r) for r in got] == [(False, False), (False, False), (True, True)]
