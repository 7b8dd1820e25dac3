"""Text functions as column expressions; every one stays inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and frames that results depend on, and below the endings of plurals and the order of constraints.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from",
    "i", "in", "is", "it", "me", "my", "of", "on", "or", "please", "some",
    "that", "the", "this", "to", "want", "with", "would", "you", "looking",
)
NO_PREFERENCE = (
    "don't have a preference",
    "don't have an additional preference",
    "do not have a preference",
    "no preference",
)
SIMPLE_PLURALS = (
    "hoodies", "neckties", "booties", "beanies", "footies", "skullies",
    "gloves", "sleeves", "adhesives",
    "blouses", "cases", "suitcases", "briefcases", "purses", "chemises",
)
DEPARTMENTS = {
    "women": ("womens", "women", "ladies", "lady", "female", "adult female"),
    "men": ("mens", "men", "male", "adult male", "gentlemen"),
    "girls": ("girls", "girl", "baby girls", "teen girls", "toddler girls", "little girls", "big girls", "juniors"),
    "boys": ("boys", "boy", "baby boys", "teen boys", "toddler boys", "little boys", "big boys"),
    "unisex-adult": ("unisex adult", "unisex adults", "unisex", "adult unisex", "adult"),
    "unisex-child": (
        "unisex child", "unisex children", "unisex kids", "unisex baby",
        "kids", "kid", "children", "child", "baby", "toddler", "infant",
    ),
}
MATERIAL_ALIASES = {
    "pu leather": "faux leather", "pleather": "faux leather", "pu": "faux leather",
    "pvc": "polyvinyl chloride", "eva": "ethylene vinyl acetate",
}
MATERIALS = ("cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "fabric")
COLORS = ("black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple", "yellow", "orange")
ROOT_CATEGORIES = ("clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry")
SCAFFOLD = (
    "A key requirement is:",
    "For that, what matters is:",
    ", but I'm still exploring",
    "Actually, ignore my earlier preference.",
    "What I need is:",
    "please use your judgment.",
    "Those options are not quite right yet. Ask me about one specific attribute.",
)
SYNONYMS = {
    "shoes": "footwear", "shoe": "footwear", "shirt": "top", "shirts": "tops",
    "jacket": "coat", "jackets": "coats", "bag": "purse", "bags": "purses",
    "watches": "timepieces", "watch": "timepiece", "sunglasses": "eyewear",
    "necklaces": "chains", "pendants": "charms", "bracelets": "wristbands",
    "sandals": "open footwear", "boots": "high footwear", "socks": "hosiery",
    "wallets": "billfolds", "earrings": "studs", "rings": "bands",
    "sneakers": "trainers", "pants": "trousers", "dress": "gown",
    "hat": "cap", "scarf": "wrap", "gloves": "mittens", "belt": "strap",
}
#: The kinds of constraint in the order they are tried, with the words that tell them.
CONSTRAINT_WORDS = (
    ("material", MATERIALS),
    ("color", ("color", "black", "white", "blue", "red", "pink", "green")),
    ("size", ("size", "sizing", "width", "wide", "narrow")),
    ("style", ("department", "style", "fit", "sleeve", "neck")),
    ("use_case", ("hiking", "running", "gym", "winter", "outdoor", "work")),
)


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _accents() -> tuple[str, str]:
    """Lower-case Latin, Greek and Cyrillic letters with marks, and what they are without; by the rule of canonical decomposition."""
    found = []
    for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if c == c.lower() and plain != c and len(plain) == 1:
            found.append((c, plain))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def fold(text: Column) -> Column:
    """Lower case without accents; combining marks go."""
    accented, plain = _accents()
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), low).otherwise(F.regexp_replace(F.translate(low, accented, plain), r"\p{Mn}+", ""))  # ASCII has none


def index_tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case and without accents, repeats kept: what an index holds."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def raw_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Raw tokens longer than one character that aren't stop words."""
    return F.filter(raw_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def field_tokens(text: Column) -> Column:
    return F.array_distinct(raw_tokens(F.coalesce(text, F.lit(""))))


def is_no_preference(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(p)) for p in NO_PREFERENCE))


def is_override(text: Column) -> Column:
    low = F.lower(text)
    return F.startswith(low, F.lit("actually")) & F.contains(low, F.lit("ignore my earlier preference"))


def constraint_tokens(text: Column) -> Column:
    return F.when(is_no_preference(text), F.expr("cast(array() as array<string>)")).otherwise(query_tokens(text))


def bigrams(text: Column) -> Column:
    """Adjacent pairs of raw tokens."""
    return phrases(text, 2)


def phrases(text: Column, longest: int) -> Column:
    """Runs of 2..longest raw tokens, short to long, repeats kept."""
    none = F.expr("cast(array() as array<string>)")

    def runs(words: Column) -> Column:
        def of(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
            return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(none)

        return F.concat(none, *(of(n) for n in range(2, longest + 1)))

    return F.transform(F.array(raw_tokens(text)), runs)[0]  # the tokens are worked out once


def singular(word: Column) -> Column:
    n = F.length(word)
    ends = lambda *s: reduce(lambda a, b: a | b, (F.endswith(word, F.lit(x)) for x in s))
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when(n <= 3, word)
        .when(word.isin(*SIMPLE_PLURALS), cut(1))
        .when(ends("ves"), F.concat(cut(3), F.lit("f")))
        .when(ends("ies"), F.concat(cut(3), F.lit("y")))
        .when(ends("ses", "xes", "zes", "ches", "shes"), cut(2))
        .when(ends("s") & ~ends("ss"), cut(1))
        .otherwise(word)
    )


def _no_apostrophes(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['’]", "")


def normalize_term(text: Column) -> Column:
    """Lower case, no apostrophes, other signs as spaces, every token singular."""
    words = F.split(F.trim(F.regexp_replace(_no_apostrophes(text), "[^a-z0-9&]+", " ")), " ")
    return F.array_join(F.transform(F.filter(words, lambda w: w != ""), singular), " ")


def normalize_department(text: Column) -> Column:
    """One of six departments, or null."""
    key = F.trim(F.regexp_replace(F.regexp_replace(_no_apostrophes(text), r"\([^)]*\)", " "), "[^a-z0-9]+", " "))
    return F.try_element_at(_map({a: d for d, names in DEPARTMENTS.items() for a in names}), key)


def with_stems(terms: Column) -> Column:
    """The terms and, where it differs, the singular of each, each once: what a query is widened to; the state keeps the plain terms."""
    return F.array_distinct(F.concat(terms, F.filter(F.transform(terms, normalize_term), lambda t: t != "")))


def split_compound(text: Column) -> Column:
    """The separately usable terms of a compound name."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?i)\s*[&,/]\s*|\s+and\s+")
    return F.filter(F.transform(parts, normalize_term), lambda t: t != "")


def is_usable_term(term: Column) -> Column:
    return F.exists(F.split(term, " "), lambda w: F.rlike(w, F.lit("^[a-z]{2,}$")))


def apply_aliases(haystack: Column, known: Column) -> Column:
    """Replace material abbreviations whose full name is among the ``known`` terms, the longest first."""
    for alias in sorted(MATERIAL_ALIASES, key=len, reverse=True):
        full = MATERIAL_ALIASES[alias]
        haystack = F.when(F.array_contains(known, full), F.replace(haystack, F.lit(f" {alias} "), F.lit(f" {full} "))).otherwise(haystack)
    return haystack


def classify_constraint(text: Column) -> Column:
    low = F.lower(text)
    kind = F.when(F.contains(low, F.lit("budget")) | F.rlike(low, F.lit(r"(?:\$|<=|under)\s*\d")), F.lit("budget"))
    for name, words in CONSTRAINT_WORDS:
        kind = kind.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), F.lit(name))
    return kind.otherwise(F.lit("feature"))


def clean_constraint(text: Column, limit: int = 180) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "), F.lit(" -;,.\t\n"))
    return F.regexp_replace(F.substring(flat, 1, limit), r"\s+$", "")


def coarse_category(categories: Column) -> Column:
    parts = F.flatten(F.transform(F.coalesce(categories, F.expr("cast(array() as array<string>)")), lambda c: F.transform(F.split(c, ","), lambda p: F.trim(p))))
    kept = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(*ROOT_CATEGORIES))
    return F.when(F.size(kept) == 0, F.lit("clothing item")).otherwise(
        F.array_join(F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), 2), " ")
    )


def first_word_of(text: Column, words: tuple[str, ...]) -> Column:
    """The first of ``words`` in the text, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(text, rf"(?i)\b({'|'.join(words)})\b", 1))


def strip_scaffold(text: Column) -> Column:
    for frame in SCAFFOLD:
        text = F.replace(text, F.lit(frame), F.lit(" "))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def drop_category(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^(.*?)(I'm looking for )[^.,]+", "$1$2something")


def substitute_synonyms(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(_map(SYNONYMS), F.lower(w)), w)), "")


STRESS_LEVELS = {
    "L0_clean": lambda text: text,
    "L1_no_scaffold": strip_scaffold,
    "L2_no_category": lambda text: drop_category(strip_scaffold(text)),
    "L3_synonyms_only": substitute_synonyms,
}


def present(value: Column, kind: str) -> Column:
    """Whether a value counts as present: not null, not blank, not empty."""
    if kind.startswith(("array", "map")):
        return value.isNotNull() & (F.size(value) > 0)
    if kind == "string":
        return F.coalesce(F.rlike(value, F.lit(r"\S")), F.lit(False))
    return value.isNotNull()
