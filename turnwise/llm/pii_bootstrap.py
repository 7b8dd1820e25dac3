"""Personal data: base patterns and bootstrapped contextual extraction (native).

Base entities (e-mail, IP, card, phone) are found in whole texts by pattern and
check. They and a fifth kind, secrets (lower-case hexadecimal digests of 32 or
more digits), are the seeds: every run of identifier-like words (words with a
digit or @) is an occurrence, with the words around it as lexical patterns: the
word on the left or right, both, and windows of two words on a side, numbers in
them generalised to one digit. Spark scores the graph of patterns
and instances in rounds: a pattern's confidence for a kind is the smoothed mean
of its instances' scores, an instance's score the confidence of its best
pattern, seeds staying at 1. Support is counted anew in each round, so what is
found in one context makes others known; scores only rise, and the rounds end when
one adds no pattern. A pattern has to be confident on both halves of its
instances, dealt by hash, so what it says of one half holds for instances it was not
learned from. Occurrences that are no seeds, and stand
in a pattern that is confident and well supported at the end, are new spans of
that kind. Secrets are spans of the method alone: no base count or digest holds them.

Null text is the empty text; texts without digits and @ are never searched
twice; very long texts and words are searched whole; patterns shared by very many
occurrences are aggregated, never gathered; of kinds with equal confidence the
last by name counts, of seeds that one run overlaps the first as listed; repeated rows get the same spans; null ids are ids like
others; columns other than doc_id and text are never read, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, settled, whole_text

#: The base patterns. Groups that repeat at the end are possessive, which matches the same without recursion.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Seeds of a kind that only the method adds: digests that hold letters and digits. Other tokens are found by what stands around them.
SECRET = r"(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}+(?![A-Za-z0-9])"
SEEDED = (*KINDS, "secret")
#: A run of words that hold a digit or @.
RUN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+"
#: What a found span does not begin or end with.
EDGE = "\"'`([{<.,;:!?)]}>=#&%*$|~"
#: A pattern needs this confidence, from this many different instances that are seeds or found by then.
CONFIDENT, SUPPORT = 0.8, 5
#: Instances that count as no seed are added to each pattern, so that rare patterns stay doubtful.
SMOOTHING = 1.0

#: Halves that a pattern's instances are dealt to.
HALVES = 2

_NONE = "cast(array() as array<struct<start:int,end:int,found:string>>)"


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,found>>: the leftmost non-overlapping matches, in code points."""
    both = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, found: F.struct(F.length(gap).alias("gap"), found.alias("found")),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr(_NONE).alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + x["gap"]
        b = a + F.length(x["found"])
        one = F.struct(a.alias("start"), b.alias("end"), x["found"].alias("found"))
        return F.when(x["found"].isNull(), s).otherwise(F.struct(b.alias("at"), F.concat(s["out"], F.array(one)).alias("out")))

    return F.aggregate(both, start, step, lambda s: s["out"])


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(found: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.ltrim(part, F.lit("0"))
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(found, r"\."), small)


def base_spans(text: Column) -> dict[str, Column]:
    """The valid spans of each kind, in order."""
    none = F.expr(_NONE)
    has_digit = F.rlike(text, F.lit("[0-9]"))
    card = lambda s: F.length(_digits(s["found"])).between(16, 19) & _luhn(_digits(s["found"]))
    phone = lambda s: F.length(_digits(s["found"])).between(8, 15)
    return {
        "email": F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(none),
        "ip": F.when(has_digit & F.contains(text, F.lit(".")), F.filter(located(text, IP), lambda s: _octets(s["found"]))).otherwise(none),
        "card": F.when(has_digit, F.filter(located(text, CARD), card)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")) & has_digit, F.filter(located(text, PHONE), phone)).otherwise(none),
    }


def secret_spans(text: Column) -> Column:
    """The digests in order."""
    return F.when(F.rlike(text, F.lit("[0-9a-f]{32}")), located(text, SECRET)).otherwise(F.expr(_NONE))


def _runs(text: Column) -> Column:
    """Each run of identifier-like words with its place, and one and two words on each side, lower-cased, numbers as 0."""
    gaps, found = F.split(text, RUN, -1), located(text, RUN)

    def one(s: Column, i: Column) -> Column:
        before, after = F.reverse(F.get(gaps, i)), F.get(gaps, i + 1)
        first = lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1)
        two = lambda x: F.regexp_extract(x, r"^\s*(\S+\s+\S+)", 1)
        plain = lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, "[0-9]+", "0"), r"\s+", " "))
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"),
            plain(F.reverse(first(before))).alias("left"), plain(first(after)).alias("right"),
            plain(F.reverse(two(before))).alias("left2"), plain(two(after)).alias("right2"),
        )

    empty = F.expr("cast(array() as array<struct<start:int,end:int,found:string,left:string,right:string,left2:string,right2:string>>)")
    return F.when(F.rlike(text, F.lit("[0-9@]")), F.transform(found, one)).otherwise(empty)


def search(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, email, ip, card, phone, secret, runs): what the seeds' patterns find, and all occurrences."""
    text = whole_text()
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        *(s.alias(k) for k, s in base_spans(text).items()), secret_spans(text).alias("secret"), _runs(text).alias("runs"),
    )


def patterns(searched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, start, end, found, patterns, seed) of all occurrences, and (pattern, kind, confidence) of the patterns that are confident at the end."""

    def seed(run: Column) -> Column:
        hit = lambda k: F.exists(F.col(k), lambda s: (s["start"] < run["end"]) & (s["end"] > run["start"]))
        chain = F.lit(None).cast("string")
        for k in reversed(SEEDED):
            chain = F.when(hit(k), F.lit(k)).otherwise(chain)
        return chain

    runs = searched.select("row", F.explode(F.transform("runs", lambda r: F.struct(r.alias("run"), seed(r).alias("seed")))).alias("x"))
    runs = runs.select("row", "x.run.*", "x.seed")
    around = F.array(
        *(F.concat(F.lit(f"{c} "), c) for c in ("left", "right", "left2", "right2")), F.concat(F.lit("both "), "left", F.lit(" "), "right")
    )
    none = ("left ", "right ", "left2 ", "right2 ", "both  ")
    runs = materialise(runs.select("row", "start", "end", "found", "seed", F.filter(around, lambda p: ~p.isin(*none)).alias("patterns")), "runs")
    edges = runs.select(F.col("found").alias("instance"), F.explode("patterns").alias("pattern"), "seed").groupBy("pattern", "instance").agg(
        F.max("seed").alias("seed")
    )
    edges = materialise(edges.withColumn("half", F.pmod(F.xxhash64("instance"), F.lit(HALVES)).cast("int")), "graph")
    sizes = edges.groupBy("pattern", "half").agg(F.count("*").alias("size"))
    seeds = edges.where(F.col("seed").isNotNull()).select("instance", F.col("seed").alias("kind")).distinct()
    score, known = seeds.withColumn("score", F.lit(1.0)), 0
    while True:
        held = edges.select("pattern", "half", "instance").join(score, "instance").groupBy("pattern", "half", "kind").agg(
            F.sum("score").alias("mass"), F.count_if(F.col("score") >= CONFIDENT).alias("support")
        )
        whole = held.join(sizes, ["pattern", "half"]).groupBy("pattern", "kind").agg(
            (F.sum("mass") / (F.sum("size") + F.lit(SMOOTHING))).alias("confidence"), F.sum("support").alias("support"),
            F.count("*").alias("halves"), F.min(F.col("mass") / F.col("size")).alias("least"),
        )
        confident = whole.where(
            (F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENT) & (F.col("halves") == HALVES) & (F.col("least") >= CONFIDENT)
        ).select("pattern", "kind", "confidence")
        confident = materialise(confident, "patterns")
        now = confident.count()
        if now == known:  # none goes, for scores only rise
            return runs, confident
        known = now
        found = edges.select("pattern", "instance").join(confident, "pattern").groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
        score = seeds.withColumn("score", F.lit(1.0)).unionByName(found).groupBy("instance", "kind").agg(F.max("score").alias("score"))


def discover(searched: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the new spans."""
    runs, confident = patterns(searched)
    best = (
        runs.where(F.col("seed").isNull())
        .select("row", "start", "found", F.explode("patterns").alias("pattern"))
        .join(confident, "pattern")
        .groupBy("row", "start", "found")
        .agg(F.max(F.struct("confidence", "kind")).alias("best"))
    )
    lead = F.length("found") - F.length(F.ltrim(F.col("found"), F.lit(EDGE)))
    core = F.trim(F.col("found"), F.lit(EDGE))
    return best.where(F.length(core) > 0).select(
        "row", F.col("best.kind").alias("kind"), (F.col("start") + lead).cast("int").alias("start"),
        (F.col("start") + lead + F.length(core)).cast("int").alias("end"),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, base, spans): arrays of struct<kind,start,end>, by kind and start; spans has the new ones too."""
    return settled(docs.sparkSession, "spans", lambda: _find(docs))


def _find(docs: DataFrame) -> DataFrame:
    searched = materialise(search(docs), "entities")
    new = discover(searched).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("new"))
    both = searched.join(new, "row", "left")
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    added = lambda k: F.filter(F.coalesce("new", none), lambda s: s["kind"] == k)
    return both.select(
        "row", "doc_id", "text_hash", F.concat(*(_of_kind(k, F.col(k)) for k in KINDS)).alias("base"),
        F.concat(*(F.array_sort(F.concat(_of_kind(k, F.col(k)), added(k))) for k in SEEDED)).alias("spans"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, the digest of their list and the list of all spans."""
    return find(docs).select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; n_chars follows, other columns stay."""
    spans = find(docs).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.first("spans").alias("_spans"))
    # texts are shuffled at every size: what is found in them has no bound
    joined = docs.join(spans.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(whole_text()) == F.col("_hash")), "left")
    in_order = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        inside = x["start"] < s["at"]  # overlaps one that is masked already
        gap = F.substring("text", s["at"] + 1, x["start"] - s["at"])
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(inside, s["out"]).otherwise(F.concat(s["out"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">"))).alias("out"),
        )

    text = F.aggregate(in_order, start, step, lambda s: F.concat(s["out"], F.substring("text", s["at"] + 1, F.length("text"))))
    out = joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
