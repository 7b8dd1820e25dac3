"""Line deduplication by an exact set-similarity join (native).

A line is the set of its lower-cased words. Two lines match if the Jaccard
similarity of their sets is at least the threshold (0.8, exactly 4/5); a line
goes if a line that comes before it in the input (smaller doc_id, then smaller
line number) matches it, whether or not that one goes too.

Words are ordered by rarity: how often the word's bucket of a fixed-size count
table, filled from all documents, occurs in the corpus, then the word's hash.
Sets that are similar enough share a word among the first n - ceil(0.8 n) + 1 of
either; they meet in a join on those words, under the filters on length and on
the position of the shared word and under a bound on how much they differ, from
128 parities of their words, and are verified on all their words. Lines with
the same set are one row of that join, so common lines cost no more than rare
ones; sets of up to three words match only themselves and stay out of it.

Null text is one empty line; lines without words stay and match nothing; very
long lines are compared whole; rows that repeat an id come in the order of their
texts' hash, and rows that repeat id and text count as the same place, so neither
goes because of the other; null ids come first; columns other than doc_id and
text are never read here, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, number_rows, remove, settled, whole_text

#: Buckets of the table of word counts, whatever the size of the vocabulary.
BUCKETS = 1 << 17
#: Words at either end of the prefix by which sets first meet few others, where more than so many sets share one.
RAREST, FEW = 3, 8
#: Copies above which sets count as copied alike.
MOST_COPIES = 1 << 19
#: 64-bit cells of the filter that tells which documents' texts verification can do without.
FILTER_CELLS = 1 << 18
#: Bits that a line's place may take, so that it can be told by one number.
PLACE_BITS = 62


def _plain(text: Column) -> Column:
    """Lower case, with a space for each tab and carriage return."""
    return F.replace(F.replace(F.lower(text), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))


def _words(plain: Column) -> Column:
    """The words; empty strings stand where spaces meet."""
    return F.split(plain, " ")


def _hashes(line: Column) -> Column:
    return F.array_distinct(F.array_remove(F.transform(_words(line), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def rarity_table(docs: DataFrame) -> list[int]:
    """One number a bucket: the logarithm of how often the bucket's words occur in all documents.

    At most BUCKETS counts reach the driver.
    """
    words = docs.select(F.explode(_words(F.replace(_plain(whole_text()), F.lit("\n"), F.lit(" ")))).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).count().collect()
    table = [1] * BUCKETS
    for b, n in counts:
        table[b] = 1 + min(125, int(2.5 * math.log2(n + 1)))
    return table


def lines_of(docs: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(doc_id, text_hash, line_no, set_a, set_b, n, every, odd, prefix): each line with its set's key, parities and rarest words."""
    table = F.split(F.lit(",".join(map(str, rarity_table(docs)))), ",").cast("array<bigint>")  # folded to one literal
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"),
        F.posexplode(F.split(_plain(whole_text()), "\n")).alias("line_no", "text"),
    )

    def key(h: Column) -> Column:
        rare = F.get(table, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.shiftleft(rare, 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))

    def parity(of) -> Column:
        """For each of 64 cells, whether an odd number of the words for which ``of`` is 1 falls into it."""
        at = lambda k: k.bitwiseAND(F.lit(63).cast("long")).cast("int")
        return F.aggregate("keys", F.lit(0).cast("long"), lambda m, k: m.bitwiseXOR(F.call_function("shiftleft", of(k), at(k))))

    every = parity(lambda k: F.lit(1).cast("long"))
    odd = parity(lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(1).cast("long")))
    keyed = rows.select("doc_id", "text_hash", "line_no", F.sort_array(F.transform(_hashes(F.col("text")), key)).alias("keys"))
    keyed = keyed.withColumn("n", F.size("keys"))
    needed = F.ceil(F.col("n") * F.lit(numerator) / F.lit(denominator)).cast("int")
    joins = F.col("n") * (denominator - numerator) >= numerator
    return keyed.select(
        "doc_id", "text_hash", "line_no", F.xxhash64("keys").alias("set_a"), F.xxhash64(F.lit(1), "keys").alias("set_b"), "n",
        F.when(joins, every).alias("every"), F.when(joins, odd).alias("odd"),
        F.when(joins, F.slice("keys", 1, F.col("n") - needed + 1)).alias("prefix"),
    )


def _in_order(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``lines`` with ``place``: one number that grows with the document and the line; rows that repeat id and text share it.

    Where ids are unique and close enough together the id itself tells the
    document's place, otherwise its rank among all documents does.
    """
    low, high, n, known = docs.select(F.col("doc_id").cast("long").alias("i")).agg(F.min("i"), F.max("i"), F.count("*"), F.countDistinct("i")).first()
    bits = (lines.agg(F.max("line_no")).first()[0] or 0).bit_length()
    if n == known and (not n or (high - low).bit_length() + bits <= PLACE_BITS):
        return lines.withColumn("place", F.shiftleft(F.col("doc_id") - F.lit(low or 0), bits).bitwiseOR(F.col("line_no").cast("long")))
    different = lines.where("line_no = 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    ranked = number_rows(different, ["_id", "_hash"], "documents-in-order", "_rank")
    same = lines["doc_id"].eqNullSafe(ranked["_id"]) & (lines["text_hash"] == ranked["_hash"])
    placed = lines.join(ranked, same).withColumn("place", F.shiftleft("_rank", bits).bitwiseOR(F.col("line_no").cast("long")))
    return materialise(placed.drop("_id", "_hash", "_rank"), "placed-lines")


def _size(side: str) -> Column:
    return F.shiftright(F.col(f"{side}.meta"), 32)


def _may_match(a: str, b: str, numerator: int, denominator: int, n=lambda x: F.col(f"{x}.n")) -> Column:
    """What two similar sets always fulfil: near enough in size, and with few enough parities apart.

    A word that only one of the two has changes one parity, so at least as many words differ as parities.
    """
    odd = F.col(f"{a}.odd").bitwiseXOR(F.col(f"{b}.odd"))
    even = F.col(f"{a}.every").bitwiseXOR(F.col(f"{b}.every")).bitwiseXOR(odd)
    return (F.least(n(a), n(b)) * denominator >= F.greatest(n(a), n(b)) * numerator) & (
        (F.bit_count(odd) + F.bit_count(even)) * (numerator + denominator) <= (n(a) + n(b)) * (denominator - numerator)
    )


def _among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose ``column`` may be among the values of ``wanted``'s only column; null goes with -1.

    A filter of at most FILTER_CELLS rows, whatever the size of the tables, leaves
    out most rows that nobody asks for before they are shuffled.
    """
    mix = lambda c: F.xxhash64(F.coalesce(c, F.lit(-1).cast("long")), F.lit(5))
    cell = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(FILTER_CELLS - 1))
    bit = lambda h: h.bitwiseAND(F.lit(63).cast("long")).cast("int")
    named = wanted.select(mix(F.col(wanted.columns[0])).alias("_h"))
    cells = named.groupBy(cell(F.col("_h")).alias("_cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("_h")))).alias("_bits"))
    keyed = rows.withColumn("_h", mix(F.col(column))).withColumn("_cell", cell(F.col("_h")))
    return keyed.join(F.broadcast(cells), "_cell").where(F.getbit("_bits", bit(F.col("_h"))) == 1).select(*rows.columns)


def _verified(docs: DataFrame, lines: DataFrame, pairs: DataFrame, numerator: int, denominator: int, label: str) -> DataFrame:
    """The later sets of those (later, earlier) pairs that are similar on all their words."""
    wanted = pairs.select(F.col("later").alias("sid")).union(pairs.select("earlier")).distinct()
    places = lines.select(F.col("place").alias("sid"), "doc_id", "text_hash", "line_no").join(wanted, "sid")
    asked = materialise(places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("sid", "line_no")).alias("asked")), f"{label}-places")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    texts = _among(texts, "doc_id", asked.select("doc_id")).withColumn("text_hash", F.xxhash64("text"))
    met = texts.join(asked, texts["doc_id"].eqNullSafe(asked["doc_id"]) & (texts["text_hash"] == asked["text_hash"])).select(
        F.split(_plain(F.col("text")), "\n").alias("lines"), "asked"
    )
    words = met.select(F.explode(F.transform("asked", lambda q: F.struct(q["sid"].alias("sid"), _hashes(F.get(F.col("lines"), q["line_no"])).alias("words")))).alias("q"))
    words = materialise(words.select("q.sid", "q.words"), f"{label}-words").dropDuplicates(["sid"])
    return (
        pairs.join(words.select(F.col("sid").alias("later"), F.col("words").alias("xs")), "later")
        .join(words.select(F.col("sid").alias("earlier"), F.col("words").alias("ys")), "earlier")
        .where(F.size(F.array_intersect("xs", "ys")) * (numerator + denominator) >= (F.size("xs") + F.size("ys")) * numerator)
        .select(F.col("later").alias("sid"))
        .distinct()
    )


def removed_lines(docs: DataFrame, numerator: int = 4, denominator: int = 5) -> DataFrame:
    """(doc_id, text_hash, line_no) of the lines that go.

    A set needs one earlier match to go, not all of them. So where many sets share
    a word they first meet only the earliest and the most copied one of those,
    which settles most of a group of similar lines with a few pairs each; then
    those still open meet every earlier set that shares a word of the prefix.
    """
    return settled(docs.sparkSession, "removed-lines", lambda: _removed(_in_order(docs, materialise(lines_of(docs, numerator, denominator), "lines")), docs, numerator, denominator))


def _removed(whole: DataFrame, docs: DataFrame, numerator: int, denominator: int) -> DataFrame:
    lines = whole.select("doc_id", "text_hash", "line_no", "place", "set_a", "set_b", "n").where("n > 0")
    # a set goes by the place of its first line
    sets = lines.groupBy("set_a", "set_b").agg(F.min("place").alias("sid"), F.count("*").alias("copies"))
    sets = materialise(sets, "line-sets")
    heads = whole.where(F.col("prefix").isNotNull()).select(F.col("place").alias("sid"), "set_a", "set_b", "n", "every", "odd", "prefix")
    heads = heads.join(sets.select("sid", "set_a", "set_b", "copies"), ["sid", "set_a", "set_b"]).drop("set_a", "set_b")
    heads = materialise(heads, "line-heads")

    # words that an edit put in are the rarest; those at the prefix's end are more likely shared
    few = F.array_distinct(F.concat(F.slice("prefix", 1, RAREST), F.slice(F.reverse("prefix"), 1, RAREST)))
    # a line that is often repeated word for word is what the similar ones were made from; equals go by a hash, alike for all words
    often = F.shiftleft(F.least("copies", F.lit(MOST_COPIES)).cast("long"), 43).bitwiseOR(F.xxhash64("sid").bitwiseAND(F.lit((1 << 43) - 1)))
    ends = heads.select("sid", often.alias("often"), F.explode(few).alias("key")).groupBy("key").agg(
        F.min("sid").alias("earliest"), F.max_by("sid", "often").alias("likeliest"), F.count("*").alias("sharing")
    )
    pivots = materialise(ends.where(F.col("sharing") > FEW).select("key", F.explode(F.array_distinct(F.array("earliest", "likeliest"))).alias("sid")), "pivots")
    told = _among(heads.select("sid", "n", "every", "odd"), "sid", pivots.select("sid"))
    rarest = _among(heads.select("sid", "n", "every", "odd", F.explode(few).alias("key")), "key", pivots.select("key"))
    a, b = pivots.join(told, "sid").alias("a"), rarest.alias("b")
    first = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.sid") < F.col("b.sid")) & _may_match("a", "b", numerator, denominator))
    first = materialise(first.select(F.col("b.sid").alias("later"), F.col("a.sid").alias("earlier")).distinct(), "line-pivots")
    found = materialise(_verified(docs, lines, first, numerator, denominator, "pivot"), "line-settled")
    settled_heads = materialise(heads.join(found.withColumn("found", F.lit(1)).hint("merge"), "sid", "left").drop("copies"), "line-heads-settled")
    remove(heads)

    # a set's number and whether it is settled share a long, as do its size and the word's place. Sets that share a run of
    # words meet at its first one: two rows with the same word before them have met, as what is asked of them holds there too.
    # Both sides need all columns alike, so that Spark shuffles the rows once.
    known = F.shiftleft("sid", 1).bitwiseOR(F.when(F.col("found").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long"))
    previous = F.when(F.col("at") > 0, F.get("prefix", F.col("at") - 1)).otherwise(-1 - F.col("sid"))
    rare = settled_heads.select("sid", known.alias("known"), "n", "every", "odd", "prefix", F.posexplode("prefix").alias("at", "key"))
    rare = rare.select("key", "known", previous.alias("previous"), "every", "odd", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("meta"))
    rare = rare.where(" AND ".join(f"{c} IS NOT NULL" for c in rare.columns))
    sid = lambda x: F.shiftright(F.col(f"{x}.known"), 1)
    left = lambda x: _size(x) - F.col(f"{x}.meta").bitwiseAND(F.lit((1 << 32) - 1))
    room = F.least(left("a"), left("b"))
    wanted = F.when(F.col("b.known").bitwiseAND(F.lit(1).cast("long")) == 0, sid("b")).otherwise(-1)
    rest = rare.alias("a").join(
        rare.alias("b"),
        (F.col("a.key") == F.col("b.key")) & (sid("a") < wanted) & (F.col("a.previous") != F.col("b.previous"))
        & (room * (numerator + denominator) >= (_size("a") + _size("b")) * numerator) & _may_match("a", "b", numerator, denominator, _size),
    ).select(sid("b").alias("later"), sid("a").alias("earlier")).distinct()
    rest = materialise(rest, "line-pairs")
    matched = found.union(_verified(docs, lines, rest, numerator, denominator, "pair")).distinct().withColumn("matched", F.lit(True))

    limits = sets.join(matched, "sid", "left").select("set_a", "set_b", "sid", F.coalesce("matched", F.lit(False)).alias("matched"))
    return lines.join(limits, ["set_a", "set_b"]).where(F.col("matched") | (F.col("place") > F.col("sid"))).select("doc_id", "text_hash", "line_no")


def report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, text_hash, n_lines, n_removed, removed (line numbers from 0, in order)."""
    gone = removed_lines(docs, **how).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    counts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"),
        F.size(F.split(whole_text(), "\n")).alias("n_lines"),
    )
    same = counts["doc_id"].eqNullSafe(gone["doc_id"]) & (counts["text_hash"] == gone["text_hash"])
    return counts.join(gone, same, "left").select(
        counts["doc_id"], counts["text_hash"], "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), "removed"
    )


def without_repeats(docs: DataFrame, drop_emptied: bool = False, **how) -> DataFrame:
    """The documents without their removed lines; n_chars follows, other columns stay.

    ``drop_emptied``: leave out documents of which the removal leaves no word.
    """
    gone = removed_lines(docs, **how).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.array_join(F.filter(F.split(whole_text(), "\n"), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    joined = docs.join(gone.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(whole_text()) == F.col("_hash")), "left")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)
    out = joined.withColumn("text", text)
    if drop_emptied:
        out = out.where(F.col("_gone").isNull() | F.rlike("text", F.lit(r"\S")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


#: The removal in DuckDB's SQL over the view ``{docs}`` (doc_id, text).
SQL_REMOVED = r"""
lines AS (
  SELECT doc_id, l.i - 1 AS line_no,
         list_distinct(list_filter(string_split(translate(lower(l.t), chr(9) || chr(13), '  '), ' '), lambda w: w <> '')) AS words
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ts FROM {docs}) d,
       unnest(list_zip(range(1, len(ts) + 1), ts)) AS u(l0), LATERAL (SELECT l0[1] AS i, l0[2] AS t) l
),
sets AS (
  SELECT list_sort(words) AS words, row_number() OVER (ORDER BY min(doc_id * 4294967296::HUGEINT + line_no)) AS sid,
         min(doc_id * 4294967296::HUGEINT + line_no) AS first, len(list_sort(words)) AS n
  FROM lines WHERE len(words) > 0 GROUP BY list_sort(words)
),
tokens AS (SELECT sid, n, unnest(words) AS w FROM sets WHERE n >= 4),
df AS (SELECT w, count(*) AS f FROM tokens GROUP BY w),
ranked AS (
  SELECT t.sid, t.n, t.w, row_number() OVER (PARTITION BY t.sid ORDER BY df.f, t.w) AS p FROM tokens t JOIN df USING (w)
),
heads AS (SELECT * FROM ranked WHERE p <= n - ceil(n * 4 / 5.0) + 1),
pairs AS (
  SELECT DISTINCT a.sid AS x, b.sid AS y FROM heads a JOIN heads b ON a.w = b.w AND a.sid < b.sid
  WHERE least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4
),
linked AS (
  SELECT x, y FROM pairs JOIN sets s ON s.sid = x JOIN sets t ON t.sid = y
  WHERE len(list_intersect(s.words, t.words)) * 9 >= (s.n + t.n) * 4
),
limits AS (
  SELECT s.words, least(s.first, coalesce(min(o.first), s.first)) AS lim
  FROM sets s LEFT JOIN (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked) l ON l.x = s.sid
  LEFT JOIN sets o ON o.sid = l.y GROUP BY s.words, s.first
),
removed AS (
  SELECT doc_id, line_no FROM lines JOIN limits ON list_sort(lines.words) = limits.words
  WHERE doc_id * 4294967296::HUGEINT + line_no > lim
)
"""
SQL_REPORT = (
    "WITH "
    + SQL_REMOVED.format(docs="documents")
    + """
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::INTEGER AS n_lines,
       count(r.line_no)::INTEGER AS n_removed, coalesce(string_agg(r.line_no::VARCHAR, ',' ORDER BY r.line_no), '') AS removed
FROM documents d LEFT JOIN removed r USING (doc_id) GROUP BY d.doc_id, d.text
"""
)
