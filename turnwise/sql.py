"""The registered queries in DuckDB's SQL, written for itself: they share the tables' views, not code, with the plans."""

from __future__ import annotations

import re

from .functions import text as X
from .operators import asking

_q = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda values: "[" + ", ".join(_q(v) for v in values) + "]"
_in = lambda values: "(" + ", ".join(_q(v) for v in values) + ")"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _terms(x: str) -> str:
    return f"list_filter({_tokens(x)}, lambda t: len(t) > 1 AND t NOT IN {_in(X.STOPWORDS)})"


def _singular(w: str) -> str:
    cut = lambda k: f"left({w}, len({w}) - {k})"
    return (
        f"CASE WHEN len({w}) <= 3 THEN {w} WHEN {w} IN {_in(X.SIMPLE_PLURALS)} THEN {cut(1)} WHEN suffix({w}, 'ves') THEN {cut(3)} || 'f' "
        f"WHEN suffix({w}, 'ies') THEN {cut(3)} || 'y' WHEN suffix({w}, 'ses') OR suffix({w}, 'xes') OR suffix({w}, 'zes') OR suffix({w}, 'ches') OR suffix({w}, 'shes') THEN {cut(2)} "
        f"WHEN suffix({w}, 's') AND NOT suffix({w}, 'ss') THEN {cut(1)} ELSE {w} END"
    )


def _norm(x: str) -> str:
    words = f"list_filter(string_split(regexp_replace(regexp_replace(lower({x}), '[''’]', '', 'g'), '[^a-z0-9&]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"array_to_string(list_transform({words}, lambda w: {_singular('w')}), ' ')"


def _no_preference(m: str) -> str:
    return "(" + " OR ".join(f"contains(lower({m}), {_q(p)})" for p in X.NO_PREFERENCE) + ")"


def _override(m: str) -> str:
    return f"(prefix(lower({m}), 'actually') AND contains(lower({m}), 'ignore my earlier preference'))"


def _dept_key(raw: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({raw}), '[''’]', '', 'g'), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _aliases(hay: str) -> str:
    """Material abbreviations by their names, the longest first, where the vocabulary has the name."""
    for a in sorted(X.MATERIAL_ALIASES, key=len, reverse=True):
        hay = f"CASE WHEN EXISTS (SELECT 1 FROM gaz WHERE slot = 'material' AND term = {_q(X.MATERIAL_ALIASES[a])}) THEN replace({hay}, ' {a} ', ' {X.MATERIAL_ALIASES[a]} ') ELSE {hay} END"
    return hay


_WHOLE = "f_title || ' ' || f_categories || ' ' || f_features || ' ' || f_details || ' ' || f_store || ' ' || f_description"


def _known() -> str:
    return ", ".join(f"({_q(w)}, {_q(a)}, {asking.PATTERN_ORDER.index(a)})" for a in asking.PATTERN_ORDER for w in asking.PATTERNS[a])


def _pairs(x: str) -> str:
    """Adjacent pairs of tokens."""
    return f"list_transform(range(1, len({_tokens(x)})), lambda i: {_tokens(x)}[i] || ' ' || {_tokens(x)}[i + 1])"


def _bm25(wanted: str, texts: str = "") -> str:
    """The ranked products of (query, term)."""
    return (
        "SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS rank FROM (SELECT query, ord, round(sum(part), 9) AS score FROM "
        f"{wanted} JOIN parts USING (term) GROUP BY query, ord)"
    )


# Views: each names those it needs.
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "sold": ((), "SELECT l_partkey, count(*)::DOUBLE AS n, ((20 * sum(l_quantity)::BIGINT + count(*)) // (2 * count(*)))::DOUBLE / 100 AS r FROM lineitem GROUP BY 1"),
    "catalog": (
        ("sold",),
        "SELECT p_partkey AS ord, p_partkey::VARCHAR AS parent_asin, p_name AS title, p_type, p_size, p_brand AS store, "
        "string_split(p_name, ' ')[1] AS word1, string_split(p_name, ' ')[-1] AS noun, "
        "['Polyvinyl Chloride', 'Ethylene Vinyl Acetate', 'Canvas', 'Denim & Mesh'][p_partkey % 4 + 1] AS material, ['Womens', 'Men''s', 'Baby Girls (0-24M)', 'garden', 'Unisex Adults', 'kids'][p_partkey % 6 + 1] AS dept, "
        "'made of ' || CASE WHEN p_partkey % 3 = 0 THEN ['pvc', 'eva', 'canvas', 'denim'][p_partkey % 4 + 1] ELSE lower(['Polyvinyl Chloride', 'Ethylene Vinyl Acetate', 'Canvas', 'Denim & Mesh'][p_partkey % 4 + 1]) END AS made, "
        "CASE WHEN p_partkey % 2 = 0 THEN p_type || ' ' || p_name END AS descr, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice END AS price, "
        "coalesce(n, 0) AS rating_number, coalesce(r, 0) AS average_rating FROM part LEFT JOIN sold ON l_partkey = p_partkey",
    ),
    "texts": (
        ("catalog",),
        "SELECT ord, parent_asin, rating_number, price, title AS f_title, 'Parts, Tools & Hardware ' || p_type || ' ' || noun AS f_categories, "
        "title || ' size ' || p_size || ' ' || made AS f_features, 'Brand ' || store || ' Size ' || p_size || ' Color ' || word1 || ' Material ' || material || ' Department ' || dept AS f_details, store AS f_store, coalesce(descr, '') AS f_description FROM catalog",
    ),
    "cards": (
        ("catalog",),
        "SELECT parent_asin, title AS target_category, p_type || ' ' || noun AS category, "
        f"list_slice(c, 1, 2) AS hard, list_slice(c, 3, 4) AS soft FROM (SELECT *, CASE WHEN word1 IN {_in(X.COLORS)} "
        "THEN [title, 'color: ' || word1, 'size ' || p_size, made] ELSE [title, 'size ' || p_size, made, 'Brand: ' || store] END AS c FROM catalog)",
    ),
    "sessions": (
        (),
        "SELECT o_orderkey AS sample_id, min_by(l_partkey, l_linenumber * 1000000000000 + l_partkey)::VARCHAR AS target, "
        "CASE WHEN o_orderkey % 20 < 8 THEN 'buying' WHEN o_orderkey % 20 < 16 THEN 'browsing' WHEN o_orderkey % 20 < 19 THEN 'intent_override' ELSE 'boundary' END AS scenario_type, "
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'hard' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'easy' END AS difficulty_bucket "
        "FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority",
    ),
    "openings": (
        ("sessions", "cards"),
        "SELECT s.*, hard, soft, category, CASE WHEN scenario_type = 'buying' THEN 'I''m looking for ' || category || '. A key requirement is: ' || hard[1] || '.' "
        "WHEN scenario_type = 'intent_override' THEN 'I''m looking for ' || category || '. ' || soft[-1] ELSE 'I''m looking for ' || category || ', but I''m still exploring.' END AS message "
        "FROM sessions s JOIN cards ON target = parent_asin",
    ),
    "messages": (
        ("openings",),
        "SELECT sample_id, scenario_type, t AS turn, CASE t WHEN 1 THEN message "
        "WHEN 2 THEN CASE scenario_type WHEN 'boundary' THEN 'I don''t have a preference for material; please use your judgment.' WHEN 'browsing' THEN 'For that, what matters is: ' || hard[1] || '; ' || hard[2] || '.' ELSE 'For that, what matters is: ' || hard[2] || '.' END "
        "WHEN 3 THEN CASE scenario_type WHEN 'intent_override' THEN 'Actually, ignore my earlier preference. What I need is: ' || hard[1] || '.' ELSE 'For that, what matters is: ' || soft[1] || '; ' || soft[2] || '.' END "
        "WHEN 4 THEN 'Those options are not quite right yet. Ask me about one specific attribute.' "
        "ELSE CASE scenario_type WHEN 'intent_override' THEN 'For that, what matters is: ' || soft[2] || '.' ELSE 'I don''t have an additional preference for size.' END END AS message "
        "FROM openings, range(1, 6) r(t)",
    ),
    "seeds": (
        ("catalog",),
        f"SELECT slot, w FROM (SELECT 'color' AS slot, {_norm('word1')} AS w, count(*) AS n FROM catalog GROUP BY 2 UNION ALL "
        f"SELECT 'material', w, count(*) FROM (SELECT DISTINCT ord, unnest(list_transform(regexp_split_to_array(material, '(?i)\\s*[&,/]\\s*|\\s+and\\s+'), lambda p: {_norm('p')})) AS w FROM catalog) GROUP BY 2)",
    ),
    "searched": (("catalog",), f"SELECT ord, ' ' || {_norm("title || ' ' || title || ' size ' || p_size || ' ' || made")} || ' ' AS hay FROM catalog"),
    "depts": (("catalog",), f"SELECT term, count(*) AS n FROM (SELECT (MAP {{{', '.join(f'{_q(a)}: {_q(d)}' for d, names in X.DEPARTMENTS.items() for a in names)}}})[{_dept_key('dept')}] AS term FROM catalog) WHERE term IS NOT NULL GROUP BY 1"),
    "gaz": (
        ("catalog", "seeds", "searched", "depts"),
        f"SELECT slot, term, support FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY CASE slot WHEN 'department' THEN 1 WHEN 'material' THEN 2 WHEN 'size' THEN 3 WHEN 'category' THEN 4 ELSE 5 END) AS place FROM ("
        f"SELECT 'department' AS slot, term, n AS support FROM depts UNION ALL SELECT 'category', {_norm('noun')} AS term, count(*) AS support FROM catalog GROUP BY 2 UNION ALL "
        f"SELECT slot, w, (SELECT count(*) FROM searched WHERE contains(hay, ' ' || w || ' ')) FROM seeds)) WHERE place = 1 AND support > 0",
    ),
    "postings": (
        ("texts",),
        "SELECT term, ord, sum(w) AS weight, any_value(doc_len) AS doc_len FROM (SELECT ord, w, unnest(toks) AS term, sum(len(toks)) OVER (PARTITION BY ord) AS doc_len FROM ("
        + " UNION ALL ".join(
            f"SELECT ord, {w} AS w, {_tokens('f_' + f)} AS toks FROM texts"
            for f, w in (("title", "6.0::DOUBLE"), ("categories", "4.0::DOUBLE"), ("features", "2.5::DOUBLE"), ("details", "2.5::DOUBLE"), ("store", "1.5::DOUBLE"), ("description", "1.0::DOUBLE"))
        )
        + ")) GROUP BY term, ord",
    ),
    "df": (("postings",), "SELECT term, count(*) AS df FROM postings GROUP BY term"),
    "corpus": (("postings", "texts"), "SELECT (SELECT count(*) FROM texts) AS n, (SELECT sum(doc_len) FROM (SELECT DISTINCT ord, doc_len FROM postings)) / (SELECT count(*) FROM texts)::DOUBLE AS avg_len"),
    "parts": (
        ("postings", "df", "corpus"),
        "SELECT term, ord, idf * weight * 2.2 / (weight + 1.2 * (0.25 + 0.75 * doc_len / avg_len)) AS part FROM postings JOIN (SELECT term, avg_len, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, corpus) USING (term)",
    ),
    "asked": (("openings",), f"SELECT *, message AS query, {_terms('message')} AS terms FROM openings"),
    "wanted": (("asked",), "SELECT DISTINCT query, unnest(terms) AS term FROM asked"),
    "ranked": (("wanted", "parts"), _bm25("wanted")),
    "pool": (("ranked",), "SELECT * FROM ranked WHERE rank <= 100"),
    "must": (  # terms of an opening that a slot which isn't durable claims
        ("wanted", "msg_slots"),
        f"SELECT DISTINCT query, term FROM (SELECT w.query, w.term, min(s.slot) AS slot FROM wanted w JOIN msg_slots s ON s.message = w.query AND list_contains(string_split(s.term, ' '), {_norm('w.term')}) GROUP BY 1, 2) WHERE slot NOT IN ('category', 'department')",
    ),
    "weights": (
        ("pool", "wanted", "texts"),
        "SELECT p.query, p.ord, p.rank, term, greatest("
        + ", ".join(f"CASE WHEN list_contains({_tokens('f_' + f)}, term) THEN {w} ELSE 0 END" for f, w in (("title", "4.0::DOUBLE"), ("categories", "6.0::DOUBLE"), ("features", "2.0::DOUBLE"), ("details", "2.0::DOUBLE"), ("store", "1.5::DOUBLE"), ("description", "1.0::DOUBLE")))
        + ") AS w FROM pool p JOIN wanted USING (query) JOIN texts USING (ord)",
    ),
    "matched": (("weights", "must"), "SELECT query, ord, rank, sum(w) AS m, coalesce(bool_and(w > 0) FILTER (must.term IS NOT NULL), false) AS complete FROM weights LEFT JOIN must USING (query, term) GROUP BY query, ord, rank"),
    "phrases": (
        ("asked",),
        f"SELECT DISTINCT query, i, toks[i] || ' ' || toks[i + 1] AS phrase FROM (SELECT DISTINCT query, {_tokens('query')} AS toks FROM asked), range(1, 60) r(i) WHERE i < len(toks)",
    ),
    "phrased": (("pool", "texts", "phrases"), "SELECT p.query, p.ord, count(*) AS ph FROM pool p JOIN texts USING (ord) JOIN phrases f ON f.query = p.query AND contains(lower(f_title || ' ' || f_categories || ' ' || f_features || ' ' || f_details || ' ' || f_store || ' ' || f_description), phrase) GROUP BY 1, 2"),
    "centres": ((), "SELECT label, list(x ORDER BY i) AS q FROM (SELECT label, i, round(avg(embedding[i]::DOUBLE), 6) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1"),
    "cosine": (
        ("centres",),
        "SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT c.label AS query, vec_id AS id, round(list_inner_product(q, embedding::DOUBLE[]) / sqrt(list_inner_product(q, q)) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS score FROM centres c, embeddings)) WHERE rank <= 100",
    ),
    "dense": (("cosine", "asked", "catalog"), "SELECT q.query, id AS ord, rank FROM (SELECT DISTINCT query FROM asked) q JOIN cosine c ON c.query = len(q.query) % 10 WHERE id IN (SELECT ord FROM catalog)"),
    "hits": (
        ("messages", "gaz"),
        f"SELECT message, slot, term FROM (SELECT message, {_aliases('hay')} AS hay FROM (SELECT message, ' ' || {_norm('message')} || ' ' AS hay FROM (SELECT DISTINCT message FROM messages WHERE NOT {_no_preference('message')}))) JOIN gaz ON contains(hay, ' ' || term || ' ')",
    ),
    "msg_slots": (("hits",), "SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits g WHERE g.message = h.message AND g.slot = h.slot AND g.term <> h.term AND contains(' ' || g.term || ' ', ' ' || h.term || ' '))"),
    "msg_tokens": (
        ("messages",),
        f"SELECT message, i - 1 AS pos, toks[i] AS token FROM (SELECT DISTINCT message, CASE WHEN {_no_preference('message')} THEN [] ELSE {_terms('message')} END AS toks FROM messages), range(1, 80) r(i) WHERE i <= len(toks)",
    ),
    "mentions": (
        ("messages", "msg_tokens", "msg_slots"),
        f"SELECT sample_id, turn, pos, token, slot FROM messages JOIN (SELECT t.message, pos, token, min(slot) AS slot FROM msg_tokens t LEFT JOIN msg_slots s ON s.message = t.message AND list_contains(string_split(s.term, ' '), {_norm('token')}) GROUP BY ALL) USING (message)",
    ),
    "overrides": (
        ("messages", "msg_slots"),
        f"SELECT sample_id, turn AS o, coalesce(named, []) AS named FROM messages LEFT JOIN (SELECT message, list(DISTINCT slot) AS named FROM msg_slots GROUP BY 1) USING (message) WHERE {_override('message')}",
    ),
    "per": (
        ("mentions",),
        "SELECT sample_id, token, min(turn) AS first_turn, min_by(pos, turn * 1000 + pos) AS first_pos, max(turn) AS last_turn, "
        "min_by(slot, turn * 1000 + pos) FILTER (slot IS NOT NULL) AS slot, min(turn) FILTER (slot IS NOT NULL) AS slot_turn FROM mentions GROUP BY 1, 2",
    ),
    "kills": (  # an override kills what its message's slots replace, and what isn't durable and came on the opening turn
        ("per", "overrides"),
        "SELECT sample_id, token, o, CASE WHEN replaced THEN 'superseded' ELSE 'revoked' END AS how FROM (SELECT *, coalesce(list_contains(named, slot_then), false) AS replaced FROM "
        "(SELECT p.*, o, named, CASE WHEN slot_turn < o THEN slot END AS slot_then FROM per p JOIN overrides USING (sample_id) WHERE o > first_turn)) "
        "WHERE replaced OR (coalesce(slot_then NOT IN ('category', 'department'), true) AND first_turn <= 1)",
    ),
    "ledger": (
        ("per", "kills"),
        "SELECT p.sample_id, p.token, slot, CASE WHEN last_turn >= coalesce(max(o), 0) THEN 'active' ELSE min_by(how, o) FILTER (o > last_turn) END AS status, first_turn, first_pos, last_turn "
        "FROM per p LEFT JOIN kills k ON k.sample_id = p.sample_id AND k.token = p.token GROUP BY p.sample_id, p.token, slot, first_turn, first_pos, last_turn",
    ),
    "turn_list": (("messages",), "SELECT DISTINCT sample_id, turn FROM messages"),
    "active": (  # the ledger's status after every turn
        ("per", "kills", "mentions", "turn_list"),
        "SELECT *, row_number() OVER (PARTITION BY sample_id, turn ORDER BY first_turn, first_pos) AS place FROM (SELECT a.sample_id, a.turn, a.token, CASE WHEN slot_turn <= a.turn THEN slot END AS slot, first_turn, first_pos FROM "
        "(SELECT p.sample_id, p.token, t.turn, first_turn, first_pos, p.slot, slot_turn, max(m.turn) AS said FROM per p JOIN turn_list t ON t.sample_id = p.sample_id JOIN mentions m ON m.sample_id = p.sample_id AND m.token = p.token AND m.turn <= t.turn GROUP BY p.sample_id, p.token, t.turn, first_turn, first_pos, p.slot, slot_turn) a "
        "LEFT JOIN kills k ON k.sample_id = a.sample_id AND k.token = a.token AND k.o <= a.turn GROUP BY a.sample_id, a.turn, a.token, first_turn, first_pos, slot, slot_turn, said HAVING said >= coalesce(max(k.o), 0)) QUALIFY place <= 40",
    ),
    "turn_terms": (
        ("messages", "active"),
        "SELECT m.sample_id, m.turn, m.message, coalesce(list(token ORDER BY place) FILTER (token IS NOT NULL), []) AS terms, coalesce(list(token ORDER BY place) FILTER (slot IS NOT NULL AND slot NOT IN ('category', 'department')), []) AS required "
        "FROM messages m LEFT JOIN active a ON a.sample_id = m.sample_id AND a.turn = m.turn GROUP BY 1, 2, 3",
    ),
    "stuck": (  # a mention gains if the token is new or was killed since it was last said
        ("messages", "mentions", "kills"),
        "SELECT sample_id, turn, gained, turn - coalesce(max(turn) FILTER (gained > 0) OVER (PARTITION BY sample_id ORDER BY turn), 0) AS stuck_for FROM (SELECT m.sample_id, m.turn, count(g.token) AS gained FROM messages m LEFT JOIN "
        "(SELECT s.sample_id, s.token, s.turn FROM (SELECT *, lag(turn) OVER (PARTITION BY sample_id, token ORDER BY turn) AS prev FROM (SELECT DISTINCT sample_id, token, turn FROM mentions)) s "
        "WHERE prev IS NULL OR EXISTS (SELECT 1 FROM kills k WHERE k.sample_id = s.sample_id AND k.token = s.token AND k.o > s.prev AND k.o <= s.turn)) g ON g.sample_id = m.sample_id AND g.turn = m.turn GROUP BY 1, 2)",
    ),
    "routed": (("messages", "msg_slots"), "SELECT m.sample_id, CASE WHEN bool_or(s.slot IS NOT NULL) THEN 'buying' ELSE 'browsing' END AS route FROM messages m LEFT JOIN (SELECT * FROM msg_slots WHERE slot NOT IN ('category', 'department')) s ON s.message = m.message WHERE m.turn = 1 GROUP BY 1"),
    # whole turns: each different query is retrieved and reranked once
    "keyed": (("turn_terms",), f"SELECT *, array_to_string(terms, ' ') || '|' || array_to_string(list_sort(required), ' ') || '|' || array_to_string({_pairs('message')}, ',') AS query, {_pairs('message')} AS phrases FROM turn_terms"),
    "different": (("keyed",), "SELECT query, any_value(terms) AS terms, any_value(required) AS required, any_value(phrases) AS phrases FROM keyed GROUP BY 1"),
    # scores as products of vectors over the index's terms, and heaps of a hundred: no row is kept for a query and a product
    "lexicon": (("parts",), "SELECT term, row_number() OVER (ORDER BY term) AS i FROM (SELECT DISTINCT term FROM parts)"),
    "product_vectors": (("parts", "lexicon"), "SELECT ord, list(coalesce(part, 0) ORDER BY i) AS v FROM (SELECT DISTINCT ord FROM parts) CROSS JOIN lexicon LEFT JOIN parts USING (ord, term) GROUP BY 1"),
    "numbered": (("different",), "SELECT query, terms, row_number() OVER () AS q FROM different"),
    "turn_vectors": (("numbered", "lexicon"), "SELECT q, list(CASE WHEN list_contains(terms, term) THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY i) AS v FROM numbered CROSS JOIN lexicon GROUP BY 1"),
    "turn_pool": (
        ("numbered", "turn_vectors", "product_vectors"),
        "SELECT q, query, -best.o AS ord, best.s AS score, rank FROM (SELECT q, unnest(best) AS best, unnest(range(1, len(best) + 1)) AS rank FROM (SELECT q, max(struct_pack(s := score, o := -ord), 100) AS best FROM ("
        "SELECT q, ord, round(list_inner_product(t.v, p.v), 9) AS score FROM turn_vectors t, product_vectors p) WHERE score > 0 GROUP BY q)) JOIN numbered USING (q)",
    ),
    "field_tokens": (("texts",), "SELECT ord, " + ", ".join(f"{_tokens('f_' + f)} AS t_{f}" for f in ("title", "categories", "features", "details", "store", "description")) + ", lower(f_title || ' ' || f_categories || ' ' || f_features || ' ' || f_details || ' ' || f_store || ' ' || f_description) AS whole, rating_number, price FROM texts"),
    "best_weight": (  # of each product's terms
        ("field_tokens",),
        "SELECT ord, term, max(w) AS w FROM (" + " UNION ALL ".join(f"SELECT ord, unnest(t_{f}) AS term, {w}::DOUBLE AS w FROM field_tokens" for f, w in (("title", 4.0), ("categories", 6.0), ("features", 2.0), ("details", 2.0), ("store", 1.5), ("description", 1.0))) + ") GROUP BY 1, 2",
    ),
    "turn_asked": (("different", "numbered"), "SELECT q, term, list_contains(required, term) AS needed FROM (SELECT query, required, unnest(terms) AS term FROM different) JOIN numbered USING (query)"),
    "turn_best": (("turn_all",), "SELECT query, ord, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank) AS place FROM turn_all) WHERE place <= 10"),
    "turn_ranks": (
        ("keyed", "turn_best", "sessions"),
        "SELECT k.sample_id, k.turn, b.rank FROM keyed k JOIN sessions s USING (sample_id) LEFT JOIN turn_best b ON b.query = k.query AND b.ord::VARCHAR = s.target",
    ),
    "turn_orders": (
        ("turn_pool", "texts"),
        f"WITH known(token, attribute, priority) AS (VALUES {_known()}), hits AS (SELECT query AS pool, ord AS item, attribute, priority, token FROM (SELECT query, ord, unnest(words) AS token FROM turn_pool JOIN (SELECT ord, list_distinct({_tokens(_WHOLE)}) AS words FROM texts) USING (ord)) JOIN known USING (token)) "
        "SELECT pool, list(attribute ORDER BY s DESC, priority) AS found FROM (SELECT h.pool, attribute, priority, round(covered / items::DOUBLE * (k - 1) / k::DOUBLE, 9) AS s FROM (SELECT pool, attribute, priority, count(DISTINCT token) AS k, count(DISTINCT item) AS covered FROM hits GROUP BY 1, 2, 3) h "
        "JOIN (SELECT query AS pool, count(*) AS items FROM turn_pool GROUP BY 1) i USING (pool) WHERE k >= 2) GROUP BY 1",
    ),
    "policy_orders": (  # the attributes that tell a pool's products apart, by the number of their values and by the entropy of these
        ("turn_pool", "texts"),
        f"WITH known(token, attribute, priority) AS (VALUES {_known()}), hits AS (SELECT query AS pool, ord AS item, attribute, priority, token FROM (SELECT query, ord, unnest(words) AS token FROM turn_pool JOIN (SELECT ord, list_distinct({_tokens(_WHOLE)}) AS words FROM texts) USING (ord)) JOIN known USING (token)), "
        "vals AS (SELECT pool, attribute, priority, token, count(*) AS n FROM hits GROUP BY ALL), told AS (SELECT pool, attribute, priority, count(*) AS k, -sum(n / t::DOUBLE * log2(n / t::DOUBLE)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY pool, attribute) AS t FROM vals) GROUP BY ALL) "
        "SELECT pool, list(attribute ORDER BY round(covered / items::DOUBLE * ((k - 1) / k::DOUBLE), 9) DESC, priority) AS by_count, list(attribute ORDER BY round(covered / items::DOUBLE * (h / log2(k::DOUBLE)), 9) DESC, priority) AS by_entropy "
        "FROM told JOIN (SELECT pool, attribute, count(DISTINCT item) AS covered FROM hits GROUP BY 1, 2) USING (pool, attribute) JOIN (SELECT query AS pool, count(*) AS items FROM turn_pool GROUP BY 1) USING (pool) WHERE k >= 2 GROUP BY 1",
    ),
    "wishes": (  # what the tags of a session's customer ask for, each once
        (),
        f"SELECT sample_id, CASE WHEN b = a THEN list_filter([a], lambda x: x IS NOT NULL) ELSE list_filter([a, b], lambda x: x IS NOT NULL) END AS wanted FROM (SELECT o_orderkey AS sample_id, names[{_list([*asking.PROFILE_MAP, 'unknown'])}[o_custkey % {len(asking.PROFILE_MAP) + 1} + 1]] AS a, "
        f"names[{_list([*asking.PROFILE_MAP, 'unknown'])}[(o_custkey // 7) % {len(asking.PROFILE_MAP) + 1} + 1]] AS b FROM orders, (SELECT MAP {{{', '.join(f'{_q(t)}: {_q(a)}' for t, a in asking.PROFILE_MAP.items())}}} AS names))",
    ),
    "answers": (  # how many of a pool's products stand for each of an attribute's words
        ("pool", "texts"),
        f"WITH known(token, attribute, priority, place) AS (VALUES {', '.join(f'({_q(w)}, {_q(a)}, {asking.PATTERN_ORDER.index(a)}, {i})' for a in asking.PATTERN_ORDER for i, w in enumerate(asking.PATTERNS[a]))}), "
        f"words AS (SELECT ord, unnest(list_distinct({_tokens(_WHOLE)})) AS token FROM texts) SELECT pool, attribute, priority, first, count(*) AS n, any_value(items) AS items FROM (SELECT query AS pool, ord, attribute, priority, min(place) AS first FROM pool JOIN words USING (ord) JOIN known USING (token) GROUP BY ALL) JOIN (SELECT query AS pool, count(*) AS items FROM pool GROUP BY 1) USING (pool) GROUP BY 1, 2, 3, 4",
    ),
    "turn_all": (  # every product of each turn's pool with its score
        ("turn_pool", "turn_asked", "different", "numbered", "best_weight", "field_tokens"),
        "SELECT d.query, p.ord, p.rank, round(m + 1.2::DOUBLE * ln(1 + rating_number) + CASE WHEN price IS NOT NULL THEN 2 ELSE 0 END + len(list_filter(d.phrases, lambda x: contains(t.whole, x))) + CASE WHEN len(d.required) > 0 AND hit = len(d.required) THEN 4 ELSE 0 END, 9) AS score FROM (SELECT p.q, p.ord, p.rank, coalesce(sum(b.w), 0) AS m, count(b.w) FILTER (needed) AS hit "
        "FROM turn_pool p JOIN turn_asked w USING (q) LEFT JOIN best_weight b ON b.ord = p.ord AND b.term = w.term GROUP BY 1, 2, 3) p JOIN numbered n USING (q) JOIN different d USING (query) JOIN field_tokens t USING (ord)",
    ),
    "asks": (  # the next question depends on those before: turn after turn
        ("keyed", "stuck", "turn_orders"),
        f"WITH RECURSIVE steps AS (SELECT k.sample_id, k.turn, stuck_for, list_concat(coalesce(found, []), list_filter({_list(asking.DEFAULT_ORDER)}, lambda a: NOT list_contains(coalesce(found, []), a))) AS attrs FROM keyed k JOIN stuck USING (sample_id, turn) LEFT JOIN turn_orders o ON o.pool = k.query), "
        f"walk AS (SELECT sample_id, 0 AS turn, NULL::VARCHAR AS ask, []::VARCHAR[] AS asked FROM (SELECT DISTINCT sample_id FROM steps) UNION ALL SELECT sample_id, turn, ask, CASE WHEN ask IS NULL THEN asked ELSE list_append(asked, ask) END FROM (SELECT s.sample_id, s.turn, asked, "
        f"CASE WHEN stuck_for = 1 THEN 'other' WHEN stuck_for > 1 THEN {_list(asking.DEFAULT_ORDER)}[(stuck_for - 2) % 9 + 1] ELSE list_filter(attrs, lambda a: NOT list_contains(asked, a))[1] END AS ask FROM walk w JOIN steps s ON s.sample_id = w.sample_id AND s.turn = w.turn + 1)) SELECT sample_id, turn, ask FROM walk WHERE turn > 0",
    ),
    "turns": (
        (),
        "SELECT user_id || '-' || ((n - 1) // 10) AS sample_id, CASE user_id % 3 WHEN 0 THEN 'buying' WHEN 1 THEN 'browsing' ELSE 'intent_override' END AS scenario_type, ((n - 1) % 10 + 1)::INTEGER AS turn, "
        "CASE WHEN k < 40 THEN k + 1 END AS rank, user_id % 3 <> 2 OR (n - 1) % 10 + 1 >= 3 AS applied FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, json_extract_string(props, '$.k')::INTEGER AS k FROM events)",
    ),
    "facts": (("turns",), "SELECT sample_id, scenario_type, count(*) FILTER (ok) > 0 AS hit, min(turn) FILTER (ok) AS first_hit_turn, min_by(rank, turn) FILTER (ok) AS best_rank, coalesce(1.0::DOUBLE / min_by(rank, turn) FILTER (ok), 0) AS reciprocal_rank FROM (SELECT *, applied AND rank IS NOT NULL AND rank <= 10 AS ok FROM turns) GROUP BY 1, 2"),
    "late_facts": (("turns",), "SELECT sample_id, scenario_type, count(*) FILTER (ok) > 0 AS hit, min(turn) FILTER (ok) AS first_hit_turn, coalesce(1.0::DOUBLE / min_by(rank, turn) FILTER (ok), 0) AS reciprocal_rank FROM (SELECT *, applied AND turn >= 2 AND rank IS NOT NULL AND rank <= 10 AS ok FROM turns) GROUP BY 1, 2"),
    "presence": (
        ("catalog",),
        "SELECT parent_asin, ord, unnest(['title', 'features', 'description', 'price', 'categories', 'details', 'average_rating', 'rating_number', 'store']) AS field, "
        "unnest([regexp_matches(title, '\\S'), true, descr IS NOT NULL, price IS NOT NULL, true, true, true, true, regexp_matches(store, '\\S')]) AS there FROM catalog",
    ),
}


def _metrics(facts: str) -> str:
    return (
        f"SELECT coalesce(scenario_type, 'all') AS scenario_type, count(*) AS sample_count, round(avg(hit::INTEGER::DOUBLE), 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mrr, round(avg(coalesce(first_hit_turn, 11)), 6) AS mttc FROM {facts} GROUP BY GROUPING SETS ((), (scenario_type))"
    )


def _scored(metrics: str) -> str:
    return f"SELECT *, round(0.5 * hit_rate + 0.3 * mrr + 0.2 * efficiency, 6) AS score FROM (SELECT *, round(coalesce(least(greatest((11 - mttc) / 10, 0), 1), 0), 6) AS efficiency FROM ({metrics}))"


def _with(body: str, *views: str) -> str:
    order: list[str] = []

    def need(v: str) -> None:
        for x in _VIEWS[v][0]:
            need(x)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    return ("WITH " + ", ".join(f"{v} AS MATERIALIZED ({_VIEWS[v][1]})" for v in order) + " " if order else "") + body


def _order(spread: str) -> str:
    known = ", ".join(f"({_q(w)}, {_q(a)}, {asking.PATTERN_ORDER.index(a)})" for a in asking.PATTERN_ORDER for w in asking.PATTERNS[a])
    whole = "f_title || ' ' || f_categories || ' ' || f_features || ' ' || f_details || ' ' || f_store || ' ' || f_description"
    return _with(
        f"SELECT pool, array_to_string(attrs, ' ') AS attributes, list_filter(attrs, lambda a: a NOT IN ('color', 'size'))[1] AS next FROM (SELECT pool, list_concat(coalesce(found, []), list_filter({_list(asking.DEFAULT_ORDER)}, lambda a: NOT list_contains(coalesce(found, []), a))) AS attrs FROM ("
        f"SELECT p.pool, list(attribute ORDER BY s DESC, priority) FILTER (attribute IS NOT NULL) AS found FROM (SELECT DISTINCT query AS pool FROM pool) p LEFT JOIN (SELECT v.pool, v.attribute, v.priority, round(covered / items::DOUBLE * {spread}, 9) AS s FROM ("
        f"SELECT pool, attribute, priority, count(*) AS k, sum(n) AS total FROM vals GROUP BY 1, 2, 3) v JOIN (SELECT pool, attribute, count(DISTINCT item) AS covered FROM hits GROUP BY 1, 2) c USING (pool, attribute) JOIN (SELECT query AS pool, count(*) AS items FROM ranked WHERE rank <= 100 GROUP BY 1) i USING (pool) "
        f"JOIN (SELECT pool, attribute, -sum(n / t::DOUBLE * log2(n / t::DOUBLE)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY pool, attribute) AS t FROM vals) GROUP BY 1, 2) e USING (pool, attribute) WHERE k >= 2) x ON x.pool = p.pool GROUP BY p.pool))",
        "pool", "texts",
    ).replace(" SELECT pool, array_to_string", f", known(token, attribute, priority) AS (VALUES {known}), hits AS (SELECT query AS pool, ord AS item, attribute, priority, token FROM (SELECT query, ord, unnest(list_distinct({_tokens(whole)})) AS token FROM ranked JOIN texts USING (ord) WHERE rank <= 100) JOIN known USING (token)), vals AS (SELECT pool, attribute, priority, token, count(*) AS n FROM hits GROUP BY 1, 2, 3, 4) SELECT pool, array_to_string", 1)


_FIELD_ROWS = "unnest([{}]) AS field"
_DEPT = {a: d for d, names in X.DEPARTMENTS.items() for a in names}
_DEPT_RAW = sorted(_DEPT) + ["Men's", "Baby Girls (0-24M)", "TODDLER-boys", "garden"]
_DEPT_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower(raw), '[''’]', '', 'g'), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_KIND = "CASE WHEN contains(lower(value), 'budget') OR regexp_matches(lower(value), '(\\$|<=|under)\\s*\\d') THEN 'budget' " + " ".join("WHEN " + " OR ".join(f"contains(lower(value), {_q(w)})" for w in words) + f" THEN {_q(k)}" for k, words in X.CONSTRAINT_WORDS) + " ELSE 'feature' END"


def _frames(x: str) -> str:
    for f in X.SCAFFOLD:
        x = f"replace({x}, {_q(f)}, ' ')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_SYN = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in X.SYNONYMS.items()) + "}"
def _stressed(level: str, x: str) -> str:
    return {
        "L0_clean": x, "L1_no_scaffold": _frames(x), "L2_no_category": f"regexp_replace({_frames(x)}, '(I''m looking for )[^.,]+', '\\1something')",
        "L3_synonyms_only": f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: coalesce(({_SYN})[lower(w)], w)), '')",
    }[level]


_VIEWS |= {
    "split": (
        ("sessions",),
        "SELECT sample_id, stratum, CASE WHEN place <= take THEN 'validation' ELSE 'development' END AS part FROM (SELECT sample_id, scenario_type || '/' || difficulty_bucket AS stratum, row_number() OVER (PARTITION BY scenario_type, difficulty_bucket ORDER BY sha256('turnwise-v1' || chr(0) || sample_id || chr(0) || sample_id)) AS place FROM sessions) JOIN ("
        "SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= 200 - sum(base) OVER () THEN 1 ELSE 0 END AS take FROM (SELECT stratum, floor(q) AS base, round(q - floor(q), 9) AS rest FROM (SELECT scenario_type || '/' || difficulty_bucket AS stratum, count(*) * 200 / (SELECT count(*) FROM sessions)::DOUBLE AS q FROM sessions GROUP BY 1))) USING (stratum)",
    ),
    "tgt": (("catalog",), "SELECT ord FROM catalog WHERE price IS NOT NULL OR rating_number >= 32"),
    "mplan": (("presence", "tgt"), "SELECT field, o, greatest(o - d, 0) AS masks FROM (SELECT field, sum(there::INTEGER) FILTER (t) AS o, round_even(sum(there::INTEGER) / count(*)::DOUBLE * count(*) FILTER (t), 0) AS d FROM (SELECT p.*, t.ord IS NOT NULL AS t FROM presence p LEFT JOIN tgt t USING (ord)) GROUP BY 1)"),
    "masks": (
        ("presence", "tgt", "mplan"),
        "SELECT field, ord FROM (SELECT p.field, p.ord, row_number() OVER (PARTITION BY p.field ORDER BY sha256('coverage-stress-v1' || chr(0) || 'turnwise-v1' || chr(0) || p.field || chr(0) || parent_asin)) AS place FROM presence p JOIN tgt USING (ord) WHERE there AND p.field IN ('price', 'description')) JOIN mplan USING (field) WHERE place <= masks",
    ),
    "masked": (
        ("catalog", "masks"),
        "SELECT c.ord, parent_asin, title, CASE WHEN a.ord IS NULL THEN price END AS price, CASE WHEN b.ord IS NOT NULL THEN '' ELSE descr END AS descr FROM catalog c LEFT JOIN (SELECT ord FROM masks WHERE field = 'price') a ON a.ord = c.ord LEFT JOIN (SELECT ord FROM masks WHERE field = 'description') b ON b.ord = c.ord",
    ),
    "catalog_s": (  # the masked catalog with all of a catalog's columns
        ("catalog", "masks"),
        "SELECT c.* REPLACE (CASE WHEN a.ord IS NULL THEN price END AS price, CASE WHEN b.ord IS NOT NULL THEN '' ELSE descr END AS descr) FROM catalog c LEFT JOIN (SELECT ord FROM masks WHERE field = 'price') a ON a.ord = c.ord LEFT JOIN (SELECT ord FROM masks WHERE field = 'description') b ON b.ord = c.ord",
    ),
    "broken": (
        ("catalog", "masked"),
        "SELECT m.ord, m.title || CASE WHEN m.ord % 31 = 0 THEN '!' ELSE '' END AS title, CASE WHEN m.ord % 43 = 0 THEN 1.0 WHEN m.ord % 5 = 0 THEN c.price ELSE m.price END AS price, m.descr FROM masked m JOIN catalog c USING (ord) WHERE m.ord % 97 <> 0",
    ),
    "replay_facts": (
        ("turn_ranks", "sessions"),
        "SELECT sample_id, difficulty_bucket, count(*) FILTER (ok) > 0 AS hit, min(turn) FILTER (ok) AS first_hit_turn, coalesce(1.0::DOUBLE / min_by(rank, turn) FILTER (ok), 0) AS reciprocal_rank FROM (SELECT r.*, difficulty_bucket, rank IS NOT NULL AND (scenario_type <> 'intent_override' OR turn >= 3) AS ok FROM turn_ranks r JOIN sessions USING (sample_id)) GROUP BY 1, 2",
    ),
    "stressed": (("openings",), " UNION ALL ".join(f"SELECT sample_id, target, {_q(k)} AS level, {_stressed(k, 'message')} AS query FROM openings" for k in X.STRESS_LEVELS)),
    "stress_wanted": (("stressed",), f"SELECT DISTINCT query, unnest({_terms('query')}) AS term FROM (SELECT DISTINCT query FROM stressed)"),
    "stress_pool": (("stress_wanted", "parts"), "SELECT * FROM (" + _bm25("stress_wanted") + ") WHERE rank <= 100"),
    "responses": (
        (),
        "SELECT user_id AS session, event_id AS turn, k, event_id % 7 AS n, CASE event_id % 7 WHEN 5 THEN [] ELSE [CASE WHEN event_id % 7 = 1 THEN '' ELSE (k * 37)::VARCHAR END, (k * 11)::VARCHAR] END AS ids FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events)",
    ),
}


def _violations(after: str) -> str:
    """The checks on a masked catalog against the one it was made from; a product has ten columns besides its id."""
    return _with(
        f"SELECT unnest(['identifiers_preserved', 'nothing_filled', 'unplanned_unchanged', 'planned_masked', 'other_products_unchanged', 'mask_counts']) AS invariant, unnest([gone, filled, unplanned, unmasked, others, (SELECT count(*) FROM mplan p LEFT JOIN "
        f"(SELECT field, count(*) AS l FROM (SELECT unnest(['price', 'description']) AS field, unnest([price IS NOT NULL, coalesce(descr, '') <> '']) AS there, ord FROM {after}) JOIN tgt USING (ord) WHERE there GROUP BY 1) x USING (field) WHERE field IN ('price', 'description') AND coalesce(l, 0) <> o - masks)])::BIGINT AS violations FROM ("
        f"SELECT 10 * (SELECT count(*) FROM catalog WHERE ord NOT IN (SELECT ord FROM {after})) AS gone, coalesce(sum((NOT was AND now)::INTEGER), 0) AS filled, coalesce(sum((target AND differs AND NOT planned)::INTEGER), 0) AS unplanned, coalesce(sum((planned AND now)::INTEGER), 0) AS unmasked, coalesce(sum((NOT target AND differs)::INTEGER), 0) AS others FROM ("
        f"SELECT f.*, t.ord IS NOT NULL AS target, m.ord IS NOT NULL AS planned FROM (SELECT c.ord, unnest(['title', 'price', 'description']) AS field, unnest([true, c.price IS NOT NULL, c.descr IS NOT NULL]) AS was, unnest([true, n.price IS NOT NULL, coalesce(n.descr, '') <> '']) AS now, "
        f"unnest([c.title <> n.title, c.price IS DISTINCT FROM n.price, c.descr IS DISTINCT FROM n.descr]) AS differs FROM catalog c JOIN {after} n ON n.ord = c.ord) f LEFT JOIN tgt t ON t.ord = f.ord LEFT JOIN masks m ON m.ord = f.ord AND m.field = f.field))",
        "catalog", "mplan", "tgt", "masks", after,
    )


ORACLES: dict[str, str] = {
    "catalog_profile": _with("SELECT field, sum(there::INTEGER)::BIGINT AS present, (count(*) - sum(there::INTEGER))::BIGINT AS missing, round(sum(there::INTEGER) / count(*)::DOUBLE, 6) AS coverage FROM presence GROUP BY 1", "presence"),
    "category_gazetteer": _with(f"SELECT {_norm('noun')} AS term, count(*) AS n FROM catalog GROUP BY 1", "catalog"),
    "attribute_seeds": _with(f"SELECT {_norm('store')} AS term, count(*) AS n FROM catalog GROUP BY 1", "catalog"),
    "department_terms": _with("SELECT term, n FROM depts", "depts"),
    "catalog_index": _with("SELECT parent_asin, title || CASE WHEN ord % 7 = 0 THEN ' again' ELSE '' END AS title FROM catalog", "catalog"),
    "document_tokens": "SELECT doc_id, len(t)::INTEGER AS n, sha256(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}\\p{Co}]+') AS t FROM documents)",
    "term_support": _with(
        f"SELECT term, (SELECT count(*) FROM searched WHERE contains(hay, ' ' || term || ' ')) AS support FROM (SELECT {_norm('title')} AS term FROM catalog UNION SELECT {_norm('p_type')} FROM catalog UNION SELECT {_norm('noun')} FROM catalog)", "catalog", "searched"),
    "slot_conflicts": _with(
        "SELECT slot, term, support FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY CASE slot WHEN 'size' THEN 3 WHEN 'category' THEN 4 WHEN 'color' THEN 5 ELSE 6 END) AS place FROM (SELECT slot, term, count(*) AS support FROM ("
        "SELECT 'style' AS slot, word1 AS term FROM catalog UNION ALL SELECT 'category', noun FROM catalog UNION ALL SELECT 'color', noun FROM catalog UNION ALL SELECT 'size', lower(p_type) FROM catalog UNION ALL SELECT 'category', lower(p_type) FROM catalog) GROUP BY 1, 2)) WHERE place = 1", "catalog"),
    "gazetteer": _with("SELECT slot, term, support FROM gaz", "gaz"),
    "gazetteer_summary": _with("SELECT slot, count(*) AS term_count, sum(support)::BIGINT AS covered_items, array_to_string(list_slice(list(term ORDER BY support DESC, term), 1, 3), ',') AS top_terms FROM gaz GROUP BY 1", "gaz"),
    "normalized_terms": (
        f"SELECT p_partkey, raw, {_norm('raw')} AS term, array_to_string(list_filter(list_transform(regexp_split_to_array(raw, '(?i)\\s*[&,/]\\s*|\\s+and\\s+'), lambda p: {_norm('p')}), lambda t: t <> ''), '|') AS parts, "
        f"len(list_filter(string_split({_norm('raw')}, ' '), lambda t: regexp_full_match(t, '[a-z]{{2,}}'))) > 0 AS usable FROM (SELECT p_partkey, p_name || e AS raw FROM part, (SELECT unnest(['s', 'es', 'ses', 'ves', 'ies', 'ss', '''s & Boots', '-Hoodies/Cases']) AS e))"),
    "department_names": f"SELECT c_custkey, raw, (MAP {{{', '.join(f'{_q(a)}: {_q(d)}' for a, d in _DEPT.items())}}})[{_DEPT_KEY}] AS department FROM (SELECT c_custkey, {_list(_DEPT_RAW)}[c_custkey % {len(_DEPT_RAW)} + 1] AS raw FROM customer)",
    "query_tokens": f"SELECT conv_id, turn, array_to_string({_terms('text')}, ' ') AS tokens, len({_tokens('text')})::INTEGER AS n_raw FROM conversations WHERE role = 'user'",
    "phrase_runs": (
        "SELECT conv_id, turn, array_to_string(list_concat(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END), '|') AS phrases "
        f"FROM (SELECT conv_id, turn, {_tokens('text')} AS w FROM conversations WHERE role = 'user')"),
    "coarse_category": _with("SELECT parent_asin, p_type || ' ' || noun AS category FROM catalog", "catalog"),
    "intent_card": _with("SELECT parent_asin, target_category, array_to_string(hard, '|') AS hard, array_to_string(soft, '|') AS soft FROM cards", "cards"),
    "classify_constraint": _with(f"SELECT parent_asin, place, value, {_KIND} AS kind FROM (SELECT parent_asin, unnest([0, 1, 2, 3]) AS place, unnest(list_concat(hard, soft)) AS value FROM cards)", "cards"),
    "opening_message": _with("SELECT sample_id, scenario_type, message FROM openings", "openings"),
    "query_stress_levels": _with(
        f"SELECT sample_id, turn, level, CASE level WHEN 'L0_clean' THEN message WHEN 'L1_no_scaffold' THEN {_frames('message')} WHEN 'L2_no_category' THEN regexp_replace({_frames('message')}, '(I''m looking for )[^.,]+', '\\1something') "
        f"ELSE array_to_string(list_transform(regexp_extract_all(message, '[A-Za-z]+|[^A-Za-z]+'), lambda w: coalesce(({_SYN})[lower(w)], w)), '') END AS text FROM messages, (SELECT unnest({_list(X.STRESS_LEVELS)}) AS level)", "messages"),
    "slot_extraction": _with("SELECT sample_id, turn, slot, term FROM messages JOIN msg_slots USING (message)", "msg_slots"),
    "postings": _with("SELECT term, ord, weight, doc_len::BIGINT AS doc_len FROM postings", "postings"),
    "term_stats": _with("SELECT term, df FROM df", "df"),
    "catalog_idf": _with("SELECT term, round(ln(1 + n / (1 + df)::DOUBLE), 9) AS idf FROM df, corpus", "df", "corpus"),
    "bm25_top10": _with("SELECT query, ord, score, rank FROM ranked WHERE rank <= 10", "ranked"),
    "match_count": _with("SELECT query, count(*) AS n FROM ranked GROUP BY 1", "ranked"),
    "field_weight_rerank": _with("SELECT query, ord, round(m, 9) AS score, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(m, 9) DESC, rank) AS place FROM matched) WHERE place <= 10", "matched"),
    "rerank_top10": _with(
        "SELECT query, ord, parent_asin, score, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank) AS place FROM (SELECT m.query, m.ord, parent_asin, m.rank, round(m + 1.2::DOUBLE * ln(1 + rating_number) + CASE WHEN price IS NOT NULL THEN 2 ELSE 0 END + coalesce(ph, 0) + CASE WHEN complete THEN 4 ELSE 0 END, 9) AS score "
        "FROM matched m JOIN texts USING (ord) LEFT JOIN (SELECT p.query, p.ord, count(*) AS ph FROM pool p JOIN texts USING (ord) JOIN phrases f ON f.query = p.query AND contains(lower(f_title || ' ' || f_categories || ' ' || f_features || ' ' || f_details || ' ' || f_store || ' ' || f_description), phrase) GROUP BY 1, 2) x ON x.query = m.query AND x.ord = m.ord)) WHERE place <= 10",
        "matched", "phrases", "texts"),
    "union_pool": _with("SELECT query, ord, rank FROM pool UNION ALL SELECT query, ord, n + place FROM (SELECT d.query, d.ord, row_number() OVER (PARTITION BY d.query ORDER BY d.rank) AS place FROM dense d ANTI JOIN (SELECT query, ord FROM pool) USING (query, ord)) JOIN (SELECT query, max(rank) AS n FROM pool GROUP BY 1) USING (query) WHERE place <= 100", "pool", "dense"),
    "rrf_fusion": _with("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS rank FROM (SELECT query, ord, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query, ord, rank FROM pool UNION ALL SELECT query, ord, rank FROM dense) GROUP BY 1, 2)) WHERE rank <= 10", "pool", "dense"),
    "rerank_weighted": _with(
        "SELECT query, ord, parent_asin, score, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank) AS place FROM (SELECT m.query, m.ord, t.parent_asin, m.rank, round(m.m + 1.2::DOUBLE * ln(1 + t.rating_number) + CASE WHEN t.price IS NOT NULL THEN 2 ELSE 0 END + 0.5::DOUBLE * c.average_rating "
        "+ coalesce(list_inner_product(q.q, e.embedding::DOUBLE[]) / sqrt(list_inner_product(q.q, q.q)) / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 0) + coalesce(ph, 0) + CASE WHEN complete THEN 4 ELSE 0 END, 9) AS score "
        "FROM (SELECT query, ord, rank, sum(w * coalesce(ln(1 + n / (1 + df)::DOUBLE), 1) * (1 + 0.25::DOUBLE * (len(term) % 3))) AS m, coalesce(bool_and(w > 0) FILTER (must.term IS NOT NULL), false) AS complete FROM weights LEFT JOIN df USING (term) LEFT JOIN must USING (query, term), corpus GROUP BY query, ord, rank) m "
        "JOIN texts t USING (ord) JOIN catalog c USING (ord) JOIN centres q ON q.label = len(m.query) % 10 LEFT JOIN embeddings e ON e.vec_id = m.ord LEFT JOIN phrased x ON x.query = m.query AND x.ord = m.ord)) WHERE place <= 10",
        "weights", "df", "corpus", "must", "texts", "centres", "phrased"),
    "cosine_topk": _with("SELECT query, id, score, rank FROM cosine WHERE rank <= 10", "cosine"),
    "ledger_status": _with("SELECT sample_id, token, slot, status, first_turn, first_pos, last_turn FROM ledger", "ledger"),
    "ledger_projection": _with("SELECT sample_id, place, token FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY first_turn, first_pos) AS place FROM ledger WHERE status = 'active') WHERE place <= 40", "ledger"),
    "slots_view": _with("SELECT sample_id, slot, string_agg(token || ':' || first_turn, ',' ORDER BY first_turn, first_pos) AS terms FROM ledger WHERE status = 'active' AND slot IS NOT NULL GROUP BY 1, 2", "ledger"),
    "source_tags": _with("SELECT sample_id, token, CASE WHEN first_turn > 1 THEN 'answered' ELSE 'volunteered' END AS source FROM ledger", "ledger"),
    "term_arrival": _with(
        "SELECT sample_id, token, min(turn) AS arrived, max(turn) AS last FROM (SELECT *, turn - row_number() OVER (PARTITION BY sample_id, token ORDER BY turn) AS run FROM active) GROUP BY sample_id, token, run", "active"),
    "recency_weights": _with(
        "SELECT sample_id, turn, token, 1 + 0.5::DOUBLE * (min(turn) OVER (PARTITION BY sample_id, token, run) - 1) AS weight FROM (SELECT *, turn - row_number() OVER (PARTITION BY sample_id, token ORDER BY turn) AS run FROM active)", "active"),
    "no_gain_islands": _with("SELECT sample_id, turn, gained, stuck_for FROM stuck", "stuck"),
    "stuck_questions": _with(
        f"SELECT *, (MAP {{{', '.join(f'{_q(a)}: {_q(q)}' for a, q in asking.QUESTIONS.items())}}})[ask] AS question FROM (SELECT sample_id, turn, stuck_for, CASE WHEN stuck_for = 1 THEN 'other' ELSE {_list(asking.DEFAULT_ORDER)}[(stuck_for - 2) % 9 + 1] END AS ask FROM stuck WHERE stuck_for >= 1)", "stuck"),
    "routes": _with("SELECT sample_id, route FROM routed", "routed"),
    "required_terms": _with("SELECT sample_id, turn, array_to_string(terms, ' ') AS terms, array_to_string(required, ' ') AS required FROM turn_terms", "turn_terms"),
    "turn_changes": _with(
        "SELECT sample_id, turn, coalesce(array_to_string(list_filter(b, lambda x: NOT list_contains(terms, x)), ','), '') AS lost, array_to_string(list_filter(terms, lambda x: NOT list_contains(coalesce(b, []), x)), ',') AS added, coalesce(b = terms, false) AS dead "
        "FROM (SELECT *, lag(terms) OVER (PARTITION BY sample_id ORDER BY turn) AS b FROM turn_terms)", "turn_terms"),
    "override_disposition": _with(
        "SELECT sample_id, o AS turn, slot, term, arrived, reason IN ('durable_slot', 'learned_after_opening_turn') AS kept, reason FROM (SELECT *, CASE WHEN list_contains(named, slot) THEN 'slot_replaced_by_message' WHEN slot IN ('category', 'department') THEN 'durable_slot' WHEN arrived > 1 THEN 'learned_after_opening_turn' ELSE 'volunteered_on_opening_turn' END AS reason FROM ("
        "SELECT a.sample_id, o, named, slot, token AS term, first_turn AS arrived FROM active a JOIN overrides x ON x.sample_id = a.sample_id AND a.turn = x.o - 1 WHERE slot IS NOT NULL))", "active", "overrides"),
    "slot_diff": _with(
        "SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.turn, b.turn + 1) AS turn, coalesce(a.slot, b.slot) AS slot, coalesce(a.token, b.token) AS term, a.first_turn AS arrived, CASE WHEN b.turn IS NULL THEN 'new' WHEN a.turn IS NULL THEN 'dropped' ELSE 'kept' END AS change FROM "
        "(SELECT * FROM active WHERE slot IS NOT NULL) a FULL JOIN (SELECT * FROM active WHERE slot IS NOT NULL AND turn < 5) b ON a.sample_id = b.sample_id AND a.turn = b.turn + 1 AND a.slot = b.slot AND a.token = b.token", "active"),
    "disclosed": _with(
        "SELECT m.sample_id, m.turn, array_to_string(list_filter(list_concat(hard, soft), lambda c: contains(so_far, c)), '|') AS named FROM (SELECT sample_id, turn, string_agg(message, ' ') OVER (PARTITION BY sample_id ORDER BY turn) AS so_far FROM messages) m JOIN openings USING (sample_id)", "messages"),
    "clarify_candidate": _order("(k - 1) / k::DOUBLE"),
    "clarify_entropy": _order("h / log2(k::DOUBLE)"),
    "clarify_profile": (
        f"SELECT pool, array_to_string(attrs, ' ') AS attributes, list_filter(attrs, lambda a: a NOT IN ('color', 'size'))[1] AS next FROM (SELECT pool, list_concat(p, list_filter({_list(asking.DEFAULT_ORDER)}, lambda a: NOT list_contains(p, a))) AS attrs FROM ("
        f"SELECT c_custkey AS pool, CASE WHEN t1 IS NULL THEN (CASE WHEN t2 IS NULL THEN [] ELSE [t2] END) WHEN t2 IS NULL OR t1 = t2 THEN [t1] ELSE [t1, t2] END AS p FROM (SELECT c_custkey, l[c_custkey % 9 + 1] AS t1, l[c_custkey // 7 % 9 + 1] AS t2 FROM customer, (SELECT {_list(asking.PROFILE_MAP.values())[:-1]}, NULL] AS l))))"),
    "corpus_digest": (
        "WITH RECURSIVE tree AS (SELECT 0 AS level, row_number() OVER (ORDER BY doc_id) - 1 AS node, sha256(coalesce(text, '')) AS digest FROM documents UNION ALL "
        "SELECT level + 1, node // 64, sha256(string_agg(digest, '' ORDER BY node)) FROM (SELECT *, count(*) OVER () AS n FROM tree) WHERE n > 1 GROUP BY level, node // 64) "
        "SELECT level, node, digest FROM tree WHERE level > 0"
    ),
    "first_hit": _with("SELECT sample_id, scenario_type, hit, coalesce(first_hit_turn, 0) AS first_hit_turn, coalesce(best_rank, 0) AS best_rank, round(reciprocal_rank, 9) AS reciprocal_rank FROM facts", "facts"),
    "metric_summary": _with(f"SELECT * EXCLUDE (scenario_type) FROM ({_scored(_metrics('facts'))}) WHERE scenario_type = 'all'", "facts"),
    "scenario_metrics": _with(_scored(_metrics("facts")), "facts"),
    "metric_deltas": _with(
        f"SELECT a.scenario_type, a.metric, round(b.v - a.v, 6) AS delta FROM (UNPIVOT (SELECT * EXCLUDE (sample_count) FROM ({_scored(_metrics('facts'))})) ON hit_rate, mrr, mttc, efficiency, score INTO NAME metric VALUE v) a JOIN (UNPIVOT (SELECT * EXCLUDE (sample_count) FROM ({_scored(_metrics('late_facts'))})) ON hit_rate, mrr, mttc, efficiency, score INTO NAME metric VALUE v) b USING (scenario_type, metric)",
        "facts", "late_facts"),
    "recall_at_k": _with(
        "SELECT coalesce(scenario_type, 'all') AS scenario_type, cutoff, count(*) AS sample_count, round(avg(CASE WHEN rank <= cutoff THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM (SELECT sample_id, scenario_type, p.rank FROM asked a LEFT JOIN pool p ON p.query = a.query AND p.ord::VARCHAR = a.target), (SELECT unnest([10, 50, 100]) AS cutoff) GROUP BY GROUPING SETS ((cutoff), (cutoff, scenario_type))", "asked", "pool"),
    "latency_profile": "SELECT event_type, count(*) AS n, round(sum(value) / count(*), 6) AS mean, round(median(value), 6) AS median, l[least(len(l) - 1, floor(len(l) * 0.95))::INTEGER + 1] AS p95, l[least(len(l) - 1, floor(len(l) * 0.99))::INTEGER + 1] AS p99, max(value) AS largest FROM (SELECT event_type, value, list(value ORDER BY value) OVER (PARTITION BY event_type ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events) GROUP BY event_type, l",
    "cleaned_responses": _with(
        "SELECT session, turn, row_number() OVER (PARTITION BY session, turn ORDER BY place) AS rank, id AS parent_asin FROM (SELECT session, turn, id, min(place) AS place FROM (SELECT session, turn, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS place FROM responses) WHERE id IN (SELECT p_partkey::VARCHAR FROM part) GROUP BY 1, 2, 3)", "responses"),
    "token_usage": _with(
        "SELECT *, prompt_tokens + completion_tokens AS total_tokens FROM (SELECT coalesce(sum(k) FILTER (n NOT IN (2, 3, 4, 5)), 0)::BIGINT AS prompt_tokens, coalesce(sum(k * 2) FILTER (n <> 5), 0)::BIGINT AS completion_tokens FROM responses)", "responses"),
    "session_listing": _with(
        "SELECT row_number() OVER (ORDER BY sample_id) AS index, sample_id, scenario_type, difficulty_bucket, target, coalesce(title, '') AS title, store, rating_number FROM sessions LEFT JOIN catalog ON parent_asin = target", "sessions", "catalog"),
    "normalized_recommendations": (
        "SELECT user_id, id, rank FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rank FROM (SELECT user_id, id, min(place) AS place FROM (SELECT user_id, (json_extract_string(props, '$.k')::INTEGER * 37)::VARCHAR AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events) WHERE id IN (SELECT p_partkey::VARCHAR FROM part) GROUP BY 1, 2)) WHERE rank <= 10"),
    "file_order": _with(
        "SELECT parent_asin, max_by(title, line) AS title, max(line) AS line FROM (SELECT *, row_number() OVER (ORDER BY place, parent_asin::BIGINT) AS line FROM (SELECT parent_asin, title, ord::DOUBLE AS place FROM catalog UNION ALL SELECT parent_asin, title || ' again', (ord * 31 % 1009) + 0.5::DOUBLE FROM catalog WHERE ord % 7 = 0)) GROUP BY 1", "catalog"),
    "stratum_counts": _with("SELECT scenario_type || '/' || difficulty_bucket AS stratum, count(*) AS n FROM sessions GROUP BY 1", "sessions"),
    "stratified_split": _with("SELECT sample_id, stratum, part FROM split", "split"),
    "missing_targets": _with("SELECT target, count(*) AS n FROM sessions WHERE target NOT IN (SELECT parent_asin FROM catalog WHERE price IS NULL) GROUP BY 1", "sessions", "catalog"),
    "mask_plan": _with(
        "SELECT field, cp AS catalog_present, round(cp / n::DOUBLE, 6) AS coverage, d::BIGINT AS desired, o AS original, greatest(o - d, 0)::BIGINT AS masks, greatest(d - o, 0)::BIGINT AS shortfall FROM (SELECT field, sum(there::INTEGER)::BIGINT AS cp, count(*) AS n, (sum(there::INTEGER) FILTER (t.x IS NOT NULL))::BIGINT AS o, round_even(sum(there::INTEGER) / count(*)::DOUBLE * count(*) FILTER (t.x IS NOT NULL), 0) AS d FROM presence LEFT JOIN (SELECT DISTINCT target AS x FROM sessions) t ON x = parent_asin GROUP BY 1)", "presence", "sessions"),
    "masked_catalog": _with("SELECT parent_asin, price, CASE WHEN descr IS NULL THEN -1 WHEN descr = '' THEN 0 ELSE 1 END AS n_description FROM masked", "masked"),
    "mask_invariants": _violations("masked"),
    "broken_invariants": _violations("broken"),
    "target_problems": _with(
        "SELECT 'duplicate product' AS problem, parent_asin FROM catalog WHERE ord % 17 = 0 AND ord % 13 <> 0 UNION ALL SELECT 'duplicate target', target FROM sessions WHERE difficulty_bucket = 'hard' GROUP BY target HAVING count(*) > 1 "
        "UNION ALL SELECT 'missing target', target FROM (SELECT DISTINCT target FROM sessions WHERE difficulty_bucket = 'hard') WHERE target::BIGINT % 13 = 0 AND target::BIGINT % 17 <> 0", "catalog", "sessions"),
    "popularity_sweep": _with(
        "SELECT a.trial, a.part, a.difficulty_bucket, count(*) AS n, count(place) AS hits, round(sum(coalesce(1.0::DOUBLE / place, 0)) / count(*), 6) AS mrr FROM (SELECT a.*, r.trial FROM (SELECT sample_id, query, target, difficulty_bucket, part FROM asked JOIN split USING (sample_id)) a, range(0, 6) r(trial)) a LEFT JOIN ("
        "SELECT query, ord::VARCHAR AS target, trial, row_number() OVER (PARTITION BY query, trial ORDER BY round(m + wp * ln(1 + t.rating_number) + wc * (t.price IS NOT NULL)::INTEGER + wr * average_rating, 9) DESC, rank) AS place FROM matched JOIN texts t USING (ord) JOIN catalog c USING (ord), "
        "(SELECT unnest([0, 1, 2, 3, 4, 5]) AS trial, unnest([0, 0.6, 1.2, 2.4, 1.2, 1.2])::DOUBLE AS wp, unnest([0, 0, 0, 0, 2, 2])::DOUBLE AS wc, unnest([0, 0, 0, 0, 0, 0.5])::DOUBLE AS wr) QUALIFY place <= 10) p ON p.query = a.query AND p.target = a.target AND p.trial = a.trial GROUP BY 1, 2, 3",
        "asked", "split", "matched", "texts"),
    "stress_recall": _with(
        "SELECT coalesce(level, 'all') AS level, cutoff, count(*) AS sample_count, round(avg(CASE WHEN rank <= cutoff THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM (SELECT level, p.rank FROM stressed a LEFT JOIN stress_pool p ON p.query = a.query AND p.ord::VARCHAR = a.target), (SELECT unnest([10, 50, 100]) AS cutoff) GROUP BY GROUPING SETS ((cutoff), (cutoff, level))", "stressed", "stress_pool"),
}



def _walked(policy: str, found: str) -> str:
    """What a policy asks, turn after turn; ``found`` are the attributes that come before the defaults."""
    return (
        f"SELECT sample_id, turn, ask, {_q(policy)} AS policy FROM (WITH RECURSIVE steps AS (SELECT k.sample_id, k.turn, stuck_for, list_concat(found, list_filter({_list(asking.DEFAULT_ORDER)}, lambda a: NOT list_contains(found, a))) AS attrs FROM (SELECT k.*, {found} AS found FROM keyed k LEFT JOIN policy_orders o ON o.pool = k.query LEFT JOIN wishes w ON w.sample_id = k.sample_id) k JOIN stuck USING (sample_id, turn)), "
        f"walk AS (SELECT sample_id, 0 AS turn, NULL::VARCHAR AS ask, []::VARCHAR[] AS asked FROM (SELECT DISTINCT sample_id FROM steps) UNION ALL SELECT sample_id, turn, ask, CASE WHEN ask IS NULL THEN asked ELSE list_append(asked, ask) END FROM (SELECT s.sample_id, s.turn, asked, "
        f"CASE WHEN stuck_for = 1 THEN 'other' WHEN stuck_for > 1 THEN {_list(asking.DEFAULT_ORDER)}[(stuck_for - 2) % 9 + 1] ELSE list_filter(attrs, lambda a: NOT list_contains(asked, a))[1] END AS ask FROM walk w JOIN steps s ON s.sample_id = w.sample_id AND s.turn = w.turn + 1)) SELECT sample_id, turn, ask FROM walk WHERE turn > 0)"
    )


def _copied(suffix: str, swapped: dict[str, str], *names: str) -> None:
    """Copies of views that read each other's copies, and ``swapped`` in place of others."""
    new = {n: n + suffix for n in names} | swapped
    for n in names:
        needs, body = _VIEWS[n]
        _VIEWS[n + suffix] = tuple(new.get(x, x) for x in needs), re.sub(r"\b(" + "|".join(new) + r")\b(?!')", lambda m: new[m[1]], body)


_copied("_s", {"catalog": "catalog_s"}, "texts", "postings", "df", "corpus", "parts", "ranked", "pool", "weights", "matched", "phrased")
_SAME = "h.s = x.s AND h.t = x.t"
_VIEWS["overrides_c"] = ("messages", "msg_slots"), (  # a slot's values turn after turn
    f"WITH RECURSIVE said AS (SELECT m.sample_id, m.turn, {_override('m.message')} AS literal, coalesce(found, []) AS slots FROM messages m LEFT JOIN (SELECT message, list({{'s': slot, 't': term}}) AS found FROM msg_slots GROUP BY 1) USING (message)), "
    "walk AS (SELECT sample_id, 0 AS turn, false AS over, [] :: STRUCT(s VARCHAR, t VARCHAR, f INTEGER)[] AS held, [] :: STRUCT(s VARCHAR, t VARCHAR)[] AS slots FROM (SELECT DISTINCT sample_id FROM said) UNION ALL "
    f"SELECT sample_id, turn, over, list_concat(kept, list_transform(list_filter(slots, lambda x: len(list_filter(kept, lambda h: {_SAME})) = 0), lambda x: {{'s': x.s, 't': x.t, 'f': turn}})), slots FROM ("
    "SELECT *, CASE WHEN over THEN list_filter(held, lambda h: len(list_filter(slots, lambda x: x.s = h.s)) = 0 AND (h.s IN ('category', 'department') OR h.f > 1)) ELSE held END AS kept FROM ("
    f"SELECT w.sample_id, s.turn, w.held, s.slots, s.literal OR len(list_filter(s.slots, lambda x: len(list_filter(w.held, lambda h: h.s = x.s)) > 0 AND len(list_filter(w.held, lambda h: {_SAME})) = 0)) > 0 AS over FROM walk w JOIN said s ON s.sample_id = w.sample_id AND s.turn = w.turn + 1))) "
    "SELECT sample_id, turn AS o, list_distinct(list_transform(slots, lambda x: x.s)) AS named FROM walk WHERE over"
)
_copied("_c", {"overrides": "overrides_c"}, "kills", "ledger")
_VIEWS["wanted_x"] = ("wanted",), f"SELECT DISTINCT query, unnest([term, {_norm('term')}]) AS term FROM wanted"
_VIEWS["ranked_x"] = ("wanted_x", "parts"), _bm25("wanted_x")


def _opening_facts(suffix: str) -> str:
    """The opening messages' hits among the ten best of a catalog."""
    return (
        "SELECT a.sample_id, scenario_type, place IS NOT NULL AS hit, CASE WHEN place IS NOT NULL THEN 1 END AS first_hit_turn, coalesce(1.0::DOUBLE / place, 0) AS reciprocal_rank FROM asked a LEFT JOIN (SELECT * FROM (SELECT query, ord, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank) AS place FROM "
        f"(SELECT m.query, m.ord, m.rank, round(m + 1.2::DOUBLE * ln(1 + rating_number) + CASE WHEN price IS NOT NULL THEN 2 ELSE 0 END + coalesce(ph, 0) + CASE WHEN complete THEN 4 ELSE 0 END, 9) AS score FROM matched{suffix} m JOIN texts{suffix} USING (ord) LEFT JOIN phrased{suffix} x ON x.query = m.query AND x.ord = m.ord)) WHERE place <= 10) b "
        "ON b.query = a.query AND b.ord::VARCHAR = a.target"
    )


def _long(metrics: str) -> str:
    return f"UNPIVOT (SELECT * EXCLUDE (sample_count) FROM ({_scored(_metrics(metrics))})) ON hit_rate, mrr, mttc, efficiency, score INTO NAME metric VALUE v"


_VIEWS["official_facts"] = ("asked", "matched", "texts", "phrased"), _opening_facts("")
_VIEWS["stress_facts"] = ("asked", "matched_s", "texts_s", "phrased_s"), _opening_facts("_s")
ORACLES |= {
    "dual_catalogs": _with(
        f", told AS (SELECT 'official' AS variant, * FROM ({_long('official_facts')}) UNION ALL SELECT 'coverage_stress', * FROM ({_long('stress_facts')})) SELECT variant, scenario_type, metric, v AS value FROM told UNION ALL SELECT 'delta', a.scenario_type, a.metric, round(b.v - a.v, 6) "
        "FROM told a JOIN told b ON a.variant = 'official' AND b.variant = 'coverage_stress' AND a.scenario_type = b.scenario_type AND a.metric = b.metric", "official_facts", "stress_facts").replace(" , told AS", ", told AS"),
    "conflict_ledger": _with("SELECT * FROM ledger_c", "ledger_c"),
    "latency_projection": "SELECT event_type, count(*) AS n, round(sum(value) / count(*), 6) AS mean, round(round(sum(value) / count(*), 6) * count(*) * 4 + 25, 6) AS projected FROM events GROUP BY 1",
    "stemmed_recall": _with(
        "SELECT coalesce(scenario_type, 'all') AS scenario_type, cutoff, count(*) AS sample_count, round(avg(CASE WHEN rank <= cutoff THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM (SELECT sample_id, scenario_type, p.rank FROM asked a LEFT JOIN (SELECT * FROM ranked_x WHERE rank <= 100) p ON p.query = a.query AND p.ord::VARCHAR = a.target), (SELECT unnest([10, 50, 100]) AS cutoff) GROUP BY GROUPING SETS ((cutoff), (cutoff, scenario_type))", "asked", "ranked_x"),
    "clarify_expected": _with(
        f"SELECT pool, array_to_string(attrs, ' ') AS attributes, list_filter(attrs, lambda a: a NOT IN ('color', 'size'))[1] AS next FROM (SELECT pool, list_concat(coalesce(found, []), list_filter({_list(asking.DEFAULT_ORDER)}, lambda a: NOT list_contains(coalesce(found, []), a))) AS attrs FROM (SELECT DISTINCT query AS pool FROM pool) LEFT JOIN ("
        "SELECT pool, list(attribute ORDER BY gain DESC, priority) AS found FROM (SELECT pool, attribute, priority, round(-sum(n / items::DOUBLE * log2(n / items::DOUBLE)), 9) AS gain FROM ("
        "SELECT pool, attribute, priority, n, items FROM answers UNION ALL SELECT pool, attribute, priority, items - sum(n), items FROM answers GROUP BY pool, attribute, priority, items HAVING items > sum(n)) GROUP BY 1, 2, 3) WHERE gain > 0 GROUP BY 1) USING (pool))", "pool", "answers"),
}

_NONE = "[]::VARCHAR[]"
#: Whole turns: each different query is retrieved and reranked once.
REPLAYED: dict[str, str] = {
    "policy_ablation": _with(
        "SELECT policy, part, turn, ask, count(*) AS n FROM (" + " UNION ALL ".join([
            _walked("fixed", _NONE), _walked("candidate", f"coalesce(o.by_count, {_NONE})"), _walked("entropy", f"coalesce(o.by_entropy, {_NONE})"), _walked("profile", "w.wanted"),
            # an order of one attribute that may be asked again and again
            f"SELECT sample_id, turn, CASE WHEN stuck_for > 1 THEN {_list(asking.DEFAULT_ORDER)}[(stuck_for - 2) % 9 + 1] ELSE 'other' END, 'other' FROM stuck",
        ]) + ") JOIN split USING (sample_id) GROUP BY 1, 2, 3, 4", "keyed", "stuck", "policy_orders", "wishes", "split"),
    "dead_turns": _with(
        "SELECT sample_id, turn, coalesce(b = terms, false) AND rank IS NULL AS dead "
        "FROM (SELECT *, lag(terms) OVER (PARTITION BY sample_id ORDER BY turn) AS b FROM turn_terms) JOIN turn_ranks USING (sample_id, turn)", "turn_terms", "turn_ranks"),
    "replay": _with(
        f"SELECT k.sample_id, k.turn, route, array_to_string(terms, ' ') AS terms, gained, stuck_for, coalesce(n, 0) AS candidates, rank, ask, coalesce((MAP {{{', '.join(f'{_q(a)}: {_q(q)}' for a, q in asking.QUESTIONS.items())}}})[ask], {_q(asking.NO_QUESTION)}) AS question "
        "FROM keyed k JOIN stuck USING (sample_id, turn) JOIN routed USING (sample_id) JOIN turn_ranks USING (sample_id, turn) JOIN asks USING (sample_id, turn) LEFT JOIN (SELECT query, count(*) AS n FROM turn_pool GROUP BY 1) c ON c.query = k.query", "keyed", "stuck", "routed", "turn_ranks", "asks"),
    "trace_summary": _with(
        f"SELECT sample_id, count(*) AS turns, count(*) FILTER (dead) AS dead_turns, coalesce(min(rank), 0) AS best_rank, coalesce(any_value(o), 0) AS override_turn, coalesce(max_by(rank, turn) FILTER (turn < o AND rank IS NOT NULL), 0) AS rank_before, coalesce(max(rank) FILTER (turn = o), 0) AS rank_at FROM "
        f"(SELECT *, coalesce(b = terms, false) AND rank IS NULL AS dead, min(turn) FILTER ({_override('message')}) OVER (PARTITION BY sample_id) AS o FROM (SELECT *, lag(terms) OVER (PARTITION BY sample_id ORDER BY turn) AS b FROM turn_terms) JOIN turn_ranks USING (sample_id, turn)) GROUP BY 1", "turn_terms", "turn_ranks"),
    "turn_ribbon": _with(f"SELECT sample_id, turn, rank IS NOT NULL AS is_hit, {_override('message')} AS is_override, coalesce(rank, 0) AS target_rank FROM turn_ranks JOIN messages USING (sample_id, turn)", "turn_ranks", "messages"),
    "session_metrics": _with(
        "SELECT *, round(0.5 * hit_rate + 0.3 * mrr + 0.2 * efficiency, 6) AS score FROM (SELECT *, round(coalesce(least(greatest((11 - mttc) / 10, 0), 1), 0), 6) AS efficiency FROM (SELECT coalesce(part, 'all') AS part, coalesce(difficulty_bucket, 'all') AS difficulty_bucket, count(*) AS sample_count, round(avg(hit::INTEGER::DOUBLE), 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mrr, round(avg(coalesce(first_hit_turn, 11)), 6) AS mttc "
        "FROM replay_facts JOIN split USING (sample_id) GROUP BY GROUPING SETS ((), (part), (part, difficulty_bucket))))", "replay_facts", "split"),
}
ORACLES |= REPLAYED
#: What is shown depends on what was: conversations turn after turn, those of the same queries once.
FOLDED: dict[str, str] = {
    "session_payload": _with(
        "SELECT sample_id, n_turns, n_shown, coalesce(hits, '') AS hits, sha256(coalesce(shown, '')) AS shown, sha256(coalesce(slots, '')) AS slots FROM (SELECT sample_id, count(*) AS n_turns FROM keyed GROUP BY 1) LEFT JOIN ("
        "SELECT sample_id, count(*) AS n_shown, string_agg(k.turn || ':' || b.rank || ':' || b.ord || ':' || c.title || ':' || (b.ord::VARCHAR = target), '|' ORDER BY k.turn, b.rank) AS shown, string_agg(k.turn || ':' || b.rank, ' ' ORDER BY k.turn) FILTER (b.ord::VARCHAR = target) AS hits "
        "FROM keyed k JOIN sessions USING (sample_id) JOIN turn_best b ON b.query = k.query JOIN catalog c ON c.ord = b.ord GROUP BY 1) USING (sample_id) LEFT JOIN ("
        "SELECT sample_id, string_agg(turn || ':' || slot || ':' || token || ':' || first_turn, '|' ORDER BY turn, slot, place) AS slots FROM active WHERE slot IS NOT NULL GROUP BY 1) USING (sample_id)", "keyed", "sessions", "turn_best", "catalog", "active"),
    "rejection_rerank": _with(
        ", course AS (SELECT sample_id, list({'t': turn, 's': stuck_for, 'q': query} ORDER BY turn) AS c FROM keyed JOIN stuck USING (sample_id, turn) GROUP BY 1), kinds AS (SELECT c, row_number() OVER () AS id FROM (SELECT DISTINCT c FROM course)), "
        "walk AS (WITH RECURSIVE w AS (SELECT id, 0 AS turn, []::BIGINT[] AS seen, []::BIGINT[] AS shown FROM kinds UNION ALL SELECT id, turn, list_concat(any_value(seen), list(ord ORDER BY s DESC, rank)[1:10]), list(ord ORDER BY s DESC, rank)[1:10] FROM ("
        "SELECT w.id, w.turn + 1 AS turn, w.seen, a.ord, a.rank, round(a.score - CASE WHEN k.c[w.turn + 1].s >= 1 THEN len(list_filter(w.seen, lambda x: x = a.ord)) ELSE 0 END, 9) AS s FROM w JOIN kinds k USING (id) JOIN turn_all a ON a.query = k.c[w.turn + 1].q WHERE w.turn < len(k.c)) GROUP BY id, turn) SELECT * FROM w) "
        "SELECT sample_id, turn, array_to_string(shown, ',') AS shown FROM course JOIN kinds USING (c) JOIN walk USING (id) WHERE turn > 0", "keyed", "stuck", "turn_all").replace(" , course AS", ", course AS"),
}
ORACLES |= FOLDED
