"""The registered queries of the screening engine and their SQL counterparts.

Views: the registry is ``part`` (p_name as title), submissions are the titles of
``pages``, and FIXTURES are literal titles for rules whose words the generated
tables lack.  Pairs are all ordered pairs of distinct part names, a bounded dimension.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masthead import vocab
from masthead.catalogue import GUIDELINES
from masthead.concepts import LEXICON
from masthead.functions import phonetic as ph
from masthead.functions import rules, text
from masthead.functions import similarity as sim
from masthead.operators import compound, evaluate, lexicon, registry, search, suggest
from masthead.operators.candidates import retrieve
from masthead.plans import apply, screen
from masthead.scratch import fixed
from masthead.sources import tables
from masthead.streaming import locks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FIXTURES = [
    "News+", "Daily*Express", "Star #1", "12345", "2024", "24 7", "The Daily Mumbai Express", "The Daily News", "Delta India", "Delta Bharat", "Delta World",
    "zzzzzzz", "asdfasdfasdf", "ghibrisg", "qwrtpzx", "The Daily Herald", "Prabhat Samachar", "Vishwa Varta", "BBC News India", "ISRO Bulletin", "NDTV Express",
    "The Crime Investigation Daily", "Mumbai Police Chronicle", "Green Harvest Agriculture Bulletin", "Tata", "TATA", "Tata!", "Microsoft", "Google", "Tata News",
    "Microsoft India", "Microsoft Times", "The Apple", "Apple Daily", "The Tata Express", "Red Cross", "Mumbai Daily", "Lok Sabha Times", "Ashoka Chakra Weekly",
    "Times of India", "The Times of India", "ghibrisg news", "Namascar India", "Zylophonic Quantum Astroflora", "Aurora Nebula Post", "Budget Bridge", "aaaaaaa bbb",
    "Half-Yearly Review", "Nav Bharat Vani", "Dainik Vani", "Scam Fraud Scam", "Who Is Who", "",
]
PAIRS = [
    ("Daily Evening", "Pratidin Sandhya"), ("Morning News", "Prabhat Samachar"), ("Peoples Voice", "Jan Vani"), ("Prabhat Samachar", "Sakala Sambad"),
    ("Pratidin Sandhya", "Rozana Shaam"), ("Daily News", "Solar Science"), ("Daily Light News", "Jyoti Express Weekly"), ("Delta", "Delta World"), ("", "Daily"), ("Sun Sun Moon", "Surya Chandra"),
]


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_quote(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_quote, words)) + "]"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fixture_titles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(FIXTURES)), "id long, title string")


def fixture_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "id long, a string, b string")


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


def all_titles(spark: SparkSession, sf: str) -> DataFrame:
    """(id, title): fixtures below 0, titles of pages even, part names odd."""
    pages = page_titles(spark, sf).select((F.col("page_id") * 2).cast("long").alias("id"), "title")
    parts = table(spark, sf, "part").select((F.col("p_partkey") * 2 + 1).cast("long").alias("id"), F.col("p_name").alias("title"))
    return fixture_titles(spark).select((-1 - F.col("id")).alias("id"), "title").unionByName(pages).unionByName(parts)


def part_registry(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("title"), F.concat(F.lit("REG/"), F.col("p_partkey")).alias("registration_no"), F.lit("English").alias("language"), F.lit("National").alias("state"), F.col("p_type").alias("periodicity"), F.col("p_brand").alias("publisher"))
    return registry.build_registry(p)


def names(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct part names, a bounded dimension of the generated data."""
    return table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()


def all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs: the measures have no common block, and the names are a bounded dimension."""
    a = names(spark, sf)
    return a.select(F.col("name").alias("a")).crossJoin(a.select(F.col("name").alias("b")))


NAMES = "names AS (SELECT DISTINCT p_name AS name FROM part), pairs AS (SELECT x.name AS a, y.name AS b FROM names x CROSS JOIN names y)"
TITLES = r"titles AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)"
FIX = _values("fixtures", "id, title", list(enumerate(FIXTURES)))
ALL_FIX = f"{TITLES}, {FIX.replace('fixtures(', 'literals(', 1)}, fixtures AS (SELECT -1 - id AS id, title FROM literals UNION ALL SELECT page_id * 2, title FROM titles UNION ALL SELECT p_partkey * 2 + 1, p_name FROM part)"
#: NFKD for letters whose mark comes off: the mark becomes a space.
DECOMPOSED = "array_to_string(list_transform(string_split({}, ''), lambda c: CASE WHEN c <> '' AND strip_accents(c) <> c THEN strip_accents(c) || ' ' ELSE c END), '')"
CLEAN = r"trim(regexp_replace(regexp_replace(lower(" + DECOMPOSED + r"), '[^\p{{L}}\p{{N}}_\s\p{{Z}}\-]', ' ', 'g'), '[\s\p{{Z}}\-]+', ' ', 'g'))"


def _clean(column: str) -> str:
    return CLEAN.format(column)


def _tokens(column: str) -> str:
    return f"list_filter(string_split({_clean(column)}, ' '), lambda t: t <> '')"


SPLIT = r"list_filter(string_split_regex(lower(regexp_replace({}, '[^\p{{L}}\p{{N}}_]', ' ', 'g')), ' +'), lambda t: t <> '')"


# ------------------------------------------------------------------ text and rules


@query(f"SELECT doc_id, md5({_clean('text')}) AS cleaned_md5, len({_tokens('text')})::BIGINT AS n_tokens FROM documents")
def clean_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("c"))
    return rows.select("doc_id", F.md5("c").alias("cleaned_md5"), F.size(text.tokens(F.col("c"))).cast("long").alias("n_tokens"))


_PROHIBITED = rules.PROHIBITED.replace("'", "''")


@query(rf"""WITH {TITLES} SELECT page_id, regexp_matches(title, '{_PROHIBITED}') AS prohibited, len(list_distinct(regexp_extract_all(title, '{_PROHIBITED}')))::BIGINT AS n_symbols FROM titles""")
def symbol_check(spark: SparkSession, sf: str) -> DataFrame:
    s = rules.prohibited_symbols(F.col("title"))
    return page_titles(spark, sf).select("page_id", F.col("title").rlike(rules.PROHIBITED).alias("prohibited"), F.size(s).cast("long").alias("n_symbols"))


@query(rf"WITH {ALL_FIX} SELECT id::BIGINT AS id, trim(title) = '' AS blank, regexp_matches(title, '\p{{L}}') AS has_letter FROM fixtures")
def numeric_check(spark: SparkSession, sf: str) -> DataFrame:
    return all_titles(spark, sf).select("id", rules.is_blank(F.col("title")).alias("blank"), F.col("title").rlike(r"\p{L}").alias("has_letter"))



_LETTERS = r"regexp_replace(lower({}), '[^\p{{L}}]', '', 'g')"
ENTROPY = "round(coalesce(list_sum(list_transform(list_distinct(list_filter(string_split({0}, ''), lambda c: c <> '')), lambda c: -((length({0}) - length(replace({0}, c, ''))) / length({0})) * log2((length({0}) - length(replace({0}, c, ''))) / length({0})))), 0), 3)"


def _entropy_sql(w: str) -> str:
    return ENTROPY.format(_LETTERS.format(w))


_GIBBERISH = rf"""CASE WHEN w = '' OR w IN ({", ".join(map(_quote, vocab.ACRONYMS))}) THEN NULL
 WHEN length(w) >= 5 AND (replace(w, w[1], '') = '' OR len(list_filter(range(2, length(w) // 2 + 1), lambda k: length(w) % k = 0 AND repeat(substr(w, 1, k), (length(w) // k)::INT) = w)) > 0) THEN 'REPETITIVE_GIBBERISH'
 WHEN length(w) >= 7 AND {_entropy_sql('w')} < 1.4 THEN 'LOW_ENTROPY_GIBBERISH'
 WHEN (length(w) > 3 AND (run >= 5 OR (run >= 4 AND vowels <= 1 AND length(w) >= 6) OR (length(w) >= 5 AND vowels = 0)))
   OR (length(w) > 2 AND (regexp_matches(w, '({"|".join(vocab.INVALID_ENDINGS)})$') OR bad >= 2 OR (bad >= 1 AND length(w) <= 6))) THEN 'UNPRONOUNCEABLE_GIBBERISH' END"""
_MEASURED = rf"""measured AS (SELECT *, coalesce(list_max(list_transform(regexp_extract_all(w, '[{vocab.CONSONANTS}]+'), lambda r: length(r))), 0) AS run, length(regexp_replace(w, '[^{vocab.VOWELS}]', '', 'g')) AS vowels,
 len(list_filter(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), lambda p: list_contains({_list(vocab.INVALID_BIGRAMS)}, p))) AS bad FROM words)"""


@query(rf"""WITH {FIX}, {TITLES}, words AS (SELECT DISTINCT lower(trim(t)) AS w FROM (SELECT unnest({_tokens('title')}) AS t FROM titles UNION ALL SELECT unnest({_tokens('p_name')}) FROM part UNION ALL SELECT unnest({_tokens('title')}) FROM fixtures)), {_MEASURED}
SELECT w AS word, {_GIBBERISH} AS gibberish FROM measured""")
def gibberish_words(spark: SparkSession, sf: str) -> DataFrame:
    own = lambda df: df.select(F.explode(text.tokens(text.clean_text(F.col("title")))).alias("word"))
    words = own(page_titles(spark, sf)).unionByName(own(table(spark, sf, "part").select(F.col("p_name").alias("title")))).unionByName(own(fixture_titles(spark))).distinct()
    return words.select("word", rules.gibberish_type(F.col("word")).alias("gibberish"))


@query(rf"WITH words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT w AS word, {_entropy_sql('w')} AS entropy FROM words")
def shannon_entropy(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", rules.entropy(F.col("word")).alias("entropy"))


_LEAD = f"coalesce(nullif(list_position(list_transform(t, lambda x: list_contains({_list(vocab.PREFIXES)}, x)), false), 0), len(t) + 1)"
_ANCHOR = rf"""toks AS (SELECT id, {_tokens('title')} AS t FROM fixtures), led AS (SELECT id, t, list_slice(t, {_LEAD}, len(t)) AS rest FROM toks),
 cut AS (SELECT id, t, rest, coalesce(nullif(list_position(list_transform(list_reverse(rest), lambda x: list_contains({_list(vocab.SUFFIXES)}, x)), false), 0), len(rest) + 1) - 1 AS trail FROM led),
 cored AS (SELECT id, t, list_slice(rest, 1, len(rest) - trail) AS core, list_filter(t, lambda x: NOT list_contains({_list(vocab.GENERIC_WORDS)}, x)) AS kept FROM cut)"""


@query(rf"""WITH {ALL_FIX}, {_ANCHOR} SELECT id::BIGINT AS id, CASE WHEN len(t) > 0 AND len(kept) = 0 THEN '' WHEN len(core) > 0 THEN array_to_string(core, ' ') ELSE coalesce(array_to_string(kept, ' '), '') END AS anchor, coalesce(array_to_string(kept, ' '), '') AS index_anchor FROM cored""")
def anchor_extract(spark: SparkSession, sf: str) -> DataFrame:
    rows = all_titles(spark, sf).withColumn("t", text.tokens(text.clean_text(F.col("title"))))
    return rows.select("id", text.anchor_parts(F.col("t"))["anchor"].alias("anchor"), text.index_anchor(F.col("t")).alias("index_anchor"))



@query(rf"WITH {ALL_FIX}, {_ANCHOR} SELECT id::BIGINT AS id, len(t) > 0 AND len(kept) = 0 AS generic_only FROM cored")
def generic_only(spark: SparkSession, sf: str) -> DataFrame:
    return all_titles(spark, sf).select("id", text.is_generic_only(text.tokens(text.clean_text(F.col("title")))).alias("generic_only"))



_WORDS_OF = r"list_filter(list_transform(list_filter(string_split_regex(title, '[\s\p{Z}]+'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '^[^\p{L}\p{N}_]+', ''), '[^\p{L}\p{N}_]+$', '')), lambda x: x <> '' AND NOT regexp_matches(x, '^\p{Nd}+$'))"


@query(rf"""WITH {TITLES}, {FIX}, all_titles AS (SELECT title, row_number() OVER () AS n FROM (SELECT title FROM titles UNION ALL SELECT title FROM fixtures)),
words AS (SELECT n, i, lower(ws[i]) AS w FROM (SELECT n, {_WORDS_OF} AS ws FROM all_titles), unnest(range(1, len(ws) + 1)) AS u(i)), {_MEASURED},
flagged AS (SELECT n, arg_min(g, i) AS g FROM (SELECT n, i, {_GIBBERISH} AS g FROM measured) WHERE g IS NOT NULL GROUP BY n)
SELECT coalesce(CASE WHEN trim(title) = '' THEN 'EMPTY_TITLE' WHEN regexp_matches(title, '{_PROHIBITED}') THEN 'PROHIBITED_SYMBOLS' WHEN NOT regexp_matches(title, '\p{{L}}') THEN 'PURE_NUMERIC' ELSE g END, 'VALID') AS verdict, count(*)::BIGINT AS n
FROM all_titles LEFT JOIN flagged USING (n) GROUP BY 1""")
def structure_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = page_titles(spark, sf).select("title").unionByName(fixture_titles(spark).select("title"))
    return rows.groupBy(F.coalesce(rules.structure_error(F.col("title")), F.lit("VALID")).alias("verdict")).agg(F.count("*").alias("n"))


_TERMS = _values("terms", "term, guideline_ref", [(t, "Guideline " + g) for t, g in vocab.ENFORCEMENT_TERMS + vocab.EMBLEM_TERMS])


@query(rf"""WITH {_TERMS}, docs AS (SELECT doc_id, ' ' || {_clean('text')} || ' ' AS c FROM documents UNION ALL SELECT -1 - id, ' ' || {_clean('title')} || ' ' FROM ({"SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quote(t)})" for i, t in enumerate(FIXTURES)) + ") AS f(id, title)"}))
SELECT DISTINCT doc_id::BIGINT AS doc_id, term, guideline_ref FROM docs JOIN terms ON contains(c, ' ' || term || ' ')""")
def blacklist_hits(spark: SparkSession, sf: str) -> DataFrame:
    terms = dict(vocab.ENFORCEMENT_TERMS + vocab.EMBLEM_TERMS)
    rows = table(spark, sf, "documents").select("doc_id", "text").unionByName(fixture_titles(spark).select((-1 - F.col("id")).alias("doc_id"), F.col("title").alias("text")))
    hits = rows.select("doc_id", F.explode(rules.terms_in(text.tokens(text.clean_text(F.col("text"))), list(terms))).alias("term"))
    refs = F.create_map(*[F.lit(x) for t, g in terms.items() for x in (t, "Guideline " + g)])
    return hits.select("doc_id", "term", F.element_at(refs, F.col("term")).alias("guideline_ref"))


@query(rf"""WITH {FIX}, toks AS (SELECT id, unnest({_tokens('title')}) AS t FROM fixtures UNION ALL SELECT -1 - doc_id, unnest({_tokens('text')}) FROM documents)
SELECT id::BIGINT AS id, t AS token, count(*)::BIGINT AS n FROM toks WHERE list_contains({_list(vocab.OBSCENE_TOKENS)}, t) GROUP BY ALL""")
def barred_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixture_titles(spark).unionByName(table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("id"), F.col("text").alias("title")))
    barred = spark.createDataFrame([(t,) for t in vocab.OBSCENE_TOKENS], "token string")
    toks = rows.select("id", F.explode(text.tokens(text.clean_text(F.col("title")))).alias("token"))
    return toks.join(F.broadcast(barred), "token").groupBy("id", "token").agg(F.count("*").alias("n"))


_PROTECTED = _values("protected", "key, name, category", [(k, d, c) for c, of in vocab.PROTECTED_NAMES.items() for k, d in of])


@query(rf"""WITH {ALL_FIX}, {_PROTECTED}, {_ANCHOR}, a AS (SELECT id, CASE WHEN len(t) > 0 AND len(kept) = 0 THEN '' WHEN len(core) > 0 THEN array_to_string(core, ' ') ELSE coalesce(array_to_string(kept, ' '), '') END AS anchor, array_to_string(t, ' ') AS cleaned FROM cored)
SELECT id::BIGINT AS id, coalesce(x.name, y.name) AS name, coalesce(x.category, y.category) AS category FROM a LEFT JOIN protected x ON x.key = cleaned LEFT JOIN protected y ON y.key = anchor WHERE coalesce(x.name, y.name) IS NOT NULL""")
def protected_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = screen.prepared(all_titles(spark, sf)).withColumn("p", rules.protected_name(F.col("cleaned_title"), F.col("anchor_words"))).filter("p is not null")
    return rows.select("id", "p.name", "p.category")



@query()
def violation_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = screen.prepared(all_titles(spark, sf))
    return rows.select("id", F.to_json(rules.violations(F.col("cleaned_title"), F.col("tokens"), F.col("anchor_words"))).alias("violations"))


#: The sizes that the vocabularies must have, stated apart from the lists.
_SIZES = {"generic": 179, "prefixes": 35, "suffixes": 74, "disallowed": 59, "obscene": 55, "guidelines": 20, "seeds": 31, "concepts": 26, "entries": 724, "words": 417, "languages": 12}


@query("SELECT vocabulary, n::BIGINT AS n FROM (VALUES " + ", ".join(f"('{k}', {n})" for k, n in _SIZES.items()) + ") AS v(vocabulary, n)")
def vocabulary_sizes(spark: SparkSession, sf: str) -> DataFrame:
    v = vocab
    rows = [("generic", len(v.GENERIC_WORDS)), ("prefixes", len(v.PREFIXES)), ("suffixes", len(v.SUFFIXES)), ("disallowed", len(v.ENFORCEMENT_TERMS) + len(v.EMBLEM_TERMS)), ("obscene", len(v.OBSCENE_TOKENS))]
    counted = spark.createDataFrame(rows, "vocabulary string, n long")
    of = lexicon.default_lexicon(spark).agg(F.count_distinct("concept").alias("concepts"), F.count("*").alias("entries"), F.count_distinct("word").alias("words"), F.count_distinct("language").alias("languages"))
    for name, rows in (("guidelines", tables.guidelines(spark)), ("seeds", tables.seed_registry(spark))):
        counted = counted.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("vocabulary"), "n"))
    return counted.unionByName(of.unpivot([], of.columns, "vocabulary", "n"))


# ------------------------------------------------------------------ registry and joins


@query(rf"""SELECT p_partkey AS entry_id, {_clean('p_name')} AS cleaned_title, len({_tokens('p_name')})::BIGINT AS n_tokens, coalesce(array_to_string(list_filter({_tokens('p_name')}, lambda t: NOT list_contains({_list(vocab.GENERIC_WORDS)}, t)), ' '), '') AS anchor_words FROM part WHERE {_clean('p_name')} <> ''""")
def registry_projection(spark: SparkSession, sf: str) -> DataFrame:
    return part_registry(spark, sf).select("entry_id", "cleaned_title", F.size("tokens").cast("long").alias("n_tokens"), "anchor_words")


@query("SELECT row_number() OVER (ORDER BY s_name, s_suppkey) - 1 AS entry_id, s_name AS title, 'REG/' || (row_number() OVER (ORDER BY s_name, s_suppkey) + 99999) AS registration_no, 'English' AS language, 'National' AS state FROM supplier")
def mapped_columns(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "supplier").select(F.col("s_name").alias("Title Name"), F.col("s_suppkey").cast("string").alias("Publisher"))
    return registry.numbered(registry.map_columns(raw), ["title", "publisher"]).select("entry_id", "title", "registration_no", "language", "state")


@query("SELECT p_name AS cleaned_title, max(p_partkey) AS match_id FROM part GROUP BY 1")
def exact_match_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return registry.exact_index(part_registry(spark, sf)).select("cleaned_title", "match_id")


_PART_ANCHOR = f"array_to_string(list_filter(string_split(p_name, ' '), lambda t: NOT list_contains({_list(vocab.GENERIC_WORDS)}, t)), ' ')"


@query(f"SELECT part FROM (SELECT p_name AS part FROM part UNION SELECT {_PART_ANCHOR} FROM part) WHERE length(part) > 2")
def registry_parts(spark: SparkSession, sf: str) -> DataFrame:
    return registry.title_parts(part_registry(spark, sf)).select("part")


_JOINED = "made AS (SELECT x.p_partkey AS query_id, x.p_name || ' ' || y.p_name || CASE WHEN x.p_partkey % 3 = 0 THEN ' ' || x.p_name WHEN x.p_partkey % 3 = 1 THEN ' quite new' ELSE '' END AS title FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"


@query(f"""WITH {_JOINED}, parts AS (SELECT DISTINCT p_name AS part FROM part), toks AS (SELECT query_id, string_split(title, ' ') AS t FROM made),
two AS (SELECT query_id, i * 1000000 AS ord, [array_to_string(t[1:i], ' '), array_to_string(t[i + 1:], ' ')] AS ps FROM toks, unnest(range(1, len(t))) AS u(i)),
three AS (SELECT query_id, 1000000000 + i * 1000 + j AS ord, [array_to_string(t[1:i], ' '), array_to_string(t[i + 1:j], ' '), array_to_string(t[j + 1:], ' ')] AS ps FROM toks, unnest(range(1, len(t) - 1)) AS u(i), unnest(range(i + 1, len(t))) AS v(j)),
each AS (SELECT query_id, ord, ps, unnest(ps) AS part FROM (SELECT * FROM two UNION ALL SELECT * FROM three)),
hit AS (SELECT query_id, ord, any_value(ps) AS ps FROM each JOIN parts USING (part) GROUP BY query_id, ord HAVING count(*) = len(any_value(ps)))
SELECT query_id, array_to_string(arg_min(ps, ord), ' + ') AS components FROM hit GROUP BY query_id""")
def compound_splits(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    tail = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_name")).when(F.col("p_partkey") % 3 == 1, " quite new").otherwise("")
    made = p.join(nxt, "p_partkey").select(F.col("p_partkey").alias("query_id"), F.split(F.concat("p_name", F.lit(" "), "other", tail), " ").alias("tokens"))
    found = compound.compound_titles(made, registry.title_parts(part_registry(spark, sf)))
    return found.select("query_id", F.array_join("components", " + ").alias("components"))


@query("""WITH w AS (SELECT p_partkey AS entry_id, u.pos - 1 AS pos, string_split(p_name, ' ')[u.pos] AS key FROM part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS u(pos))
SELECT key, count(*)::BIGINT AS n, min(entry_id) AS first_id, max(entry_id) AS last_id FROM w WHERE length(key) >= 2 GROUP BY key""")
def postings_words(spark: SparkSession, sf: str) -> DataFrame:
    return _postings(spark, sf).filter("kind = 'word'").groupBy("key").agg(F.count("*").alias("n"), F.min("entry_id").alias("first_id"), F.max("entry_id").alias("last_id"))


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    reg = part_registry(spark, sf)
    return registry.build_postings(reg, registry.token_dimension(reg, lexicon.word_concepts(lexicon.default_lexicon(spark))))


@query(f"""WITH t AS (SELECT p_partkey AS entry_id, coalesce(nullif({_PART_ANCHOR}, ''), p_name) AS name FROM part), g AS (SELECT entry_id, i AS pos, substr('_' || name || '_', i, 3) AS key FROM t, unnest(range(1, length(name) + 1)) AS u(i)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY entry_id, pos) AS n FROM g) SELECT key, count(*)::BIGINT AS n, max(entry_id) AS last_id FROM r WHERE n <= 50 GROUP BY key""")
def postings_grams_capped(spark: SparkSession, sf: str) -> DataFrame:
    return _postings(spark, sf).filter("kind = 'gram'").groupBy("key").agg(F.count("*").alias("n"), F.max("entry_id").alias("last_id"))


@query()
def candidates_top100(spark: SparkSession, sf: str) -> DataFrame:
    index = screen.build_index(part_registry(spark, sf))
    titles = names(spark, sf).select(F.xxhash64("name").alias("query_id"), F.concat("name", F.lit(" gazette")).alias("title"))
    subs = screen.prepared(titles.unionByName(page_titles(spark, sf).select(F.col("page_id").cast("long").alias("query_id"), "title")))
    subs = fixed(subs.select("query_id", "cleaned_title", "tokens", "anchor_words", F.split("anchor_words", " ").alias("anchor_tokens")), "submissions")
    words = subs.select(F.explode("tokens").alias("word")).distinct().select(F.array("word").alias("tokens"))
    return retrieve(subs, index.postings, fixed(registry.token_dimension(words, index.concepts), "dimension"))


#: One search for each tier, several together, a number, and one that finds nothing.
SEARCHES = ["blue bolt", "blue", "REG/12", "super gizmo", "cold gears and rods", "izm", "old", "nothing like it"]


@query(f"""WITH qs(q, c) AS (VALUES {", ".join(f"({_quote(q)}, {_quote(q.lower().replace('/', ' '))})" for q in SEARCHES)}),
t AS (SELECT q, c, p_partkey AS entry_id, p_name AS title, 'REG/' || p_partkey AS reg, coalesce({_PART_ANCHOR}, '') AS anchor FROM part, qs),
r AS (SELECT q, entry_id, title, CASE WHEN title = q OR reg = q OR title = c OR anchor = c THEN 1 WHEN starts_with(title, q) OR starts_with(reg, q) OR starts_with(title, c) OR starts_with(anchor, c) THEN 2
 WHEN list_contains(list_transform(list_filter(string_split(c, ' '), lambda x: length(x) >= 3), lambda x: starts_with(anchor, x) OR starts_with(title, x)), true) THEN 2 + list_position(list_transform(list_filter(string_split(c, ' '), lambda x: length(x) >= 3), lambda x: starts_with(anchor, x) OR starts_with(title, x)), true)
 WHEN contains(title, q) OR contains(title, c) THEN 1000 END AS tier FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, entry_id) AS place, min(tier) OVER (PARTITION BY q) AS first FROM r WHERE tier IS NOT NULL)
SELECT q AS query, entry_id, title, tier::INTEGER AS tier FROM n WHERE place <= 20 AND (tier < 1000 OR first = 1000)""")
def search_tiers(spark: SparkSession, sf: str) -> DataFrame:
    reg = part_registry(spark, sf)
    found = [search.search(reg, q, q.lower().replace("/", " "), 20).select(F.lit(q).alias("query"), "entry_id", "title", "tier") for q in SEARCHES]
    return functools.reduce(DataFrame.unionByName, found)


@query("""WITH t AS (SELECT c_custkey AS entry_id, c_name AS title, CASE WHEN c_name = 'Customer#000000012' THEN 1 WHEN starts_with(c_name, 'Customer#000000012') THEN 2 END AS tier FROM customer) SELECT entry_id, title, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, entry_id LIMIT 50""")
def search_exact(spark: SparkSession, sf: str) -> DataFrame:
    reg = table(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("registration_no"), F.lower("c_name").alias("cleaned_title"), F.lit("").alias("anchor_words"))
    return search.search(reg, "Customer#000000012", "", 50).select("entry_id", "title", "tier")


@query("SELECT coalesce(nullif(CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END, ''), 'N/A') AS registration_no, count(*)::BIGINT AS n FROM part GROUP BY 1")
def display_defaults(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")).alias("registration_no"))
    return search.shown(rows).groupBy("registration_no").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ similarity


@query(f"WITH {NAMES} SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity FROM pairs")
def levenshtein_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return all_pairs(spark, sf).select("a", "b", F.round(sim.levenshtein_sim(F.col("a"), F.col("b")), 6).alias("similarity"))



@query(f"WITH {NAMES} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS similarity FROM pairs")
def jaro_winkler_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return all_pairs(spark, sf).select("a", "b", F.round(sim.jaro_winkler_udf("a", "b"), 6).alias("similarity"))



_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 1), lambda i: substr('_' || {0} || '_', i, 3)))"


@query(f"WITH {NAMES} SELECT a, b, round(2 * len(list_intersect({_GRAMS.format('a')}, {_GRAMS.format('b')})) / (len({_GRAMS.format('a')}) + len({_GRAMS.format('b')})), 6) AS similarity FROM pairs")
def dice_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    return all_pairs(spark, sf).select("a", "b", F.round(sim.dice(F.col("a"), F.col("b")), 6).alias("similarity"))



@query(f"WITH {NAMES} SELECT a, b, round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))), 6) AS similarity FROM pairs")
def token_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return all_pairs(spark, sf).select("a", "b", F.round(sim.token_jaccard(F.split("a", " "), F.split("b", " ")), 6).alias("similarity"))



@query()
def token_sort_ratio(spark: SparkSession, sf: str) -> DataFrame:
    ordered = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    return all_pairs(spark, sf).select("a", "b", F.round(sim.indel_ratio_udf(ordered("a"), ordered("b")), 6).alias("ratio"))


@query()
def orthographic_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return all_pairs(spark, sf).withColumn("s", sim.orthographic_udf("a", "b")).select("a", "b", "s.*")


@query()
def phonetic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return all_pairs(spark, sf).select("a", "b", sim.phonetic_udf("a", "b").alias("similarity"))


_INDIC = "lower(trim(w))"
for _pattern, _to in vocab.INDIC_REWRITES:
    _p, _t = (_pattern.replace("(?=[eiy])", "([eiy])"), _to + r"\1") if "(?=" in _pattern else (_pattern, _to)
    _INDIC = f"regexp_replace({_INDIC}, '{_p}', '{_t}', 'g')"
_INDIC = f"regexp_replace({_INDIC}, '[^a-z]', '', 'g')"
_WORDS = "words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT unnest(['bharat', 'barat', 'khabar', 'dainik', 'daineq', 'sooraj', 'vani', 'qaumi', 'namaskar', 'mannan', 'x1z', 'aachchha']))"
_WORDS += ")"


def _some_words(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.createDataFrame([(w,) for w in ("bharat", "barat", "khabar", "dainik", "daineq", "sooraj", "vani", "qaumi", "namaskar", "mannan", "x1z", "aachchha")], "word string")
    return table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).unionByName(extra).distinct()


@query(f"WITH {_WORDS} SELECT w AS word, {_INDIC} AS normal FROM words")
def indic_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _some_words(spark, sf).select("word", ph.indic_normal(F.col("word")).alias("normal"))


_RUNS = "translate(normal, 'bfpvwcgjkqsxzdtlmnraeiouyh', '1111122222222334556" + "0" * 7 + "')"
for _d in "0123456":
    _RUNS = f"regexp_replace({_RUNS}, '{_d}+', '{_d}', 'g')"


@query(f"WITH {_WORDS}, n AS (SELECT w, {_INDIC} AS normal FROM words) SELECT w AS word, CASE WHEN normal = '' THEN '' ELSE rpad(upper(normal[1]) || replace(substr({_RUNS}, 2), '0', ''), 5, '0') END AS code FROM n")
def indic_soundex(spark: SparkSession, sf: str) -> DataFrame:
    return _some_words(spark, sf).select("word", ph.indic_soundex(F.col("word")).alias("code"))


@query()
def double_metaphone(spark: SparkSession, sf: str) -> DataFrame:
    return _some_words(spark, sf).withColumn("dm", ph.double_metaphone_udf("word")).select("word", "dm.*")


@query(f"WITH {_WORDS} SELECT w AS word, (('0x' || substr(sha256('WORD:' || w), 1, 8))::BIGINT % 2048)::INTEGER AS bucket FROM words UNION ALL SELECT 'CONCEPT:daily', 719")
def hash_bucket(spark: SparkSession, sf: str) -> DataFrame:
    rows = _some_words(spark, sf).select("word", sim.hash_bucket(F.concat(F.lit("WORD:"), "word")).alias("bucket"))
    return rows.unionByName(spark.range(1).select(F.lit("CONCEPT:daily").alias("word"), sim.hash_bucket(F.lit("CONCEPT:daily")).alias("bucket")))


def _hash_units(spark: SparkSession, sf: str) -> DataFrame:
    toks = F.split("name", " ")
    feats = names(spark, sf).select("name", F.explode(sim.vector_features(toks, F.transform(toks, lambda t: F.lit(None).cast("string")))).alias("x"))
    buckets = feats.groupBy("name", sim.hash_bucket(F.col("x.feature")).alias("k")).agg(F.sum("x.weight").alias("w"))
    return buckets.join(buckets.groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "name").select("name", "k", (F.col("w") / F.col("norm")).alias("w"))


@query(f"""WITH {NAMES}, feats AS (SELECT name, 'WORD:' || unnest(string_split(name, ' ')) AS f, 1.0 AS w FROM names UNION ALL SELECT name, 'GRAM:' || substr('_' || t || '_', i, 3), 0.3 FROM (SELECT name, unnest(string_split(name, ' ')) AS t FROM names), unnest(range(1, length(t) + 1)) AS u(i)),
buckets AS (SELECT name, ('0x' || substr(sha256(f), 1, 8))::BIGINT % 2048 AS k, sum(w)::DOUBLE AS w FROM feats GROUP BY ALL), norms AS (SELECT name, sqrt(sum(w * w)) AS n FROM buckets GROUP BY name),
dots AS (SELECT x.name AS a, y.name AS b, sum(x.w * y.w) AS d FROM buckets x JOIN buckets y USING (k) GROUP BY ALL)
SELECT a, b, round(coalesce(d / p.n / q.n, 0), 4) AS cosine FROM pairs JOIN norms p ON p.name = a JOIN norms q ON q.name = b LEFT JOIN dots USING (a, b)""")
def hash_vector_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs; those without a common bucket have 0."""
    unit = _hash_units(spark, sf)
    met = unit.select(F.col("name").alias("a"), "k", F.col("w").alias("x")).join(unit.select(F.col("name").alias("b"), "k", F.col("w").alias("y")), "k")
    dots = met.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    return all_pairs(spark, sf).join(dots, ["a", "b"], "left").select("a", "b", F.round(F.coalesce("d", F.lit(0.0)), 4).alias("cosine"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, vec_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 4) AS cosine FROM q, embeddings""")
def embedding_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """A stated query set against all rows; only the queries are broadcast, in blocks."""
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = e.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).crossJoin(q)
    return rows.select("query_id", "vec_id", F.round(dot(F.col("q"), F.col("v")) / F.sqrt(dot(F.col("q"), F.col("q"))) / F.sqrt(dot(F.col("v"), F.col("v"))), 4).alias("cosine"))


_LEXICON = _values("entries", "word, concept, language, ord", [(w, c, lang, i) for i, (w, c, lang) in enumerate((w.lower(), c, lang) for c, _, v in LEXICON for lang, ws in v.items() for w in ws)])
_CONCEPTS = f"{_LEXICON}, concepts AS (SELECT word, arg_max(concept, ord) AS concept, arg_max(language, ord) AS language FROM entries GROUP BY word)"


@query(f"WITH {_CONCEPTS} SELECT word, concept, language FROM concepts")
def lexicon_words(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.word_concepts(lexicon.default_lexicon(spark)).select("word", "concept", "language")


_PAIRS = _values("fp", "id, a, b", [(i, *p) for i, p in enumerate(PAIRS)])


@query(f"""WITH {_CONCEPTS}, {_PAIRS}, sized AS (SELECT id, a, b, len({SPLIT.format('a')}) AS n, len({SPLIT.format('b')}) AS m FROM fp),
ca AS (SELECT id, concept, count(*) AS k FROM (SELECT id, unnest({SPLIT.format('a')}) AS word FROM fp) JOIN concepts USING (word) GROUP BY ALL), cb AS (SELECT id, concept, count(*) AS k FROM (SELECT id, unnest({SPLIT.format('b')}) AS word FROM fp) JOIN concepts USING (word) GROUP BY ALL),
hits AS (SELECT id, sum(least(ca.k, cb.k)) AS h FROM ca JOIN cb USING (id, concept) GROUP BY id)
SELECT id::BIGINT AS id, CASE WHEN n = 0 OR m = 0 OR h IS NULL THEN 0.0 WHEN h >= least(n, m) THEN greatest(0.9, round(h / greatest(n, m), 4)) ELSE round(h / greatest(n, m), 4) END::DOUBLE AS lexicon FROM sized LEFT JOIN hits USING (id)""")
def lexicon_similarity(spark: SparkSession, sf: str) -> DataFrame:
    concepts = lexicon.word_concepts(lexicon.default_lexicon(spark)).select("word", "concept")
    pairs = fixture_pairs(spark).withColumns({"x": text.scorer_tokens(F.col("a")), "y": text.scorer_tokens(F.col("b"))})

    def counted(side: str, n: str) -> DataFrame:
        return pairs.select("id", F.explode(side).alias("word")).join(F.broadcast(concepts), "word").groupBy("id", "concept").agg(F.count("*").alias(n))

    hits = counted("x", "k").join(counted("y", "l"), ["id", "concept"]).groupBy("id").agg(F.sum(F.least("k", "l")).alias("h"))
    n, m, h = F.size("x"), F.size("y"), F.col("h")
    score = F.round(h / F.greatest(n, m), 4)
    return pairs.join(hits, "id", "left").select("id", F.when((n == 0) | (m == 0) | h.isNull(), 0.0).when(h >= F.least(n, m), F.greatest(F.lit(0.9), score)).otherwise(score).alias("lexicon"))


@query()
def semantic_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    score = sim.semantic_udf(lexicon.concept_map(lexicon.default_lexicon(spark)))
    return fixture_pairs(spark).withColumn("s", score("a", "b")).select("id", "s.*")


@query(f"""WITH {NAMES}, s AS (SELECT a, b, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS v FROM pairs WHERE a <> b), r AS (SELECT a, b, v, row_number() OVER (PARTITION BY a ORDER BY v DESC, b) AS place FROM s)
SELECT a, b, place::INTEGER AS place, round(v, 6) AS similarity FROM r WHERE place <= 5""")
def top_matches(spark: SparkSession, sf: str) -> DataFrame:
    s = all_pairs(spark, sf).filter("a <> b").withColumn("v", sim.levenshtein_sim(F.col("a"), F.col("b")))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("v"), "b"))).filter("place <= 5").select("a", "b", "place", F.round("v", 6).alias("similarity"))



# ------------------------------------------------------------------ decisions and reports


@query("SELECT p_partkey, CASE WHEN p_size <= 1 THEN p_size * 100 ELSE p_size END::INTEGER AS percent, CASE WHEN p_size * 2 >= 70 THEN 'high' WHEN p_size * 2 >= 40 THEN 'medium' ELSE 'low' END AS band, p_size < 20 OR p_type LIKE '%BRASS%' AS failed FROM part")
def display_bands(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    status = F.when(F.col("p_type").contains("BRASS"), "Rejected").otherwise("Approved")
    return p.select("p_partkey", apply.shown_percent(F.col("p_size").cast("double")).alias("percent"), apply.band(F.col("p_size") * 2).alias("band"), apply.failed_badge(F.col("p_size") * 2, status).alias("failed"))


@query("SELECT o_orderstatus AS status, o_totalprice < 40000 AND o_orderstatus = 'F' AS turned_away, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def application_gate(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderstatus", (F.col("o_totalprice") / 1000).alias("p"))
    gone = apply.turned_away(F.col("p"), F.when(F.col("o_orderstatus") == "F", "Rejected").otherwise("Approved"))
    return o.groupBy(F.col("o_orderstatus").alias("status"), gone.alias("turned_away")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS bound, count(*)::BIGINT AS n, count_if(CASE WHEN value > 50 THEN value >= 60 ELSE value <= 40 END)::BIGINT AS met FROM events GROUP BY 1")
def expectation_check(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    none, high = F.lit(None).cast("double"), F.col("value") > 50
    ok = evaluate.met(F.col("value"), none, F.when(high, 60.0), F.when(~high, 40.0), F.lit("x"), F.lit(None).cast("string"))
    return e.groupBy(F.when(high, "high").otherwise("low").alias("bound")).agg(F.count("*").alias("n"), F.count_if(ok).alias("met"))


@query(f"WITH {NAMES} SELECT 'title_lock:' || name AS key FROM names")
def lock_keys(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select(apply.lock_key(text.clean_text(F.col("name"))).alias("key"))


@query(f"WITH {_CONCEPTS}, w AS (SELECT DISTINCT concept, word FROM entries) SELECT concept, array_to_string(list_sort(list(word)), ' ') AS words FROM w GROUP BY concept")
def lexicon_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.concept_words(lexicon.default_lexicon(spark)).select("concept", F.array_join("words", " ").alias("words"))


@query("SELECT s_name, count(*)::BIGINT AS n FROM supplier GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT p_brand, count(*) FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("registration_no")).unionByName(table(spark, sf, "part").select(F.col("p_brand").alias("registration_no")))
    return tables.repeated_numbers(rows).select(F.col("registration_no").alias("s_name"), F.col("count").alias("n"))


@query(f"""WITH {NAMES}, s AS (SELECT 100 - round(100 * (1 - levenshtein(a, b) / greatest(length(a), length(b))), 1) AS p FROM pairs)
SELECT CASE WHEN p >= 70 THEN 'high' WHEN p >= 40 THEN 'medium' ELSE 'low' END AS band, count(*)::BIGINT AS n FROM s GROUP BY 1""")
def status_bands(spark: SparkSession, sf: str) -> DataFrame:
    p = all_pairs(spark, sf).select(F.greatest(F.lit(0.0), 100 - F.round(100 * sim.levenshtein_sim(F.col("a"), F.col("b")), 1)).alias("p"))
    return p.groupBy(F.when(F.col("p") >= 70, "high").when(F.col("p") >= 40, "medium").otherwise("low").alias("band")).agg(F.count("*").alias("n"))



@query(f"""WITH {NAMES}, s AS (SELECT 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS v FROM pairs)
SELECT count(*)::BIGINT AS total, count_if(v < 0.45)::BIGINT AS approved, count_if(v >= 0.65)::BIGINT AS rejected, count_if(v >= 0.45 AND v < 0.65)::BIGINT AS review_needed FROM s""")
def batch_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = all_pairs(spark, sf).select(sim.levenshtein_sim(F.col("a"), F.col("b")).alias("v"))
    return screen.batch_summary(v.select(F.when(F.col("v") >= sim.REJECT, "Rejected").when(F.col("v") >= sim.REVIEW, "Review Needed").otherwise("Approved").alias("status")))



@query("SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1")
def percentile_latency(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.latency(table(spark, sf, "events"), "event_type", "value")
    return out.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "p95", "p99")])


@query("""WITH j AS (SELECT n_chars > 1000 AS p, quality = 1 AS a FROM labels JOIN documents USING (doc_id)), c AS (SELECT count_if(p AND a)::BIGINT AS tp, count_if(p AND NOT a)::BIGINT AS fp, count_if(NOT p AND NOT a)::BIGINT AS tn, count_if(NOT p AND a)::BIGINT AS fn FROM j)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    out = evaluate.confusion(rows, F.col("n_chars") > 1000, F.col("quality") == 1)
    return out.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_GUIDELINES = ", ".join("(" + ", ".join([*(_quote(x or "") for x in g[:4]), _list(g[4])]) + ")" for g in GUIDELINES)
GUIDELINE_SEARCHES = ["extortion", "title", "GUIDELINE 1", "india", "no such word"]


@query(f"""WITH g(guideline_ref, category, title, description, examples) AS (VALUES {_GUIDELINES}), qs(q) AS (VALUES {", ".join(f"({_quote(q)})" for q in GUIDELINE_SEARCHES)})
SELECT q AS query, guideline_ref FROM g, qs WHERE contains(lower(guideline_ref || chr(10) || category || chr(10) || title || chr(10) || description || chr(10) || array_to_string(examples, chr(10))), lower(q))""")
def guideline_search(spark: SparkSession, sf: str) -> DataFrame:
    of = tables.guidelines(spark)
    return functools.reduce(DataFrame.unionByName, [tables.find_guidelines(of, q).select(F.lit(q).alias("query"), "guideline_ref") for q in GUIDELINE_SEARCHES])


# ------------------------------------------------------------------ locks


#: Whole seconds, the nearest and of two the even one, as the SQL's cast takes them; ``unix_seconds`` would cut.
_SECOND = "rint(unix_micros(cast(ts as timestamp)) / 1e6D)"


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    action = F.when(F.col("event_type") == "purchase", "release").otherwise("acquire")
    return e.select(F.concat(F.lit("k"), F.col("user_id") % 50).alias("key"), F.expr(_SECOND).alias("at"), F.col("event_id").alias("request"), F.col("user_id").cast("string").alias("applicant"), action.alias("action"))


_FOLD = """WITH RECURSIVE r AS (SELECT 'k' || (user_id % 50) AS key, epoch(ts)::BIGINT::DOUBLE AS sec, event_id AS request, user_id::VARCHAR AS applicant, CASE WHEN event_type = 'purchase' THEN 'release' ELSE 'acquire' END AS action,
 row_number() OVER (PARTITION BY user_id % 50 ORDER BY epoch(ts)::BIGINT, event_id) AS n FROM events),
f AS (SELECT key, n, sec, request, action, action = 'acquire' AS granted, CASE WHEN action = 'acquire' THEN applicant END AS holder, CASE WHEN action = 'acquire' THEN sec + 600 ELSE 0.0 END AS until FROM r WHERE n = 1
UNION ALL SELECT r.key, r.n, r.sec, r.request, r.action,
 CASE WHEN r.action = 'acquire' THEN f.holder IS NULL OR f.until <= r.sec ELSE f.holder IS NOT NULL AND f.until > r.sec AND f.holder = r.applicant END,
 CASE WHEN r.action = 'acquire' THEN CASE WHEN f.holder IS NULL OR f.until <= r.sec THEN r.applicant ELSE f.holder END WHEN f.holder IS NOT NULL AND f.until > r.sec AND f.holder = r.applicant THEN NULL ELSE f.holder END,
 CASE WHEN r.action = 'acquire' THEN CASE WHEN f.holder IS NULL OR f.until <= r.sec THEN r.sec + 600 ELSE f.until END WHEN f.holder IS NOT NULL AND f.until > r.sec AND f.holder = r.applicant THEN 0.0 ELSE f.until END
 FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)"""


@query(_FOLD + " SELECT key, request, granted FROM f")
def lock_replay(spark: SparkSession, sf: str) -> DataFrame:
    return locks.replay(_requests(spark, sf)).select("key", "request", "granted")


@query(_FOLD + """, cut AS (SELECT quantile_disc(epoch(ts)::BIGINT, 0.5)::DOUBLE AS now FROM events), last AS (SELECT key, arg_max(holder, n) AS holder, arg_max(until, n) AS until FROM f, cut WHERE sec <= now GROUP BY key)
SELECT key, holder, until AS expires_at FROM last, cut WHERE holder IS NOT NULL AND until > now""")
def active_locks(spark: SparkSession, sf: str) -> DataFrame:
    now = table(spark, sf, "events").agg(F.expr(f"percentile_disc(0.5) within group (order by {_SECOND})")).first()[0]
    return locks.active(locks.replay(_requests(spark, sf)), float(now)).select("key", "holder", "expires_at")


# ------------------------------------------------------------------ suggestions, export, screening

_CAP = "array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_MADE = [f"'{p} ' || t" for p in vocab.LANGUAGE_AFFIXES["English"][0][:3]] + [f"t || ' {s}'" for s in vocab.LANGUAGE_AFFIXES["English"][1][:3]] + ["'Maharashtra ' || t", "'Delhi ' || t", "'Bharat ' || t"]
_MADE += [f"t || ' {b}'" for b in suggest.BRANDS] + [f"'{c} ' || t" for c in suggest.COMPOUNDS]


@query(f"WITH {NAMES}, c AS (SELECT name, {_CAP} AS t FROM names) SELECT DISTINCT name, unnest([{', '.join(_MADE)}]) AS suggestion FROM c")
def suggestions_generate(spark: SparkSession, sf: str) -> DataFrame:
    rows = names(spark, sf).select(F.col("name").alias("query_id"), F.col("name").alias("title"), F.col("name").alias("anchor_words"), F.lit("English").alias("language"), F.lit("National").alias("state"))
    return suggest.generate(rows).select(F.col("query_id").alias("name"), F.col("title").alias("suggestion"))


@query()
def screen_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    index = screen.build_index(part_registry(spark, sf))
    subs = fixture_titles(spark).select(F.col("id").alias("query_id"), "title").unionByName(page_titles(spark, sf).select((F.col("page_id") + 1000).alias("query_id"), "title")).unionByName(names(spark, sf).select((F.xxhash64("name")).alias("query_id"), F.concat("name", F.lit(" Review")).alias("title")))
    out = screen.screen(subs, index)
    return out.select("query_id", "title", "decision", "status", "verification_probability", "highest_similarity", "n_candidates", F.to_json("top_matches").alias("top_matches"), F.to_json("reasons").alias("reasons"))


@query()
def screen_seed_registry(spark: SparkSession, sf: str) -> DataFrame:
    index = screen.build_index(tables.load_registry(spark))
    return screen.screen(all_titles(spark, sf).select(F.col("id").alias("query_id"), "title"), index).select("query_id", "title", "decision", "status", "verification_probability")


@query()
def apply_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Each title is asked for by two applicants, one after the other."""
    index = screen.build_index(part_registry(spark, sf))
    rows = all_titles(spark, sf).select((F.col("id") * 2).alias("query_id"), "title", F.lit("a").alias("applicant_id"), F.lit(0.0).alias("at"))
    again = all_titles(spark, sf).select((F.col("id") * 2 + 1).alias("query_id"), "title", F.lit("b").alias("applicant_id"), F.lit(30.0).alias("at"))
    return apply.apply_titles(rows.unionByName(again), index)[0].select("query_id", "title", "decision", "result")


@query()
def export_batch(spark: SparkSession, sf: str) -> DataFrame:
    index = screen.build_index(part_registry(spark, sf))
    rows, _ = screen.screen_batch(all_titles(spark, sf).select(F.col("id").alias("query_id"), "title"), index)
    return tables.export_rows(rows)


@query(f"WITH {ALL_FIX} SELECT id::BIGINT AS id, CASE WHEN title IS NULL THEN 'MISSING' WHEN length(title) = 0 THEN 'TOO_SHORT' WHEN length(title) > {apply.LONGEST_TITLE} THEN 'TOO_LONG' END AS error FROM fixtures")
def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    return all_titles(spark, sf).select("id", apply.request_error(F.col("title")).alias("error"))


@query(rf"""WITH {ALL_FIX}, {_CONCEPTS}, w AS (SELECT id, i, ws[i] AS word FROM (SELECT id, {SPLIT.format('title')} AS ws FROM fixtures), unnest(range(1, len(ws) + 1)) AS u(i))
SELECT id::BIGINT AS id, string_agg(concept, ' ' ORDER BY i) AS concepts FROM w JOIN concepts USING (word) GROUP BY id""")
def title_concepts(spark: SparkSession, sf: str) -> DataFrame:
    rows = all_titles(spark, sf).select("id", text.scorer_tokens(F.col("title")).alias("toks"))
    found = lexicon.title_concepts(rows, lexicon.word_concepts(lexicon.default_lexicon(spark)), "id")
    return found.select("id", F.array_join("concepts", " ").alias("concepts"))


@query()
def phonetic_details(spark: SparkSession, sf: str) -> DataFrame:
    """The words that stand behind each pair's phonetic score."""
    rows = all_pairs(spark, sf).withColumn("d", sim.phonetic_detail_udf("a", "b"))
    return rows.select("a", "b", F.col("d.score").alias("similarity"), F.to_json("d.matched").alias("matched"))


@query()
def phonetic_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return all_titles(spark, sf).withColumn("f", sim.fingerprint_udf("title")).select("id", F.to_json("f").alias("fingerprint"))
