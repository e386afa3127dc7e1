"""The concept lexicon: a parameter, by default the whole one of ``masthead.concepts``.

A lexicon is a table (concept, language, word, ord).  ``load_lexicon`` reads a
JSON list of ``{concept, category, language_variants: {language: [words]}}``.
Of a word that stands under several concepts, the last one wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masthead.concepts import LEXICON

#: Words a lexicon may have to be used inside tasks; checked when it is collected.
MAX_WORDS = 100_000


def _words(nested: DataFrame) -> DataFrame:
    """(concept, language, word, ord) from rows of (ord, concept, variants)."""
    by_language = nested.select("ord", "concept", F.posexplode(F.map_entries("variants")).alias("l", "entry"))
    flat = by_language.select("ord", "l", "concept", F.col("entry.key").alias("language"), F.posexplode("entry.value").alias("w", "word"))
    return flat.select("concept", "language", F.lower("word").alias("word"), F.struct("ord", "l", "w").alias("ord"))


def default_lexicon(spark: SparkSession) -> DataFrame:
    """All concepts, flat: a map column would not keep the order of its languages."""
    rows = [(c, lang, w.lower(), (i, j, k)) for i, (c, _, v) in enumerate(LEXICON) for j, (lang, ws) in enumerate(v.items()) for k, w in enumerate(ws)]
    return spark.createDataFrame(rows, "concept string, language string, word string, ord struct<ord:int,l:int,w:int>")


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", True).schema("concept string, category string, language_variants map<string,array<string>>").json(path)
    return _words(raw.select(F.monotonically_increasing_id().alias("ord"), "concept", F.col("language_variants").alias("variants")))


def word_concepts(lexicon: DataFrame) -> DataFrame:
    """(word, concept, language): one row a word, the last entry wins."""
    last = lexicon.groupBy("word").agg(F.max_by(F.struct("concept", "language"), "ord").alias("x"))
    return last.select("word", "x.concept", "x.language")


def concept_words(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("concept").agg(F.array_sort(F.collect_set("word")).alias("words"))


def shipped(concepts: DataFrame) -> dict[str, str]:
    """(word, concept) rows for use inside tasks; refuses a lexicon that isn't small."""
    rows = concepts.select("word", "concept").limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"a lexicon of more than {MAX_WORDS} words can't be shipped with tasks")
    return {r["word"]: r["concept"] for r in rows}


def concept_map(lexicon: DataFrame) -> dict[str, str]:
    return shipped(word_concepts(lexicon))


def title_concepts(titles: DataFrame, concepts: DataFrame, key: str) -> DataFrame:
    """(key, concepts): concepts of a title's words in order, repeats kept; titles without any have no row.

    titles: key, toks; concepts: word, concept (a lexicon's words, checked against ``MAX_WORDS``).
    """
    if concepts.limit(MAX_WORDS + 1).count() > MAX_WORDS:
        raise ValueError(f"a lexicon has at most {MAX_WORDS} words")
    words = titles.select(key, F.posexplode("toks").alias("pos", "word")).join(F.broadcast(concepts.select("word", "concept")), "word")
    found = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "concept"))).alias("x"))
    return found.select(key, F.transform("x", lambda v: v["concept"]).alias("concepts"))
