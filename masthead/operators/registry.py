"""The registry: mapping raw columns, derived columns, and the postings index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masthead.functions.phonetic import double_metaphone_udf, indic_soundex
from masthead.functions.text import clean_text, index_anchor, padded_grams, tokens
from masthead.scratch import fixed

#: Words in a folded column name that claim a role, in order of trial (fixed values).
ROLES = [("title", ("title",)), ("registration_no", ("reg",)), ("language", ("lang",)), ("state", ("state",)), ("periodicity", ("period",)), ("publisher", ("publisher", "owner"))]
DEFAULTS = {"language": "English", "state": "National", "periodicity": "Daily", "publisher": ""}
#: Earliest postings kept for a key, by kind; the other kinds keep all.
CAPS = {"phon": 120, "indic": 120, "gram": 50}


def map_columns(raw: DataFrame) -> DataFrame:
    """Rename by the roles' words; the first column that claims a role has it.

    Without a title column the first column is the title.  Missing roles get their
    defaults; ``nan`` counts as null.  Titles are trimmed, and rows whose title is
    null or of one character are dropped.
    """
    chosen: dict[str, str] = {}
    for column in raw.columns:
        folded = column.lower().strip().replace(" ", "_")
        role = next((r for r, marks in ROLES if r not in chosen and any(m in folded for m in marks)), None)
        if role:
            chosen[role] = column
    chosen.setdefault("title", raw.columns[0])

    def value(role: str) -> Column:
        if role not in chosen:
            return F.lit(DEFAULTS.get(role)).cast("string")
        text = F.trim(F.col(f"`{chosen[role]}`").cast("string"))
        text = F.when(F.lower(text) != "nan", text)
        return F.coalesce(text, F.lit(DEFAULTS[role])) if role in DEFAULTS else text

    out = raw.select(*[value(r).alias(r) for r, _ in ROLES])
    return out.filter(F.length("title") > 1)


def numbered(mapped: DataFrame, order: list[str], prefix: str = "REG/") -> DataFrame:
    """entry_id from 0 in the given order; default registration numbers from it.

    The numbering is by ranges and their counts, without a window over all rows.
    """
    spark = mapped.sparkSession
    dealt = mapped.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    dealt = fixed(dealt, "numbered")  # ranges come from a sample: they must not be drawn twice
    sizes = sorted(dealt.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")).collect())
    base, rows = 0, []
    for r in sizes:
        rows.append((r["__part"], base - r["first"]))
        base += r["n"]
    shift = spark.createDataFrame(rows or [(0, 0)], "__part int, __shift long")
    out = dealt.join(F.broadcast(shift), "__part").withColumn("entry_id", F.col("__at") + F.col("__shift"))
    number = F.concat(F.lit(prefix), F.col("entry_id") + 100_000)
    return out.withColumn("registration_no", F.coalesce(F.nullif("registration_no", F.lit("")), number)).drop("__part", "__at", "__shift")


def build_registry(entries: DataFrame) -> DataFrame:
    """Add cleaned_title, tokens and anchor_words; rows that clean to nothing go."""
    clean = entries.withColumn("cleaned_title", clean_text(F.col("title"))).filter("cleaned_title <> ''")
    return clean.withColumn("tokens", tokens(F.col("cleaned_title"))).withColumn("anchor_words", index_anchor(F.col("tokens")))


def exact_index(registry: DataFrame) -> DataFrame:
    """One row for each cleaned title: the last entry wins."""
    last = registry.groupBy("cleaned_title").agg(F.max_by(F.struct("entry_id", "title", "registration_no"), "entry_id").alias("x"))
    return last.select("cleaned_title", F.col("x.entry_id").alias("match_id"), F.col("x.title").alias("match_title"), F.col("x.registration_no").alias("match_no"))


def token_dimension(registry: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row for each distinct word: keys are made once a word, not once a title."""
    words = registry.select(F.explode("tokens").alias("token")).distinct()
    keyed = words.withColumn("dm", double_metaphone_udf("token"))
    return keyed.select("token", F.col("dm.primary").alias("dm_primary"), F.col("dm.secondary").alias("dm_secondary"), indic_soundex(F.col("token")).alias("soundex")).join(concepts.select(F.col("word").alias("token"), "concept"), "token", "left")


def word_positions(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.posexplode("tokens").alias("pos", "token"))


def token_keys(words: DataFrame, dimension: DataFrame) -> DataFrame:
    """(…, token, kind, key, sub) for every key of a word of two characters or more."""
    kinds = F.array(
        F.struct(F.lit("word").alias("kind"), F.col("token").alias("key"), F.lit(0).alias("sub")),
        F.struct(F.lit("phon").alias("kind"), F.nullif("dm_primary", F.lit("")).alias("key"), F.lit(1).alias("sub")),
        F.struct(F.lit("phon").alias("kind"), F.when(F.col("dm_secondary") != F.col("dm_primary"), F.nullif("dm_secondary", F.lit(""))).alias("key"), F.lit(2).alias("sub")),
        F.struct(F.lit("indic").alias("kind"), F.nullif("soundex", F.lit("")).alias("key"), F.lit(3).alias("sub")),
        F.struct(F.lit("concept").alias("kind"), F.col("concept").alias("key"), F.lit(4).alias("sub")),
    )
    joined = words.filter(F.length("token") >= 2).join(dimension, "token")
    return joined.select(*words.columns, F.explode(kinds).alias("x")).select(*words.columns, "x.kind", "x.key", "x.sub").filter("key is not null")


def gram_keys(rows: DataFrame, key: str) -> DataFrame:
    """Padded trigrams of the anchor, or of the title if there is none; repeats are kept."""
    text = F.when(F.col("anchor_words") != "", F.col("anchor_words")).otherwise(F.col("cleaned_title"))
    return rows.select(key, F.posexplode(padded_grams(text)).alias("pos", "key"))


def capped(postings: DataFrame) -> DataFrame:
    """The earliest postings of each key, by kind, where a kind has a cap.

    Rank limits run before the shuffle as well, so a very common key sends at most
    its cap from each task.
    """
    order = Window.partitionBy("kind", "key").orderBy("entry_id", "pos", "sub")
    out = postings.filter(~F.col("kind").isin(list(CAPS)))
    for kind, cap in CAPS.items():
        out = out.unionByName(postings.filter(F.col("kind") == kind).withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= cap).drop("__rank"))
    return out


def build_postings(registry: DataFrame, dimension: DataFrame) -> DataFrame:
    """(kind, key, entry_id, pos, sub), in order of insertion, capped."""
    words = token_keys(word_positions(registry, "entry_id"), dimension).select("kind", "key", "entry_id", "pos", "sub")
    grams = gram_keys(registry, "entry_id").select(F.lit("gram").alias("kind"), "key", "entry_id", "pos", F.lit(0).alias("sub"))
    return capped(words.unionByName(grams))


def title_parts(registry: DataFrame) -> DataFrame:
    """Distinct titles and anchors of more than two characters."""
    both = registry.select(F.col("cleaned_title").alias("part")).unionByName(registry.select(F.col("anchor_words").alias("part")))
    return both.select(F.trim(F.lower("part")).alias("part")).filter(F.length("part") > 2).distinct()
