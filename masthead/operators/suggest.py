"""Alternative titles: templates, then the funnel itself as their judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masthead.vocab import LANGUAGE_AFFIXES, SUBSTITUTIONS

SECURITY = ["crime", "police", "investigation", "cbi", "cid", "vigilance", "army", "navy"]
OPENERS = ["Public Truth", "Satyashodhak", "Vigilant Citizen", "Transparency"]
BRANDS = ["Chronicle", "Herald", "Observer", "Journal", "Post", "Horizon", "Spectrum", "Sentinel"]
COMPOUNDS = ["Vanguard", "Apex", "Zenith", "Pinnacle", "Astro", "Quantum", "Stellar"]
NOWHERE = ["National", "All India", "Unknown"]


def _entries(category: str, titles: list[Column]) -> Column:
    return F.array(*[F.struct(t.alias("title"), F.lit(category).alias("category")) for t in titles])


def templates() -> Column:
    """array of struct(title, category) from title, anchor_words, language and state."""
    raw, low = F.trim("title"), F.lower(F.trim("title"))
    shown = F.initcap(raw)
    letters = F.trim(F.regexp_replace(raw, r"[^a-zA-Z\s]", ""))
    anchor = F.initcap(F.coalesce(F.nullif(F.trim("anchor_words"), F.lit("")), F.nullif(letters, F.lit("")), raw))
    none = F.array().cast("array<struct<title:string,category:string>>")
    base = F.trim(F.regexp_replace(F.regexp_replace(shown, r"(?i)\b(" + "|".join(SECURITY) + r")\b", ""), r"\s+", " "))
    base = F.when((base == "") | F.lower(base).isin("the", "daily", "weekly"), "Journal").otherwise(base)
    secure = F.when(low.rlike("|".join(SECURITY[:6])), _entries("Semantic Substitution", [F.concat(F.lit(o + " "), base) for o in OPENERS])).otherwise(none)
    swaps = []
    for word, others in SUBSTITUTIONS.items():
        new = _entries("Semantic Substitution", [F.regexp_replace(shown, rf"(?i)\Q{word}\E", o) for o in others])
        swaps.append(F.when(low.contains(word) & low.rlike("namascar|namaskar"), new).otherwise(none))

    def affixed(language: str) -> Column:
        before, after = LANGUAGE_AFFIXES[language]
        return _entries("Linguistic Variant", [F.concat(F.lit(p + " "), anchor) for p in before[:3]] + [F.concat(anchor, F.lit(" " + s)) for s in after[:3]])

    spoken = affixed("English")
    for language in LANGUAGE_AFFIXES:
        spoken = F.when(F.col("language") == language, affixed(language)).otherwise(spoken)
    state = F.when(F.coalesce("state", F.lit("")).isin("", *NOWHERE), "Maharashtra").otherwise(F.col("state"))
    region = _entries("Regional Scope", [F.concat(state, F.lit(" "), shown), F.concat(F.lit("Delhi "), shown), F.concat(F.lit("Bharat "), anchor)])
    brand = _entries("Domain Brand", [F.concat(x, F.lit(" " + b)) for b in BRANDS for x in (anchor, shown)])
    compound = _entries("Distinctive Compound", [F.concat(F.lit(c + " "), anchor) for c in COMPOUNDS])
    return F.concat(secure, *swaps, spoken, region, brand, compound)


def generate(titles: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, gen_ord, title, category): distinct by lower case, and never the title itself."""
    rows = titles.filter("trim(title) <> ''").select(key, F.lower(F.trim("title")).alias("own"), F.posexplode(templates()).alias("gen_ord", "x"))
    rows = rows.select(key, "own", "gen_ord", "x.title", "x.category").withColumn("folded", F.lower(F.trim("title"))).filter("folded <> own")
    first = F.row_number().over(Window.partitionBy(key, "folded").orderBy("gen_ord"))
    return rows.withColumn("__n", first).filter("__n = 1").select(key, "gen_ord", "title", "category")


def suggest(titles: DataFrame, judge, top: int = 5) -> DataFrame:
    """The best alternatives of each title; judge: screens (query_id, title) rows."""
    made = generate(titles).withColumn("source_id", F.col("query_id")).withColumn("query_id", F.concat_ws(":", "query_id", "gen_ord"))
    judged = made.join(judge(made.select("query_id", "title")).select("query_id", "verification_probability", "status"), "query_id")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("verification_probability"), "gen_ord"))
    return judged.withColumn("place", place).filter(F.col("place") <= top).select(F.col("source_id").alias("query_id"), "place", "title", "category", "verification_probability", "status")
