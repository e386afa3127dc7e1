"""The screening funnel: submissions against a registry, one decision a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masthead.functions.rules import first_gibberish, is_blank, prohibited_symbols, structure_error, violations
from masthead.functions.similarity import ORTHOGRAPHIC, PHONETIC, REJECT, REVIEW, SEMANTIC, pair_scores
from masthead.functions.text import anchor_parts, clean_text, is_generic_only, tokens
from masthead.operators.candidates import LIMIT, retrieve
from masthead.operators.compound import compound_titles
from masthead.operators.lexicon import concept_map, default_lexicon, shipped, word_concepts
from masthead.operators.registry import build_postings, exact_index, title_parts, token_dimension
from masthead.scratch import fixed

TOP_MATCHES = 5


@dataclass
class Index:
    """The tables a registry is searched by; write them once, read them in every run."""

    registry: DataFrame
    exact: DataFrame
    parts: DataFrame
    postings: DataFrame
    concepts: DataFrame
    concept_of: dict[str, str]


def build_index(registry: DataFrame, lexicon: DataFrame | None = None) -> Index:
    """Derive all tables once and write them; screening runs read them."""
    lexicon = lexicon if lexicon is not None else default_lexicon(registry.sparkSession)
    concepts = fixed(word_concepts(lexicon), "concepts")
    registry = fixed(registry, "registry")
    postings = build_postings(registry, token_dimension(registry, concepts))
    return Index(registry, fixed(exact_index(registry), "exact"), fixed(title_parts(registry), "parts"), fixed(postings, "postings"), concepts, concept_map(lexicon))


TABLES = ("registry", "exact", "parts", "postings", "concepts")


def save_index(index: Index, path: str) -> None:
    """One Parquet table for each part of the index."""
    for name in TABLES:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> Index:
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    return Index(**tables, concept_of=shipped(tables["concepts"]))


def prepared(submissions: DataFrame) -> DataFrame:
    """submissions (query_id, title, …) with cleaned title, tokens, anchor and rule results."""
    rows = submissions.withColumn("cleaned_title", clean_text(F.coalesce("title", F.lit(""))))
    rows = rows.withColumn("tokens", tokens(F.col("cleaned_title")))
    parts = anchor_parts(F.col("tokens"))
    return rows.withColumns({"anchor_words": parts["anchor"], "prefixes": parts["prefixes"], "suffixes": parts["suffixes"]})


def rule_decision(rows: DataFrame) -> Column:
    """The decision of the rules that need no registry, in their order; exact matches come between."""
    error = structure_error(F.col("title"))
    return F.when(error.isNotNull(), F.concat(F.lit("REJECTED_"), error)).when(F.size("tokens") == 0, "REJECTED_EMPTY_TITLE")


def screen(submissions: DataFrame, index: Index, locks: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """One row for each submission: decision, status, probability, scores, top matches, reasons.

    submissions: query_id (unique), title and, if locks are given, applicant_id.
    locks: active ones as (cleaned_title, holder).  Rows that a cheap rule decides
    never reach the joins of the stages behind it.
    """
    rows = prepared(submissions)
    if locks is None:
        rows = rows.withColumn("holder", F.lit(None).cast("string"))
    else:
        rows = rows.join(locks.select("cleaned_title", "holder"), "cleaned_title", "left")
    collides = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("applicant_id")) if "applicant_id" in submissions.columns else F.col("holder").isNotNull()
    rows = rows.join(index.exact, "cleaned_title", "left").withColumn("broken", violations(F.col("cleaned_title"), F.col("tokens"), F.col("anchor_words")))
    rules = F.coalesce(
        F.when(collides, "REJECTED_PENDING_COLLISION"),
        rule_decision(rows),
        F.when(F.col("match_id").isNotNull(), "REJECTED_ALREADY_REGISTERED"),
        F.when(is_generic_only(F.col("tokens")), "REJECTED_STAGE_1"),
        F.when(F.size("broken") > 0, "REJECTED_STAGE_2"),
    )
    # three branches read the rules' results and their Python parts: fix them once
    staged = fixed(rows.withColumn("early", rules), "staged")
    open_ = staged.filter("early is null").select("query_id", "cleaned_title", "tokens", "anchor_words", F.filter(F.split("anchor_words", " "), lambda t: t != "").alias("anchor_tokens"))
    compounds = compound_titles(open_, index.parts)
    compounds = fixed(compounds, "compounds")
    open_ = open_.join(compounds, "query_id", "left_anti")

    words = open_.select(F.explode("tokens").alias("word")).distinct().select(F.array("word").alias("tokens"))
    dimension = token_dimension(words, index.concepts)
    candidates = retrieve(open_, index.postings, fixed(dimension, "dimension"), limit)
    entries = index.registry.select("entry_id", F.col("title").alias("match"), F.col("cleaned_title").alias("c_title"), F.col("anchor_words").alias("c_anchor"), F.col("tokens").alias("c_tokens"), "registration_no", "language", "state", "periodicity")
    pairs = candidates.join(entries, "entry_id").join(open_.select("query_id", "cleaned_title", "anchor_words", "anchor_tokens"), "query_id")
    scored = pairs.repartition("query_id").withColumn("s", pair_scores(index.concept_of)("cleaned_title", "c_title", "anchor_words", "c_anchor"))
    # the UDF's result is used in several places: it is fixed before
    scored = fixed(scored.select("*", "s.phonetic", "s.orthographic", "s.semantic").drop("s"), "scored")
    own = F.array_distinct("anchor_tokens")
    overlap = F.when(F.size(own) > 0, F.size(F.array_intersect(own, "c_tokens")) / F.size(own)).otherwise(0.0)
    highest = F.greatest("phonetic", "orthographic", "semantic", F.when(overlap > 0, overlap * 0.95).otherwise(0.0))
    scored = scored.withColumn("highest", F.round(highest, 4))
    match = F.struct("highest", F.col("match").alias("title"), "registration_no", "language", "state", "periodicity", "phonetic", "orthographic", "semantic")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("highest"), "rank"))
    tops = scored.withColumn("place", place)
    summary = tops.groupBy("query_id").agg(
        F.max("phonetic").alias("max_phonetic"), F.max("orthographic").alias("max_orthographic"), F.max("semantic").alias("max_semantic"), F.count("*").alias("n_candidates"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= TOP_MATCHES, F.struct("place", match.alias("m"))))), lambda x: x["m"]).alias("top_matches"),
    )

    out = staged.join(compounds, "query_id", "left").join(summary, "query_id", "left")
    top = F.coalesce(F.greatest("max_phonetic", "max_orthographic", "max_semantic"), F.lit(0.0))
    out = out.withColumn("highest_similarity", F.when(F.col("early") == "REJECTED_ALREADY_REGISTERED", 1.0).when(F.col("early").isNotNull() | F.col("components").isNotNull(), None).otherwise(top))
    decision = (
        F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("components").isNotNull(), "REJECTED_STAGE_3")
        .when(F.col("highest_similarity") >= REJECT, "REJECTED_SIMILARITY").when(F.col("highest_similarity") >= REVIEW, "MODERATE_SIMILARITY_FLAG").otherwise("APPROVED")
    )
    out = out.withColumn("decision", decision)
    status = F.when(F.col("decision") == "APPROVED", "Approved").when(F.col("decision") == "MODERATE_SIMILARITY_FLAG", "Review Needed").otherwise("Rejected")
    by_similarity = F.col("decision").isin("REJECTED_SIMILARITY", "MODERATE_SIMILARITY_FLAG", "APPROVED")
    probability = F.when(by_similarity, F.greatest(F.lit(0.0), F.round(100 - F.round(F.col("highest_similarity") * 100, 1), 1))).otherwise(0.0)
    return out.select("query_id", "title", "cleaned_title", "anchor_words", "decision", status.alias("status"), probability.alias("verification_probability"), "highest_similarity", "max_phonetic", "max_orthographic", "max_semantic", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "top_matches", reasons().alias("reasons"), hints().alias("suggestions"))


def reasons() -> Column:
    """Explanations by decision; the similarity reasons look at the top match alone."""
    first = F.get("top_matches", F.lit(0))
    percent = lambda c: F.format_number(c * 100, 1)

    def if_over(name: str, limit: float, shown: str) -> Column:
        return F.when(first[name] >= limit, F.concat(F.lit(shown + " similarity "), percent(first[name]), F.lit("% to "), first["title"]))

    alike = F.filter(F.array(if_over("phonetic", PHONETIC, "Phonetic"), if_over("orthographic", ORTHOGRAPHIC, "Orthographic"), if_over("semantic", SEMANTIC, "Semantic")), lambda x: x.isNotNull())
    combined = F.array(F.concat(F.lit("Combined similarity "), percent(F.col("highest_similarity")), F.lit("% to "), F.coalesce(first["title"], F.lit(""))))
    d = F.col("decision")
    return (
        F.when(d == "REJECTED_PENDING_COLLISION", F.array(F.lit("Another applicant holds a lock on this title")))
        .when(d == "REJECTED_PROHIBITED_SYMBOLS", F.array(F.concat(F.lit("Prohibited symbols: "), F.array_join(prohibited_symbols(F.col("title")), ", "))))
        .when(d.endswith("GIBBERISH"), F.array(F.concat(F.lit("Not a meaningful word: "), F.coalesce(first_gibberish(F.col("title"))["word"], F.lit("")))))
        .when(d == "REJECTED_ALREADY_REGISTERED", F.array(F.concat_ws(" ", F.lit("Registered already as"), "match_title", "match_no")))
        .when(d == "REJECTED_STAGE_1", F.array(F.lit("Only generic words")))
        .when(d == "REJECTED_STAGE_2", F.transform("broken", lambda v: F.concat_ws(": ", v["guideline_ref"], v["rule"], v["term"])))
        .when(d == "REJECTED_STAGE_3", F.array(F.concat(F.lit("Combines registered titles: "), F.array_join("components", " + "))))
        .when(d == "REJECTED_SIMILARITY", F.when(F.size(alike) > 0, alike).otherwise(combined))
        .when(d == "MODERATE_SIMILARITY_FLAG", combined)
        .when(d == "APPROVED", F.array(F.lit("Distinctive")))
        .otherwise(F.array(d))
    )


#: What an applicant can do, by decision.
HINTS = {
    "REJECTED_EMPTY_TITLE": ["Enter a title with letters"],
    "REJECTED_PROHIBITED_SYMBOLS": ["Remove symbols and special characters"],
    "REJECTED_PURE_NUMERIC": ["Add words to the number"],
    "REJECTED_REPETITIVE_GIBBERISH": ["Use meaningful words"],
    "REJECTED_LOW_ENTROPY_GIBBERISH": ["Use meaningful words"],
    "REJECTED_UNPRONOUNCEABLE_GIBBERISH": ["Use meaningful words"],
    "REJECTED_PENDING_COLLISION": ["Wait until the lock expires", "Choose another title"],
    "REJECTED_ALREADY_REGISTERED": ["Choose another title"],
    "REJECTED_STAGE_1": ["Add a distinctive word"],
    "REJECTED_STAGE_2": ["Remove the barred terms"],
    "REJECTED_STAGE_3": ["Don't combine registered titles"],
    "REJECTED_SIMILARITY": ["Change the distinctive part of the title"],
    "MODERATE_SIMILARITY_FLAG": ["Make the title more distinctive"],
    "APPROVED": ["Apply for registration"],
}


def hints() -> Column:
    table = F.create_map(*[x for k, v in HINTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.element_at(table, F.col("decision"))


def batch_summary(screened: DataFrame) -> DataFrame:
    """Counts by status, in one row."""
    count = lambda s: F.count_if(F.col("status") == s)
    return screened.agg(F.count("*").alias("total"), count("Approved").alias("approved"), count("Rejected").alias("rejected"), count("Review Needed").alias("review_needed"))


def screen_batch(submissions: DataFrame, index: Index, **options) -> tuple[DataFrame, DataFrame]:
    """Decisions and counts; blank titles are skipped."""
    out = screen(submissions.filter(~is_blank(F.col("title"))), index, **options)
    return out, batch_summary(out)
