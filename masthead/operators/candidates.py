"""Candidate retrieval as one plan: keys of the submissions joined with the postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from masthead.operators.registry import gram_keys, token_keys, word_positions

#: Tenths of a point for each hit (fixed values); whole numbers make ties exact.
WEIGHTS = {("word", 0): 30, ("phon", 1): 15, ("phon", 2): 12, ("indic", 3): 15, ("concept", 4): 30}
ANCHOR_WEIGHT, GRAM_WEIGHT, BOOST = 40, 8, 40
SPARSE, LIMIT = 30, 100


def _weight():
    out = F.lit(0)
    for (kind, sub), w in WEIGHTS.items():
        out = F.when((F.col("kind") == kind) & (F.col("sub") == sub), w).otherwise(out)
    return out


def retrieve(submissions: DataFrame, postings: DataFrame, dimension: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query_id, entry_id, score, rank): the best candidates of each submission.

    submissions: query_id, tokens, anchor_tokens, anchor_words, cleaned_title.
    Hits are summed with partial aggregation; words that hit an entry by themselves
    or by their concept are counted for the boost; trigrams are asked only for
    submissions with fewer than ``SPARSE`` candidates so far.
    """
    words = word_positions(submissions, "query_id")
    keys = token_keys(words, dimension).withColumn("w", _weight())
    own = postings.select("kind", "key", "entry_id", F.struct("entry_id", F.col("pos").alias("p"), F.col("sub").alias("s")).alias("ord"))
    hits = keys.join(own, ["kind", "key"]).select("query_id", "entry_id", "w", F.when(F.col("kind").isin("word", "concept"), F.col("token")).alias("tok"), F.struct(F.lit(1).alias("phase"), "pos", "sub", "ord").alias("seq"))
    anchors = submissions.select("query_id", F.posexplode("anchor_tokens").alias("pos", "key")).join(own.filter("kind = 'word'"), "key")
    anchors = anchors.select("query_id", "entry_id", F.lit(ANCHOR_WEIGHT).alias("w"), F.col("key").alias("tok"), F.struct(F.lit(0).alias("phase"), "pos", F.lit(0).alias("sub"), "ord").alias("seq"))
    summed = hits.unionByName(anchors).groupBy("query_id", "entry_id").agg(F.sum("w").alias("w"), F.count_distinct("tok").alias("n"), F.min("seq").alias("seq"))
    scored = summed.select("query_id", "entry_id", (F.col("w") + F.when(F.col("n") > 1, F.col("n") * BOOST).otherwise(0)).alias("w"), "seq")

    found = scored.groupBy("query_id").count()
    sparse = submissions.join(found, "query_id", "left").filter(F.coalesce("count", F.lit(0)) < SPARSE).select(*submissions.columns)
    grams = gram_keys(sparse, "query_id").join(own.filter("kind = 'gram'"), "key")
    grams = grams.select("query_id", "entry_id", F.lit(GRAM_WEIGHT).alias("w"), F.struct(F.lit(2).alias("phase"), "pos", F.lit(0).alias("sub"), "ord").alias("seq"))
    total = scored.unionByName(grams).groupBy("query_id", "entry_id").agg(F.sum("w").cast("long").alias("score"), F.min("seq").alias("seq"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    return total.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).select("query_id", "entry_id", "score", "rank")
