"""Quality and latency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masthead.functions.similarity import REJECT
from masthead.functions.text import anchor_parts, clean_text, tokens


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall and F1 in one row; empty denominators give 0."""
    counted = rows.agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & ~actual).alias("tn"), F.count_if(~predicted & actual).alias("fn")
    )
    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counted.withColumns({"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """mean, median, p95 and p99 with linear interpolation."""
    v = F.col(value)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, 0.95).alias("p95"), F.percentile(v, 0.99).alias("p99"))


def evaluate_pairs(pairs: DataFrame, scores, threshold: float = REJECT) -> DataFrame:
    """Confusion of labelled pairs (title_a, title_b, expected_relation) under a pair scorer.

    scores: the UDF of ``similarity.pair_scores``.
    """
    rows = pairs
    for side in ("a", "b"):
        rows = rows.withColumn(f"c_{side}", clean_text(F.coalesce(f"title_{side}", F.lit(""))))
        rows = rows.withColumn(f"w_{side}", anchor_parts(tokens(F.col(f"c_{side}")))["anchor"])
    scored = rows.withColumn("s", scores("c_a", "c_b", "w_a", "w_b"))
    return confusion(scored, F.greatest("s.phonetic", "s.orthographic", "s.semantic") >= threshold, F.upper("expected_relation") == "SIMILAR")


def met(probability: Column, exact: Column, least: Column, most: Column, status: Column, expected: Column) -> Column:
    """Whether a result meets the bounds that are given."""
    ok = lambda bound, test: bound.isNull() | test
    return ok(exact, probability == exact) & ok(least, probability >= least) & ok(most, probability <= most) & ok(expected, status == expected)
