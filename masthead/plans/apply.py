"""Applications: verify, gate, lock, record; and the summaries around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masthead.plans.screen import Index, screen
from masthead.sources.tables import application_rows
from masthead.streaming import locks

#: An application below this probability that was rejected is turned away (fixed value).
LEAST_PROBABILITY = 40.0
LOCK_PREFIX = "title_lock:"
#: Bounds of an interactive request (fixed values).
LONGEST_TITLE, MOST_TITLES = 300, 500


def turned_away(probability: Column, status: Column) -> Column:
    return (probability < LEAST_PROBABILITY) & (status == "Rejected")


def request_error(title: Column, longest: int = LONGEST_TITLE) -> Column:
    """Why a title can't be asked for: MISSING, TOO_SHORT or TOO_LONG, else null."""
    return F.when(title.isNull(), "MISSING").when(F.length(title) == 0, "TOO_SHORT").when(F.length(title) > longest, "TOO_LONG")


def checked_batch(titles: DataFrame, most: int = MOST_TITLES) -> DataFrame:
    """The titles of one interactive request; an empty one, or one of more than ``most``, is refused."""
    n = titles.limit(most + 1).count()
    if not 1 <= n <= most:
        raise ValueError(f"a request has 1 to {most} titles")
    return titles


def record_applications(results: DataFrame, table: str = "title_applications") -> None:
    """Append the accepted applications to their table; columns that the results lack are null."""
    rows = application_rows(results.filter("result = 'ACCEPTED'")).withColumnsRenamed({"query_id": "id", "decision": "decision_code"})
    wanted = results.sparkSession.table(table).schema
    rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]).write.mode("append").insertInto(table)


def lock_key(cleaned_title: Column) -> Column:
    return F.concat(F.lit(LOCK_PREFIX), cleaned_title)


def apply_titles(applications: DataFrame, index: Index, held: DataFrame | None = None, ttl: float = locks.TTL) -> tuple[DataFrame, DataFrame]:
    """(results, requests): each application's verdict, and the lock requests that were made.

    applications: query_id, title, applicant_id, at (seconds).  Applications that
    pass the gate ask for their title's lock in order of time; within a batch the
    first applicant gets it.  ``held`` are earlier lock requests, replayed before.
    """
    earlier = held if held is not None else applications.sparkSession.createDataFrame([], locks.REQUEST)
    verdicts = screen(applications, index).join(applications.select("query_id", "applicant_id", "at"), "query_id")
    gone = turned_away(F.col("verification_probability"), F.col("status"))
    asking = verdicts.filter(~gone).select(lock_key(F.col("cleaned_title")).alias("key"), F.col("at").cast("double").alias("at"), F.col("query_id").cast("long").alias("request"), F.col("applicant_id").alias("applicant"), F.lit("acquire").alias("action"))
    granted = locks.replay(earlier.unionByName(asking), ttl).select(F.col("request").alias("query_id"), "applicant", "at", "granted")
    keyed = granted.select("query_id", F.col("applicant").alias("applicant_id"), "at", "granted")
    out = verdicts.withColumn("query_id", F.col("query_id").cast("long")).withColumn("at", F.col("at").cast("double")).join(keyed, ["query_id", "applicant_id", "at"], "left")
    result = F.when(F.col("granted").isNull(), "TURNED_AWAY").when(F.col("granted"), "ACCEPTED").otherwise("LOCKED_BY_OTHER")
    return out.withColumn("result", result), asking


def health(index: Index, active: DataFrame) -> DataFrame:
    """One row: titles, distinct titles and active locks."""
    counts = index.registry.agg(F.count("*").alias("registered_titles"), F.count_distinct("cleaned_title").alias("distinct_titles"))
    return counts.crossJoin(active.agg(F.count("*").alias("active_locks"))).select(F.lit("healthy").alias("status"), "*")


def shown_percent(value: Column) -> Column:
    """Shares become percent, percents stay; whole numbers for display."""
    return F.round(F.when(value <= 1, value * 100).otherwise(value)).cast("int")


def band(percent: Column) -> Column:
    return F.when(percent >= 70, "high").when(percent >= 40, "medium").otherwise("low")


def failed_badge(probability: Column, status: Column) -> Column:
    return (status == "Rejected") | (probability < LEAST_PROBABILITY)


__all__ = ["apply_titles", "band", "checked_batch", "failed_badge", "health", "lock_key", "record_applications", "request_error", "shown_percent", "turned_away"]
