"""Titles put together from two or three registered titles or anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def splits(toks: Column) -> Column:
    """array of struct(ord, parts): two-way splits first, then three-way ones."""
    n = F.size(toks)

    def part(a: Column, b: Column) -> Column:
        """Words from position a up to before b, positions from 1."""
        return F.array_join(F.slice(toks, a.cast("int"), (b - a).cast("int")), " ")

    end = n + 1
    none = F.array().cast("array<struct<ord:int,parts:array<string>>>")
    two = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.struct(i.cast("int").alias("ord"), F.array(part(F.lit(1), i), part(i, end)).alias("parts")))
    three = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))),
            lambda i: F.transform(F.sequence(i + 1, F.greatest(n, i + 1)), lambda j: F.struct((i * 1000 + j).cast("int").alias("ord"), F.array(part(F.lit(1), i), part(i, j), part(j, end)).alias("parts"))),
        )
    )
    return F.concat(F.when(n >= 2, two).otherwise(none), F.when(n >= 3, three).otherwise(none))


def compound_titles(titles: DataFrame, parts: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, components) of titles with a split whose parts are all known.

    parts: (part), distinct.  Every part is looked up by an equi-join; a split
    counts when as many parts were found as it has, and the first one is kept.
    """
    each = titles.filter(F.size("tokens") >= 2).select(key, F.explode(splits(F.col("tokens"))).alias("x"))
    rows = each.select(key, "x.ord", "x.parts", F.explode("x.parts").alias("part"))
    found = rows.join(parts, "part").groupBy(key, "ord").agg(F.first("parts").alias("parts"), F.count("*").alias("n")).filter(F.col("n") == F.size("parts"))
    return found.groupBy(key).agg(F.min_by("parts", "ord").alias("components"))
