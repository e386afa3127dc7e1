"""Tiered registry search: exact, then prefix, then word prefix, then substring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISPLAY = {"registration_no": "N/A", "language": "English", "state": "National", "periodicity": "Daily", "publisher": ""}


def shown(rows: DataFrame) -> DataFrame:
    """Display defaults for missing values."""
    return rows.withColumns({c: F.coalesce(F.nullif(c, F.lit("")), F.lit(d)) for c, d in DISPLAY.items() if c in rows.columns})


def search(registry: DataFrame, query: str, cleaned: str, limit: int = 20) -> DataFrame:
    """(entry_id, tier, title, …) in order of tier and id; prefixes are literal.

    Only one pass over the registry: each row has the first tier that takes it.
    The substring tier counts only when the others find nothing.
    """
    if not query and not cleaned:
        return shown(registry.orderBy("entry_id").limit(limit)).withColumn("tier", F.lit(0))
    c = F.col
    no = F.lit(False)

    def any_of(*tests: Column) -> Column:
        out = no
        for t in tests:
            out = out | F.coalesce(t, no)
        return out

    raw, own = bool(query), bool(cleaned)
    exact = any_of(*([c("title") == query, c("registration_no") == query] if raw else []), *([c("cleaned_title") == cleaned, c("anchor_words") == cleaned] if own else []))
    prefix = any_of(*([c("title").startswith(query), c("registration_no").startswith(query)] if raw else []), *([c("cleaned_title").startswith(cleaned), c("anchor_words").startswith(cleaned)] if own else []))
    tier = F.when(exact, 1).when(prefix, 2)
    for i, word in enumerate(w for w in cleaned.split() if len(w) >= 3):
        tier = tier.when(any_of(c("anchor_words").startswith(word), c("cleaned_title").startswith(word)), 3 + i)
    tier = tier.when(any_of(*([c("title").contains(query)] if raw else []), *([c("cleaned_title").contains(cleaned)] if own else [])), 1000)
    found = shown(registry.withColumn("tier", tier).filter("tier is not null").orderBy("tier", "entry_id").limit(limit))
    first = found.agg(F.min("tier").alias("__first"))
    return found.join(F.broadcast(first), (c("tier") < 1000) | (c("__first") == 1000)).drop("__first")
