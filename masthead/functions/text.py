"""Text normalisation as column expressions; only NFKD of values beyond ASCII needs Python (Arrow)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masthead.vocab import GENERIC_WORDS, PREFIXES, SUFFIXES

#: White space and word characters as the rules mean them, in Java's notation.
SPACE = r"\s\p{Z}\x1c-\x1f\x85"
WORD = r"\p{L}\p{N}_"


@F.pandas_udf(T.StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKD", t))


def decomposed(text: Column) -> Column:
    """NFKD; ASCII values, which it leaves as they are, are not sent to Python."""
    return F.coalesce(nfkd(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def clean_text(text: Column) -> Column:
    """Decompose, lower, blank out all but word characters and hyphens, collapse."""
    kept = F.regexp_replace(F.lower(decomposed(text)), f"[^{WORD}{SPACE}\\-]", " ")
    return F.trim(F.regexp_replace(kept, f"[{SPACE}\\-]+", " "))


def tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def scorer_tokens(text: Column) -> Column:
    """Lower-cased words without decomposition; every other character parts them."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, f"[^{WORD}]", " ")), " +"), lambda t: t != "")


def orthographic_clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), f"[^{WORD}]+", " "))


def protected_normal(text: Column) -> Column:
    """Trimmed and lower-cased, punctuation deleted, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), f"[^{WORD}{SPACE}]", ""), f"[{SPACE}]+", " "))


def is_generic_only(toks: Column) -> Column:
    return (F.size(toks) > 0) & F.forall(toks, lambda t: t.isin(GENERIC_WORDS))


def non_generic(toks: Column) -> Column:
    """Order and repeats are kept."""
    return F.filter(toks, lambda t: ~t.isin(GENERIC_WORDS))


def _leading(flags: Column) -> Column:
    """Length of the leading run of true values."""
    first = F.array_position(flags, False)
    return F.when(first == 0, F.size(flags)).otherwise(first - 1).cast("int")


def anchor_parts(toks: Column) -> Column:
    """struct(anchor, prefixes, suffixes) of a title's words.

    Leading prefixes and trailing suffixes go, never crossing; if nothing is left,
    the words that aren't generic make the anchor.
    """
    lead = _leading(F.transform(toks, lambda t: t.isin(PREFIXES)))
    rest = F.when(lead < F.size(toks), F.slice(toks, lead + 1, F.size(toks) - lead)).otherwise(F.array().cast("array<string>"))
    trail = _leading(F.transform(F.reverse(rest), lambda t: t.isin(SUFFIXES)))
    core = F.when(trail < F.size(rest), F.slice(rest, 1, F.size(rest) - trail)).otherwise(F.array().cast("array<string>"))
    anchor = F.when(is_generic_only(toks), "").when(F.size(core) > 0, F.array_join(core, " ")).otherwise(F.array_join(non_generic(toks), " "))
    suffixes = F.when(trail > 0, F.slice(rest, F.size(rest) - trail + 1, F.greatest(trail, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    prefixes = F.when(lead > 0, F.slice(toks, 1, F.greatest(lead, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.struct(anchor.alias("anchor"), prefixes.alias("prefixes"), suffixes.alias("suffixes"))


def index_anchor(toks: Column) -> Column:
    return F.array_join(non_generic(toks), " ")


def padded_grams(text: Column, n: int = 3) -> Column:
    """All n-grams of ``_text_``, repeats kept; the padded text itself if it is shorter."""
    padded = F.concat(F.lit("_"), text, F.lit("_"))
    size = F.length(padded)
    return F.when(size < n, F.array(padded)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n))))


def gram_set(text: Column, n: int = 3) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(padded_grams(text, n)))
