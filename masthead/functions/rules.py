"""Structure, gibberish and blacklist rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from masthead.functions.text import SPACE, WORD, protected_normal
from masthead.vocab import ACRONYMS, CONSONANTS, EMBLEM_TERMS, ENFORCEMENT_TERMS, INVALID_BIGRAMS, INVALID_ENDINGS, OBSCENE_TOKENS, PROHIBITED_CHARACTERS, PROTECTED_NAMES, VOWELS

_ESCAPED = "".join("\\" + c if c in r"\[]^-&" else c for c in PROHIBITED_CHARACTERS)
#: Symbols of any kind; the last range covers signs newer than the JVM's tables.
PROHIBITED = r"[\p{So}\p{Sm}\p{Sc}\p{Sk}" + _ESCAPED + r"\x{1F300}-\x{1FAFF}]"


def prohibited_symbols(title: Column) -> Column:
    """Distinct prohibited characters in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(title, F.lit(f"({PROHIBITED})"), 1))


def entropy(word: Column) -> Column:
    """Shannon entropy in bits of the letters, to three places."""
    letters = F.regexp_replace(F.lower(word), r"[^\p{L}]", "")
    n = F.length(letters)
    bits = F.aggregate(
        F.array_distinct(F.filter(F.split(letters, ""), lambda c: c != "")), F.lit(0.0),
        lambda total, c: total - ((n - F.length(F.replace(letters, c, F.lit("")))) / n) * F.log2((n - F.length(F.replace(letters, c, F.lit("")))) / n),
    )
    return F.when(n == 0, 0.0).otherwise(F.round(bits, 3) + 0.0)


def gibberish_type(word: Column) -> Column:
    """The kind of gibberish a single word is, else null."""
    w = F.lower(F.trim(word))
    n = F.length(w)
    runs = F.regexp_extract_all(w, F.lit(f"([{CONSONANTS}]+)"), 1)
    cluster = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    vowels = F.length(F.regexp_replace(w, f"[^{VOWELS}]", ""))
    pairs = F.when(n < 2, 0).otherwise(F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2))), lambda p: p.isin(INVALID_BIGRAMS))))
    hard = (n > 3) & ((cluster >= 5) | ((cluster >= 4) & (vowels <= 1) & (n >= 6)) | ((n >= 5) & (vowels == 0)))
    odd = (n > 2) & (w.rlike("(" + "|".join(INVALID_ENDINGS) + ")$") | (pairs >= 2) | ((pairs >= 1) & (n <= 6)))
    return (
        F.when((w == "") | w.isin(ACRONYMS), None)
        .when((n >= 5) & (w.rlike(r"^(.)\1+$") | w.rlike(r"^(.{2,}?)\1+$")), "REPETITIVE_GIBBERISH")
        .when((n >= 7) & (entropy(w) < 1.4), "LOW_ENTROPY_GIBBERISH")
        .when(hard | odd, "UNPRONOUNCEABLE_GIBBERISH")
    )


def first_gibberish(title: Column) -> Column:
    """struct(word, type) of the first gibberish word, else null."""
    words = F.transform(F.filter(F.split(title, f"[{SPACE}]+"), lambda w: w != ""), lambda w: F.regexp_replace(w, f"^[^{WORD}]+|[^{WORD}]+$", ""))
    asked = F.filter(words, lambda w: (w != "") & ~w.rlike(r"^\p{Nd}+$"))
    typed = F.transform(asked, lambda w: F.struct(w.alias("word"), gibberish_type(w).alias("type")))
    return F.get(F.filter(typed, lambda x: x["type"].isNotNull()), F.lit(0))


def is_blank(title: Column) -> Column:
    return title.isNull() | title.rlike(f"^[{SPACE}]*$")


def structure_error(title: Column) -> Column:
    """The first failing structural rule, else null."""
    return (
        F.when(is_blank(title), "EMPTY_TITLE")
        .when(title.rlike(PROHIBITED), "PROHIBITED_SYMBOLS")
        .when(~title.rlike(r"\p{L}"), "PURE_NUMERIC")
        .otherwise(first_gibberish(title)["type"])
    )


def _map(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def protected_name(title: Column, anchor: Column) -> Column:
    """struct(name, category) if the whole title, else the whole anchor, is protected."""
    names = [(key, f"{shown}|{kind}") for kind, of in PROTECTED_NAMES.items() for key, shown in of]
    found = F.coalesce(F.element_at(_map(names), protected_normal(title)), F.element_at(_map(names), protected_normal(anchor)))
    return F.when(found.isNotNull(), F.struct(F.substring_index(found, "|", 1).alias("name"), F.substring_index(found, "|", -1).alias("category")))


def terms_in(toks: Column, terms: list[str]) -> Column:
    """The terms, of one or more whole words, that stand in a title or text, in the list's order."""
    padded = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))

    def found(text: Column) -> Column:
        return F.when(text.isNotNull(), F.array_compact(F.array(*[F.when(F.contains(text, F.lit(f" {t} ")), t) for t in terms])))

    return F.get(F.transform(F.array(padded), found), F.lit(0))  # a variable, so that the text is made once


def violations(cleaned: Column, toks: Column, anchor: Column) -> Column:
    """array of struct(rule, term, guideline_ref): protected, enforcement, emblem, then tokens."""
    def entry(rule: str, term: Column, ref: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), term.alias("term"), ref.alias("guideline_ref"))

    name = protected_name(cleaned, anchor)
    none = F.array().cast("array<struct<rule:string,term:string,guideline_ref:string>>")
    own = F.when(name.isNotNull(), F.array(entry("Protected Name", name["name"], F.lit("Protected Corporate Name Rule")))).otherwise(none)

    def listed(rule: str, terms: list[tuple[str, str]]) -> Column:
        refs = _map([(t, "Guideline " + g) for t, g in terms])
        return F.transform(terms_in(toks, [t for t, _ in terms]), lambda t: entry(rule, F.initcap(t), F.element_at(refs, t)))

    coarse = F.transform(F.filter(toks, lambda t: t.isin(OBSCENE_TOKENS)), lambda t: entry("Derogatory / Criminal Association Term", F.initcap(t), F.lit("Guideline 14")))
    return F.concat(own, listed("Prohibited Enforcement Word", ENFORCEMENT_TERMS), listed("Emblems and Names", EMBLEM_TERMS), coarse)


__all__ = ["entropy", "first_gibberish", "gibberish_type", "is_blank", "prohibited_symbols", "protected_name", "structure_error", "terms_in", "violations"]
