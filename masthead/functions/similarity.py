"""Similarity measures: expressions where Spark has them, one Arrow UDF for pairs.

The pair UDF runs on candidate pairs only (at most a hundred for a title) and
keeps keys of words in bounded caches, so a word is analysed once in a worker.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masthead.functions.phonetic import double_metaphone, indic_normal_py, indic_soundex_py
from masthead.functions.text import gram_set

VECTOR_SIZE = 2048
SHORT_WORD, SHORT_CHAR_SIM = 4, 0.80
#: Thresholds of the decision (fixed values).
REJECT, REVIEW, PHONETIC, ORTHOGRAPHIC, SEMANTIC = 0.65, 0.45, 0.70, 0.65, 0.70

# ---------------------------------------------------------------- expressions


def levenshtein_sim(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays, as sets; empty against empty is 0."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def dice(a: Column, b: Column, n: int = 3) -> Column:
    """Of the padded n-gram sets of two texts."""
    x, y = gram_set(a, n), gram_set(b, n)
    total = F.size(x) + F.size(y)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2 * F.size(F.array_intersect(x, y)) / total)


def hash_bucket(text: Column, size: int = VECTOR_SIZE) -> Column:
    """SHA-256, the first four bytes as a number, modulo the size."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % size).cast("int")


def vector_features(toks: Column, concepts: Column) -> Column:
    """array of struct(feature, weight); concepts: the words' concepts by position, null if none."""
    word = F.zip_with(toks, concepts, lambda w, c: F.struct(F.when(c.isNotNull(), F.concat(F.lit("CONCEPT:"), c)).otherwise(F.concat(F.lit("WORD:"), w)).alias("feature"), F.when(c.isNotNull(), 3.0).otherwise(1.0).alias("weight")))
    grams = F.flatten(F.transform(toks, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.struct(F.concat(F.lit("GRAM:"), F.substring(F.concat(F.lit("_"), w, F.lit("_")), i, F.lit(3))).alias("feature"), F.lit(0.3).alias("weight")))))
    return F.concat(word, grams)


# ---------------------------------------------------------------- plain functions


def jaro_winkler(a: str, b: str) -> float:
    """Prefix weight 0.1, boosted only above a Jaro similarity of 0.7."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used, hits = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    k = len(hits)
    if not k:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    if jaro > 0.7:
        prefix = 0
        while prefix < min(4, n, m) and a[prefix] == b[prefix]:
            prefix += 1
        jaro += 0.1 * prefix * (1 - jaro)
    return jaro


def levenshtein_ratio(a: str, b: str) -> float:
    """1 - edit distance / longer length; the rows of the table are bit vectors (Myers)."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        x = places.get(c, 0) | down
        same = ((up + (x & up)) ^ up | x) & full
        more, less = down | full & ~(up | same), up & same
        distance += bool(more & last) - bool(less & last)
        more = more << 1 | 1
        up, down = (less << 1 | ~(more | same)) & full, more & same
    return 1 - distance / max(len(a), len(b))


def indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / both lengths, by bit-parallel rows."""
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        here = row & places.get(c, 0)
        row = (row + here | row - here) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


@lru_cache(50_000)
def ngrams(text: str, n: int = 3) -> frozenset[str]:
    if not text:
        return frozenset()
    padded = f"_{text}_"
    return frozenset(padded[i : i + n] for i in range(max(1, len(padded) - n + 1)))


def dice_py(a: str, b: str, n: int = 3) -> float:
    x, y = ngrams(a, n), ngrams(b, n)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def jaccard_py(a: Sequence[str], b: Sequence[str]) -> float:
    x, y = set(a), set(b)
    return len(x & y) / max(1, len(x | y))


@lru_cache(50_000)
def _folded(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text.lower())).strip()


def orthographic(a: str, b: str, policy: str = "max") -> dict[str, float]:
    """The four measures and their aggregate, each to four places."""
    names = ("jaro_winkler", "levenshtein", "token_sort", "dice", "score")
    x, y = _folded(a), _folded(b)
    if not x or not y:
        return dict.fromkeys(names, 0.0)
    if x == y:
        return dict.fromkeys(names, 1.0)
    overlap = jaccard_py(x.split(), y.split())
    lev = levenshtein_ratio(x, y)
    raw = indel_ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split())))
    order = raw if overlap >= 0.5 else raw * (0.2 + 0.8 * overlap)
    single = " " not in x and " " not in y
    if lev >= 0.85 or single and lev >= 0.70:
        jw = jaro_winkler(x, y)
    elif single and max(len(x), len(y)) <= 6 and lev >= 0.60:
        jw = 0.85 * jaro_winkler(x, y)
    else:
        jw = lev
    grams = dice_py(x, y)
    parts = (lev, jw, order, grams)
    total = sum(parts) / 4 if policy == "mean" else max(parts)
    return dict(zip(names, (round(v, 4) for v in (jw, lev, order, grams, total)), strict=True))


@lru_cache(50_000)
def _words(text: str) -> tuple[str, ...]:
    return tuple(re.sub(r"[^\w\s]", " ", text).lower().split())


@lru_cache(50_000)
def _sound_key(words: tuple[str, ...]) -> str:
    return " ".join(p for p, _ in map(double_metaphone, words) if p)


#: Scores when keys of two words agree: (long and alike, long and unlike, short and alike, short and unlike).
_RULES = {
    "primary": (1.0, 0.75, 1.0, 0.35),
    "cross": (0.90, 0.65, 0.90, 0.30),
    "secondary": (0.85, 0.85, 0.85, 0.25),
    "soundex": (0.95, 0.50, 0.95, 0.30),
}


@lru_cache(200_000)
def word_match(a: str, b: str) -> tuple[str, float]:
    """(kind, score) of the first kind of agreement of two words' keys."""
    (p, s), (q, t) = double_metaphone(a), double_metaphone(b)
    chars = jaro_winkler(a, b)

    def scored(rule: str) -> tuple[str, float]:
        alike, unlike, short_alike, short_unlike = _RULES[rule]
        if max(len(a), len(b)) <= SHORT_WORD:
            return rule, short_alike if chars >= SHORT_CHAR_SIM or levenshtein_ratio(a, b) >= 0.80 else short_unlike
        return rule, alike if chars >= 0.70 else unlike

    if p and p == q:
        return scored("primary")
    if (p and p == t) or (s and s == q):
        return scored("cross")
    if s and s == t:
        return scored("secondary")
    x = indic_soundex_py(a)
    if x and x == indic_soundex_py(b):
        return scored("soundex")
    if indic_normal_py(a) == indic_normal_py(b):
        return "normalised", 0.95  # words without Latin letters agree too; kept as it is
    if p and q:
        keys = jaro_winkler(p, q)
        if keys >= 0.88 and chars >= 0.75:
            return "fuzzy", 0.90 * keys
    return "none", 0.0


def aligned(x: tuple[str, ...], y: tuple[str, ...]) -> tuple[float, list[tuple[str, str, str, float]]]:
    """Score of two titles' words and the pairs behind it, as (word, word, kind, score).

    Equal words, equal keys as a whole, else words aligned in order, the best free one for each.
    """
    if not x or not y:
        return 0.0, []
    if x == y:
        return 1.0, [(w, w, "exact", 1.0) for w in x]
    key = _sound_key(x)
    if key and key == _sound_key(y):
        left, right = " ".join(x), " ".join(y)
        chars, lev = jaro_winkler(left, right), levenshtein_ratio(left, right)
        if max(len(left), len(right)) <= SHORT_WORD:
            score = 1.0 if chars >= SHORT_CHAR_SIM or lev >= 0.80 else round(max(chars, lev) * 0.5, 4)
        else:
            score = 1.0 if chars >= 0.70 else round(max(chars, 0.75), 4)
        if score >= 0.70:
            return score, [(v, w, "whole key", score) for v, w in zip(x, y, strict=False)]
    free, total, pairs = list(range(len(y))), 0.0, []
    for w in x:
        best, place, kind = 0.0, -1, "none"
        for j in free:
            how, got = word_match(w, y[j])
            if got > best:
                best, place, kind = got, j, how
        if best >= 0.60:
            free.remove(place)
            total += best
            pairs.append((w, y[place], kind, round(best, 4)))
    return round(min(1.0, total / max(len(x), len(y))), 4), pairs


def phonetic(a: str, b: str) -> float:
    return aligned(_words(a), _words(b))[0]


def fingerprint(title: str) -> dict[str, list[str] | str]:
    """Keys of a title's words: metaphones and Indic soundex, empty ones left out."""
    words = _words(title)
    keys = [double_metaphone(w) for w in words]
    sounds = [k for k in map(indic_soundex_py, words) if k]
    return {"primary": [p for p, _ in keys if p], "secondary": [s for _, s in keys if s], "metaphone": _sound_key(words), "soundex": sounds, "soundex_key": "-".join(sounds)}


@lru_cache(100_000)
def _bucket(feature: str) -> int:
    return int.from_bytes(hashlib.sha256(feature.encode()).digest()[:4], "big") % VECTOR_SIZE


@lru_cache(50_000)
def _vector(words: tuple[str, ...], concepts: tuple[str | None, ...]) -> dict[int, float]:
    """Hashed features of length one: words or their concepts, and padded trigrams."""
    v: dict[int, float] = {}
    for w, concept in zip(words, concepts, strict=True):
        own = _bucket(f"CONCEPT:{concept}" if concept is not None else f"WORD:{w}")
        v[own] = v.get(own, 0.0) + (3.0 if concept is not None else 1.0)
        for i in range(len(w)):
            g = _bucket("GRAM:" + f"_{w}_"[i : i + 3])
            v[g] = v.get(g, 0.0) + 0.3
    norm = math.sqrt(sum(t * t for t in v.values()))
    return {k: t / norm for k, t in v.items()}


def semantic(a: str, b: str, concept: dict[str, str]) -> dict[str, float]:
    """Concepts shared word by word, and the cosine of hashed features."""
    x, y = _words(a), _words(b)
    left_v, right_v = (_vector(w, tuple(map(concept.get, w))) for w in (x, y))
    cosine = round(min(1.0, max(0.0, sum(t * right_v.get(k, 0.0) for k, t in left_v.items()))), 4)
    lexicon = 0.0
    if x and y:
        left, matched = [concept[w] for w in y if w in concept], 0
        for w in x:
            if concept.get(w) in left:
                left.remove(concept[w])
                matched += 1
        lexicon = round(matched / max(len(x), len(y)), 4)
        if matched and matched >= min(len(x), len(y)):
            lexicon = max(lexicon, 0.90)
    if lexicon >= 0.80:
        score = lexicon
    elif lexicon >= 0.50:
        score = round(max(lexicon, 0.8 * lexicon + 0.2 * cosine), 4)
    elif lexicon > 0:
        score = lexicon
    else:
        score = round(cosine * (0.2 + 0.8 * jaccard_py(x, y)), 4)
    return {"lexicon": lexicon, "vector": cosine, "score": score}


def compare(new: str, candidate: str, new_anchor: str, anchor: str, concept: dict[str, str]) -> tuple[float, float, float]:
    """Phonetic, orthographic and semantic similarity of a pair, to four places."""
    sound = phonetic(new, candidate)
    if new_anchor and anchor and (new_anchor, anchor) != (new, candidate):
        sound = max(sound, phonetic(new_anchor, anchor))
    whole = orthographic(new, candidate)["score"]
    if new == candidate:
        spelling = 1.0
    elif new_anchor and new_anchor == anchor:
        spelling = 0.95
    elif new_anchor and anchor:
        spelling = max(orthographic(new_anchor, anchor)["score"], 0.70 * whole)
    else:
        spelling = 0.75 * whole
    return round(sound, 4), round(spelling, 4), round(semantic(new, candidate, concept)["score"], 4)


# ---------------------------------------------------------------- Arrow UDFs


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def phonetic_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([phonetic(x, y) for x, y in zip(a, b, strict=True)])


PAIR = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "kind")] + [T.StructField("score", T.DoubleType())])
DETAIL = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("matched", T.ArrayType(PAIR))])


@F.pandas_udf(DETAIL)
def phonetic_detail_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The phonetic score with its aligned words; null counts as empty."""
    rows = [aligned(_words(x or ""), _words(y or "")) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame({"score": [r[0] for r in rows], "matched": [[dict(zip(PAIR.names, m, strict=True)) for m in r[1]] for r in rows]})


FINGERPRINT = T.StructType([T.StructField(c, T.StringType() if c in ("metaphone", "soundex_key") else T.ArrayType(T.StringType())) for c in ("primary", "secondary", "metaphone", "soundex", "soundex_key")])


@F.pandas_udf(FINGERPRINT)
def fingerprint_udf(title: pd.Series) -> pd.DataFrame:
    """Phonetic keys of a whole title; null counts as empty."""
    return pd.DataFrame([fingerprint(t or "") for t in title], columns=FINGERPRINT.names)


ORTHOGRAPHIC_TYPE = T.StructType([T.StructField(k, T.DoubleType()) for k in ("jaro_winkler", "levenshtein", "token_sort", "dice", "score")])


@F.pandas_udf(ORTHOGRAPHIC_TYPE)
def orthographic_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([orthographic(x, y) for x, y in zip(a, b, strict=True)], columns=ORTHOGRAPHIC_TYPE.names)


SCORES = T.StructType([T.StructField(k, T.DoubleType()) for k in ("phonetic", "orthographic", "semantic")])


def pair_scores(concept: dict[str, str]):
    """UDF of (title, candidate, anchor, candidate's anchor) with a bounded lexicon."""

    @F.pandas_udf(SCORES)
    def run(new: pd.Series, candidate: pd.Series, new_anchor: pd.Series, anchor: pd.Series) -> pd.DataFrame:
        rows = [compare(a, b, c or "", d or "", concept) for a, b, c, d in zip(new, candidate, new_anchor, anchor, strict=True)]
        return pd.DataFrame(rows, columns=SCORES.names)

    return run


def semantic_udf(concept: dict[str, str]):
    kind = T.StructType([T.StructField(k, T.DoubleType()) for k in ("lexicon", "vector", "score")])

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([semantic(x, y, concept) for x, y in zip(a, b, strict=True)], columns=kind.names)

    return run
