"""Phonetic keys: Indic forms as expressions, Double Metaphone by an Arrow UDF."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masthead.vocab import INDIC_REWRITES, SOUND_CLASSES


def indic_normal(word: Column) -> Column:
    """The ordered rewrites, then letters a-z only."""
    out = F.lower(F.trim(word))
    for pattern, to in INDIC_REWRITES:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, "[^a-z]", "")


def indic_soundex(word: Column) -> Column:
    """Initial and four digits; vowels and h part equal classes."""
    normal = indic_normal(word)
    letters = "".join(SOUND_CLASSES) + "aeiouyh"
    digits = "".join(str(i + 1) * len(c) for i, c in enumerate(SOUND_CLASSES)) + "0" * 7
    runs = F.regexp_replace(F.translate(normal, letters, digits), r"(.)\1+", "$1")
    coded = F.replace(F.substring(runs, F.lit(2), F.length(runs)), F.lit("0"), F.lit(""))
    return F.when(normal == "", "").otherwise(F.rpad(F.concat(F.upper(F.substring(normal, 1, 1)), coded), 5, "0"))


_REWRITES = [(re.compile(p), to) for p, to in INDIC_REWRITES]
_CLASS = {c: str(i + 1) for i, of in enumerate(SOUND_CLASSES) for c in of}


@lru_cache(200_000)
def indic_normal_py(word: str) -> str:
    for pattern, to in _REWRITES:
        word = pattern.sub(to, word)
    return re.sub("[^a-z]", "", word)


@lru_cache(200_000)
def indic_soundex_py(word: str) -> str:
    normal = indic_normal_py(word)
    if not normal:
        return ""
    codes = [_CLASS.get(c, "") for c in normal]
    kept = [c for before, c in zip(codes, codes[1:], strict=False) if c and c != before]
    return (normal[0].upper() + "".join(kept) + "0000")[:5]


VOWELS = frozenset("AEIOUY")
KEY_LENGTH = 8


@lru_cache(200_000)
def double_metaphone(word: str) -> tuple[str, str]:
    """Primary and secondary keys of at most eight characters, after L. Philips.

    Characters other than A-Z are dropped first.  The secondary key is the
    primary's copy when no rule made them differ.
    """
    w = re.sub("[^A-Z]", "", word.upper())
    n = len(w)
    if not n:
        return "", ""
    one: list[str] = []
    two: list[str] = []

    def add(a: str, b: str | None = None) -> None:
        one.append(a)
        two.append(a if b is None else b)

    def at(start: int, *options: str) -> bool:
        return 0 <= start < n and any(w.startswith(o, start) for o in options)

    def ch(i: int) -> str:
        return w[i] if 0 <= i < n else ""

    def vowel(i: int) -> bool:
        return ch(i) in VOWELS and ch(i) != ""

    slavic = "W" in w or "K" in w or "CZ" in w or "WITZ" in w
    germanic = at(0, "SCH")
    i = 1 if at(0, "GN", "KN", "PN", "WR", "PS") else 0
    if w[0] == "X":
        add("S")
        i = 1
    simple = {"B": "P", "D": "T", "F": "F", "K": "K", "L": "L", "M": "M", "N": "N", "P": "P", "Q": "K", "R": "R", "T": "T", "V": "F"}
    while i < n and (len("".join(one)) < KEY_LENGTH or len("".join(two)) < KEY_LENGTH):
        c, step = w[i], 1
        if c in VOWELS:
            if i == 0:
                add("A")
        elif c == "B":
            add("P")
            step = 2 if ch(i + 1) == "B" else 1
        elif c == "C":
            if i > 1 and not vowel(i - 2) and at(i - 1, "ACH") and ch(i + 2) != "I" and (ch(i + 2) != "E" or at(i - 2, "BACHER", "MACHER")):
                add("K")
                step = 2
            elif i == 0 and at(0, "CAESAR"):
                add("S")
                step = 2
            elif at(i, "CHIA"):
                add("K")
                step = 2
            elif at(i, "CH"):
                step = 2
                if i > 0 and at(i, "CHAE"):
                    add("K", "X")
                elif i == 0 and (at(1, "HARAC", "HARIS") or at(1, "HOR", "HYM", "HIA", "HEM")) and not at(0, "CHORE"):
                    add("K")
                elif germanic or at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or at(i + 2, "T", "S") or ((i == 0 or at(i - 1, "A", "O", "U", "E")) and (i + 2 >= n or at(i + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W"))):
                    add("K")
                elif i > 0:
                    add("K") if at(0, "MC") else add("X", "K")
                else:
                    add("X")
            elif at(i, "CZ") and not at(i - 2, "WICZ"):
                add("S", "X")
                step = 2
            elif at(i + 1, "CIA"):
                add("X")
                step = 3
            elif at(i, "CC") and not (i == 1 and w[0] == "M"):
                if at(i + 2, "I", "E", "H") and not at(i + 2, "HU"):
                    add("KS") if (i == 1 and w[0] == "A") or at(i - 1, "UCCEE", "UCCES") else add("X")
                    step = 3
                else:
                    add("K")
                    step = 2
            elif at(i, "CK", "CG", "CQ"):
                add("K")
                step = 2
            elif at(i, "CI", "CE", "CY"):
                add("S", "X") if at(i, "CIO", "CIE", "CIA") else add("S")
                step = 2
            else:
                add("K")
                step = 2 if at(i + 1, "C", "K", "Q") and not at(i + 1, "CE", "CI") else 1
        elif c == "D":
            if at(i, "DG"):
                soft = at(i + 2, "I", "E", "Y")
                add("J" if soft else "TK")
                step = 3 if soft else 2
            else:
                add("T")
                step = 2 if at(i, "DT", "DD") else 1
        elif c == "G":
            if ch(i + 1) == "H":
                step = 2
                if i > 0 and not vowel(i - 1):
                    add("K")
                elif i == 0:
                    add("J" if ch(i + 2) == "I" else "K")
                elif at(i - 2, "B", "H", "D") or at(i - 3, "B", "H", "D") or at(i - 4, "B", "H"):
                    pass
                elif i > 2 and ch(i - 1) == "U" and at(i - 3, "C", "G", "L", "R", "T"):
                    add("F")
                elif i > 0 and ch(i - 1) != "I":
                    add("K")
            elif ch(i + 1) == "N":
                step = 2
                if i == 1 and vowel(0) and not slavic:
                    add("KN", "N")
                elif not at(i + 2, "EY") and ch(i + 1) != "Y" and not slavic:
                    add("N", "KN")
                else:
                    add("KN")
            elif at(i + 1, "LI") and not slavic:
                add("KL", "L")
                step = 2
            elif i == 0 and (ch(1) == "Y" or at(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
                add("K", "J")
                step = 2
            elif (at(i + 1, "ER") or ch(i + 1) == "Y") and not at(0, "DANGER", "RANGER", "MANGER") and not at(i - 1, "E", "I", "RGY", "OGY"):
                add("K", "J")
                step = 2
            elif at(i + 1, "E", "I", "Y") or at(i - 1, "AGGI", "OGGI"):
                step = 2
                if germanic or at(i + 1, "ET"):
                    add("K")
                elif w[i + 1 : i + 4] == "IER" and i + 4 >= n:
                    add("J")
                else:
                    add("J", "K")
            else:
                add("K")
                step = 2 if ch(i + 1) == "G" else 1
        elif c == "H":
            if (i == 0 or vowel(i - 1)) and vowel(i + 1):
                add("H")
                step = 2
        elif c == "J":
            if at(0, "SAN") and i == 3 or at(i, "JOSE"):
                add("H") if (i == 0 and n == 4) or at(0, "SAN") else add("J", "H")
            elif i == 0:
                add("J", "A")
            elif vowel(i - 1) and not slavic and ch(i + 1) in ("A", "O"):
                add("J", "H")
            elif i == n - 1:
                add("J", "")
            elif not at(i + 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not at(i - 1, "S", "K", "L"):
                add("J")
            step = 2 if ch(i + 1) == "J" else 1
        elif c == "L":
            if ch(i + 1) == "L":
                step = 2
                ending = (i == n - 3 and at(i - 1, "ILLO", "ILLA", "ALLE")) or ((at(n - 2, "AS", "OS") or at(n - 1, "A", "O")) and at(i - 1, "ALLE"))
                add("L", "") if ending else add("L")
            else:
                add("L")
        elif c == "M":
            add("M")
            step = 2 if ch(i + 1) == "M" or (at(i - 1, "UMB") and (i + 1 == n - 1 or at(i + 2, "ER"))) else 1
        elif c == "P":
            add("F" if ch(i + 1) == "H" else "P")
            step = 2 if at(i + 1, "H", "P", "B") else 1
        elif c == "R":
            if i == n - 1 and not slavic and at(i - 2, "IE") and not at(i - 4, "ME", "MA"):
                add("", "R")
            else:
                add("R")
            step = 2 if ch(i + 1) == "R" else 1
        elif c == "S":
            if at(i - 1, "ISL", "YSL"):
                pass
            elif i == 0 and at(0, "SUGAR"):
                add("X", "S")
            elif at(i, "SH"):
                add("S") if at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else add("X")
                step = 2
            elif at(i, "SIO", "SIA"):
                add("S") if slavic else add("S", "X")
                step = 3
            elif (i == 0 and at(1, "M", "N", "L", "W")) or at(i + 1, "Z"):
                add("S", "X")
                step = 2 if at(i + 1, "Z") else 1
            elif at(i, "SC"):
                step = 3
                if ch(i + 2) == "H":
                    if at(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                        add("X", "SK") if at(i + 3, "ER", "EN") else add("SK")
                    elif i == 0 and not vowel(3) and ch(3) != "W":
                        add("X", "S")
                    else:
                        add("X")
                else:
                    add("S" if at(i + 2, "I", "E", "Y") else "SK")
            else:
                add("", "S") if i == n - 1 and at(i - 2, "AI", "OI") else add("S")
                step = 2 if at(i + 1, "S", "Z") else 1
        elif c == "T":
            if at(i, "TION", "TIA", "TCH"):
                add("X")
                step = 3
            elif at(i, "TH", "TTH"):
                add("T") if at(i + 2, "OM", "AM") or germanic else add("0", "T")
                step = 2
            else:
                add("T")
                step = 2 if at(i + 1, "T", "D") else 1
        elif c == "W":
            if at(i, "WR"):
                add("R")
                step = 2
            else:
                if i == 0 and (vowel(1) or at(0, "WH")):
                    add("A", "F") if vowel(1) else add("A")
                if (i == n - 1 and vowel(i - 1)) or at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or at(0, "SCH"):
                    add("", "F")
                elif at(i, "WICZ", "WITZ"):
                    add("TS", "FX")
                    step = 4
        elif c == "X":
            if not (i == n - 1 and (at(i - 3, "IAU", "EAU") or at(i - 2, "AU", "OU"))):
                add("KS")
            step = 2 if at(i + 1, "C", "X") else 1
        elif c == "Z":
            if ch(i + 1) == "H":
                add("J")
                step = 2
            else:
                add("S", "TS") if at(i + 1, "ZO", "ZI", "ZA") or (slavic and i > 0 and ch(i - 1) != "T") else add("S")
                step = 2 if ch(i + 1) == "Z" else 1
        else:
            add(simple[c])
            step = 2 if ch(i + 1) == c else 1
        i += step
    a, b = "".join(one)[:KEY_LENGTH], "".join(two)[:KEY_LENGTH]
    return a, b or a


@F.pandas_udf(T.StructType([T.StructField("primary", T.StringType()), T.StructField("secondary", T.StringType())]))
def double_metaphone_udf(word: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([double_metaphone(w or "") for w in word], columns=["primary", "secondary"])
