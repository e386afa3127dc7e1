"""Unit tests of keys, measures and rules on known values."""

import random

import pytest
from pyspark.sql import functions as F

from masthead.functions import phonetic as ph
from masthead.functions import rules, text
from masthead.functions import similarity as sim
from masthead.functions.similarity import levenshtein_ratio
from masthead.functions.text import clean_text, tokens
from masthead.operators import lexicon


@pytest.fixture(scope="module")
def concepts(spark):
    return lexicon.concept_map(lexicon.default_lexicon(spark))


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


@pytest.mark.parametrize("word, keys", [("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")), ("", ("", "")), ("123", ("", ""))])
def test_double_metaphone(word, keys):
    assert ph.double_metaphone(word) == keys


@pytest.mark.parametrize("a, b", [("Namaskar", "Namascar"), ("Dainik", "Daineq")])
def test_equal_primary_keys(a, b):
    assert ph.double_metaphone(a)[0] == ph.double_metaphone(b)[0]


@pytest.mark.parametrize("a, b", [("bharat", "barat"), ("khabar", "kabar"), ("dainik", "daynik"), ("sooraj", "suraj"), ("vani", "wani"), ("qaumi", "kaumi")])
def test_indic_pairs_agree(a, b):
    assert ph.indic_normal_py(a) == ph.indic_normal_py(b)


def test_indic_expression_equals_python(spark):
    words = ["namaskar", "barat", "mannan", "vani", "aachchha", "xyz", "news", "", "cycle", "hhh"]
    assert column(spark, words, ph.indic_normal) == [ph.indic_normal_py(w) for w in words]
    assert column(spark, words, ph.indic_soundex) == [ph.indic_soundex_py(w) for w in words]
    assert ph.indic_soundex_py("namaskar") == "N5260"


@pytest.mark.parametrize("a, b, low, high", [
    ("Namaskar", "Namascar", 0.9, 1), ("Bharat", "Bhaarat", 0.9, 1), ("Bharat", "Bharath", 0.85, 1), ("Dainik", "Daineq", 0.85, 1), ("bat", "buzz", 0, 0.3), ("pen", "pit", 0, 0.3),
    ("bat", "bet", 0, 0.5), ("pan", "pin", 0, 0.5), ("Daily India Times", "Times Daily India", 0.9, 1), ("Hindustan Times", "Gujarat Samachar", 0, 0.3), ("", "x", 0, 0), ("24", "365", 0.95, 0.95),
])
def test_phonetic(a, b, low, high):
    assert low <= sim.phonetic(a, b) <= high


@pytest.mark.parametrize("a, b, low, high", [("Hindustan Times", "Hindustan Tymes", 0.85, 1), ("Times of India", "India Times", 0.8, 1), ("orbit", "debit", 0, 0.65), ("Daily News!", "daily news", 1, 1), ("", "x", 0, 0)])
def test_orthographic(a, b, low, high):
    assert low <= sim.orthographic(a, b)["score"] <= high


def test_measures():
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert sim.indel_ratio("kitten", "sitting") == pytest.approx(8 / 13)
    assert sim.dice_py("ABCDEF", "UVWXYZ") == 0 and sim.dice_py("Hindustan", "Hindustan") == 1
    assert sim.ngrams("a") == {"_a_"}


@pytest.mark.parametrize("a, b, low, high", [("Daily Evening", "Pratidin Sandhya", 0.85, 1), ("Morning News", "Prabhat Samachar", 0.85, 1), ("Peoples Voice", "Jan Vani", 0.85, 1), ("Daily News", "Solar Science", 0, 0.3)])
def test_semantic(concepts, a, b, low, high):
    assert low <= sim.semantic(a, b, concepts)["score"] <= high


def test_pair(concepts):
    sound, spelling, _ = sim.compare("namascar daily", "namaskar daily", "namascar", "namaskar", concepts)
    assert max(sound, spelling) >= 0.9
    assert sim.compare("the weekly navbharat post", "daily navbharat express", "navbharat", "navbharat", concepts)[1] == 0.95


def test_gibberish(spark):
    words = ["zzzzzzz", "asdfasdfasdf", "ghibrisg", "qwrtpzx", "herald", "bbc", "budget"]
    got = column(spark, words, rules.gibberish_type)
    assert got[:4] == ["REPETITIVE_GIBBERISH", "REPETITIVE_GIBBERISH", "UNPRONOUNCEABLE_GIBBERISH", "UNPRONOUNCEABLE_GIBBERISH"]
    assert got[4:6] == [None, None] and got[6] == "UNPRONOUNCEABLE_GIBBERISH"
    low, high = column(spark, ["aaaaaaa", "newspaper"], rules.entropy)
    assert low == 0 and high > 2.5


def test_structure(spark):
    titles = ["News+", "Star #1", "12345", "24 7", "", "   ", None, "The Daily Herald", "\U0001fae0 News"]
    assert column(spark, titles, rules.structure_error) == ["PROHIBITED_SYMBOLS", "PROHIBITED_SYMBOLS", "PURE_NUMERIC", "PURE_NUMERIC", "EMPTY_TITLE", "EMPTY_TITLE", "EMPTY_TITLE", None, "PROHIBITED_SYMBOLS"]


def test_anchor(spark):
    titles = ["The Daily Mumbai Express", "The Daily News", "Delta India", "naïve"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, v string").withColumn("t", text.tokens(text.clean_text(F.col("v"))))
    rows = df.select("i", text.anchor_parts(F.col("t")).alias("a"), "t").orderBy("i").collect()
    assert [r.a.anchor for r in rows[:3]] == ["mumbai", "", "delta"]
    assert rows[0].a.prefixes == ["the", "daily"] and rows[0].a.suffixes == ["express"]
    assert rows[3].t == ["nai", "ve"]


def test_edit_distance_against_the_table():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abcé ", k=rng.randrange(0, 80 if rng.random() < 0.1 else 9))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert levenshtein_ratio(a, b) == (1 - row[-1] / max(len(a), len(b)) if a or b else 1.0)


def test_terms_are_whole_words_and_decomposition_spares_ascii(spark):
    rows = spark.createDataFrame([("the police gazette",), ("policeman",), ("lok  sabha",), ("",), (None,), ("Café ﬁne",)], "title string")
    toks = tokens(clean_text(F.col("title")))
    got = rows.select(rules.terms_in(toks, ["police", "lok sabha"]).alias("x"), clean_text(F.col("title")).alias("c")).collect()
    assert [r.x for r in got] == [["police"], [], ["lok sabha"], [], None, []]
    assert [r.c for r in got] == ["the police gazette", "policeman", "lok sabha", "", None, "cafe fine"]
