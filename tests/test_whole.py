"""Queries over their whole tables, without the cuts of smaller definitions."""

import pytest

import __spark_entry__ as entry
from masthead import queries as screening
from masthead.operators import lexicon
from masthead.plans import screen

SF = "/root/testdata/sf0.001"
PAIRED = ["levenshtein_similarity", "jaro_winkler_similarity", "dice_trigrams", "token_jaccard", "hash_vector_cosine", "token_sort_ratio", "orthographic_aggregate", "phonetic_pairs"]


def run(spark, name):
    return entry.queries()[name](spark, SF)


@pytest.mark.parametrize("name", PAIRED)
def test_all_pairs_of_names(spark, name):
    n = screening.names(spark, SF).count()
    got = run(spark, name).select("a", "b")
    assert got.count() == got.distinct().count() == n * n
    assert got.filter("substr(a, 1, 1) <> substr(b, 1, 1)").count() > 0


def test_top_matches_are_the_nearest_of_all_names(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    all_names = sorted(r.name for r in screening.names(spark, SF).collect())
    want = {(a, i + 1, b) for a in all_names for i, b in enumerate(sorted((b for b in all_names if b != a), key=lambda b: (distance(a, b) / max(len(a), len(b)), b))[:5])}
    assert {(r.a, r.place, r.b) for r in run(spark, "top_matches").collect()} == want


def test_counts_of_all_pairs(spark):
    n = screening.names(spark, SF).count()
    assert sum(r.n for r in run(spark, "status_bands").collect()) == n * n == run(spark, "batch_counts").first().total


def test_default_lexicon_is_whole(spark):
    assert {r.vocabulary: r.n for r in run(spark, "vocabulary_sizes").collect()} .items() >= {"concepts": 26, "entries": 724, "words": 417, "languages": 12}.items()
    of = lexicon.concept_map(lexicon.default_lexicon(spark))
    assert (of["masika"], of["oli"], of["lokam"]) == ("journal", "light", "world")
    assert {"national", "chronicle", "revolution", "victory"} <= set(of.values())


def test_index_has_the_whole_lexicon(spark):
    titles = spark.createDataFrame([(1, "Viduthalai Kural", "1")], "entry_id int, title string, registration_no string")
    rows = titles.selectExpr("*", "'Tamil' AS language", "'National' AS state", "'Daily' AS periodicity", "'x' AS publisher")
    index = screen.build_index(screening.registry.build_registry(rows))
    assert len(index.concept_of) == 417 and index.concepts.count() == 417


@pytest.mark.parametrize("name", ["numeric_check", "anchor_extract", "generic_only", "violation_lists"])
def test_all_titles(spark, name):
    ids = {r.id for r in run(spark, name).select("id").collect()}
    pages, parts = (screening.table(spark, SF, t).count() for t in ("pages", "part"))
    assert len(ids) == run(spark, name).count() == len(screening.FIXTURES) + pages + parts


def test_apply_and_export_at_size(spark):
    titles = screening.all_titles(spark, SF)
    n, blank = titles.count(), titles.filter("trim(title) = ''").count()
    applied = run(spark, "apply_end_to_end").collect()
    assert len(applied) == len({r.query_id for r in applied}) == 2 * n
    parts = {2 * (2 * r.p_partkey + 1) for r in screening.table(spark, SF, "part").collect()}
    mine = [r for r in applied if r.query_id in parts]
    # a registered name with a word of gibberish meets that rule first
    assert len(mine) == len(parts) and all(r.decision == "REJECTED_ALREADY_REGISTERED" or r.decision.endswith("GIBBERISH") for r in mine)
    assert {r.result for r in mine} == {"TURNED_AWAY"}
    assert run(spark, "export_batch").count() == n - blank
    assert run(spark, "screen_seed_registry").count() == n


def test_candidates_of_page_titles(spark):
    pages = {r.page_id for r in screening.page_titles(spark, SF).collect()}
    assert pages & {r.query_id for r in run(spark, "candidates_top100").select("query_id").distinct().collect()}
