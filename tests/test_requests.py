"""Requests, application records, pair details and concepts of titles."""

import pytest

import __spark_entry__ as entry
from masthead import queries as screening
from masthead.functions import similarity as sim
from masthead.functions.phonetic import double_metaphone
from masthead.plans import apply
from masthead.sources import tables

SF = "/root/testdata/sf0.001"


def test_request_bounds(spark):
    rows = spark.createDataFrame([(None,), ("",), ("x" * 300,), ("x" * 301,)], "title string")
    assert [r.e for r in rows.select(apply.request_error(rows.title).alias("e")).collect()] == ["MISSING", "TOO_SHORT", None, "TOO_LONG"]
    assert apply.checked_batch(rows, 4) is rows
    for refused in (rows.limit(0), rows.unionAll(rows)):
        with pytest.raises(ValueError):
            apply.checked_batch(refused, 7)


def test_accepted_applications_are_recorded(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS requests")
    tables.create_tables(spark, "requests")
    results = spark.createDataFrame(
        [(1, "Aurora", "a", "Approved", "APPROVED", 80.0, "ACCEPTED"), (2, "News", "b", "Rejected", "REJECTED_STAGE_1", 0.0, "TURNED_AWAY"), (3, "Aurora", "b", "Approved", "APPROVED", 80.0, "LOCKED_BY_OTHER")],
        "query_id long, title string, applicant_id string, status string, decision string, verification_probability double, result string",
    )
    try:
        apply.record_applications(results, "requests.title_applications")
        (row,) = spark.table("requests.title_applications").collect()
        assert (row.id, row.title, row.decision_code, row.applicant_email) == (1, "Aurora", "APPROVED", None)
        assert row.application_no.startswith("APP-") and row.submitted_at
    finally:
        spark.sql("DROP DATABASE requests CASCADE")


def test_details_carry_the_score(spark):
    for a, b in [("Daineq Bhaskar", "Dainik Bhaskar"), ("Namascar India", "Namaskar India"), ("Bat", "Bet"), ("Delta", "Solar"), ("", "x"), ("One Two", "One Two")]:
        score, pairs = sim.aligned(sim._words(a), sim._words(b))
        assert score == sim.phonetic(a, b)
        if pairs and all(p[2] not in ("exact", "whole key") for p in pairs):
            assert score == pytest.approx(sum(p[3] for p in pairs) / max(len(a.split()), len(b.split())), abs=1e-3)
    same = {(r.a, r.b): r.similarity for r in entry.queries()["phonetic_pairs"](spark, SF).collect()}
    assert {(r.a, r.b): r.similarity for r in entry.queries()["phonetic_details"](spark, SF).collect()} == same


def test_fingerprints(spark):
    got = sim.fingerprint("Prabhat Samachar 24")
    assert got["primary"] == [double_metaphone(w)[0] for w in ("prabhat", "samachar")]
    assert got["metaphone"] == " ".join(got["primary"]) and got["soundex_key"] == "-".join(got["soundex"])
    assert entry.queries()["phonetic_fingerprints"](spark, SF).count() == screening.all_titles(spark, SF).count()
