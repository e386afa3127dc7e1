"""Whole legal texts, tables of other licences, and short texts without a known n-gram."""

from pathlib import Path

import numpy as np
import pytest

from masthead.llm import langid, licenses

LEGAL = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not LEGAL.is_dir(), reason="no legal texts on this machine")
def test_full_legal_texts(spark):
    want = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0"}
    rows = spark.createDataFrame([(f, (LEGAL / f).read_text()) for f in want], "doc_id string, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan_licenses(rows).filter("unit = 'text'").collect()} == want


def test_table_of_other_licenses(spark):
    docs = spark.createDataFrame([(1, "Do as you like!"), (2, "Be kind\nDO AS YOU LIKE"), (3, "MIT License")], "doc_id int, text string")
    table = spark.createDataFrame([("do as you like", "X-1"), ("Do as you like", "X-1")], "text string, license_id string")
    got = licenses.scan_licenses(docs, table=table).collect()
    assert sorted((r.doc_id, r.unit, r.license_id) for r in got) == [(1, "text", "X-1"), (2, "line", "X-1")]
    again = licenses.scan_licenses(docs, table=spark.createDataFrame([(got[0].digest, "X-2")], "digest string, license_id string"))
    assert {(r.doc_id, r.license_id) for r in again.collect()} == {(1, "X-2"), (2, "X-2")}


def test_short_texts_without_a_known_gram_are_rejected():
    model = langid.fit_model([(lang, *langid.row_grams(text)) for lang, text in (("en", "the cat and the dog " * 9), ("de", "der hund und die katze " * 9)) for _ in range(3)])
    assert model.predict("\u0449\u044b\u0436")[1:] == (0.0, True)
    assert not model.predict("the")[2] and np.isclose(model.floor[0], 0)
