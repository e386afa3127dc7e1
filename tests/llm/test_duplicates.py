"""Exact and near duplicates and the pipeline, against brute force."""

import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from masthead.llm import dedup, jaccard
from masthead.llm.components import components

SF = "/root/testdata/sf0.001"


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def classes_by_hand(rows, k, percent):
    """{row number: (set size, smallest id of its class)}"""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    inverse = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverse[x].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in inverse[x] if j > i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(j)] = root(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(len(s), least.get(root(i))) for i, s in enumerate(sets)]


def edited_copies(n, size, seed):
    """A family of copies of one text with a few changed words each."""
    rng = np.random.default_rng(seed)
    base = [f"w{seed}x{i}" for i in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(int(rng.integers(0, 6))):
            words[int(rng.integers(0, size))] = f"e{int(rng.integers(0, 10**9))}"
        out.append(" ".join(words))
    return out


def family_rows():
    texts = edited_copies(60, 120, 1) + edited_copies(30, 40, 2) + edited_copies(10, 900, 3) + ["a b", "A  b", "a", "", None, "a b c d e", "a b c d e f g", "x " * 4000, "x " * 4001]
    return list(enumerate(texts))


@pytest.mark.parametrize("k, percent, cluster, pairs", [(4, 85, 1500, 8), (5, 80, 1500, 8), (4, 85, 7, 2)])
def test_classes(spark, monkeypatch, k, percent, cluster, pairs):
    monkeypatch.setattr(jaccard, "CLUSTER", cluster)
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in family_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicate_classes(df, k, percent).collect()}
    assert got == {doc: want for (doc, _), want in zip(rows, classes_by_hand(rows, k, percent), strict=True)}


def test_large_group_costs_its_size(spark, monkeypatch):
    """A group of near copies many blocks large, with a few outsiders that share its keys: sets sent to tasks stay a few a set."""
    monkeypatch.setattr(jaccard, "CLUSTER", 20)
    sent, deal = [], jaccard._dealt

    def counted(rows, others):
        out = jaccard.materialize(deal(rows, others), "test-dealt")
        sent.append((out.count(), out.groupBy("task").count().agg({"count": "max"}).first()[0] or 0))
        return out

    monkeypatch.setattr(jaccard, "_dealt", counted)
    texts = edited_copies(800, 400, 1) + [" ".join([f"w1x{i}" for i in range(200)] + [f"o{j}y{i}" for i in range(200)]) for j in range(10)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicate_classes(df, 4, 85).collect()}
    assert got == dict(enumerate(classes_by_hand(rows, 4, 85)))
    n_sets = len({jaccard.set_digest(jaccard.shingles(t, 4)) for t in texts})
    assert n_sets > 600 and sum(n for n, _ in sent) < 5 * n_sets  # pairs of blocks would send each 30 times and more
    assert max(m for _, m in sent) < 4 * 20


def test_class_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicate_classes(none).count() == 0
    rows = [(None, "one two three four five six"), (3, "one two three four five six"), (3, "another text of some other words here"), (2, None), (None, None)]
    df = spark.createDataFrame([(*r, "k", "s") for r in rows], "doc_id long, text string, keys string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicate_classes(df).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 3, 3), (2, 0, 2), (None, 0, None)], key=str)
    kept = jaccard.near_dedup(df)
    assert kept.columns == df.columns and kept.count() == 4


def test_keys_meet():
    rng = np.random.default_rng(0)
    for percent in (85, 80):
        for _ in range(400):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.int64).astype(np.uint64) << np.uint64(1))
            drop = int(rng.integers(0, len(a) // 6 + 1))
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 8 + 1)), dtype=np.int64).astype(np.uint64))))
            if not len(b):
                continue
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common):
                assert len(np.intersect1d(jaccard.block_keys(a, percent), jaccard.block_keys(b, percent)))
                x, y = (jaccard.sketch(s, jaccard.sketch_bits(len(s))) for s in (a, b))
                assert jaccard.may_link(len(a), x, len(b), y, percent)


def test_components(spark):
    rng = np.random.default_rng(1)
    for n, m in ((50, 30), (200, 150), (40, 0)):
        edges = rng.integers(0, n, (m, 2)).tolist() + ([[i, i + 1] for i in range(1000, 1060)] if m else [])
        parent = {}

        def root(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a != b:
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
        df = spark.createDataFrame(edges, "a long, b long") if edges else spark.createDataFrame([], "a long, b long")
        got = {r.node: r.component for r in components(df).collect()}
        assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("bound, tables", [(140, 2), (139, None)])
def test_components_of_few_edges(spark, monkeypatch, bound, tables):
    """Edges up to the bound are solved by one task, with the result of the rounds that more of them take."""
    module, written = sys.modules[components.__module__], []
    write = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, label, *used: written.append(label) or write(df, label, *used))
    monkeypatch.setattr(module, "LOCAL_EDGES", bound, raising=False)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(460, 500)]
    pairs = [(900 + 2 * i, 901 + 2 * i) for i in range(38)]
    edges = [*chain, *star, *pairs, (7, 7), (161, 130)]
    got = sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()))
    want = [(i, 100) for i in range(100, 162)] + [(i, 460) for i in range(460, 501)] + [(x, a) for a, b in pairs for x in (a, b)]
    assert got == want
    assert len(written) == tables if tables else len(written) > 4


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_report(spark):
    texts = ["a  b", "a b", "a\tb", None, "", "x", "a b\u00a0", "a b ", "y" * 200_000] + ["hot  copy"] * 300
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    by = defaultdict(list)
    for i, t in enumerate(texts):
        by[normal(t)].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in dedup.dedup_report(df).collect()}
    assert got == {i: (min(g), len(g), i == min(g)) for g in by.values() for i in g}
    kept = dedup.exact_dedup(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in by.values())


def test_exact_edges(spark):
    df = spark.createDataFrame([(None, "a", 1), (5, "a", 2), (5, "a", 3), (None, "b", 4), (None, "b", 5)], "doc_id long, text string, __n int")
    rows = dedup.dedup_report(df).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 2
    assert {r.keep_id for r in rows} == {5, None}
    kept = dedup.exact_dedup(df)
    assert kept.columns == df.columns and kept.count() == 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert dedup.dedup_report(none).count() == 0 and dedup.exact_dedup(none).count() == 0


def test_filter_grows_with_the_rows(spark, monkeypatch):
    """With a filter that is full, ranges keep the share of unique rows that shuffle low."""
    monkeypatch.setattr(dedup, "MAX_BITS", 15)
    texts = spark.range(9_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") % 100 < 5, F.col("id") % 50).otherwise(F.col("id"))).alias("text"))
    assert dedup._ranges(9_000) == 5
    asked = dedup._asked(texts.withColumn("__sha", dedup.digest()), 9_000)
    unique = asked.filter("doc_id % 100 >= 5")
    assert unique.filter("__maybe").count() < 0.05 * unique.count()
    assert asked.filter("doc_id % 100 < 5 and not __maybe").count() == 0 and asked.count() == 9_000
    assert dedup.dedup_report(texts).filter("kept").count() == texts.select("text").distinct().count()
    kept = dedup.exact_dedup(texts)
    assert kept.columns == texts.columns and kept.count() == texts.select("text").distinct().count()


def test_dedup_is_native(spark):
    plan = dedup.exact_dedup(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "packing"]
    now = docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        kept.append([(r.doc_id, r.text) for r in now.collect()])
    lang, exact, near = kept
    assert len(lang) >= 0.98 * docs.count()
    first = {}
    for doc, text in sorted(lang):
        first.setdefault(normal(text), doc)
    assert sorted(d for d, _ in exact) == sorted(first.values())
    by_hand = classes_by_hand(exact, 5, 80)
    assert sorted(d for d, _ in near) == sorted(d for (d, _), (_, c) in zip(exact, by_hand, strict=True) if c is None or c == d)
    rows = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in rows.select("doc_id").collect()} == {d for d, _ in near}
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
