"""BPE, licences, language, packing, shards, chat, media, URLs: exact results and edge cases."""

import hashlib
import json
import math
import random
import re
import subprocess
import sys
import textwrap
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from masthead.llm import chat, flac, langid, licenses, packing, tokens, urls, wavelet
from masthead.llm.bpe import BpeCodec, MergeAutomaton, bpe_decode, bpe_digests, bpe_encode
from masthead.llm.queries import CONTROL_TEXT, QUERIES, URL_RULES
from masthead.llm.tokens import CachedEncoder

SF = "/root/testdata/sf0.001"
TRICKY = ["", " ", "  ", "a  b", "a\n  b", "a \nb", "\n\n a b", "a\u00a0 b", "a\x1c b", "x<|endoftext|> y\n <|endoftext|>z", "don't  stop.\nIt's\t5, ok.", "é. ñ, ß日本語 \U0001fae0", "a" * 5000, "word " * 3000, "a.\nb", "\na\n", "x,., y"]


def some_texts(n=3000):
    rng = random.Random(7)
    return TRICKY + ["".join(rng.choice("abcdeth inreons \n.,'-=é日\t<|") for _ in range(rng.randrange(70))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer(definition):
    return Tokenizer.from_str(definition)


def edge_documents(spark, *extra):
    texts = [*TRICKY, None, "", "same text here", "same text here", *extra]
    return spark.createDataFrame([(i, t, None if i % 5 == 0 else "en", "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, ids string")


# -- encoding


def test_automaton_of_a_small_merge_list():
    labels = {0: b"a", 1: b"b", 2: b"ab", 3: b"aa", 4: b"aba", 5: b"abab"}
    merges = [(0, 1, 2), (0, 0, 3), (2, 0, 4), (2, 2, 5)]

    def merged(word):
        parts = [bytes([c]) for c in word]
        for u, v, _ in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == labels[u] and parts[i + 1] == labels[v]:
                    parts[i : i + 2] = [labels[u] + labels[v]]
                i += 1
        return parts

    machine = MergeAutomaton(labels, merges)
    for n in range(1, 12):
        for bits in range(1 << n):
            word = bytes(b"ab"[bits >> i & 1] for i in range(n))
            assert [labels[t] for t in machine.encode_word(word)] == merged(word)


def test_ids_equal_the_library(definition, tokenizer):
    own, cached = BpeCodec(definition), CachedEncoder(definition)
    texts = some_texts()
    for text, ids in zip(texts, cached.encode_batch(texts), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(array("I", ids)) == want
        assert list(array("I", own.encode(text))) == want
        assert own.decode(ids) == tokenizer.decode(want, skip_special_tokens=False) == text


LONG = ["word and\nother 12 words. " * 60_000, "日本語の文。" * 200_000, "ab12," * 210_000, "x " * 10 + "<|endoftext|>" + " y" * 700_000, "tail  \n  space " * 90_000]


def test_long_texts_in_segments(definition, tokenizer):
    own, cached = BpeCodec(definition), CachedEncoder(definition)
    texts = ["before it", *LONG, "", "after"]
    for text, ids, more in zip(texts, cached.encode_stream(iter(texts)), map(own.encode, texts), strict=True):
        want = array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        assert ids == want and more == want
        assert "".join(tokens.segments(text)) == text


def column_ids(own: CachedEncoder, texts: list, end: bytes = b"") -> list[list[int]]:
    out = []
    for ids, lengths in own.encode_column(pa.array(texts, pa.string()), end):
        assert lengths.sum() == len(ids)
        out += [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    return out


PARTS = [*" \n" * 6, *"abzA09'\"_.,!-$\t\r\v\f\x1c\x00\x7f", "'s", "'re", "'T", *"éß×÷Āſñ—…日。ひá²½٣ⅷ😀ªʰ", *"́\u0085      　​﻿", "word", " word", "<|endoftext|>"]


@pytest.mark.parametrize("portion", [tokens.PORTION_BYTES, 90])
def test_column_ids_equal_the_library(definition, tokenizer, monkeypatch, portion):
    monkeypatch.setattr(tokens, "PORTION_BYTES", portion)
    rng, own = random.Random(portion), CachedEncoder(definition)
    own.cache_bytes, own.keeps = 100_000, True
    texts = ["", " ", "end  ", "next", "\n", "x", None, "日本語" * 40, "w" * 300, *some_texts(), "", *["".join(rng.choices(PARTS, k=rng.randrange(40))) for _ in range(4000)], ""]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert column_ids(own, texts) == want
    assert column_ids(own, texts, bytes(4)) == [ids + [0] for ids in want]
    assert column_ids(own, []) == [] and column_ids(own, ["", ""]) == [[], []]
    part = pa.array(texts, pa.string()).slice(3, 7)
    assert np.concatenate([ids for ids, _ in own.encode_column(part)]).tolist() == sum(want[3:10], [])


def test_column_units_are_words_and_signs(definition, tokenizer, monkeypatch):
    """A known word beside any sign or digits asks nothing of the library again."""
    own = CachedEncoder(definition)
    column_ids(own, ["thonder wérzu ! ) ( 12 thonder !) 7"])
    text = "thonder) wérzu! 12) thonder!) wérzu) 12! thonder7 wérzu7!)"
    column_ids(own, [f"thonder!) {x}" for x in ("thonder) 12", "7", "!")])
    asked = []
    for name in ("_whole", "_words", "_lines"):
        real = getattr(own, name)
        monkeypatch.setattr(own, name, lambda units, real=real: asked.extend(units) or real(units))
    assert column_ids(own, [" " + text]) == [tokenizer.encode(" " + text, add_special_tokens=False).ids]
    assert set(asked) <= {")", "!", "!)", "7"}
    before = own.held, len(own.units)
    line = "aB3+" * 60
    assert column_ids(own, [line]) == [tokenizer.encode(line, add_special_tokens=False).ids]
    assert (own.held, len(own.units)) == before



PROBE = """
import sys, psutil, random
from masthead.llm import bpe, shared, tokens
from masthead.llm.queries import tokenizer_path
d = tokens.read_definition(tokenizer_path())
own = tokens.encoder(d) if sys.argv[1] == "tokens" else bpe.codec(d)
encode = own.encode_batch if sys.argv[1] == "tokens" else lambda t: [own.encode(x) for x in t]
rng = random.Random(1)
encode(["warm up " * 50])
start = psutil.Process().memory_info().rss
most = 0
for _ in range(50 if sys.argv[1] == "tokens" else 10):
    encode(["".join(chr(rng.randrange(0x4e00, 0x9fa5)) for _ in range(200)) for _ in range(1000)])
    most = max(most, psutil.Process().memory_info().rss)
assert own.held <= tokens.CACHE_BYTES + (16 << 20), own.held
shared.release()
assert own.held == 0 and not own.rest
print((most - start) >> 20, (psutil.Process().memory_info().rss - start) >> 20)
"""


@pytest.mark.parametrize("kind", ["tokens", "bpe"])
def test_memory_of_many_long_units(kind):
    """Lines of 200 Chinese characters without a space: under 160 MB, and given back."""
    out = subprocess.run([sys.executable, "-c", PROBE, kind], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert int(out[0]) < 160 and int(out[1]) < 100, out


def test_bpe_query_against_the_library(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op1_bpe"](spark, SF).collect()}
    for d in docs.collect():
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids
        said = tokenizer.decode(ids, skip_special_tokens=False)
        assert got.pop(d.doc_id) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    assert not got


def test_bpe_columns(spark, definition):
    docs = edge_documents(spark)
    coded = bpe_encode(docs, definition)  # an input column named ids gives way
    assert coded.columns == ["doc_id", "text", "lang", "ids"]
    back = bpe_decode(coded, definition).collect()
    assert all(r.decoded == (r.text or "") for r in back) and len(back) == docs.count()
    assert bpe_decode(spark.createDataFrame([(1, None)], "i int, ids binary"), definition).first().decoded is None
    assert bpe_digests(docs.limit(0), definition).count() == 0


# -- licences


def test_licenses(spark):
    mit = licenses.TEXTS["MIT"][1]
    changed = mit.replace("MIT License", "MIT LICENCE").replace("\n\n", "\n\nCopyright (c) 2020 Someone\n\n", 1).upper()
    rows = [(1, changed), (2, "Hello\nReleased under the MIT License.\nbye"), (3, None), (4, ""), (5, mit + " more"), (6, "released under the mit licence!"), (6, "released under the mit licence!"), (7, "x " * 50_000)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.unit, r.line_no, r.license_id) for r in got if r.doc_id != 6) == [(1, "text", None, "MIT"), (2, "line", 1, "MIT")]
    assert [(r.unit, r.license_id) for r in got if r.doc_id == 6] == [("text", "MIT")] * 2


@pytest.mark.parametrize("leader", ["", "// ", "# ", " * ", "-- "])
def test_wrapped_licenses(spark, leader):
    """Every known text, wrapped at any width, under a copyright line and behind comment leaders."""
    rows = []
    for name, texts in licenses.TEXTS.items():
        for text in texts:
            for width in range(60, 101):
                lines = ["Copyright (c) 2019, 2021 Some One <one@example.com>", ""]
                for paragraph in text.split("\n\n"):
                    lines += [*textwrap.wrap(paragraph, width, break_on_hyphens=False), ""]
                rows.append((name, "\n".join(leader + line for line in lines)))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).filter("unit = 'text'").groupBy("doc_id", "license_id").count().collect()
    assert {(r.doc_id, r.license_id): r["count"] for r in got} == {(name, name): 41 * len(texts) for name, texts in licenses.TEXTS.items()}


def test_license_filter_loses_nothing(spark):
    """The scan with its filter on words against all texts normalised, and the edges."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = spark.createDataFrame(licenses.all_known(), "digest string, license_id string")
    assert sorted(map(str, licenses.scan_licenses(docs).collect())) == sorted(map(str, licenses.scan_licenses(docs, table=table).collect()))
    odd = spark.createDataFrame([(1, "MIT", "Released under the MIT License")], "doc_id int, digest string, text string")
    assert [r.license_id for r in licenses.scan_licenses(odd.withColumn("license_id", F.lit("x"))).collect()] == ["MIT"]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_license_markers_are_necessary():
    known = [t for of in licenses.TEXTS.values() for t in of] + [f"{o} {n}" for o in licenses.OPENINGS for of in licenses.NAMES.values() for n in of]
    assert all(any(m in t.lower() for m in licenses.markers()) for t in known)
    assert len({d for d, _ in licenses.known()}) == len(licenses.known()) < 300


# -- language


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_predictions(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    right = got.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert right[0] >= 0.97 and right[1] <= 0.01
    assert got.filter("held_out <> (crc32(cast(doc_id as string)) % 4 = 2)").count() == 0


def test_language_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(docs)
    assert model.predict(None) == model.predict("") == model.predict("123 !? 45") == ("und", 0.0, True)
    assert model.predict("Щлыжьйфш " * 40)[2]
    rows = spark.createDataFrame([(1, None, "en"), (1, "x", "en")], "doc_id int, text string, score string")
    out = langid.detect_languages(rows, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "rejected"] and out.count() == 2
    none = langid.fit_languages(docs.limit(0))
    assert none.predict("some text") == ("und", 0.0, True)
    again = langid.fit_languages(docs.repartition(3))
    assert np.allclose(model.centroids, again.centroids)


def grams_by_hand(text):
    """Counts of hashed n-grams, in plain Python."""
    mod = 1 << 32
    codes = [ord(c) for c in " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "] if any(c.isalpha() for c in text) else []
    counts = Counter()
    for i, a in enumerate(codes):
        if a != 32:
            counts[(a * 2654435761 % mod >> 7) % langid.BUCKETS] += 1
        if i:
            two = lambda x, y: (x * 2654435761 * 31 + y * 2246822519) % mod
            counts[(two(codes[i - 1], a) >> 9) % langid.BUCKETS] += 1
            if i > 1:
                counts[((two(codes[i - 2], codes[i - 1]) * 37 + a * 3266489917) % mod >> 11) % langid.BUCKETS] += 1
    return counts


def test_predictions_against_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(docs)
    texts = [r.text for r in docs.limit(60).collect()] + [" ", "ÀÉ x", "Ünï 12 cöde\n\nΣΑΣ", "a", "日本語"]
    for text in texts:
        counts = Counter()
        for bucket, n in grams_by_hand(text or "").items():
            if model.place[bucket] < len(model.idf):
                counts[int(model.place[bucket])] += n
        vector = {f: (1 + math.log(n)) * float(model.idf[f]) for f, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in vector.values())) or 1
        cosines = [sum(v / norm * float(c[f]) for f, v in vector.items()) for c in model.centroids]
        lang, score, _ = model.predict(text)
        assert abs(score - max(0.0, *cosines)) < 1e-4
        if score:
            assert max(c for c, o in zip(cosines, model.owner, strict=True) if model.languages[o] == lang) >= max(cosines) - 1e-4
        whole = model.predict(text)
        monkeypatch.setattr(langid, "PIECE", 7)
        assert np.allclose(model.predict(text)[1], whole[1], atol=1e-6)
        monkeypatch.setattr(langid, "PIECE", 1 << 20)


def test_many_languages_are_learned(spark):
    """A thousand labels: none is left out, and the sample stays small."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " * 30, f"l{i % 1000}") for i in range(4000)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    assert len(model.languages) > 900


# -- packing


def packed(spark, docs, definition, **options):
    return packing.pack_documents(docs, definition, **options).collect()


def check_packing(rows, lengths, capacity):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, pieces in by_doc.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(pieces)):
            assert (piece, start) == (k, at) and (k == 0 or length == capacity)
            at += length
        assert at == lengths[doc]
        assert len(pieces) == -(-at // capacity)
    return len(by_sequence)


@pytest.mark.parametrize("capacity, fan", [(2048, 2000), (64, 7)])
def test_packing(spark, definition, tokenizer, capacity, fan):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(edge_documents(spark).select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = packed(spark, docs.repartition(5), definition, capacity=capacity, fan=fan)
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    n = check_packing(rows, {d: len(i) for d, i in ids.items()}, capacity)
    least = -(-sum(map(len, ids.values())) // capacity)
    assert n <= 1.02 * least + 1
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(array("I", ids[r.doc_id][r.start : r.start + r.length]).tobytes())


def test_packing_rounds_stay_small(spark, definition, monkeypatch):
    """Bins that can't be joined are never gathered, whatever their number."""
    taken = []
    of = packing._joinable
    monkeypatch.setattr(packing, "_joinable", lambda *a: taken.append(of(*a)) or taken[-1])
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10_000 == 5, "a").otherwise("a a a a a a a a").alias("text")).repartition(40)
    out = packing.pack_documents(rows, definition, capacity=16, slack=1)
    assert out.select("sequence_id").distinct().count() == 50_000 - 5
    assert len(taken) <= 4 and max(n for _, n in taken) <= 4 * 40
    more = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a a a").alias("text")).repartition(200)
    n = packing.pack_documents(more, definition, capacity=16, slack=0, fan=64).select("sequence_id").distinct().count()
    assert n <= 55  # 50 at least: four of four tokens in each


def test_packing_odd_ids(spark, definition):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None), (7, "c"), (7, "c")], "doc_id int, text string")
    rows = packed(spark, df, definition, capacity=8)
    assert sorted(((r.doc_id, r.length) for r in rows), key=str) == sorted([(None, 3), (None, 3), (7, 1), (7, 2), (7, 2)], key=str)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(x)[0][0] == 0 and sum(n for _, n in x) <= 8 for x in by.values())


def test_packing_by_column(spark, definition, tokenizer, monkeypatch):
    """Texts are encoded by column, in portions that may be smaller than a text."""

    def by_column(*options, of=packing.encoder):
        own = of(*options)

        class Columns:
            encode_column = staticmethod(own.encode_column)

        return Columns

    monkeypatch.setattr(packing, "encoder", by_column)
    docs = edge_documents(spark)
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    for portion in (64, 1 << 20):
        rows = packed(spark, docs.repartition(2), definition, capacity=32, portion_bytes=portion)
        check_packing(rows, {d: len(i) for d, i in ids.items()}, 32)
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(array("I", ids[r.doc_id][r.start : r.start + r.length]).tobytes())


def test_packing_empty(spark, definition):
    assert packed(spark, edge_documents(spark).limit(0), definition) == []


def test_best_fit_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(40))]
        bins = packing.best_fit(sizes, 30)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        want = []
        for s in sorted(sizes, reverse=True):
            fit = [w for w in want if w[0] >= s]
            if fit:
                b = min(fit, key=lambda w: w[0])
                b[0] -= s
            else:
                want.append([30 - s])
        assert sorted(30 - sum(sizes[i] for i in b) for b in bins) == sorted(w[0] for w in want)


# -- shards


def test_wavelet_shard():
    rng = np.random.default_rng(5)
    for n in (1, 7, 512, 513, 3000):
        tokens = (rng.zipf(1.5, n) % 900).astype(np.uint16)
        cuts = np.unique(np.append(rng.integers(1, n + 1, 9), n))
        tokens[cuts - 1] = 3
        file = wavelet.WaveletShard(wavelet.build(tokens, np.diff(cuts, prepend=0).tolist(), pa.array(range(len(cuts))), 16, end_id=3))
        assert (file.tokens() == tokens).all() and file.ids.to_pylist() == list(range(len(cuts)))
        assert [x.tolist() for x in file.borders()] == [[0, *cuts[:-1].tolist()], cuts.tolist()]
        starts, ends = file.borders()
        assert file.count_many(3, starts, ends).tolist() == [int((tokens[a:b] == 3).sum()) for a, b in zip(starts, ends, strict=True)]
        for i in rng.integers(0, n, 5).tolist():
            t = int(tokens[i])
            assert file.access(i) == t
            where = np.flatnonzero(tokens == t)
            assert file.count(t) == len(where) and file.count(t, 0, i) == (where < i).sum()
            k = int(rng.integers(0, len(where)))
            assert file.select(t, k) == where[k]
        assert file.count(60_000) == 0
        with pytest.raises(IndexError):
            file.access(n)
    with pytest.raises(ValueError):
        wavelet.WaveletShard(b"XXXX" + bytes(40))


def test_shards(spark, definition, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(edge_documents(spark).select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    got = sorted(wavelet.read_token_shards(wavelet.write_token_shards(docs.repartition(3), definition, shard_tokens=5_000)).collect())
    at = 0
    for r, d in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(array("I", ids).tobytes()), ids.count(0))
        at += len(ids)
    assert wavelet.read_token_shards(wavelet.write_token_shards(docs.limit(0), definition)).count() == 0


@pytest.mark.parametrize("kind, ids", [("int", [1, None, 7, 7]), ("string", ["b", "a", None, "é"]), ("date", ["2020-01-02", None, "1999-01-01", "2020-01-02"]), ("timestamp", ["2020-01-02 03:04:05", None, "1999-01-01 00:00:00", None])])
def test_shards_of_other_ids(spark, definition, tmp_path, kind, ids):
    docs = spark.createDataFrame([(x, "some text") for x in ids], "doc_id string, text string").select(F.col("doc_id").cast(kind), "text")
    shards = wavelet.write_token_shards(docs, definition)
    got = wavelet.read_token_shards(shards, docs.schema["doc_id"].dataType)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    order = [r.doc_id for r in got.orderBy("start").collect()]
    assert order == [r.doc_id for r in docs.orderBy("doc_id").collect()]
    assert wavelet.save_shard_files(shards, str(tmp_path / "files")) == shards.count()
    again = wavelet.load_shard_files(spark, str(tmp_path / "files"))
    assert sorted(map(tuple, again.select("part", "first", "n_docs", "n_tokens").collect())) == sorted(map(tuple, shards.select("part", "first", "n_docs", "n_tokens").collect()))
    assert sorted(map(str, wavelet.read_token_shards(again, docs.schema["doc_id"].dataType).collect())) == sorted(map(str, got.collect()))


# -- chat


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("<|\\>nlim_ \n") for _ in range(rng.randrange(12)))
        assert "<|" not in chat.escape(t) and chat.unescape(chat.escape(t)) == t


def test_chat(spark, definition):
    rows = [(1, 0, "user", CONTROL_TEXT), (1, 1, "assistant", CONTROL_TEXT), (2, 1, "assistant", "é日\n. x"), (2, 0, None, None), (2, 2, "assistant", ""), (2, 3, "as\nsistant<|x", "<\\|im_end|>"), (None, 0, "assistant", "z"), (3, 0, "assistant", "dup"), (3, 0, "assistant", "dup"), (4, 0, "assistant", "\U0001fae0" * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.format_conversations(df, definition)
    out = {r.conv_id: r for r in chat.conversation_digests(whole).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    for conv, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = out[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0), definition).count() == 0


def test_chat_mask_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(300):
        cuts = np.sort(rng.choice(200, 40, replace=False))
        spans = cuts.reshape(-1, 2)[rng.random(20) < 0.5]
        edges = np.unique(np.concatenate(([0], rng.integers(0, 200, 60), [200])))
        offsets = np.stack((edges[:-1], edges[1:]), axis=1)
        want = [any(a < e and s < b for a, b in spans.tolist()) for s, e in offsets.tolist()]
        assert chat.mask_tokens(offsets, spans).tolist() == want


# -- media


def test_flac_round_trip():
    rng = random.Random(4)
    data = [bytes(rng.choice([0, 0, 0, 255, 5]) for _ in range(rng.choice([1, 2, 3, 17, 5000]))) for _ in range(40)] + [bytes(1200), b"a" * 3000, bytes(range(256)) * 9, bytes(3000) + b"\xff" + bytes(500), flac.payload("text " * 40_000)]
    for lpc in (False, True):
        streams = flac.encode_many(data, as_lpc=lpc)
        assert [(x.view(np.uint8) ^ 0x80).tobytes() for x in flac.decode_many(streams)] == data
    assert flac.encode_many(data) == [flac.encode_many([d])[0] for d in data]
    long = flac.payload("Some long text, é. " * 150_000)
    assert flac.encode_many([b"x" * 64, long])[1] == flac.encode_many([long])[0]
    assert (flac.decode_many(flac.encode_many([long]))[0].view(np.uint8) ^ 0x80).tobytes() == long
    for place in (-1, -10, 60):
        broken = bytearray(flac.encode_many([flac.payload("hello world " * 500)])[0])
        broken[place] ^= 4
        with pytest.raises((flac.FlacError, IndexError)):
            flac.decode_many([bytes(broken)])


MEDIA_PROBE = """
import psutil, threading, time
from masthead.llm import flac
text = "Some words of a text, é. " * 1_200_000
start, most, done = psutil.Process().memory_info().rss, [0], []
def watch():
    while not done:
        most[0] = max(most[0], psutil.Process().memory_info().rss)
        time.sleep(0.02)
threading.Thread(target=watch).start()
data = flac.payload(text)
stream = flac.encode_many([data])
flac.decode_many(stream)
done.append(1)
print(len(data), most[0] - start)
"""


def test_media_memory_of_a_long_text():
    """A text of 31 MB: its payload, stream and samples, and work of a fixed size."""
    size, most = map(int, subprocess.run([sys.executable, "-c", MEDIA_PROBE], capture_output=True, text=True, check=True, timeout=300).stdout.split())
    assert most < 8 * size + (160 << 20), (size, most)


def test_media(spark):
    docs = edge_documents(spark)
    media = flac.text_to_flac(docs)
    rows = {r.doc_id: r for r in flac.media_digests(media).collect()}
    assert {r.doc_id: tuple(r) for r in flac.media_digests(media, 100).collect()} == {d: tuple(r) for d, r in rows.items()}
    twice = flac.media_digests(flac.text_to_flac(docs.select(F.lit(1).alias("doc_id"), "text"))).collect()
    assert len(twice) == docs.count() and {r.payload_sha256 for r in twice} == {r.payload_sha256 for r in rows.values()}
    for d in docs.collect():
        want = flac.payload(d.text or "")
        r = rows[d.doc_id]
        assert len(want) % 64 == 0 and len(want) >= 64
        x = np.frombuffer(want, np.uint8).astype(int) - 128
        assert r.feature == f"sum={x.sum()};energy={(x * x).sum()};peak={abs(x).max()};crossings={((x[1:] < 0) != (x[:-1] < 0)).sum()}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((d.text or "").encode()), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    same = [rows[d.doc_id] for d in docs.collect() if d.text == "same text here"]
    assert same[0][1:] == same[1][1:]
    pcm = flac.flac_to_pcm(media, 1000).filter("doc_id = 12").orderBy("block").collect()
    assert [r.sample_offset for r in pcm] == list(range(0, 1000 * len(pcm), 1000))
    assert flac.media_digests(media.limit(0)).count() == 0


# -- URLs


def rule_by_hand(host, path):
    best = None
    for rule, verdict in URL_RULES:
        domain, _, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def test_url_rules(spark):
    cases = [None, "", "nothing", "http://Blog.Example.NET/en/1?x=1", "http://example.net/en", "https://a.net", "https://a.net/", "ftp://internet/x", "http://x.org/fr/?q", "http://x.org/frx", "http://www.example.com/de/9#t", "a://b://c.net/d", "http://net/", "http://É.NET/\n/x", "http://" + "a" * 5000 + ".net/" + "b" * 5000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id int, url string")
    model = urls.train_urls(urls.seed_urls(spark))
    for r in urls.judge_urls(df, URL_RULES, model).collect():
        u = cases[r.page_id] or ""
        host, path = "", ""
        if "://" in u:
            rest = u.split("://", 1)[1]
            end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
            path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        assert (r.host, r.path) == (host, path)
        best = rule_by_hand(host, path)
        assert r.rule == (best[0] if best else None)
        assert r.verdict == (best[1] if best else "block" if r.score >= 0.5 else "allow")


#: From another source than the training rows: written down by hand.
OTHER_URLS = [
    ("http://www.cheap-pills-online.com/order?aff=221&sid=9", 1), ("http://free-casino-777.net/", 1), ("https://win-money-now.top/go?clickid=88213", 1), ("http://hot-deals-24.xyz/offer/12?ref=a&aff=7", 1),
    ("http://click-bonus-promo.info/", 1), ("https://replica-slots.biz/en?utm_source=x&aff=1&sid=2", 1), ("http://track-ads.click/4f2a99e1c0", 1), ("http://loan-offer-free.com/9?id=77", 1),
    ("https://www.spam-farm.example.com/en/450?page=2&ref=x", 1), ("http://free-bets.example.net/offer", 1), ("https://crypto-prize-win.top", 1), ("http://go.cheap-loan-99.com/x?aff=3&clickid=123456", 1),
    ("https://library.city.gov/archive/1998", 0), ("https://en.wiki.org/river", 0), ("https://www.openscience.edu/research/data.html", 0), ("http://weather.info/north", 0),
    ("https://museum.fr/fr/history", 0), ("https://blog.tionsh.example.net/en/633", 0), ("http://thther.example.org/fr/12", 0), ("https://music-review.org/2021/06", 0),
    ("https://m.verlopersen.de/news/5", 0), ("https://countypress.com/maps?page=2", 0), ("http://school.edu/", 0), ("https://health.gov/data?q=water", 0),
]


def features_by_hand(url, model):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    n = len(url)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(url).values()) if n else 0
    query = re.search(r"\?([^#]*)", url)
    return {
        "length": n, "depth": path.count("/"), "digits": 100 * sum(c in "0123456789" for c in url) // n if n else 0, "entropy": math.floor(entropy * 10 + 0.5), "parameters": query[1].count("=") if query else 0,
        "labels": host.count("."), "hyphens": host.count("-"), "host_length": len(host), "suffix_rate": model.suffix_rate.get(host.rsplit(".", 1)[-1], model.prior),
    }


def test_url_scores_against_brute_force(spark):
    model = urls.train_urls(urls.seed_urls(spark))
    cases = [u for u, _ in urls.labelled_urls(300, 9)] + [u for u, _ in OTHER_URLS] + [None, "", "no scheme", "http://a.com/b?c=d=e#f?g=h"] + [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = spark.createDataFrame([(i % 7, u, "x") for i, u in enumerate(cases)], "page_id int, url string, verdict string")  # repeated ids, clashing names
    got = sorted((r.page_id, r.score, r.verdict) for r in urls.judge_urls(df, [], model).collect())
    want = []
    for i, u in enumerate(cases):
        x, margin = features_by_hand(u, model), model.bias
        for tree in model.trees:
            node = 1
            while not isinstance(tree[node], float):
                name, threshold = tree[node]
                node = 2 * node + (x[name] > threshold)
            margin += tree[node]
        score = 1 / (1 + math.exp(-margin))
        want.append((i % 7, score, "block" if score >= 0.5 else "allow"))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 1e-9


def test_url_trees(spark):
    rows = urls.seed_urls(spark)
    model = urls.train_urls(rows)
    used = {v[0] for tree in model.trees for v in tree.values() if not isinstance(v, float)}
    assert len(used) >= 5 and "suffix_rate" in used, used
    labels = {k: {len(u.split("://")[1].split("/")[0].split("-")) > 1 for u, y in urls.labelled_urls(500, 1) if y == k} for k in (0, 1)}
    assert labels == {0: {True, False}, 1: {True, False}}  # hyphens in both

    def right(pairs):
        df = spark.createDataFrame(pairs, "url string, label int")
        return df.select(((model.score(F.col("url")) >= 0.5).cast("int") == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]

    assert right(urls.labelled_urls(1_500, 77)) >= 0.85
    assert right(OTHER_URLS) >= 0.85
    none = urls.train_urls(rows.limit(0))
    assert urls.judge_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id int, url string"), [], none).first().verdict == "allow"
    plan = urls.judge_urls(rows.select(F.lit(1).alias("page_id"), "url"), URL_RULES, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["op6_url_filter", "op8_chat_format", "op1_bpe", "op10_media"])
def test_queries_give_a_row_for_each_input(spark, name):
    out = QUERIES[name](spark, SF)
    source = {"op6_url_filter": "pages", "op8_chat_format": "conversations"}.get(name, "documents")
    rows = spark.read.parquet(f"{SF}/{source}.parquet")
    want = rows.select("conv_id").distinct().count() + 1 if source == "conversations" else rows.count()
    assert out.count() == want
    assert json.dumps(out.schema.jsonValue())
