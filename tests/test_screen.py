"""The funnel, its index, search, suggestions and locks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from masthead import vocab
from masthead.functions.phonetic import double_metaphone, indic_soundex_py
from masthead.operators import lexicon, search, suggest
from masthead.operators.candidates import retrieve
from masthead.operators.registry import build_registry, token_dimension
from masthead.plans import apply, screen
from masthead.sources import tables
from masthead.streaming import locks


@pytest.fixture(scope="module")
def index(spark):
    return screen.build_index(tables.load_registry(spark))


def decide(spark, index, titles, **options):
    rows = spark.createDataFrame([(i, t, "me") for i, t in enumerate(titles)], "query_id int, title string, applicant_id string")
    return {r.query_id: r for r in screen.screen(rows, index, **options).collect()}


def test_decisions(spark, index):
    want = {
        "News+": "REJECTED_PROHIBITED_SYMBOLS", "2024": "REJECTED_PURE_NUMERIC", "": "REJECTED_EMPTY_TITLE", "ghibrisg news": "REJECTED_UNPRONOUNCEABLE_GIBBERISH",
        "The Hindu": "REJECTED_ALREADY_REGISTERED", "The Daily News": "REJECTED_STAGE_1", "The Crime Investigation Daily": "REJECTED_STAGE_2", "Apple Daily": "REJECTED_STAGE_2",
        "Lokmat Sakshi": "REJECTED_STAGE_3", "Namascar India": "REJECTED_SIMILARITY", "Zylophonic Quantum Astroflora": "APPROVED",
    }
    got = decide(spark, index, list(want))
    assert {t: got[i].decision for i, t in enumerate(want)} == want
    assert got[9].verification_probability <= 25 and got[10].verification_probability >= 60
    assert got[4].highest_similarity == 1.0
    assert got[9].top_matches[0].title == "Namaskar India" and got[9].reasons


def test_rows_are_whole_and_bounded(spark, index):
    got = decide(spark, index, ["Morning Herald of Delhi"] * 3 + [None])
    assert len(got) == 4 and got[3].decision == "REJECTED_EMPTY_TITLE"
    assert len({got[i].decision for i in range(3)}) == 1
    assert len(got[0].top_matches or []) <= 5


def test_lock_collision(spark, index):
    held = spark.createDataFrame([("aurora nebula post", "other"), ("zylo quantum flora", "me")], "cleaned_title string, holder string")
    got = decide(spark, index, ["Aurora Nebula Post", "Zylo Quantum Flora"], locks=held)
    assert got[0].decision == "REJECTED_PENDING_COLLISION" and got[1].decision != "REJECTED_PENDING_COLLISION"


def test_apply(spark, index):
    rows = [(1, "Aurora Nebula Flora", "x", 0.0), (2, "Aurora Nebula Flora", "y", 10.0), (3, "Aurora Nebula Flora", "y", 700.0), (4, "News+", "x", 0.0)]
    out, asked = apply.apply_titles(spark.createDataFrame(rows, "query_id int, title string, applicant_id string, at double"), index)
    assert {r.query_id: r.result for r in out.collect()} == {1: "ACCEPTED", 2: "LOCKED_BY_OTHER", 3: "ACCEPTED", 4: "TURNED_AWAY"}
    assert asked.count() == 3
    row = apply.health(index, locks.active(locks.replay(asked), 5.0)).first()
    assert (row.status, row.registered_titles, row.active_locks) == ("healthy", 31, 1)


def test_batch(spark, index):
    rows = spark.createDataFrame([(0, "News+"), (1, "2024"), (2, "Mumbai Police Chronicle"), (3, "The Daily News"), (4, "Aurora Nebula Flora"), (5, " ")], "query_id int, title string")
    _, counts = screen.screen_batch(rows, index)
    assert counts.first().asDict() == {"total": 5, "approved": 1, "rejected": 4, "review_needed": 0}


def test_index_round_trip(spark, index, tmp_path):
    screen.save_index(index, str(tmp_path / "index"))
    again = screen.load_index(spark, str(tmp_path / "index"))
    assert again.postings.count() == index.postings.count()
    assert decide(spark, again, ["Namascar India"])[0].decision == "REJECTED_SIMILARITY"


def test_search(spark, index):
    got = search.search(index.registry, "Times", "times", 10).collect()
    assert got and all(r.registration_no and r.language for r in got)
    assert search.search(index.registry, "", "", 3).count() == 3


def test_suggestions(spark, index):
    rows = spark.createDataFrame([(1, "Crime Namaskar Daily", "namaskar", "Hindi", "National")], "query_id int, title string, anchor_words string, language string, state string")
    made = [r.title for r in suggest.generate(rows).orderBy("gen_ord").collect()]
    assert made[0] == "Public Truth Namaskar Daily" and "Crime Abhinandan Daily" in made and len(made) == len({m.lower() for m in made})
    top = suggest.suggest(rows, lambda df: screen.screen(df, index)).collect()
    assert 1 <= len(top) <= 5 and [r.verification_probability for r in sorted(top, key=lambda r: r.place)] == sorted((r.verification_probability for r in top), reverse=True)


REQUESTS = [("a", 0.0, 1, "x", "acquire"), ("a", 500.0, 2, "y", "acquire"), ("a", 700.0, 3, "x", "acquire"), ("a", 900.0, 4, "x", "acquire"), ("b", 0.0, 5, "x", "acquire"), ("b", 1.0, 6, "y", "release"), ("b", 2.0, 7, "x", "release"), ("b", 3.0, 8, "y", "acquire")]
GRANTED = {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 8: True}


def test_lock_replay(spark):
    out = locks.replay(spark.createDataFrame(REQUESTS, locks.REQUEST))
    assert {r.request: r.granted for r in out.collect()} == GRANTED
    assert [(r.key, r.holder, r.remaining) for r in locks.active(out, 750.0).collect()] == [("a", "x", 550)]


def test_lock_stream_equals_replay(spark, tmp_path):
    spark.createDataFrame(REQUESTS, locks.REQUEST).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(locks.REQUEST).parquet(str(tmp_path / "in"))
    q = locks.stream(stream).writeStream.format("memory").queryName("locked").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.request: r.granted for r in spark.table("locked").collect()} == GRANTED


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([("Alpha Beta", "12", None), ("nan", "13", "x"), ("G", "14", "x"), (None, "15", "x")], "`Title Name` string, `Regn No` string, State string")
    raw.write.option("header", True).csv(str(tmp_path / "r.csv"))
    got = tables.load_registry(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.title, r.registration_no, r.state, r.language) for r in got] == [("Alpha Beta", "12", "National", "English")]
    (tmp_path / "t.txt").write_text("One \n\n Two\n")
    assert [r.title for r in tables.read_titles(spark, str(tmp_path / "t.txt")).collect()] == ["One", "Two"]
    with pytest.raises(ValueError):
        tables.read_raw(spark, "x.zip")
    rows = spark.createDataFrame([(1, 'A "b"', 1.5, "Approved", "APPROVED", ["ok"])], "query_id int, title string, verification_probability double, status string, decision string, reasons array<string>")
    tables.write_csv(tables.export_rows(rows), str(tmp_path / "out"))
    assert '"A ""b"""' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))


def test_empty_submissions(spark, index):
    none = spark.createDataFrame([], "query_id int, title string")
    assert screen.screen(none, index).count() == 0


def test_guidelines(spark):
    assert tables.guidelines(spark).count() == 20
    assert tables.find_guidelines(tables.guidelines(spark), "namascar").count() == 1


def test_duplicate_numbers(spark):
    rows = spark.createDataFrame([("1",), ("1",), ("2",)], "registration_no string")
    assert [r.registration_no for r in tables.repeated_numbers(rows).collect()] == ["1"]


def retrieved_by_hand(titles, submissions, concept):
    """Scores and ranks by plain loops over postings; titles and submissions: {id: title}."""
    def words(title):
        return title.lower().split()

    def anchor(title):
        return [w for w in words(title) if w not in vocab.GENERIC_WORDS]

    def grams(title):
        padded = "_" + (" ".join(anchor(title)) or title.lower()) + "_"
        return [padded[i : i + 3] for i in range(len(padded) - 2)]

    def keys(w):
        first, second = double_metaphone(w)
        found = [("word", w, 0, 30), ("phon", first, 1, 15), ("phon", second if second != first else "", 2, 12), ("indic", indic_soundex_py(w), 3, 15), ("concept", concept.get(w), 4, 30)]
        return [k for k in found if k[1]] if len(w) >= 2 else []

    postings = defaultdict(list)
    for entry in sorted(titles):
        for pos, w in enumerate(words(titles[entry])):
            for kind, key, sub, _ in keys(w):
                postings[kind, key].append((entry, pos, sub))
        for pos, g in enumerate(grams(titles[entry])):
            postings["gram", g].append((entry, pos, 0))
    for (kind, _), rows in postings.items():
        rows.sort()
        del rows[{"phon": 120, "indic": 120, "gram": 50}.get(kind, len(rows)) :]
    out = {}
    for query, title in submissions.items():
        score, first, matched = defaultdict(int), {}, defaultdict(set)

        def hit(posting, w, seq, word=None, score=score, first=first, matched=matched):
            score[posting[0]] += w
            first[posting[0]] = min(first.get(posting[0], (9,)), (*seq, posting))
            if word:
                matched[posting[0]].add(word)

        for pos, w in enumerate(anchor(title)):
            for p in postings["word", w]:
                hit(p, 40, (0, pos, 0), w)
        for pos, w in enumerate(words(title)):
            for kind, key, sub, weight in keys(w):
                for p in postings[kind, key]:
                    hit(p, weight, (1, pos, sub), w if kind in ("word", "concept") else None)
        for entry, ws in matched.items():
            if len(ws) > 1:
                score[entry] += 40 * len(ws)
        if len(score) < 30:
            for pos, g in enumerate(grams(title)):
                for p in postings["gram", g]:
                    hit(p, 8, (2, pos, 0))
        best = sorted(score, key=lambda e: (-score[e], first[e]))[:100]
        out |= {(query, e): (score[e], i + 1) for i, e in enumerate(best)}
    return out


def test_candidates_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["morning", "prabhat", "daily", "dainik", "news", "samachar", "times", "samay", "herald", "voice", "vani", "india", "bharat", "delta", "aurora", "namaskar", "namascar", "kerala", "pune", "solar", "river", "stone", "garden", "lotus", "x", "zebra", "quartz", "evening", "sandhya", "the", "of"]
    pool += ["".join(rng.choice("bcdklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))) for _ in range(150)]
    titles = {i: " ".join(rng.choices(pool, k=rng.randrange(1, 5))).title() for i in range(1500)}
    submissions = {i: " ".join(rng.choices(pool, k=rng.randrange(1, 5))).title() for i in range(150)} | {900: "Prabhat Dainik", 901: "Morning Daily", 902: "Wholly Unheard"}
    rows = spark.createDataFrame([(i, t, f"R{i}", "English", "National", "Daily", "") for i, t in titles.items()], "entry_id long, title string, registration_no string, language string, state string, periodicity string, publisher string")
    index = screen.build_index(build_registry(rows))
    subs = screen.prepared(spark.createDataFrame(list(submissions.items()), "query_id long, title string"))
    subs = subs.select("query_id", "cleaned_title", "tokens", F.expr("array_join(filter(tokens, t -> not array_contains(array(" + ",".join(f"'{w}'" for w in vocab.GENERIC_WORDS) + "), t)), ' ')").alias("anchor_words"))
    subs = subs.withColumn("anchor_tokens", F.expr("filter(split(anchor_words, ' '), t -> t <> '')"))
    words = subs.select(F.explode("tokens").alias("word")).distinct().select(F.array("word").alias("tokens"))
    got = retrieve(subs, index.postings, token_dimension(words, index.concepts))
    assert {(r.query_id, r.entry_id): (r.score, r["rank"]) for r in got.collect()} == retrieved_by_hand(titles, submissions, index.concept_of)


def test_an_index_with_too_many_words_is_refused(spark, index, tmp_path, monkeypatch):
    screen.save_index(index, str(tmp_path / "index"))
    monkeypatch.setattr(lexicon, "MAX_WORDS", 10)
    with pytest.raises(ValueError):
        screen.load_index(spark, str(tmp_path / "index"))
