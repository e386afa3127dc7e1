"""What operators leave on the disk."""

import os

from pyspark.sql import functions as F

from masthead.llm import jaccard
from masthead.llm.shared import discard, materialize, scratch_root


def left(spark) -> set[str]:
    top = scratch_root(spark).removeprefix("file://") + "/masthead"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def shuffles(spark) -> set[str]:
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    return {x for d in map(str, env.blockManager().diskBlockManager().localDirs()) for _, _, names in os.walk(d) for x in names if x.startswith("shuffle_")}


def test_tables_and_shuffles_go_when_they_are_read(spark):
    before, old = left(spark), shuffles(spark)
    spark.range(1000).groupBy((F.col("id") % 5).alias("k")).count().collect()
    assert shuffles(spark) - old  # these stay until garbage is collected
    old = shuffles(spark)
    first = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "scratch-a")
    assert not shuffles(spark) - old
    second = materialize(first.filter("k > 2"), "scratch-b", first, spark.range(3))
    assert [x[:9] for x in left(spark) - before] == ["scratch-b"] and second.count() == 4
    discard(second)
    assert left(spark) == before


def test_near_dedup_leaves_only_the_ids_that_go(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CLUSTER", 20)  # clusters of more than one block as well
    text = lambda i, j: " ".join(f"w{i}x{k}" for k in range(200)) + f" end{j}"
    docs = spark.createDataFrame([(100 * i + j, text(i, j)) for i in range(3) for j in range(1 + 30 * i)] + [(999, None)], "doc_id long, text string")
    before = left(spark)
    out = jaccard.near_dedup(docs)
    assert [x[:13] for x in left(spark) - before] == ["jaccard-gone-"]
    assert sorted(r.doc_id for r in out.collect()) == [0, 100, 200, 999]
