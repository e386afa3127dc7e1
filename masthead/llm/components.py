"""Connected components of an edge table by alternating large and small stars.

All work is in joins and aggregations over edges; each round is written to the
shared folder, and only the number of changed rows reaches the driver.  A table of
at most ``LOCAL_EDGES`` edges with long ids is solved by one task instead: its
rounds would be a dozen or more written tables of few rows each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masthead.llm.shared import lean, materialize

#: Edges that one task solves, in memory of about 100 bytes an edge.
LOCAL_EDGES = 1_000_000


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges in order, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, after := label[label]):
            label = after


def _local(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")] for batch in batches]
        if held:
            nodes, least = smallest_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(least, pa.int64())], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(lean(run), "node long, component long")


def _minimum(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of a node and its neighbours in a directed view."""
    return edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node.

    ``edges`` that aren't materialized yet are written first.  Loops and repeated edges don't matter; nodes without an edge aren't listed.
    The joins are on materialized tables, so a node with very many edges is split
    by adaptive execution.  The result is materialized; the rounds' tables are removed.
    """
    long = all(isinstance(edges.schema[c].dataType, T.LongType) for c in ("a", "b"))
    given = edges if hasattr(edges, "scratch_path") else materialize(edges.select("a", "b"), "cc-given")
    written = () if given is edges else (given,)
    if long and given.count() <= LOCAL_EDGES:
        return materialize(_local(given.select("a", "b").filter("a <> b")), "cc-done", *written)
    now = materialize(given.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges", *written)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(_minimum(both), "cc-min")
        # large star: neighbours greater than the node point to the smallest
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = materialize(large.distinct(), "cc-large", now, least)
        # small star: a node and its smaller neighbours point to the smallest of them
        least = materialize(_minimum(kept), "cc-min")
        joined = kept.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.filter("u <> m").select("u", F.col("m").alias("v")))
        after = materialize(small.distinct(), "cc-small", kept, least)
        # a forest of stars: every node has one parent, and no parent has one
        many = after.groupBy("u").count().filter("count > 1").limit(1).count()
        chained = 1 if many else after.select("v").distinct().join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        now = after
        if not many and not chained:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))), "cc-done", now)
