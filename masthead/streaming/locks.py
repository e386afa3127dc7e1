"""Title locks: first applicant wins until the lock is released or runs out.

The fold is the same in batch and in a stream: a request for a free key takes it
for a fixed time; any request for a taken key is refused, the holder's own too;
only the holder can release.  Times are event times in seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL = 600
#: (key, at, request, applicant, action); action is ``acquire`` or ``release``.
REQUEST = "key string, at double, request long, applicant string, action string"
RESULT = "key string, at double, request long, applicant string, action string, granted boolean, expires_at double"


def step(holder: str | None, until: float, at: float, applicant: str | None, action: str, ttl: float = TTL) -> tuple[bool, str | None, float]:
    """(granted, holder, until) after one request."""
    free = holder is None or until <= at
    if action == "release":
        mine = not free and holder == applicant
        return mine, (None if mine else holder), (0.0 if mine else until)
    if free:
        return True, applicant or "", at + ttl
    return False, holder, until


def replay(requests: DataFrame, ttl: float = TTL) -> DataFrame:
    """The fold over a table of requests, by (at, request) within a key.

    A task streams over its sorted rows and keeps one lock at a time, so a key
    with very many requests needs no more memory than any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, holder, until = object(), None, 0.0
        for batch in batches:
            granted, ends = [], []
            for k, at, who, action in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "applicant", "action")), strict=True):
                if k != key:
                    key, holder, until = k, None, 0.0
                ok, holder, until = step(holder, until, at, who, action, ttl)
                granted.append(ok)
                ends.append(until if holder is not None else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(granted, pa.bool_()), pa.array(ends, pa.float64())], names=[*batch.schema.names, "granted", "expires_at"])

    dealt = requests.select("key", F.col("at").cast("double"), F.col("request").cast("long"), "applicant", "action").repartition("key").sortWithinPartitions("key", "at", "request")
    return dealt.mapInArrow(run, RESULT)


def active(results: DataFrame, now: float) -> DataFrame:
    """Locks held at a time, newest first: (key, holder, created_at, expires_at, remaining)."""
    last = results.filter((F.col("granted")) & (F.col("at") <= now)).groupBy("key").agg(F.max_by(F.struct("action", "applicant", "at", "expires_at"), F.struct("at", "request")).alias("x"))
    held = last.select("key", "x.*").filter((F.col("action") == "acquire") & (F.col("expires_at") > now))
    return held.select("key", F.col("applicant").alias("holder"), F.col("at").alias("created_at"), "expires_at", F.greatest(F.lit(0), F.floor(F.col("expires_at") - now)).cast("int").alias("remaining")).orderBy(F.desc("created_at"), "key")


def stream(requests: DataFrame, ttl: float = TTL) -> DataFrame:
    """The same fold over a streaming table of requests; a key's state is its lock."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder, until = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(frames)).sort_values(["at", "request"])
        granted, ends = [], []
        for at, who, action in zip(rows["at"], rows["applicant"], rows["action"], strict=True):
            ok, holder, until = step(holder, until, at, who, action, ttl)
            granted.append(ok)
            ends.append(until if holder is not None else None)
        if holder is None:
            state.remove()
        else:
            state.update((holder, until))
        yield rows.assign(granted=granted, expires_at=ends)[["key", "at", "request", "applicant", "action", "granted", "expires_at"]]

    return requests.groupBy("key").applyInPandasWithState(run, RESULT, "holder string, until double", "append", GroupStateTimeout.NoTimeout)


def first_applicants(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First request of a key within the watermark; unlike a lock, it isn't taken again later."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
