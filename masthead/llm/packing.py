"""Operator 5: best-fit packing of documents into sequences, by residual rounds.

Each input partition packs its own pieces best-fit, longest first, and closes
the bins that are nearly full.  The underfull bins alone are gathered: in rounds
of a tree, groups of about ``fan`` of them are packed best-fit again with whole
bins as items.  Text never shuffles; only the records of underfull bins do, and a
bin's record is bounded by the capacity.

**What a round takes.**  Two bins of more than half the capacity never fit together,
and best fit leaves at most one smaller bin in a group.  So with S small bins left
anywhere, at most S joins are still possible, and if a small bin fits any large
one it fits an emptier one too: a round takes the S small bins and the S emptiest
large ones, and every other bin is done.  S falls by a factor of about ``fan`` with each
round, whatever the sizes are, so no task ever gets more than a group.  For this
choice the driver gets the number of bins by size (at most ``capacity`` rows), and
by partition for the one size at the edge.

Defined results: a null text is empty and still gives one piece, its end id.
Documents longer than the capacity are cut into pieces of just the capacity, of
which the first takes the remainder.  Null and repeated document ids are packed
like any other, one set of pieces for each row.  An empty table gives no rows.
Extra input columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masthead.llm.shared import lean, materialize
from masthead.llm.tokens import KEPT_BYTES, PORTION_BYTES, encoder

#: Pieces that a partition packs at once; bounds a worker's memory.
CHUNK_PIECES = 20_000
#: The most underfull bins that one group of a round has; groups are dealt by a hash to be three quarters full.
FAN = 2_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices by bin: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set when some bin has room r
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > size:
            open_by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    first = length % capacity or capacity
    return [(0, min(first, length))] + [(s, capacity) for s in range(first, length, capacity)]


def _bin_schema(id_type: T.DataType) -> T.StructType:
    item = T.StructType([T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("offset", T.LongType())])
    return T.StructType([T.StructField("size", T.IntegerType()), T.StructField("closed", T.BooleanType()), T.StructField("items", T.ArrayType(item))])


def _merged(bins: list[dict], capacity: int, slack: int) -> list[dict]:
    """Bins packed as items; a joined bin's offsets run on from bin to bin."""
    out = []
    for members in best_fit([b["size"] for b in bins], capacity):
        items, size = [], 0
        for i in members:
            items += [x | {"offset": x["offset"] + size} for x in bins[i]["items"]]
            size += bins[i]["size"]
        out.append({"size": size, "closed": size >= capacity - slack, "items": items})
    return out


def pack_documents(docs: DataFrame, definition: str, capacity: int = 2048, end_id: int = 0, slack: int = 8, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN, cache_bytes: int = KEPT_BYTES, keep_cache: bool = True, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    slack: a bin with at most so much room left is closed where it is made.
    cache_bytes, keep_cache: the bound of a worker's unit cache, and whether its next
    tasks have it; portion_bytes: the bytes of text cut at once; for executors with
    less memory or other stages.
    """
    schema = _bin_schema(docs.schema[id_col].dataType)
    arrow = pa.schema([("size", pa.int32()), ("closed", pa.bool_())])
    end = int(end_id).to_bytes(4, "little")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces = encoder(definition, cache_bytes, keep_cache), []

        def packed() -> pa.RecordBatch:
            bins = _merged(pieces, capacity, slack)
            pieces.clear()
            return pa.RecordBatch.from_pylist(bins, schema=pa.schema([*arrow, ("items", item_type)]))

        item_type = None
        for batch in batches:
            if item_type is None:
                item_type = pa.list_(pa.struct([("doc_id", batch.schema.field("doc_id").type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]))
            doc_ids = iter(batch.column("doc_id").to_pylist())
            for ids, lengths in own.encode_column(batch.column("text"), end, portion_bytes):
                raw, at = memoryview(ids).cast("B") if len(ids) else b"", 0
                for n in lengths.tolist():
                    doc_id = next(doc_ids)
                    for k, (start, length) in enumerate(cut(n, capacity)):
                        crc = zlib.crc32(raw[4 * (at + start) : 4 * (at + start + length)])
                        pieces.append({"size": length, "items": [{"doc_id": doc_id, "piece": k, "start": start, "length": length, "ids_crc32": crc, "offset": 0}]})
                    at += n
                    if len(pieces) >= CHUNK_PIECES:
                        yield packed()
        if pieces:
            yield packed()

    def again(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["__group"])
        return pa.Table.from_pylist(_merged(table.to_pylist(), capacity, slack), schema=table.schema)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rank = 0

    def kept(bins: DataFrame) -> DataFrame:
        """Written once, so that numbers and bins stay as they are when tasks run again."""
        return materialize(bins.withColumn("sequence_id", F.lit(rank << 58) + F.monotonically_increasing_id()), f"pack{rank}")

    now = kept(rows.mapInArrow(lean(local), schema))
    done = []
    while True:
        joinable, n = _joinable(now, capacity)
        if n < 2:
            break
        done.append(now.filter(~joinable))
        rank += 1
        groups = -(-4 * n // (3 * fan)) if n > fan else 1
        taken = now.filter(joinable).withColumn("__group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("int")).drop("sequence_id")
        now = kept(taken.groupBy("__group").applyInArrow(again, schema))
    result = now
    for part in done:
        result = result.unionByName(part)
    return result.select("sequence_id", F.explode("items").alias("x")).select("x.doc_id", "x.piece", "x.start", "x.length", "x.ids_crc32", "sequence_id", "x.offset")


def _joinable(bins: DataFrame, capacity: int) -> tuple[Column, int]:
    """Which open bins may still be joined with others, and how many they are."""
    left = bins.filter("not closed")
    by_size = dict(sorted(map(tuple, left.groupBy("size").count().collect())))
    small = {s: c for s, c in by_size.items() if 2 * s <= capacity}
    n = sum(small.values())
    if not n:
        return F.lit(False), 0
    fitting = {s: c for s, c in by_size.items() if s not in small and s + min(small) <= capacity}
    total, below, edge = 0, capacity // 2 + 1, None
    for size, count in fitting.items():
        if total + count > n:
            edge = size
            break
        total, below = total + count, size + 1
    open_ = ~F.col("closed") & (F.col("size") < below)
    if edge is not None and total < n:
        part = F.shiftright("sequence_id", 33)  # the task that wrote the bin
        last = None
        for last, count in sorted(map(tuple, left.filter(F.col("size") == edge).groupBy(part.alias("part")).count().collect())):
            total += count
            if total >= n:
                break
        open_ = open_ | (~F.col("closed") & (F.col("size") == edge) & (part <= last))
    return open_, n + total
