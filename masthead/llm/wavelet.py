"""Operator 7: token ids in wavelet-matrix shards.

**File format** (all numbers little-endian)::

    "WVMX"  u8 version  u8 planes  u64 tokens  u32 documents  u32 end id  u32 size of the ids block
    ids block     zlib of an Arrow stream with the document ids, of any type, in order
    u32[documents]  which occurrence of the end id, from 0, closes each document
    for each plane, the highest bit first:
        u64 zeros   u32[ceil(tokens / 512)] ones before each block of 512   bits, packed

Plane k holds bit k of the tokens in the order that planes 0..k-1 have sorted
them in, stably.  Rank is a block count plus one popcount, so one shard answers
access, count and select without being expanded.  The documents' borders are not
stored: they are where ``select`` finds the end ids that close them.

Shards are written as rows of a Parquet table, one shard a row: Spark's committer
makes the write atomic and a lost executor's task writes its shards again, in any
store that Spark reaches.  ``save_shard_files`` writes each as a file of its own
to a folder that all executors have mounted; ``load_shard_files`` reads them.

Defined results: null text is empty and still gets its end id.  Documents are in
ascending id order, null ids first; rows with one id follow the hash of their
text.  Ids may be of any type that Spark orders.  An empty table gives no shards.  Extra input columns are not carried.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masthead.llm.shared import lean, materialize
from masthead.llm.tokens import KEPT_BYTES, encoder

MAGIC = b"WVMX"
RANK_BLOCK = 512
_HEAD = struct.Struct("<4sBBQIII")
#: A shard is closed when it has at least so many tokens; documents stay whole.
SHARD_TOKENS = 1 << 19


def _packed_ids(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
    return zlib.compress(sink.getvalue())


def build(tokens: np.ndarray, lengths: list[int], ids: pa.Array, planes: int, end_id: int = 0) -> bytes:
    """The file's bytes for the tokens of consecutive documents, which all end with the end id."""
    n = len(tokens)
    last = np.cumsum(lengths) - 1
    if len(last) and (tokens[last] != end_id).any():
        raise ValueError("a document lacks its end id")
    closing = np.cumsum(tokens == end_id)[last] - 1
    block = _packed_ids(ids)
    out = [_HEAD.pack(MAGIC, 2, planes, n, len(ids), end_id, len(block)), block, closing.astype("<u4").tobytes()]
    now = tokens
    for level in range(planes):
        ones = (now & now.dtype.type(1 << (planes - 1 - level))) != 0
        packed = np.packbits(ones)
        full = np.zeros(-(-n // RANK_BLOCK) * RANK_BLOCK // 8, np.uint8)
        full[: len(packed)] = packed
        counts = np.bitwise_count(full.view(np.uint64)).reshape(-1, RANK_BLOCK // 64).sum(axis=1, dtype=np.uint32)
        before = np.zeros(len(counts), "<u4")
        np.cumsum(counts[:-1], out=before[1:])
        zeros = n - int(counts.sum())
        out += [struct.pack("<Q", zeros), before.tobytes(), packed.tobytes()]
        after = np.empty_like(now)
        np.compress(~ones, now, out=after[:zeros])
        np.compress(ones, now, out=after[zeros:])
        now = after
    return b"".join(out)


class WaveletShard:
    """Read side of one file."""

    def __init__(self, data: bytes):
        magic, version, self.planes, self.n, documents, self.end_id, size = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 2:
            raise ValueError("not a wavelet shard")
        at = _HEAD.size
        self.ids = pa.ipc.open_stream(zlib.decompress(data[at : at + size])).read_all().column(0).combine_chunks()
        at += size
        self.closing = np.frombuffer(data, "<u4", documents, at)
        at += 4 * documents
        self.zeros: list[int] = []
        self.before: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        blocks, packed = -(-self.n // RANK_BLOCK), -(-self.n // 8)
        for _ in range(self.planes):
            self.zeros.append(struct.unpack_from("<Q", data, at)[0])
            self.before.append(np.frombuffer(data, "<u4", blocks, at + 8))
            self.bits.append(np.frombuffer(data, np.uint8, packed, at + 8 + 4 * blocks))
            at += 8 + 4 * blocks + packed
        if at != len(data):
            raise ValueError("wavelet shard has a wrong length")
        self._bytes_before: dict[int, np.ndarray] = {}

    def _bit(self, level: int, at: int) -> int:
        return int(self.bits[level][at >> 3]) >> (7 - (at & 7)) & 1

    def _ones(self, level: int, end: int) -> int:
        """Ones of the plane before ``end``."""
        block = min(end // RANK_BLOCK, len(self.before[level]) - 1)
        if block < 0:
            return 0
        part = np.unpackbits(self.bits[level][block * RANK_BLOCK // 8 : -(-end // 8)], count=end - block * RANK_BLOCK)
        return int(self.before[level][block]) + int(part.sum())

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.planes):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.planes):
            a, b = self._ones(level, start), self._ones(level, end)
            if token >> (self.planes - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences in [start, end)."""
        if token >> self.planes:
            return 0
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0."""
        if token >> self.planes:
            raise IndexError(k)
        first, end = self._range(token, 0, self.n)
        if not 0 <= k < end - first:
            raise IndexError(k)
        at = first + k
        for level in reversed(range(self.planes)):
            one = bool(token >> (self.planes - 1 - level) & 1)
            rank = at - self.zeros[level] if one else at
            lo, hi = 0, self.n  # smallest end with more than rank such bits before it
            while lo < hi:
                mid = (lo + hi) // 2
                have = self._ones(level, mid + 1)
                if (have if one else mid + 1 - have) > rank:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at

    def _before_bytes(self, level: int) -> np.ndarray:
        """Ones of the plane before each byte, made when many places are asked for."""
        if level not in self._bytes_before:
            found = np.zeros(len(self.bits[level]) + 1, np.int64)
            np.cumsum(np.bitwise_count(self.bits[level]), out=found[1:])
            self._bytes_before[level] = found
        return self._bytes_before[level]

    def _ones_many(self, level: int, ends: np.ndarray) -> np.ndarray:
        byte, part = ends >> 3, ends & 7
        last = self.bits[level][np.minimum(byte, len(self.bits[level]) - 1)].astype(np.int64) >> (8 - part)
        return self._before_bytes(level)[byte] + np.where(part > 0, np.bitwise_count(last), 0)

    def count_many(self, token: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Occurrences in each [start, end), by rank."""
        if token >> self.planes or not self.n:
            return np.zeros(len(starts), np.int64)
        for level in range(self.planes):
            a, b = self._ones_many(level, starts), self._ones_many(level, ends)
            if token >> (self.planes - 1 - level) & 1:
                starts, ends = self.zeros[level] + a, self.zeros[level] + b
            else:
                starts, ends = starts - a, ends - b
        return ends - starts

    def select_many(self, token: int, ks: np.ndarray) -> np.ndarray:
        """The places of these occurrences, from 0."""
        if not len(ks):
            return np.zeros(0, np.int64)
        first, end = self._range(token, 0, self.n) if not token >> self.planes else (0, 0)
        if int(ks.min()) < 0 or int(ks.max()) >= end - first:
            raise IndexError("no such occurrence")
        at = first + ks.astype(np.int64)
        for level in reversed(range(self.planes)):
            one = token >> (self.planes - 1 - level) & 1
            rank = at - self.zeros[level] if one else at
            before = self._before_bytes(level)
            before = before if one else 8 * np.arange(len(before)) - before
            byte = np.searchsorted(before, rank, side="right") - 1
            bits = np.unpackbits(self.bits[level][byte][:, None], axis=1) == one
            at = 8 * byte + (np.cumsum(bits, axis=1) <= (rank - before[byte])[:, None]).sum(axis=1)
        return at

    def borders(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each document, found by select."""
        ends = self.select_many(self.end_id, self.closing) + 1
        return np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1])), ends

    def tokens(self) -> np.ndarray:
        """All tokens in order, from the lowest plane up."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for level in reversed(range(self.planes)):
            ones, zeros = np.unpackbits(self.bits[level], count=self.n).view(bool), self.zeros[level]
            value[zeros:] |= kind(1 << (self.planes - 1 - level))
            wider = np.empty_like(value)
            wider[np.flatnonzero(ones)] = value[zeros:]  # places are several times faster than masks
            wider[np.flatnonzero(~ones)] = value[:zeros]
            value = wider
        return value


SHARDS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("payload", T.BinaryType())])


def write_token_shards(docs: DataFrame, definition: str, end_id: int = 0, planes: int = 16, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode, append ``end_id`` and write shards in ascending id order.

    The one shuffle deals texts out by ranges of (id, hash of the text), so that
    no repeated id is hot.  ``part`` is the range's number and ``first`` the
    tokens before the shard in its range.
    """
    schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, first = encoder(definition, KEPT_BYTES, keep=True), TaskContext.get().partitionId(), 0
        kind = np.uint16 if planes <= 16 else np.uint32
        held: list[np.ndarray] = []
        ids: list = []

        def shard() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            row = {"part": part, "first": first, "n_docs": len(ids), "n_tokens": len(tokens), "payload": build(tokens, [len(x) for x in held], pa.array(ids, id_type), planes, end_id)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        size, id_type = 0, None
        for batch in batches:
            id_type = batch.schema.field("id").type
            doc_ids = iter(batch.column("id").to_pylist())
            for wide, lengths in own.encode_column(batch.column("text"), end):
                if planes < 32 and wide.max() >> planes:
                    raise ValueError(f"a token id needs more than {planes} planes")
                tokens, at = wide.astype(kind), 0
                for n in lengths.tolist():
                    held.append(tokens[at : at + n])
                    ids.append(next(doc_ids))
                    at += n
                    size += n
                    if size >= shard_tokens:
                        yield shard()
                        first, size = first + size, 0
                        held.clear()
                        ids.clear()
        if held:
            yield shard()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return materialize(dealt.mapInArrow(lean(run), SHARDS), "wavelet")


def read_token_shards(shards: DataFrame, id_type: T.DataType = T.LongType()) -> DataFrame:
    """One row for each document, from the shards: doc_id, start, n_tokens, ids_crc32, n_end_ids.

    Borders come from select, the count of end ids (the added one, and those the
    text itself holds) from rank, and the digest from all tokens in order.  Only one
    number for each range goes to the driver, for the running totals.
    """
    base, total = {}, 0
    for part, n in sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_tokens")).collect())):
        base[part] = total
        total += n
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32", "n_end_ids")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                file = WaveletShard(payload.as_py())
                ids = memoryview(file.tokens().astype("<u4")).cast("B")
                starts, ends = file.borders()
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                at = base[part.as_py()] + first.as_py()
                numbers = [pa.array(c, pa.int64()) for c in (starts + at, ends - starts, crc, file.count_many(file.end_id, starts, ends))]
                yield pa.RecordBatch.from_arrays([file.ids, *numbers], names=schema.names)

    return shards.select("part", "first", "payload").mapInArrow(lean(run), schema)


def save_shard_files(shards: DataFrame, folder: str) -> int:
    """Write each shard as ``part-first.wvm``; a task that runs again replaces its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        n = 0
        for batch in batches:
            for part, first, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                path = f"{folder}/{part.as_py():06d}-{first.as_py():015d}.wvm"
                with open(f"{path}.{os.getpid()}", "wb") as out:
                    out.write(payload.as_py())
                os.replace(out.name, path)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return shards.select("part", "first", "payload").mapInArrow(lean(run), "n long").agg(F.sum("n")).first()[0] or 0


def load_shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files as a table that ``read_token_shards`` takes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder)
    place = F.split(F.regexp_extract("path", r"(\d+-\d+)\.wvm$", 1), "-")
    number = lambda at, size: F.expr(f"conv(hex(reverse(substring(content, {at}, {size}))), 16, 10)").cast("long")
    return found.select(place[0].cast("int").alias("part"), place[1].cast("long").alias("first"), number(15, 4).alias("n_docs"), number(7, 8).alias("n_tokens"), F.col("content").alias("payload"))
