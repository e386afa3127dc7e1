"""Operator 9: exact duplicates by two-pass Bloom filtering, in DataFrame functions.

The first pass hashes every normalised text to two cells of a blocked Bloom
filter and keeps the cells that more than one row hit.  The second pass asks
that filter about each row: a row with a cell that nobody else hit is unique and
passes straight through; only the possibly repeated rows shuffle, by digest.

The filter has ``BITS_PER_ROW`` bits a row, rounded up to a power of two, and is
broadcast in parts of at most ``2 ** MAX_BITS`` bits (16 MiB): beyond 8 million rows
the space of digests is dealt into ranges by a hash, and each range has a filter of
its own, built and asked one after the other over rows that lie sorted by range.  So
the filter grows with the rows and the share of unique rows that shuffle doesn't.

The first pass shuffles the two cells of each row, 16 bytes, and not bitmaps: a
bitmap of all cells from every task would be 2 bytes a row *and task*.

Defined results: null text counts as the empty text; of equal texts the smallest
id stays, null ids last, and of repeated ids one row.  An empty table gives no
rows.  Other columns, whatever their names, are carried by ``exact_dedup``.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masthead.llm.shared import materialize, scratch_root

MAX_BITS = 27
BITS_PER_ROW = 16
#: Bits of one block; the size of Spark's bitmap buckets.
BLOCK = 32_768
#: At most so many groups can hold at least this share of the rows.
HOT_GROUPS = 1_000


def normalised(text_col: str = "text") -> Column:
    """The text with each run of ASCII white space replaced by one space."""
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text_col: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(text_col), 256))


def _blocks(rows: int) -> int:
    bits = min(MAX_BITS, max(15, math.ceil(math.log2(max(1, rows) * BITS_PER_ROW))))
    return 2**bits // BLOCK


def _ranges(rows: int) -> int:
    return max(1, math.ceil(rows * BITS_PER_ROW / 2**MAX_BITS))


def _cells(sha: Column, blocks: int) -> tuple[Column, Column, Column]:
    """Block, and two places in it."""
    h = F.xxhash64(sha)
    return F.pmod(h, F.lit(blocks)), F.pmod(F.shiftright(h, 32), F.lit(BLOCK)), F.pmod(F.xxhash64(sha, F.lit(1)), F.lit(BLOCK))


def repeated_cells(digests: DataFrame, blocks: int, sha: str = "__sha") -> DataFrame:
    """The filter: (__block, __bits), a bit set where two rows or more hit the cell."""
    block, a, b = _cells(F.col(sha), blocks)
    cells = digests.select(F.explode(F.array(block * BLOCK + a, block * BLOCK + b)).alias("cell"))
    return (
        cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
        .groupBy(F.floor(F.col("cell") / BLOCK).alias("__block"))
        .agg(F.bitmap_construct_agg(F.col("cell") % BLOCK).alias("__bits"))
    )


def maybe_repeated(rows: DataFrame, cells: DataFrame, blocks: int, sha: str = "__sha") -> DataFrame:
    """Rows with a boolean ``__maybe``; the filter's size is bounded, so it is broadcast."""
    block, a, b = _cells(F.col(sha), blocks)

    def bit(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int"))) != 0

    found = rows.withColumn("__block", block).join(F.broadcast(cells), "__block", "left")
    return found.withColumn("__maybe", F.coalesce(bit(a) & bit(b), F.lit(False))).drop("__block", "__bits")


def _asked(rows: DataFrame, total: int) -> DataFrame:
    """The rows with ``__maybe``, from two passes over each range of their ``__sha``."""
    ranges = _ranges(total)
    blocks = _blocks(-(-total // ranges))
    if ranges == 1:
        return maybe_repeated(rows, materialize(repeated_cells(rows.select("__sha"), blocks), "dedup-cells"), blocks)
    dealt = materialize(rows.withColumn("__range", F.pmod(F.xxhash64("__sha", F.lit(2)), F.lit(ranges)).cast("int")).sortWithinPartitions("__range"), "dedup-ranges")
    path = f"{scratch_root(rows.sparkSession).rstrip('/')}/masthead/dedup-asked-{uuid.uuid4().hex}"
    for r in range(ranges):
        mine = dealt.filter(F.col("__range") == r).drop("__range")
        found = maybe_repeated(mine, materialize(repeated_cells(mine.select("__sha"), blocks), "dedup-cells"), blocks)
        found.write.parquet(f"{path}/{r}")
    return rows.sparkSession.read.schema(found.schema).parquet(f"{path}/*")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Unique rows stay in their partitions.  The others are reduced on the map
    side first, so a group of copies sends at most one row from each task.
    """
    asked = _asked(docs.withColumn("__sha", digest(text_col)), docs.count())
    order = F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), F.xxhash64(text_col).alias("c"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    best = asked.filter("__maybe").groupBy("__sha").agg(F.min_by(whole, order).alias("__row"))
    return asked.filter("not __maybe").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(best.select("__row.*"))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are read once, for (id, digest) records; the filter and the groups work
    on those.  Groups of a thousandth of the rows or more number at most a
    thousand, so they are joined by broadcast and no hot key is shuffled.
    """
    seen = materialize(docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("__sha"), F.monotonically_increasing_id().alias("__row")), "dedup-digests")
    total = seen.count()
    asked = _asked(seen, total)
    suspects = asked.filter("__maybe").drop("__maybe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("__row").alias("c")))
    groups = materialize(suspects.groupBy("__sha").agg(first.alias("f"), F.count("*").alias("group_size")).select("__sha", F.col("f.b").alias("keep_id"), F.col("f.c").alias("__first"), "group_size"), "dedup-groups")
    hot = F.col("group_size") >= max(2, math.ceil(total / HOT_GROUPS))
    in_hot = suspects.join(F.broadcast(groups.filter(hot)), "__sha")
    in_cold = suspects.join(F.broadcast(groups.filter(hot).select("__sha")), "__sha", "left_anti").join(groups.filter(~hot), "__sha")
    alone = asked.filter("not __maybe").select("doc_id", "__sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    out = alone
    for part in (in_hot, in_cold):
        out = out.unionByName(part.select("doc_id", "__sha", "keep_id", "group_size", (F.col("__row") == F.col("__first")).alias("kept")))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("__sha")).alias("text_sha256"))


#: Ties of repeated ids aside, which the data do not have, the report in plain SQL.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
