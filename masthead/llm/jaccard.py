"""Operator 4: exact n-gram Jaccard join by parity sketches.

A document's set holds the 64-bit hashes of its distinct word shingles.  Its
*parity sketch* XORs one bit for each shingle, so the Hamming distance of two
sketches is at most the symmetric difference of the sets.  The sketch is cut into
blocks; with at most k differing shingles, at most k blocks differ.

1. **Sets.**  One row for each different set (copies are one row from here on),
   with the keys of its blocks: the XOR of all its shingles' hashes, which is the
   block's parity pattern of a very wide sketch, folded to 64 bits.
2. **Pigeonhole join**, by band of sizes (powers of two, with the sets near an
   upper border entered in the next band too).  A band has half as many blocks
   again as differences can be; so any k + 1 keys under one order of all keys
   suffice (prefix filter).  The order puts the fullest blocks first: blocks that
   are empty or hold one common passage are not used as keys.
3. **Candidates.**  In a bucket of up to ``PAIRS`` sets all pairs, kept only if
   their folded sketches' Hamming distance allows a link; a larger bucket links
   all its sets to its first.  So every true link lies inside one candidate
   cluster, without pairs of large groups being listed.
4. **Verification** inside clusters with the whole sets.  A cluster of more than
   ``CLUSTER`` sets is dealt out in blocks, and no task holds more than two.  First
   one block, a random sample, is compared with every block: that links each large
   group.  Then a set is left out if all sets that share a key with it are linked
   with it already, and the rest of the cluster's largest group isn't compared
   with itself; only what remains is dealt out in pairs of blocks.  So a group of
   C near copies costs C, not its square.

Results are exact up to collisions of 64-bit hashes inside one pair of sets and
of 128-bit digests of sets.  No cap drops candidates.

Defined results: null texts and texts without words have no shingles and link
with nothing; rows of equal sets link; null ids come last when a smallest id is
chosen; an empty table gives no rows; ``near_dedup`` carries all other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masthead.llm.components import components
from masthead.llm.dedup import BLOCK, _blocks, _cells, maybe_repeated
from masthead.llm.shared import discard, lean, materialize

#: Buckets of at most so many sets list their pairs.
PAIRS = 8
#: Sets of a cluster, or of a block of one, that a task compares.
CLUSTER = 1_500
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes; fewer words than the width are one shingle."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        one = np.uint64(len(words))
        with np.errstate(over="ignore"):
            for x in h:
                one = one * _A + x
        return _mix(np.array([one]))
    n = len(h) - width + 1
    x = h[:n].copy()
    for i in range(1, width):
        x = x * _A + h[i : i + n]
    return np.unique(_mix(x))


def set_digest(s: np.ndarray) -> tuple[int, int]:
    return int(_mix(s * _C).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(_mix(s ^ _A)).view(np.int64))


def most_differing(n: int, percent: int) -> int:
    """Greatest symmetric difference of a set of n with any set it links with."""
    largest = n * 100 // percent
    return (n + largest) * (100 - percent) // (100 + percent)


def _bands(n: int, percent: int) -> list[int]:
    own = n.bit_length() - 1
    return [own, own + 1] if n * 100 // percent >= 2 << own else [own]


def block_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The pigeonhole keys of a sorted set."""
    n = len(s)
    out = []
    for band in _bands(n, percent):
        size = 2 << band
        blocks = 1 + -(-3 * (size * 100 // percent - size) // 2)
        at = ((s >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # rises with the hash
        edge = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate((np.zeros(1, np.int64), edge))
        load = np.diff(np.append(first, n)).astype(np.uint64)
        fold = np.bitwise_xor.reduceat(_mix(s * _A), first)
        key = _mix(fold ^ _mix(at[first] * _A + load * _B + np.uint64(band)))
        take = most_differing(n, percent) + 1
        if take > len(key):  # blocks without shingles count as well
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), at[first])
            load = np.concatenate((load, np.zeros(len(empty), np.uint64)))
            key = np.concatenate((key, _mix(_mix(empty * _A + np.uint64(band)))))
        order = np.lexsort((key, -load.astype(np.int64)))
        out.append(key[order[:take]])
    return np.concatenate(out)


def sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """The parity sketch of so many bits (a power of two) as unsigned 64-bit words."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def sketch_bits(n: int) -> int:
    return min(16_384, max(256, 1 << (n - 1).bit_length()))


def _fold(words: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def may_link(n: int, a: np.ndarray, m: int, b: np.ndarray, percent: int) -> bool:
    """Whether sizes and sketches allow a link."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    size = min(len(a), len(b))
    apart = int(np.bitwise_count(_fold(a, size) ^ _fold(b, size)).sum())
    return apart <= (n + m) * (100 - percent) // (100 + percent)


def linked_sets(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of true links among the sets: the components of all their links.

    Sets of equal labels are linked already and not compared.
    """
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    bits = sketch_bits(int(2 * np.median(n)))
    rows = np.stack([sketch(s, bits) for s in sets])[order]
    size = n[order]
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    until = np.searchsorted(size, size * 100 // percent, side="right")
    for i in range(len(sets)):
        j = slice(i + 1, int(until[i]))
        apart = np.bitwise_count(rows[i] ^ rows[j]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(apart <= (size[i] + size[j]) * (100 - percent) // (100 + percent))
        a = int(order[i])
        if labels is not None:
            near = near[labels[order[i + 1 + near]] != labels[a]]
        for other in near[np.argsort(apart[near], kind="stable")].tolist():
            b = int(order[i + 1 + other])
            ra, rb = root(a), root(b)
            if ra == rb:
                continue
            both = np.concatenate((sets[a], sets[b]))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * common >= percent * (len(both) - common):
                parent[rb] = ra
                links.append((a, b))
    return links


def _described(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n, hi, lo, keys, sketch of every row; hi and lo are the set's digest."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_key", T.LongType())] + [T.StructField(c, T.LongType()) for c in ("n", "hi", "lo")] + [T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, keys, sketches = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                if not len(s):
                    hi.append(0)
                    lo.append(0)
                    keys.append(None)
                    sketches.append(None)
                    continue
                high, low = set_digest(s)
                hi.append(high)
                lo.append(low)
                keys.append(block_keys(s, percent).view(np.int64))
                sketches.append(sketch(s, sketch_bits(len(s))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)


def _bucket_edges(keys: DataFrame) -> DataFrame:
    """(a, b, sure) from (key, sid): all pairs of small buckets, stars of large ones.

    Streams over sorted keys; of a large bucket it holds its first set only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, spilled = None, [], False

        def pairs(found: list, members: list[int]) -> None:
            found += [(members[i], members[j], False) for i in range(len(members)) for j in range(i + 1, len(members))]

        for batch in batches:
            k, sid = batch.column("key").to_numpy(zero_copy_only=False), batch.column("sid").to_numpy(zero_copy_only=False)
            starts = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(k[1:] != k[:-1]) + 1))
            ends = np.append(starts[1:], len(k))
            shared = (ends - starts > 1) | (starts == 0) | (ends == len(k))
            found: list[tuple[int, int, bool]] = []
            for a, b in zip(starts[shared].tolist(), ends[shared].tolist(), strict=True):
                if k[a] != key:
                    if not spilled:
                        pairs(found, held)
                    key, held, spilled = k[a], [], False
                members = sid[a:b].tolist()
                if spilled or len(held) + len(members) > PAIRS:
                    if not spilled:
                        held, members, spilled = held[:1] or members[:1], (held + members)[1:], True
                    found += [(held[0], m, True) for m in members]
                else:
                    held += members
            if found:
                a, b, sure = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure)], names=["a", "b", "sure"])
        if held and not spilled:
            found = []
            pairs(found, held)
            if found:
                a, b, sure = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure)], names=["a", "b", "sure"])

    return keys.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(lean(run), "a long, b long, sure boolean")


def _allowed(pairs: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_pylist(), batch.column("m").to_pylist()
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = [may_link(n[i], np.frombuffer(x[i], np.uint64), m[i], np.frombuffer(y[i], np.uint64), percent) for i in range(len(n))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(lean(run), "a long, b long")


def _verified(rows: DataFrame, percent: int) -> DataFrame:
    """True links (a, b) from (task, sid, label, shingles), task by task."""

    def run(table: pa.Table) -> pa.Table:
        sids = table.column("sid").to_pylist()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        links = linked_sets(sets, percent, table.column("label").to_numpy())
        return pa.table({"a": pa.array([sids[i] for i, _ in links], pa.int64()), "b": pa.array([sids[j] for _, j in links], pa.int64())})

    return rows.groupBy("task").applyInArrow(run, "a long, b long")


def _dealt(rows: DataFrame, others: Column) -> DataFrame:
    """The rows (component, own, label, ...) once for each other block that theirs is compared with."""
    rows = rows.withColumn("other", F.explode(others))
    return rows.select(F.struct("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("task"), "sid", "label", "shingles")


def _links(sent: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span the components of all true links.

    sent: sid, component, blocks, shingles; sets: sid, keys.  Clusters of one block
    are compared at once.  In larger ones, block 0 is compared with all, and then
    what may still lack a link: sets that share a key with a set of another label.
    """
    sent = sent.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("label", F.col("sid"))
    hubs = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    first = materialize(_verified(_dealt(sent, hubs), percent), "jaccard-links")
    large = sent.filter("blocks > 1")
    if large.isEmpty():
        return first

    ids = large.select("sid", "component", "own").distinct()
    found = components(first.join(ids.select(F.col("sid").alias("a")), "a", "left_semi"))
    labelled = materialize(ids.join(found.select(F.col("node").alias("sid"), F.col("component").alias("label")), "sid", "left").withColumn("label", F.coalesce("label", "sid")), "jaccard-labelled", found)
    keyed = materialize(sets.select("sid", F.explode("keys").alias("key")).join(labelled.select("sid", "label"), "sid"), "jaccard-keyed")
    mixed = keyed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
    open_ = labelled.filter("own > 0").join(keyed.join(mixed, "key", "left_semi").select("sid").distinct(), "sid", "left_semi")
    largest = labelled.groupBy("component", "label").count().groupBy("component").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    open_ = materialize(open_.join(largest, "component").select("sid", "component", "label", (F.col("label") == F.col("largest")).alias("main")), "jaccard-open", keyed, labelled)
    # blocks 0 to u - 1 hold the sets outside the largest group, the next m its own
    part = lambda name, which: F.ceil(F.count_if(which) / CLUSTER).cast("int").alias(name)
    sizes = open_.groupBy("component").agg(part("u", ~F.col("main")), part("m", F.col("main"))).filter("u > 0")
    drawn = F.xxhash64("sid", F.lit(1))  # anew: the first draw has no block 0 here
    own = F.when(F.col("main"), F.col("u") + F.pmod(drawn, F.greatest("m", F.lit(1)))).otherwise(F.pmod(drawn, F.greatest("u", F.lit(1)))).cast("int")
    rest = large.select("sid", "shingles").join(open_.join(sizes, "component").withColumn("own", own), "sid")
    others = F.sequence(F.lit(0), F.col("u") - 1 + F.when(F.col("main"), 0).otherwise(F.col("m")))
    return materialize(first.unionByName(_verified(_dealt(rest, others), percent)), "jaccard-links", first, open_)


def near_duplicate_classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Rows link when 100 * |intersection| >= percent * |union| of their sets; the
    component is the smallest id that links reach.
    """
    return _classes(docs, width, percent, id_col, text_col)[0].drop("text_key")


def _classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """The classes, with the hash that tells apart rows of one id (or none), and the scratch tables behind them.

    Each other table is removed once nothing reads it any more, so the disk never
    holds more than the keys twice.
    """
    whole = materialize(_described(docs, width, percent, id_col, text_col), "jaccard-docs")
    first = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"))
    described = materialize(whole.select("doc_id", "text_key", "n", "hi", "lo"), "jaccard-digests")
    grouped = whole.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min_by(F.struct("doc_id", "keys", "sketch"), first).alias("x"))
    sets = materialize(grouped.select(F.monotonically_increasing_id().alias("sid"), "hi", "lo", "n", F.col("x.doc_id").alias("rep"), "x.keys", "x.sketch"), "jaccard-sets", whole)

    edges = materialize(_bucket_edges(sets.select(F.explode("keys").alias("key"), "sid")).groupBy("a", "b").agg(F.max("sure").alias("sure")), "jaccard-edges")
    left = sets.select(F.col("sid").alias("a"), "n", F.col("sketch").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    weak = _allowed(edges.filter("not sure").join(left, "a").join(right, "b").select("a", "b", "n", "x", "m", "y"), percent)
    candidates = materialize(edges.filter("sure").select("a", "b").unionByName(weak), "jaccard-candidates", edges)
    clusters = components(candidates)
    discard(candidates)

    sizes = materialize(clusters.groupBy("component").count().select("component", F.ceil(F.col("count") / CLUSTER).cast("int").alias("blocks")), "jaccard-sizes")
    members = materialize(clusters.join(sizes, "component").join(sets.select(F.col("sid").alias("node"), "rep", "hi", "lo"), "node").select(F.col("node").alias("sid"), "rep", "hi", "lo", "component", "blocks"), "jaccard-members", clusters, sizes)
    texts, bits = _texts_of(members, docs, id_col, text_col)
    sent = materialize(_shingled(texts, width), "jaccard-shingles", members, bits)
    links = _links(sent, sets.select("sid", "keys"), percent)
    discard(sent)
    classes = components(links)
    discard(links)

    named = sets.select("hi", "lo", "n", "rep", "sid").join(classes.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = materialize(named.join(least, "component").select("hi", "lo", "n", "component_id"), "jaccard-labels", sets, classes)
    full = described.filter("n > 0").select("doc_id", "text_key", "n", "hi", "lo").join(labels, ["hi", "lo", "n"]).select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(described.filter("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))), (described, labels)


def _texts_of(members: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The members with their representatives' texts, and the filter's table.

    A Bloom filter of the representatives, of bounded size, keeps the texts of all
    other rows out of the shuffle.  Rows that repeat an id with another text are
    told apart by the set's digest when their shingles are made.
    """
    blocks = _blocks(members.count())
    block, a, b = _cells(F.coalesce(F.col("rep").cast("string"), F.lit("")).cast("binary"), blocks)
    cells = members.select(F.explode(F.array(block * BLOCK + a, block * BLOCK + b)).alias("cell")).distinct()
    bits = materialize(cells.groupBy(F.floor(F.col("cell") / BLOCK).alias("__block")).agg(F.bitmap_construct_agg(F.col("cell") % BLOCK).alias("__bits")), "jaccard-bloom")
    rows = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    asked = maybe_repeated(rows.withColumn("__sha", F.coalesce(F.col("rep").cast("string"), F.lit("")).cast("binary")), bits, blocks).filter("__maybe").select("rep", "text")
    return members.join(asked, members["rep"].eqNullSafe(asked["rep"])).select("sid", "hi", "lo", "component", "blocks", "text"), bits


def _shingled(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, own = [], []
            for text, hi, lo in zip(*(batch.column(c).to_pylist() for c in ("text", "hi", "lo")), strict=True):
                s = shingles(text, width)
                own.append(bool(len(s)) and set_digest(s) == (hi, lo))
                data.append(s.tobytes())
            whole = pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("component"), batch.column("blocks"), pa.array(data, pa.binary())], names=["sid", "component", "blocks", "shingles"])
            yield whole.filter(pa.array(own, pa.bool_()))

    return texts.mapInArrow(lean(run), "sid long, component long, blocks int, shingles binary")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of their class; all columns are carried.

    Rows of one class that repeat the smallest id all stay; exact duplicates are
    another operator's.
    """
    classes, used = _classes(docs, width, percent, id_col, text_col)
    gone = classes.filter("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__gone_text")).distinct()
    gone = materialize(gone, "jaccard-gone", *used)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]) & (F.xxhash64(docs[text_col]) == gone["__gone_text"]), "left_anti")
