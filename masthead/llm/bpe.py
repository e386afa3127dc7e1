"""Operator 1: byte-pair encoding and decoding by a tokenization automaton.

**Compilation.**  The automaton starts with one state that loops on every base
symbol.  Each merge ``(u, v) -> w``, taken in order, adds a gadget: all arcs
labelled ``u`` end in one state ``q``; if ``q`` has an arc ``v`` to ``r``, the
``u`` arcs are led to a copy of ``q`` that lacks ``v``, and every state with an
arc ``u`` gets an arc ``w`` to ``r``.  The paths of the last automaton are just
the token sequences that the merges give, one for each byte string, and it is
deterministic over tokens.  There is one state more than there are effective
gadgets.  A copy is kept as (origin, missing label, time), so compiling takes
time linear in the merges; the rows of the transition table are filled from
those records as encoding first needs them.

**Encoding.**  Words come pre-split by the byte-level pattern.  A word is walked
left to right: the longest token with an arc from the present state is taken,
and a dead end steps back; positions proven dead are marked, so a word of n
bytes takes O(n) table steps for each token length.  Results of short text
units are kept during a task, in a cache bounded in bytes; a very long text is
worked off in segments.

**Decoding** emits arc labels: the bytes of each id, joined, malformed UTF-8
replaced.

Defined results: null text is encoded as the empty text (0 tokens); strings of
added tokens in a text become their single ids, as the tokenizer file asks;
null ids decode to null; unknown ids decode to nothing.  Every other column is
passed on unchanged; output columns replace input columns of the same name.
Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masthead.llm.shared import AT_TASK_END, lean
from masthead.llm.tokens import _CUT, CACHE_BYTES, ENTRY_BYTES, UNIT_CHARS, around_added, segments

#: Transitions kept per Python worker before starting afresh (about 100 bytes each).
CACHE_ARCS = 1_000_000
#: The pre-split of byte-level tokenizer files (fixed value of the format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in tokenizer files, by its rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class MergeAutomaton:
    """Deterministic over tokens; see the module's text for its construction."""

    def __init__(self, labels: dict[int, bytes], merges: Iterable[tuple[int, int, int]]):
        """labels: bytes by id; merges: ids (u, v, w) by rank."""
        self.label = labels
        self.base = {i for i, b in labels.items() if len(b) == 1}
        #: The state that arcs with a label lead to; only tokens on some path have one.
        self.target = {i: 0 for i in self.base}
        self.left: dict[int, int] = {}
        self.made_at = {i: -1 for i in self.base}
        self.origin, self.lacks, self.since = [0], [-1], [-1]
        self.table: dict[int, int] = {}
        for time, (u, v, w) in enumerate(merges):
            q, r = self.target.get(u), self.target.get(v)
            if q is None or r is None or not self.allows(q, v):
                continue  # no path holds u v, so no arc can be made
            if w in self.target:
                raise ValueError(f"two merges make the token {w}")
            self.origin.append(q)
            self.lacks.append(v)
            self.since.append(time)
            self.left[w], self.made_at[w], self.target[w] = u, time, r
            self.target[u] = len(self.origin) - 1
        self.token = {b: i for i, b in labels.items() if i in self.target}
        #: Lengths of the tokens that begin with four bytes, the longest first.
        lengths: dict[bytes, set[int]] = {}
        for b in self.token:
            if len(b) > 3:
                lengths.setdefault(b[:4], set()).add(len(b))
        self.reach = {head: (*sorted(of, reverse=True), 3, 2, 1) for head, of in lengths.items()}

    def allows(self, state: int, token: int) -> bool:
        """Whether the state has an arc with this label."""
        while True:
            if token == self.lacks[state]:
                return False
            if state == 0 and token in self.base:
                return True
            if self.made_at[token] >= self.since[state] and token in self.left:
                token = self.left[token]  # made with the gadget of its left part
            else:
                state = self.origin[state]

    def step(self, state: int, token: int) -> int:
        """The table's entry: the next state, or -1."""
        key = state << 20 | token
        to = self.table.get(key)
        if to is None:
            if len(self.table) >= CACHE_ARCS:
                self.table.clear()
            to = self.table[key] = self.target[token] if self.allows(state, token) else -1
        return to

    def encode_word(self, word: bytes) -> list[int]:
        token = self.token
        whole = token.get(word)
        if whole is not None and self.step(0, whole) >= 0:
            return [whole]
        n, table, reach, short, shift = len(word), self.table, self.reach, (3, 2, 1), 20
        path: list[int] = []
        ends: list[int] = [0]
        states: list[int] = [0]
        dead: set[tuple[int, int]] = set()
        at, state, most = 0, 0, n
        while at < n:
            for size in reach.get(word[at : at + 4], short):
                if size > most:
                    continue
                t = token.get(word[at : at + size])
                if t is not None:
                    to = table.get(state << shift | t)
                    if to is None:
                        to = self.step(state, t)
                    if to >= 0 and (not dead or (at + size, to) not in dead):
                        break
            else:
                if not path:
                    raise ValueError(f"no path for {word!r}")
                dead.add((at, state))
                ends.pop()
                states.pop()
                most = len(self.label[path.pop()]) - 1
                at, state = ends[-1], states[-1]
                continue
            path.append(t)
            at += size
            state = to
            ends.append(at)
            states.append(state)
            most = n - at
        return path


class BpeCodec:
    """A tokenizer file's encoder and decoder over the automaton."""

    def __init__(self, definition: str):
        import regex

        spec = json.loads(definition)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        alphabet, ids = byte_alphabet(), model["vocab"]
        labels = {i: bytes(alphabet[c] for c in s) for s, i in ids.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(labels, ((ids[u], ids[v], ids[u + v]) for u, v in pairs))
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.arcs = labels | {i: s.encode() for s, i in added.items()}
        self.added = added
        self.around = around_added(added)
        self.split = regex.compile(BYTE_LEVEL).findall
        self.forget()

    def forget(self) -> None:
        """Empty the cache: words, and units at a text's start and after a space."""
        self.words: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.held = 0

    def _keep(self, known: dict[str, bytes], unit: str, ids: bytes) -> None:
        if len(unit) <= UNIT_CHARS:
            known[unit] = ids
            self.held += sys.getsizeof(unit) + sys.getsizeof(ids) + ENTRY_BYTES

    def _ids(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        out, words = [], self.words
        for word in self.split(text):
            ids = words.get(word)
            if ids is None:
                ids = array("I", self.automaton.encode_word(word.encode())).tobytes()
                self._keep(words, word, ids)
            out.append(ids)
        return b"".join(out)

    def _segment(self, text: str) -> bytes:
        # A single space before a non-space always opens a word: a safe cut.
        if self.held > CACHE_BYTES:
            self.forget()
        units = _CUT.split(text)
        known, out = self.first, []
        for i, unit in enumerate(units):
            ids = known.get(unit)
            if ids is None:
                ids = self._ids(" " + unit if i else unit)
                self._keep(known, unit, ids)
            out.append(ids)
            known = self.rest
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        parts = [text]
        if self.around is not None and any(a in text for a in self.added):
            parts = [p for p in self.around.split(text) if p]
        out = []
        for part in parts:
            if part in self.added:
                out.append(array("I", [self.added[part]]).tobytes())
            else:
                out += map(self._segment, segments(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        arcs = self.arcs
        return b"".join([arcs.get(i, b"") for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


_CODECS: dict[int, BpeCodec] = {}
AT_TASK_END.append(lambda: [c.forget() for c in _CODECS.values()])


def codec(definition: str) -> BpeCodec:
    """This Python worker's codec; its cache of units goes when the task ends."""
    key = hash(definition)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = BpeCodec(definition)
    return _CODECS[key]


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """The schema with these fields last, in place of any of the same name."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema if f.name.lower() not in new] + list(fields))


def bpe_encode(docs: DataFrame, definition: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Append the ids of every whole text as binary (unsigned 32-bit, little-endian)."""
    fields = _with(docs.schema, T.StructField(ids_col, T.BinaryType()))
    source = docs.withColumn("__bpe_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    kept = [f.name for f in fields][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(definition)
        for batch in batches:
            ids = pa.array([own.encode(t) for t in batch.column("__bpe_text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), ids], names=[*kept, ids_col])

    return source.select(*[F.col(f"`{k}`") for k in kept], "__bpe_text").mapInArrow(lean(run), fields)


def bpe_decode(rows: DataFrame, definition: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Append the text of binary ids; null stays null."""
    fields = _with(rows.schema, T.StructField(text_col, T.StringType()))
    kept = [f.name for f in fields][:-1]
    source = rows.withColumn("__bpe_ids", F.col(f"`{ids_col}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(definition)
        for batch in batches:
            texts = [None if b is None else own.decode(b) for b in batch.column("__bpe_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(texts, pa.string())], names=[*kept, text_col])

    return source.select(*[F.col(f"`{k}`") for k in kept], "__bpe_ids").mapInArrow(lean(run), fields)


def bpe_digests(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass and keep only counts and SHA-256 digests.

    One narrow stage: no shuffle, and neither ids nor decoded text leave the worker.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(definition)
        for batch in batches:
            sizes, coded, decoded = [], [], []
            for text in batch.column("__bpe_text"):
                ids = own.encode(text.as_py())
                sizes.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            columns = [batch.column(id_col), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__bpe_text")).mapInArrow(lean(run), schema)
