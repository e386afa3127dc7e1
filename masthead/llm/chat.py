"""Operator 8: chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the
sorted spans of the turns under loss are intersected with the sorted token spans
by binary search.  A token that covers a border belongs to the mask, and the
loss spans keep where inside it the turn begins or ends.

Template of a turn: ``<|im_start|>role`` newline ``text<|im_end|>`` newline.
Inside roles and texts, ``<``, any backslashes and ``|`` get one backslash more,
so no text can hold a control string, and reading takes it off again.  A newline
in a role is written as ``<|nl|>``.

Defined results: null roles and texts are empty; turns are in ascending order,
null turns first, ties by role and text; repeated rows are turns like others.
Rows with a null conversation id form one conversation.  An empty table gives no
rows.  Other columns are not carried.  A conversation must fit into one text cell.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masthead.llm.shared import lean
from masthead.llm.tokens import BATCH_CHARS, encoder

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
LOSS_ROLE = "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the texts under loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = START + escape(role).replace("\n", NEWLINE) + "\n"
        body = escape(text)
        if role == loss_role and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role.replace(NEWLINE, "\n")), unescape(text)) for role, text in _TURN.findall(formatted)]


def mask_tokens(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which token spans meet a turn span; both sorted, found by binary search."""
    if not len(spans):
        return np.zeros(len(offsets), bool)
    turn = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")  # the first that ends after the token starts
    inside = turn < len(spans)
    begins = spans[np.minimum(turn, len(spans) - 1), 0]
    return inside & (begins < offsets[:, 1])


def masked_texts(formatted: str, offsets: np.ndarray, mask: np.ndarray, spans: np.ndarray) -> list[str]:
    """Each turn's text under the mask, from the tokens' own offsets, unescaped."""
    pieces: list[list[str]] = [[] for _ in range(len(spans))]
    chosen = offsets[mask]
    if len(chosen):
        reached = np.maximum.accumulate(chosen[:, 1])
        first = np.flatnonzero(np.concatenate(([True], chosen[1:, 0] > reached[:-1])))  # runs of tokens without a gap
        starts, ends = chosen[first, 0], reached[np.append(first[1:], len(chosen)) - 1]
        low, high = np.searchsorted(spans[:, 1], starts, side="right"), np.searchsorted(spans[:, 0], ends, side="left")
        places = spans.tolist()
        for start, end, i, j in zip(starts.tolist(), ends.tolist(), low.tolist(), high.tolist(), strict=True):
            for turn in range(i, j):
                pieces[turn].append(formatted[max(start, places[turn][0]) : min(end, places[turn][1])])
    return [unescape("".join(p)) for p in pieces]


def format_conversations(rows: DataFrame, definition: str, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row a conversation: conv_id, formatted, ids, offsets, mask, loss_spans.

    ids, offsets (pairs) and loss_spans (pairs) are unsigned 32-bit little-endian,
    mask one byte a token.  The one shuffle brings the turns of a conversation
    together; a task streams over its sorted turns and holds one at a time.
    """
    id_type = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", id_type), T.StructField("formatted", T.StringType())] + [T.StructField(c, T.BinaryType()) for c in ("ids", "offsets", "mask", "loss_spans")])
    clean = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(definition).tokenizer

        def out(found: list[tuple[object, list[tuple[str, str]]]]) -> pa.RecordBatch:
            rendered = [render(turns, loss_role) for _, turns in found]
            columns: list[list[bytes]] = [[], [], [], []]
            for (_, spans), encoded in zip(rendered, tokenizer.encode_batch([r[0] for r in rendered], add_special_tokens=False), strict=True):
                offsets = np.fromiter(chain.from_iterable(encoded.offsets), "<u4", 2 * len(encoded)).reshape(-1, 2)
                places = np.array(spans, "<u4").reshape(-1, 2)
                for column, value in zip(columns, (np.array(encoded.ids, "<u4"), offsets, mask_tokens(offsets, places), places), strict=True):
                    column.append(value.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], kind), pa.array([r[0] for r in rendered], pa.string()), *(pa.array(c, pa.binary()) for c in columns)], names=schema.names)

        kind, held, chars = None, [], 0
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not held or held[-1][0] != conv:
                    if chars >= BATCH_CHARS // 4:
                        yield out(held)
                        held, chars = [], 0
                    held.append((conv, []))
                held[-1][1].append((role, text))
                chars += len(text)
        if held:
            yield out(held)

    return dealt.select("conv_id", "role", "text").mapInArrow(lean(run), schema)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Turns and loss text read back from the formatted output alone."""
    schema = T.StructType([T.StructField("conv_id", formatted.schema["conv_id"].dataType)] + [T.StructField(a, b) for a, b in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for text, offsets, mask, spans in zip(*(batch.column(c).to_pylist() for c in ("formatted", "offsets", "mask", "loss_spans")), strict=True):
                turns = parse(text)
                loss = "".join(masked_texts(text, np.frombuffer(offsets, "<u4").astype(np.int64).reshape(-1, 2), np.frombuffer(mask, bool), np.frombuffer(spans, "<u4").astype(np.int64).reshape(-1, 2)))
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                for column, value in zip(rows, (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *map(pa.array, rows, kinds)], names=schema.names)

    return formatted.select("conv_id", "formatted", "offsets", "mask", "loss_spans").mapInArrow(lean(run), schema)
