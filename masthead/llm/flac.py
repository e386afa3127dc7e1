"""Operator 10: FLAC media columns.

The codec works on many frames side by side with numpy: one step handles sample
i of every frame of a batch, so that the chain of Rice codes inside a frame costs
one vector step and not a Python loop.  Frames are found by the seek table, which
holds one point for each frame.

Encoder: mono, 8 bits, constant, verbatim or fixed predictors of order 0 to 2
with one Rice partition.  Decoder: mono, 8 or 16 bits, constant, verbatim, fixed
and LPC subframes, any partition order, escaped partitions; it checks the CRC-8
of every header, the CRC-16 of every frame, and the stream's MD5.  Anything else
(more channels, wasted bits, a damaged frame) raises ``FlacError``.

Defined results: null text is stored as the empty text; the payload is UTF-8
with zero bytes up to a positive multiple of ``pad``, so no stream is empty.
Equal texts give equal streams, repeated ids a row each.  An empty table gives no
rows; other columns are not carried.  A long text is coded in runs of frames: a
worker holds it, its stream and its samples, each about a byte a byte, besides
work of a fixed size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masthead.llm.shared import lean

BLOCK_SAMPLES = 1152
SAMPLE_RATE = 8000
#: Samples of a PCM block.
PCM_SAMPLES = 1 << 16
#: Samples that are coded side by side; bounds a worker's memory, a long stream's too.
BATCH_SAMPLES = 400_000
_SEEK = struct.Struct(">QQH")


class FlacError(ValueError):
    pass


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    table = []
    for byte in range(256):
        crc = byte << (width - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly) & mask if crc & top else crc << 1 & mask
        table.append(crc)
    return np.array(table, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Leading zeros of 16 bits.
_ZEROS16 = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def _crc(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """CRC of data[start : start + size] for many ranges, a byte of each in a step."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    crc = np.zeros(len(at), np.uint32)
    mask = np.uint32((1 << width) - 1)
    active = len(at) - np.searchsorted(left[::-1], np.arange(int(left[0]) if len(left) else 0), side="right")
    for i, n in enumerate(active.tolist()):
        c = crc[:n]
        crc[:n] = (c << np.uint32(8) & mask) ^ table[(c >> np.uint32(width - 8)) ^ data[at[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >> (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size) & 0xFF | n, *tail[::-1]])


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + b] = values >> (width - 1 - b) & 1


def _runs(n: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of frames that hold about ``BATCH_SAMPLES`` samples; a frame stays whole."""
    total = int(n.sum())
    size = -(-total // max(1, round(total / BATCH_SAMPLES)))  # runs of like size: a short one costs as much as a full one
    chunk = (np.cumsum(n) - n) // max(1, size)
    cuts = [*np.flatnonzero(np.diff(chunk, prepend=-1)).tolist(), len(n)]
    return list(zip(cuts, cuts[1:], strict=False))


def _encode_frames(x: np.ndarray, start: np.ndarray, n: np.ndarray, number: np.ndarray, as_lpc: bool) -> tuple[bytes, np.ndarray]:
    """Consecutive frames and their sizes; a frame has n samples of x from its start."""
    place = np.arange(len(x)) - np.repeat(start, n)
    residuals = [x.astype(np.int32)]
    for order in (1, 2):
        d = np.zeros_like(residuals[0])
        d[1:] = residuals[-1][1:] - residuals[-1][:-1]
        residuals.append(d)
    folded, cost = [], []
    for order, d in enumerate(residuals):
        u = (d << 1) ^ (d >> 31)
        u[place < order] = 0
        folded.append(u)
        cost.append(np.add.reduceat(u, start))
    cost = np.array(cost, np.int64)
    cost[1, n <= 1] = cost[2, n <= 2] = 1 << 40
    order = np.argmin(cost, axis=0)
    count = np.maximum(n - order, 1)
    mean = np.take_along_axis(cost, order[None], 0)[0] / count
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1e-9))) + 1, 0, 14).astype(np.int64)
    u = np.choose(np.repeat(order, n), folded).astype(np.int64)
    coded = place >= np.repeat(order, n)
    widths = np.where(coded, (u >> np.repeat(k, n)) + 1 + np.repeat(k, n), 0)
    lpc_bits = np.where(as_lpc & (order > 0), 4 + 5 + 4 * order, 0)
    rice_bits = 8 * order + lpc_bits + 10 + np.add.reduceat(widths, start)
    constant = np.add.reduceat((residuals[1] != 0) & (place > 0), start) == 0
    verbatim = ~constant & (rice_bits >= 8 * n)
    rice = ~constant & ~verbatim
    body = np.where(constant, 8, np.where(verbatim, 8 * n, rice_bits))

    heads = [b"\xff\xf8\x70\x02" + _utf8_number(i) + struct.pack(">H", m - 1) for i, m in zip(number.tolist(), n.tolist(), strict=True)]
    head_size = np.array([len(h) for h in heads], np.int64)
    frame_size = head_size + 1 + 1 + -(-body // 8) + 2
    frame_at = np.cumsum(frame_size) - frame_size
    bits = np.zeros(int(frame_size.sum()) * 8, np.uint8)
    code_at = 8 * (frame_at + head_size + 2)
    lpc = rice & (lpc_bits > 0)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 32 + order - 1, 8 + order)))
    _put(bits, code_at - 8, kind << 1, 8)
    if constant.any():
        _put(bits, code_at[constant], x[start[constant]].astype(np.int64) & 0xFF, 8)
    flat_at = np.repeat(code_at, n)
    raw = np.repeat(verbatim, n)
    if raw.any():
        _put(bits, (flat_at + 8 * place)[raw], x[raw].astype(np.int64) & 0xFF, 8)
    warm = np.repeat(rice, n) & ~coded
    if warm.any():
        _put(bits, (flat_at + 8 * place)[warm], x[warm].astype(np.int64) & 0xFF, 8)
    if lpc.any():
        at = code_at[lpc] + 8 * order[lpc]
        _put(bits, at, np.full(len(at), 3), 4)  # coefficients of 4 bits, shift 0
        first, two = np.where(order[lpc] == 1, 1, 2), order[lpc] == 2
        _put(bits, at + 9, first & 15, 4)
        _put(bits, at[two] + 13, np.full(int(two.sum()), -1 & 15), 4)
    at = code_at[rice] + (8 * order + lpc_bits)[rice]
    _put(bits, at + 6, k[rice], 4)
    use = np.repeat(rice, n) & coded
    before = np.cumsum(widths) - widths
    before -= np.repeat(before[start], n)
    pos = (np.repeat(code_at + 8 * order + lpc_bits + 10, n) + before)[use]
    values, ks = u[use], np.repeat(k, n)[use]
    stop = pos + (values >> ks)
    bits[stop] = 1
    for b in range(int(ks.max()) if len(ks) else 0):
        inside = ks > b
        bits[(stop + ks - b)[inside]] = (values[inside] >> b) & 1
    out = np.packbits(bits)
    for size in np.unique(head_size).tolist():
        same = np.flatnonzero(head_size == size)
        out[frame_at[same][:, None] + np.arange(size)] = np.frombuffer(b"".join(heads[i] for i in same.tolist()), np.uint8).reshape(-1, size)
    out[frame_at + head_size] = _crc(out, frame_at, head_size, CRC8, 8)
    crc = _crc(out, frame_at, frame_size - 2, CRC16, 16)
    out[frame_at + frame_size - 2], out[frame_at + frame_size - 1] = crc >> 8, crc & 0xFF

    return out.tobytes(), frame_size


def encode_many(payloads: list[bytes], block: int = BLOCK_SAMPLES, as_lpc: bool = False) -> list[bytes]:
    """A stream for each non-empty payload of unsigned bytes.

    as_lpc writes the fixed predictors as LPC subframes with the same coefficients.
    Frames are coded in runs, so the work in hand doesn't grow with a payload.
    """
    sizes = np.array([len(p) for p in payloads], np.int64)
    if not len(sizes):
        return []
    raw = np.frombuffer(b"".join(payloads) if len(payloads) > 1 else payloads[0], np.uint8)
    per_doc = -(-sizes // block)
    doc = np.repeat(np.arange(len(sizes)), per_doc)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    start = np.repeat(np.cumsum(sizes) - sizes, per_doc) + number * block
    n = np.minimum(block, np.repeat(sizes, per_doc) - number * block)
    coded = []
    for lo, hi in _runs(n):
        x = raw[start[lo] : start[hi - 1] + n[hi - 1]].astype(np.int16) - 128
        coded.append(_encode_frames(x, start[lo:hi] - start[lo], n[lo:hi], number[lo:hi], as_lpc))
    data, frame_size = b"".join(c[0] for c in coded), np.concatenate([c[1] for c in coded])
    del coded
    frame_at = np.cumsum(frame_size) - frame_size

    streams, lo = [], 0
    ends = np.cumsum(per_doc)
    for i, hi in enumerate(ends.tolist()):
        a, b = int(frame_at[lo]), int(frame_at[hi - 1] + frame_size[hi - 1])
        total = int(sizes[i])
        md5 = hashlib.md5(np.frombuffer(payloads[i], np.uint8) ^ np.uint8(0x80)).digest()
        packed = SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | total
        info = struct.pack(">HH", max(16, block), max(16, block)) + int(frame_size[lo:hi].min()).to_bytes(3, "big") + int(frame_size[lo:hi].max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
        seek = b"".join(_SEEK.pack(j * block, int(frame_at[lo + j]) - a, int(n[lo + j])) for j in range(hi - lo))
        streams.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[a:b])
        lo = hi
    return streams


def _metadata(stream: bytes) -> tuple[int, int, bytes, list[tuple[int, int, int]], int]:
    """(total samples, bits, MD5, seek points, place of the first frame)."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, total, width, md5, points = 4, False, 0, 8, b"", []
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 41 & 7:
                raise FlacError("only mono streams are read")
            total, width, md5 = packed & (1 << 36) - 1, (packed >> 36 & 31) + 1, body[18:34]
        elif kind == 3:
            points = [p for p in _SEEK.iter_unpack(body) if p[0] != (1 << 64) - 1]
        at += 4 + size
    if width not in (8, 16):
        raise FlacError(f"{width} bits a sample aren't read")
    return total, width, md5, points, at


class _Window:
    """64 bits from any bit place of a buffer, for many places at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate((data, np.zeros(16, np.uint8)))
        self.words = np.zeros(len(data) + 8, np.uint64)
        for i in range(8):
            self.words = self.words << np.uint64(8) | padded[i : i + len(data) + 8]
        self.last = len(self.words) - 1

    def __call__(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits, left-aligned."""
        return self.words[np.minimum(at >> 3, self.last)] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width: int) -> np.ndarray:
        return (self(at) >> np.uint64(64 - width)).astype(np.int64)

    def take_signed(self, at: np.ndarray, width: int) -> np.ndarray:
        return (self(at).astype(np.int64)) >> (64 - width)


#: Coefficients of the fixed predictors, the nearest sample first (fixed values of the format).
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _restore(data: np.ndarray, view: _Window, at: np.ndarray, n: np.ndarray, width: int, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (step, frame) of predicted subframes, n falling, and the bits' ends."""
    frames, steps = len(n), int(n[0])
    order = np.where(kinds >= 32, kinds - 31, kinds - 8)
    most = int(order.max())
    x = np.zeros((steps, frames), np.int64)
    at = at.copy()
    for j in range(most):
        has = order > j
        x[j, has] = view.take_signed(at[has], width)
        at[has] += width
    coefficient, shift = np.zeros((most, frames), np.int64), np.zeros(frames, np.int64)
    for o, c in FIXED.items():
        if (kinds == 8 + o).any():
            coefficient[:o, kinds == 8 + o] = np.array(c, np.int64)[:, None]
    for f in np.flatnonzero(kinds >= 32).tolist():
        one = at[f : f + 1]
        precision = int(view.take(one, 4)[0]) + 1
        shift[f] = view.take_signed(one + 4, 5)[0]
        if shift[f] < 0 or precision == 16:
            raise FlacError("bad LPC subframe")
        for j in range(int(order[f])):
            coefficient[j, f] = view.take_signed(one + 9 + j * precision, precision)[0]
        at[f] += 9 + int(order[f]) * precision
    method, partition = view.take(at, 2), view.take(at + 2, 4)
    at += 6
    if (method > 1).any():
        raise FlacError("unknown residual coding")
    parameter_bits = 4 + method
    each = n >> partition
    if ((each << partition) != n).any() and (partition[(each << partition) != n] > 0).any():
        raise FlacError("partitions don't fit the block")
    k, raw, left = np.zeros(frames, np.int64), np.full(frames, -1), np.zeros(frames, np.int64)
    fresh = np.ones(frames, bool)
    active = frames - np.searchsorted(n[::-1], np.arange(steps), side="right")
    for i, m in enumerate(active.tolist()):
        todo = np.flatnonzero((left[:m] == 0) & (order[:m] <= i))
        if len(todo):
            for bits in (4, 5):
                some = todo[parameter_bits[todo] == bits]
                if len(some):
                    got = view.take(at[some], bits)
                    at[some] += bits
                    escaped = some[got == (1 << bits) - 1]
                    k[some], raw[some] = got, -1
                    if len(escaped):
                        raw[escaped], k[escaped] = view.take(at[escaped], 5), 0
                        at[escaped] += 5
            left[todo] = each[todo] - np.where(fresh[todo], order[todo], 0)
            fresh[todo] = False
        live = slice(0, m) if i >= most else np.flatnonzero(order[:m] <= i)
        if i < most and not len(live):
            continue
        p, ks = at[live], k[live]
        window = view(p)
        zeros = _ZEROS16[(window >> np.uint64(48)).astype(np.int64)]
        if (zeros == 16).any():
            open_ = np.flatnonzero(zeros == 16)
            while len(open_):
                more = _ZEROS16[(view(p[open_] + zeros[open_]) >> np.uint64(48)).astype(np.int64)]
                zeros[open_] += more
                open_ = open_[more == 16]
                if len(open_) and int((p[open_] + zeros[open_]).max()) > 8 * len(data):
                    if (raw[live][open_] < 0).any():
                        raise FlacError("a code runs past the stream")
                    break
            window = view(p + zeros + 1)
        else:
            window = window << (zeros + 1).astype(np.uint64)
        low = ((window >> np.uint64(1)) >> (63 - ks).astype(np.uint64)).astype(np.int64)
        u = zeros << ks | low
        value = (u >> 1) ^ -(u & 1)
        width_used = zeros + 1 + ks
        unfolded = raw[live] >= 0
        if unfolded.any():
            for w in np.unique(raw[live][unfolded]).tolist():
                these = raw[live] == w
                value[these] = view.take_signed(p[these], w) if w else 0
                width_used[these] = w
        at[live] = p + width_used
        left[live] -= 1
        if most:
            back = min(i, most)
            guess = sum((coefficient[j, live] * x[i - 1 - j, live] for j in range(back)), np.zeros(len(p), np.int64))
            value = value + (guess >> shift[live])
        x[i, live] = value
    return x, at


def _decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, n: np.ndarray, kind: np.ndarray, bits: np.ndarray, target: np.ndarray, flat: np.ndarray) -> None:
    """Write the samples of consecutive frames to their places; at: their CRC-8."""
    if (_crc(data, start, end - start - 2, CRC16, 16) != data[end - 2].astype(np.uint32) * 256 + data[end - 1]).any():
        raise FlacError("a frame's CRC-16 is wrong")
    view, body = _Window(data), 8 * (at + 2)
    for width in np.unique(bits).tolist():
        mine = bits == width
        for f in np.flatnonzero(mine & (kind == 0)).tolist():
            flat[target[f] : target[f] + n[f]] = view.take_signed(body[f : f + 1], width)[0]
        for f in np.flatnonzero(mine & (kind == 1)).tolist():
            flat[target[f] : target[f] + n[f]] = view.take_signed(body[f] + width * np.arange(n[f]), width)
        coded = np.flatnonzero(mine & (kind >= 8))
        if len(coded):
            coded = coded[np.argsort(-n[coded], kind="stable")]
            x, stop = _restore(data, view, body[coded], n[coded], width, kind[coded])
            if (-(-stop // 8) != end[coded] - 2).any():
                raise FlacError("a frame has a wrong length")
            for j, f in enumerate(coded.tolist()):
                flat[target[f] : target[f] + n[f]] = x[: n[f], j]


def decode_many(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of each stream; every checksum is verified.  Frames are decoded in runs."""
    if not streams:
        return []
    totals, widths, md5s, starts, owner, sample = [], [], [], [], [], []
    base = 0
    for i, s in enumerate(streams):
        total, width, md5, points, first = _metadata(s)
        if not points:
            raise FlacError("a seek table with a point for each frame is needed")
        totals.append(total)
        widths.append(width)
        md5s.append(md5)
        for at, offset, _ in points:
            starts.append(base + first + offset)
            owner.append(i)
            sample.append(at)
        base += len(s)
    data = np.frombuffer(b"".join(streams) if len(streams) > 1 else streams[0], np.uint8)
    start, own, sample_at = np.array(starts, np.int64), np.array(owner), np.array(sample, np.int64)
    stream_end = np.cumsum([len(s) for s in streams])
    end = np.append(start[1:], 0)
    last = np.append(own[1:] != own[:-1], True)
    end[last] = stream_end[own[last]]
    if (np.diff(start) <= 0).any():
        raise FlacError("seek points aren't in order")
    if (data[start] != 0xFF).any() or ((data[start + 1] & 0xFE) != 0xF8).any() or (data[start + 3] >> 4 != 0).any():
        raise FlacError("no mono frame at a seek point")
    lead = data[start + 4].astype(np.int64)
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    code, at = (data[start + 2] >> 4).astype(np.int64), start + 5 + extra
    rate = data[start + 2] & 15
    eight, next_ = data[at].astype(np.int64), data[np.minimum(at + 1, len(data) - 1)]
    n = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7, code >= 8], [192, 576 << np.clip(code - 2, 0, 3), eight + 1, eight * 256 + next_ + 1, 256 << np.clip(code - 8, 0, 7)], 0)
    at = at + np.select([code == 6, code == 7], [1, 2], 0) + np.select([rate == 12, rate == 13, rate == 14], [1, 2, 2], 0)
    if (_crc(data, start, at - start, CRC8, 8) != data[at]).any():
        raise FlacError("a frame header's CRC-8 is wrong")
    head = data[at + 1]
    if (head & 0x81).any():
        raise FlacError("wasted bits aren't read")
    kind = (head >> 1).astype(np.int64)
    if not ((kind <= 1) | ((kind >= 8) & (kind <= 12)) | (kind >= 32)).all():
        raise FlacError("a reserved subframe")
    bits = np.array(widths)[own]
    first = np.cumsum(totals) - totals
    flat = np.zeros(int(sum(totals)), np.int8 if max(widths) == 8 else np.int16)
    target = first[own] + sample_at
    if (sample_at + n > np.array(totals)[own]).any() or n.sum() != len(flat):
        raise FlacError("frames don't cover the stream")
    for lo, hi in _runs(n):
        _decode_frames(data[start[lo] : end[hi - 1]], start[lo:hi] - start[lo], end[lo:hi] - start[lo], at[lo:hi] - start[lo], n[lo:hi], kind[lo:hi], bits[lo:hi], target[lo:hi], flat)
    out = []
    for i, total in enumerate(totals):
        one = flat[first[i] : first[i] + total].astype(np.int8 if widths[i] == 8 else "<i2", copy=False)
        if md5s[i].strip(b"\0") and hashlib.md5(one.tobytes()).digest() != md5s[i]:
            raise FlacError("the stream's MD5 is wrong")
        out.append(one)
    return out


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of about ``BATCH_SAMPLES`` bytes of a column."""
    for batch in batches:
        sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        chunk = (np.cumsum(sizes) - sizes) // BATCH_SAMPLES
        cuts = [*np.flatnonzero(np.diff(chunk, prepend=-1)).tolist(), len(sizes)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)


def payload(text: str, pad: int = 64) -> bytes:
    data = text.encode()
    return data + b"\0" * (max(1, -(-len(data) // pad)) * pad - len(data))


def text_to_flac(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pad: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as 8-bit samples in a FLAC stream."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "text"):
            sizes = pc.binary_length(batch.column("text")).cast(pa.int64())
            media = encode_many([payload(t.as_py(), pad) for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(media, pa.binary())], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(lean(run), schema)


def flac_to_pcm(media: DataFrame, block: int = PCM_SAMPLES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry…, block, sample_offset, pcm): decoded blocks that can be sought by sample.

    A stream's blocks follow each other in order, in the partition of its row; every
    stream has one block at least.  Null media gives none.
    """
    kept = ["doc_id", *carry]
    schema = T.StructType([media.schema[c] for c in kept] + [T.StructField("block", T.IntegerType()), T.StructField("sample_offset", T.LongType()), T.StructField("pcm", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "media"):
            rows, numbers, offsets, blocks, size = [], [], [], [], 0

            def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                same = [batch.column(c).take(pa.array(rows, pa.int64())) for c in kept]
                return pa.RecordBatch.from_arrays([*same, pa.array(numbers, pa.int32()), pa.array(offsets, pa.int64()), pa.array(blocks, pa.binary())], names=schema.names)

            for i, x in enumerate(decode_many(batch.column("media").to_pylist())):
                for j, a in enumerate(range(0, max(1, len(x)), block)):
                    rows.append(i)
                    numbers.append(j)
                    offsets.append(a)
                    blocks.append(x[a : a + block].tobytes())
                    size += block
                    if size >= 16 * BATCH_SAMPLES:
                        yield out()
                        rows, numbers, offsets, blocks, size = [], [], [], [], 0
            if rows:
                yield out()

    return media.filter("media is not null").select(*kept, "media").mapInArrow(lean(run), schema)


class Feature:
    """Sum, energy, peak and zero crossings of 8-bit samples, block by block; all whole numbers."""

    def __init__(self) -> None:
        self.sum = self.energy = self.peak = self.crossings = 0
        self.last = None

    def add(self, x: np.ndarray) -> None:
        if not len(x):
            return
        wide = x.astype(np.int64)
        self.sum += int(wide.sum())
        self.energy += int((wide * wide).sum())
        self.peak = max(self.peak, int(np.abs(wide).max()))
        self.crossings += int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
        if self.last is not None and (self.last < 0) != (wide[0] < 0):
            self.crossings += 1
        self.last = int(wide[-1])

    def __str__(self) -> str:
        return f"sum={self.sum};energy={self.energy};peak={self.peak};crossings={self.crossings}"


def media_digests(media: DataFrame, block: int = PCM_SAMPLES) -> DataFrame:
    """The stored streams read back as PCM blocks: sizes, digests and features of each row.

    One task streams over the blocks of its streams and holds one block of each.
    """
    schema = T.StructType([T.StructField("doc_id", media.schema["doc_id"].dataType)] + [T.StructField(a, b) for a, b in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))])
    stored = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # of the stream in hand: fixed columns, length, digest, tail, feature

        def row() -> list:
            (doc_id, n_bytes, size, sha), length, digest, tail, feature = now
            return [doc_id, n_bytes, length, digest.hexdigest(), zlib.crc32(tail), size, sha, str(feature)]

        kinds = None
        for batch in batches:
            if kinds is None:
                kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            rows = []
            fixed = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256")), strict=True)
            for number, pcm, own in zip(batch.column("block").to_pylist(), batch.column("pcm"), fixed, strict=True):
                if number == 0:
                    if now:
                        rows.append(row())
                    now = [own, 0, hashlib.sha256(), b"", Feature()]
                x = np.frombuffer(pcm.as_buffer(), np.int8)
                data = x.view(np.uint8) ^ np.uint8(0x80)
                now[1] += len(x)
                now[2].update(data)
                now[3] = (now[3] + data[-64:].tobytes())[-64:]
                now[4].add(x)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row(), kinds, strict=True)], names=schema.names)

    return flac_to_pcm(stored, block, ("n_bytes", "media_bytes", "media_sha256")).mapInArrow(lean(run), schema)
