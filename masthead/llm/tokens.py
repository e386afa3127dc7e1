"""Encoding with the ``tokenizers`` library behind a bounded cache of text units.

A text is cut before every single space that a non-space follows, and around a
single newline between non-spaces.  Such cuts never change what a byte-level
pre-tokenizer does (the space always belongs to the word after it, the newline is
alone), so a unit's ids can be kept and reused.  Strings of added tokens are cut
out first.  Tokenizers of another kind get their texts whole.

``encode_column`` does the same to the bytes of an Arrow column without a Python
string for each word.  It cuts finer: also where letters (ASCII, and Latin letters
of the lead bytes C3 to C5), ASCII digits and ASCII punctuation meet, but never
after an apostrophe, nowhere next to other characters, and not inside what has more
than ``UNIT_CHARS`` bytes between white space (pieces of base64 hardly ever come
again).  Texts of more than ``PORTION_BYTES``, and those that hold an added token,
go the way above.

Memory is bounded in bytes: the cache by ``CACHE_BYTES``, the work in hand by
``BATCH_CHARS`` or ``PORTION_BYTES``.  Units longer than ``UNIT_CHARS`` (a line of Chinese, a run of
base64) are encoded anew each time.  A text longer than ``BATCH_CHARS`` is worked
off in segments that end at a cut, or where a letter meets a digit or an ASCII
punctuation mark; only a single unit without any of these is taken in one piece.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from masthead.llm.shared import AT_TASK_END

#: Bytes of units and ids kept during a task; the cache starts afresh beyond it.
CACHE_BYTES = 144 << 20
#: The same for operators that leave the cache to a worker's next tasks; beyond it
#: the longer, rarer half goes.
KEPT_BYTES = 288 << 20
#: Bytes of a cache entry besides its strings.
ENTRY_BYTES = 100
#: Units of more characters are not kept.
UNIT_CHARS = 48
#: New words that the library gets as one text.
JOINED = 1_000
#: Characters handed to the library at once.
BATCH_CHARS = 1_000_000
#: Bytes of a column that are cut at once.
PORTION_BYTES = 4 << 20

_CUT = re.compile(r" (?=\S)")
#: Where a pre-tokenizer by classes of characters always begins a new word.
_LETTER = r"A-Za-z\u0e01-\u0e2e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_BORDER = re.compile(rf"(?= \S)|(?<=[{_LETTER}])(?=[0-9])|(?<=[0-9])(?=[{_LETTER}])|(?<=[{_LETTER}0-9])(?=[!-&(-/:-@\[-^`{{-~\u3002\uff0c\uff01\uff1f])")

#: Classes of bytes for cuts: 0 unknown, 1 white space, and what never shares a pre-token: 2 letter, 3 digit, 4 punctuation.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[33:127] = 4
_CLASS[48:58] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 2
#: Bytes that begin a character which surely isn't white space.
_VISIBLE = _CLASS > 1
_VISIBLE[0xC3:0xF5] = True
_VISIBLE[0xE1:0xE4] = False


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte of texts that begin at ``starts``, whether a unit begins there.

    A unit that ends in white space before something visible has just one such
    character, because the pre-tokenizer would part a longer run."""
    kind = _CLASS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    lead = lead[lead < len(data) - 1]
    after = data[lead + 1]
    lead = lead[(data[lead] != 0xC3) | ((after != 0x97) & (after != 0xB7))]  # the signs of times and division
    kind[lead] = kind[lead + 1] = 2
    visible = _VISIBLE[data]
    known, newline = kind > 1, data == 10
    out = np.zeros(len(data) + 1, bool)
    inner = out[1:-1]  # between each byte and the next
    np.logical_and(known[:-1], kind[1:] == 1, out=inner)
    inner[1:] |= known[:-2] & newline[1:-1] & visible[2:]
    space = data[:-1] == 32
    space &= visible[1:]
    space[starts[(starts > 0) & (starts < len(data))] - 1] = False  # a text's last space
    out[:-2] |= space
    out[starts] = True
    fine = kind[:-1] != kind[1:]
    fine &= known[:-1]
    fine &= known[1:]
    fine &= ~((data[:-1] == 39) & (kind[1:] == 2))
    begin = np.append(np.flatnonzero(out[:-1]), len(data))
    for i in np.flatnonzero(np.diff(begin) > UNIT_CHARS).tolist():
        fine[begin[i] : begin[i + 1] - 1] = False
    inner |= fine
    return out[:-1]


def read_definition(path: str) -> str:
    """The tokenizer's JSON, read on the driver and shipped with the task."""
    return Path(path).read_text(encoding="utf-8")


def segments(text: str, size: int | None = None) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that are encoded independently."""
    size = size or BATCH_CHARS
    at = 0
    while len(text) - at > size:
        border = _BORDER.search(text, at + size)
        if border is None:
            break
        yield text[at : border.start()]
        at = border.start()
    yield text[at:] if at else text


def around_added(added: dict[str, int]) -> re.Pattern | None:
    """The pattern that parts a text at its added tokens, the longest first."""
    return re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None


class CachedEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(definition)
        pre = spec.get("pre_tokenizer") or {}
        own = spec.get("added_tokens", [])
        plain = spec.get("normalizer") is None and spec.get("post_processor") is None and not any(x.get(k) for x in own for k in ("lstrip", "rstrip", "single_word"))
        self.cuttable = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.added = {x["content"]: array("I", [x["id"]]).tobytes() for x in own}
        self.around = around_added(self.added)
        self.newline, *stops = self._whole(["\n", ".", ","])
        self.newline_id = int.from_bytes(self.newline, "little") if len(self.newline) == 4 else -1
        self.stops = dict(zip(".,", stops, strict=True))
        self.cache_bytes, self.keeps = CACHE_BYTES, False
        self.starts = self._space_starts() if self.cuttable else None
        self.forget()

    def forget(self) -> None:
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.units: dict[bytes, bytes] = {}
        self.held = 0

    def _bound(self) -> None:
        if self.held > self.cache_bytes:
            if self.keeps:
                self._thin()
            else:  # all at once leaves no memory in pieces
                self.forget()

    def _thin(self) -> None:
        """Keep the shorter units, at most half of the bytes."""
        size, sizes = sys.getsizeof, [0] * (UNIT_CHARS + 1)
        for known in (self.first, self.rest, self.units):
            for unit, ids in known.items():
                sizes[len(unit)] += size(unit) + size(ids) + ENTRY_BYTES
        kept, longest = 0, -1
        while longest < UNIT_CHARS and kept + sizes[longest + 1] <= self.cache_bytes // 2:
            longest += 1
            kept += sizes[longest]
        self.first = {u: ids for u, ids in self.first.items() if len(u) <= longest}
        self.rest = {u: ids for u, ids in self.rest.items() if len(u) <= longest}
        self.units = {u: ids for u, ids in self.units.items() if len(u) <= longest}
        self.held = kept

    def _space_starts(self) -> np.ndarray:
        """For each id, whether its token begins with a space."""
        vocab = self.tokenizer.get_vocab()
        starts = np.zeros(max(vocab.values(), default=0) + 1, bool)
        starts[[i for token, i in vocab.items() if token[:1] == "\u0120" and token not in self.added]] = True
        return starts

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, each after a space.

        Such a word and its space are one pre-token, so in one text of many words
        the tokens that begin with a space part the words."""
        texts = [" " + " ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        out: list[bytes] = []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            raw, at = ids.tobytes(), (4 * np.flatnonzero(self.starts[ids])).tolist()
            at.append(len(raw))
            out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out if len(out) == len(words) else self._whole([" " + w for w in words])

    def _lines(self, units: list[str]) -> list[bytes]:
        """Ids of units without white space but for one space that may lead; a newline
        between two of them is a token of its own."""
        out: list[bytes] = []
        for e in self.tokenizer.encode_batch_fast(["\n".join(units[i : i + JOINED]) for i in range(0, len(units), JOINED)], add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            raw, at = ids.tobytes(), (4 * np.flatnonzero(ids == self.newline_id)).tolist()
            out += [raw[a:b] for a, b in zip([0, *(x + 4 for x in at)], [*at, len(raw)], strict=True)]
        return out if len(out) == len(units) else self._whole(units)

    def _learn(self, units: Iterable[str], known: dict[str, bytes], lead: str) -> list[str]:
        """Add the ids of new units; returned are those too long to be kept.

        A stop or comma after a letter is a token of its own, so such units are put
        together from the word's ids."""
        added = new = set(units).difference(known)
        ended = {u: u[:-1] for u in new if u[-1:] in self.stops and u[-2:-1].isalpha()}
        if ended:
            words = set(ended.values()).difference(known)
            added = added | words
            new = new.difference(ended) | words
        plain = [u for u in new if u.isalpha()] if lead else []
        fresh = [u for u in new if not u.isalpha()] if lead else list(new)
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            known.update(zip(part, self._words(part), strict=True))
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            known.update(zip(part, self._whole([lead + u for u in part]), strict=True))
        for unit, word in ended.items():
            known[unit] = known[word] + self.stops[unit[-1]]
        long = [u for u in added if len(u) > UNIT_CHARS]
        size = sys.getsizeof
        short = added.difference(long) if long else added
        self.held += sum(map(size, short)) + sum(map(size, map(known.__getitem__, short))) + ENTRY_BYTES * len(short)
        return long

    def _units(self, text: str) -> list[list[str]]:
        """Units by line; single newlines between non-spaces are cuts as well."""
        lines = text.split("\n")
        if len(lines) > 1 and (any(not x or x[-1].isspace() for x in lines[:-1]) or any(not x or x[0].isspace() for x in lines[1:])):
            lines = [text]
        return [_CUT.split(x) for x in lines]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.  The many short-lived lists hold no cycles, so the
        collector, which would walk them again and again, rests meanwhile."""
        return list(self.encode_stream(texts))

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Texts without added tokens, about ``BATCH_CHARS`` together."""
        if not self.cuttable:
            return self._whole(texts)
        self._bound()
        cut = [self._units(text) for text in texts]
        heads = [[line.pop(0) for line in lines] for lines in cut]
        first, rest = self.first, self.rest
        long_first = self._learn(chain.from_iterable(heads), first, "")
        long_rest = self._learn(chain.from_iterable(line for lines in cut for line in lines), rest, " ")
        get = rest.__getitem__
        out = [self.newline.join([first[head] + b"".join(map(get, line)) for head, line in zip(own, lines, strict=True)]) for lines, own in zip(cut, heads, strict=True)]
        for known, long in ((first, long_first), (rest, long_rest)):
            for unit in long:
                del known[unit]
        return out

    def _parts(self, text: str) -> list[str]:
        """The text at its added tokens, in segments; added tokens stand alone."""
        if not self.cuttable:
            return [text]
        parts = [text]
        if self.around is not None and any(a in text for a in self.added):
            parts = [p for p in self.around.split(text) if p]
        if len(text) > BATCH_CHARS:
            parts = [s for p in parts for s in (segments(p) if p not in self.added else (p,))]
        return parts

    def encode_stream(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, worked off in portions of about ``BATCH_CHARS``."""
        held: list[str] = []  # parts that wait
        ends: list[int] = []  # for each text, the number of parts up to its end
        done: list[bytes] = []  # ids of the parts before a long text's last portion
        chars = 0

        def portion() -> list[bytes]:
            collecting = gc.isenabled()
            gc.disable()
            try:
                plain = [i for i, p in enumerate(held) if p not in self.added] if self.cuttable else range(len(held))
                out = [b""] * len(held) if len(plain) == len(held) else [self.added.get(p, b"") for p in held]
                for i, ids in zip(plain, self._encode_plain([held[i] for i in plain]), strict=True):
                    out[i] = ids
                return out
            finally:
                if collecting:
                    gc.enable()

        for text in texts:
            for part in self._parts(text):
                held.append(part)
                chars += len(part)
                if chars >= BATCH_CHARS:
                    coded, at = portion(), 0
                    for end in ends:
                        yield b"".join(done + coded[at:end])
                        done, at = [], end
                    done += coded[at:]
                    held, ends, chars = [], [], 0
            ends.append(len(held))
        coded, at = portion() if held else [], 0
        for end in ends:
            yield b"".join(done + coded[at:end])
            done, at = [], end

    def encode_column(self, texts: pa.Array, end: bytes = b"", portion: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of consecutive texts, each followed by ``end``, and their numbers by text; about ``portion`` bytes at once."""
        if not len(texts):
            return
        portion = portion or PORTION_BYTES
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        sizes = np.diff(at)
        apart = (sizes > portion) | (not self.cuttable)
        for token in self.added if self.cuttable else ():
            apart |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(at, at[first] + portion, side="right")) - 1)
            change = np.flatnonzero(apart[first:last] != apart[first])
            last = min(last, len(texts), first + int(change[0]) if len(change) else last)
            if apart[first]:
                coded = [ids + end for ids in self.encode_stream(t.as_py() for t in texts[first:last])]
                yield np.frombuffer(b"".join(coded), "<u4"), np.array([len(ids) // 4 for ids in coded])
            else:
                yield self._encode_portion(texts.buffers()[2], at[first : last + 1], end)
            first = last

    def _encode_portion(self, values: pa.Buffer | None, at: np.ndarray, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Texts between neighbours of ``at``: units to a dictionary, its ids taken for each unit."""
        size = int(at[-1] - at[0])
        data = np.frombuffer(values, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
        starts = at[:-1] - at[0]
        if size:
            begin = np.flatnonzero(cuts(data, starts[starts < size]))
        else:
            begin = np.zeros(0, np.int64)
        offsets = np.append(begin, size).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        places, raw = np.frombuffer(units.dictionary.buffers()[1], np.int32, len(units.dictionary) + 1).tolist(), units.dictionary.buffers()[2]
        raw = raw.to_pybytes() if raw else b""
        ids = self._ids([raw[a:b] for a, b in zip(places, places[1:], strict=False)])
        ends = np.searchsorted(begin, at[1:] - at[0])  # units before each text's end
        order = np.insert(units.indices.to_numpy(), ends, len(ids))
        ids.append(end)
        got = pa.array(ids, pa.large_binary()).take(pa.array(order))
        borders = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)
        closed = borders[ends + np.arange(1, len(ends) + 1)] // 4
        flat = np.frombuffer(got.buffers()[2], "<u4", int(borders[-1]) // 4) if borders[-1] else np.zeros(0, "<u4")
        return flat, np.diff(closed, prepend=0)

    def _ids(self, units: list[bytes]) -> list[bytes]:
        """Ids of different units, from the cache or the library."""
        self._bound()
        known = self.units
        found = list(map(known.get, units))
        missing = [i for i, ids in enumerate(found) if ids is None]
        fresh = [units[i] for i in missing]
        long = [u for u in fresh if len(u) > UNIT_CHARS]
        short = [u for u in fresh if len(u) <= UNIT_CHARS] if long else fresh
        words, lines, other = [], [], []
        for u in short:
            text = u.decode()
            word = text.removeprefix(" ")
            if word.isalpha():
                if len(word) < len(text):
                    words.append((u, word))
                else:
                    lines.append((u, text))
            else:
                (lines if word and word.isascii() and word.isprintable() and " " not in word else other).append((u, text))
        for some, coded in ((words, self._words), (lines, self._lines), (other, self._whole)):
            for i in range(0, len(some), 20_000):
                part, asked = zip(*some[i : i + 20_000], strict=True)
                known.update(zip(part, coded(list(asked)), strict=True))
        size = sys.getsizeof
        self.held += sum(map(size, short)) + sum(map(size, map(known.__getitem__, short))) + ENTRY_BYTES * len(short)
        once = dict(zip(long, self.encode_stream(u.decode() for u in long), strict=True))
        for i, u in zip(missing, fresh, strict=True):
            found[i] = once[u] if u in once else known[u]
        return found


_ENCODERS: dict[int, CachedEncoder] = {}
AT_TASK_END.append(lambda: [e.forget() for e in _ENCODERS.values() if not e.keeps])


def encoder(definition: str, cache_bytes: int = CACHE_BYTES, keep: bool = False) -> CachedEncoder:
    """This Python worker's encoder for a definition.

    Its cache goes when the task ends, unless ``keep`` leaves it, within its bound, to
    the worker's next tasks (Spark ends a worker that was idle for a minute).
    """
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = CachedEncoder(definition)
    _ENCODERS[key].cache_bytes, _ENCODERS[key].keeps = cache_bytes, keep
    return _ENCODERS[key]
