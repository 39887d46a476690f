"""Cutting texts where no tokenizer in use can join, so that pieces may be encoded once and kept.

A cut lies only (a) between a letter or digit and a following space or ASCII punctuation mark
other than the apostrophe, (b) before white space that follows anything else, and (c) after a
single line break that a letter or digit follows. Both public tokenizers split there before
they merge, their normalizers cannot compose across such a place, and their special strings hold
no white space and start with punctuation, so ids of the pieces in order are the ids of the text.
Whole Arrow columns are cut on their UTF-8 bytes, at those of these places that ASCII shows.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space in the tokenizers' sense (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CUTS = re.compile(
    f"\\n(?=[^\\W_])|[{SPACE}]*[^\\W_\u0130]++(?=[{SPACE}\\x21-\\x26\\x28-\\x7e]|\\Z)(?!_)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
)
#: White space after anything else: no token lies across it.
SURE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
STRETCH = 1 << 17
KEPT_CHARS = 48
#: New words that the library gets as one text.
JOINED = 256
#: Bytes of a column that are cut at once.
WINDOW = 1 << 22
OTHER, WORD, BLANK, MARK = range(4)
#: Kinds of bytes: ASCII letters and digits, white space, and punctuation that may end a word.
KINDS = np.array(
    [
        WORD if c.isalnum() else BLANK if c in "\t\n\v\f\r " else MARK if "!" <= c <= "~" and c not in "'_" else OTHER
        for c in map(chr, range(128))
    ]
    + [OTHER] * 128,
    np.uint8,
)
#: Whether a word may hold the character of a two-byte code: letters and digits as ``CUTS`` takes them.
LETTERS = np.array([re.match("[^\\W_\u0130]", chr(c)) is not None for c in range(0x800)])
#: White space beyond ASCII as numbers of its two or three UTF-8 bytes.
BLANKS = [int.from_bytes(c.encode(), "big") for c in map(chr, range(128, 0x3001)) if re.match(f"[{SPACE}]", c)]


def starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces start in UTF-8 bytes that begin at a cut; ``firsts`` are the starts of texts in them.

    Each lies at a cut of ``CUTS`` and rests on no byte after itself, so bytes may end anywhere behind it.
    """
    kinds = KINDS[data]
    pairs = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    pairs = pairs[pairs + 1 < len(data)]
    pairs = pairs[LETTERS[(data[pairs].astype(np.int16) & 31) << 6 | data[pairs + 1] & 63]]
    kinds[pairs] = kinds[pairs + 1] = WORD
    at = np.flatnonzero(kinds != WORD)
    kind = kinds[at]
    before = np.concatenate([[BLANK], kind])[:-1]
    touches = np.diff(at, prepend=-1) == 1
    opens = (kind == BLANK) & ~(touches & (before == BLANK))
    doubt = np.flatnonzero(opens & touches & (before == OTHER))
    a, b, c = (data[at[doubt] - k].astype(np.int64) for k in (3, 2, 1))
    opens[doubt] = ~np.isin(b << 8 | c, BLANKS) & ~np.isin(a << 16 | b << 8 | c, BLANKS)
    lines = at[opens & (data[at] == 10)] + 1
    lines = lines[lines < len(data)]
    found = np.zeros(len(data), bool)
    found[0] = True
    found[firsts] = True
    found[at[opens | ((kind == MARK) & ~touches & (before == BLANK))]] = True
    found[lines[kinds[lines] == WORD]] = True
    return np.flatnonzero(found)


def stretches(text: str) -> Iterator[str]:
    """A text cut at sure places, so that none of its pieces is much longer than a stretch."""
    at = 0
    while len(text) - at > 2 * STRETCH:
        m = SURE.search(text, at + STRETCH)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Kept:
    """Values of pieces in two generations: when the young one is full, the old one is dropped."""

    def __init__(self, most: int = 500_000):
        self.most, self.young, self.old = most, {}, {}

    def values(self, pieces: list[str], find) -> list:
        """The value of each piece; ``find`` gets the unknown ones, each once."""
        young = self.young
        found = list(map(young.get, pieces))
        if None in found:
            old = self.old
            wanted = {p for p, v in zip(pieces, found, strict=True) if v is None}
            fresh = {p: old[p] for p in wanted if p in old}
            new = [p for p in wanted if p not in fresh]
            if new:
                fresh.update(zip(new, find(new), strict=True))
            found = [fresh[p] if v is None else v for p, v in zip(pieces, found, strict=True)]
            if len(young) + len(fresh) > self.most:
                self.old, self.young = young, {}
            self.young.update((p, v) for p, v in fresh.items() if len(p) <= KEPT_CHARS)
        return found

    def distinct(self, pieces: list, find) -> list:
        """The same of pieces that differ from each other, with fewer look-ups."""
        found = list(map(self.young.get, pieces))
        gaps = [k for k, v in enumerate(found) if v is None]
        asked = [pieces[k] for k in gaps]
        fresh = list(map(self.old.get, asked))
        new = [k for k, v in enumerate(fresh) if v is None]
        for k, v in zip(new, find([asked[k] for k in new]) if new else (), strict=True):
            fresh[k] = v
        for k, v in zip(gaps, fresh, strict=True):
            found[k] = v
        if len(self.young) + len(gaps) > self.most:
            self.old, self.young = self.young, {}
        self.young.update((p, v) for p, v in zip(asked, fresh, strict=True) if len(p) <= KEPT_CHARS)
        return found


class Read:
    """Values of whole texts: ``find`` gives the values of new pieces, ``add`` joins values in order."""

    def __init__(self, find: Callable[[list[str]], list], add: Callable[[list], object]):
        self.find, self.add = find, add
        self.pieces = Kept()

    def closed(self, text: str):
        """The value of a text that starts and ends at cuts."""
        return self.add(self.pieces.values(CUTS.findall(text), self.find))

    def __call__(self, text: str | None):
        return self.add([self.closed(x) for x in stretches(text or "")])

    def all(self, texts: list[str | None]) -> list:
        """The value of each text; the pieces of some hundred thousand characters are looked up at once.

        Nothing made here refers to itself, so the collector of cycles rests meanwhile: it would walk through the
        kept pieces again and again.
        """
        resumes = gc.isenabled()
        gc.disable()
        try:
            return self._all(texts)
        finally:
            if resumes:
                gc.enable()

    def _all(self, texts: list[str | None]) -> list:
        out: list = []
        pieces: list[str] = []
        ends: list[int] = []
        size = 0

        def look_up():
            values, at = self.pieces.values(pieces, self.find), 0
            for end in ends:
                out.append(self.add(values[at:end]))
                at = end
            pieces.clear()
            ends.clear()

        for text in texts:
            text = text or ""
            if len(text) > STRETCH:
                look_up()
                out.append(self(text))
                continue
            if size + len(text) > 2 * STRETCH:
                look_up()
                size = 0
            pieces += CUTS.findall(text)
            ends.append(len(pieces))
            size += len(text)
        look_up()
        return out


class Encoder(Read):
    """Ids of a tokenizers file as little-endian unsigned 32-bit bytes, with a bounded memory of pieces.

    New pieces of a space and letters reach the library joined, since a text of its own costs more than its
    tokens do. A cut lies before each, so their ids are those of the pieces; where one ends shows in
    the vocabulary, which marks the last token of a word, or the byte of a space, which only opens a piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.suffix = json.load(f)["model"].get("end_of_word_suffix")
        tokens = self.library.get_vocab()
        self.marked = np.zeros(max(tokens.values(), default=0) + 1, bool)
        self.marked[[i for t, i in tokens.items() if (t.endswith(self.suffix) if self.suffix else t.startswith("\u0120"))]] = True
        super().__init__(self.ids, b"".join)

    def ids(self, pieces: list[str]) -> list[bytes]:
        words = [k for k, p in enumerate(pieces) if p[0] == " " and p[1:].isalpha()]
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        out: list = [None] * len(pieces)
        for group, ids in zip(groups, self.library_ids(["".join([pieces[k] for k in g]) for g in groups]), strict=True):
            raw = array("I", ids).tobytes()
            ends = np.flatnonzero(self.marked[np.frombuffer(raw, "<u4")])
            if len(ends) == len(group):  # else some piece is no single word to the library
                cuts = [0, *(4 * ends + 4).tolist()] if self.suffix else [*(4 * ends).tolist(), len(raw)]
                for k, start, end in zip(group, cuts, cuts[1:], strict=False):
                    out[k] = raw[start:end]
        rest = [k for k, v in enumerate(out) if v is None]
        for k, ids in zip(rest, self.library_ids([pieces[k] for k in rest]), strict=True):
            out[k] = array("I", ids).tobytes()
        return out

    def column(self, texts: pa.Array, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column in order, and how many each has; null counts as empty.

        Windows of bytes are cut and their distinct pieces numbered, so that no object is made for each piece.
        """
        texts = pc.fill_null(texts, "")
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds or bytes(8), "<i8" if pa.types.is_large_string(texts.type) else "<i4")
        bounds = bounds[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw, last = np.frombuffer(data or b"", np.uint8), int(bounds[-1])
        before = np.zeros(len(bounds), np.int64)  # ids before each text
        out, held, at, size = [np.zeros(0, kind)], 0, int(bounds[0]), WINDOW
        while at < last:
            end = min(at + size, last)
            found = starts(raw[at:end], bounds[slice(*np.searchsorted(bounds, [at, end]))] - at)
            if end < last:
                if len(found) == 1:  # no cut yet
                    size *= 2
                    continue
                end, found = at + int(found[-1]), found[:-1]
            ids, counts = self._window(raw[at:end], found)
            own = slice(*np.searchsorted(bounds, [at, end]))
            before[own] = held + np.append(0, np.cumsum(counts))[np.searchsorted(found, bounds[own] - at)]
            out.append(ids.astype(kind))
            held, at, size = held + len(ids), end, WINDOW
        before[np.searchsorted(bounds, last) :] = held
        return np.concatenate(out), np.diff(before)

    def _window(self, data: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that start at ``found``, and how many each has."""
        ends = np.append(found, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = self.pieces.distinct(distinct, lambda new: self.ids([p.decode() for p in new]))
        sizes = np.fromiter(map(len, values), np.int32, len(values)) // 4
        kept, which = np.frombuffer(b"".join(values), "<u4"), pieces.indices.to_numpy()
        counts = sizes[which]
        first = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(counts) - counts)
        at = np.repeat(first.astype(np.int32), counts)
        at += np.arange(len(at), dtype=np.int32)
        return kept[at], counts

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
