"""Word shingles as sets of 64-bit hashes, their names and sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bits of a sketch for each shingle, at least; a sketch is an eighth of its set or less.
SKETCH_BITS = 4
SLICE = 1 << 16


def shingle_hashes(text: bytes | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 values of the word shingles, some thousands at a time; none without a word."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    parts = (text or b"").lower().split()
    if not parts:
        return
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = ends - [len(p) for p in parts]
    width = min(words, len(parts))
    spans = list(zip(starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True))
    for at in range(0, len(spans), SLICE):
        yield np.array([hashed(line[s:e], 42) for s, e in spans[at : at + SLICE]], "<u8")


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Distinct shingle hashes in order."""
    held = [np.unique(h) for h in shingle_hashes(text, words)]
    return np.unique(np.concatenate(held)) if held else np.zeros(0, "<u8")


def node_of(held: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(held.tobytes())], "<u8").view("<i8")[0])


def sketch(held: np.ndarray) -> bytes:
    """A bit for each shingle in a string of bits that grows with the set, a power of two."""
    bits = np.zeros(max(64, 1 << (SKETCH_BITS * len(held) - 1).bit_length()) if len(held) else 64, np.uint8)
    bits[(held & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_alike(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """False only if the sketches of sets of na and nb shingles show that they are not alike enough.

    A bit that the other sketch lacks is a shingle that it lacks. The longer sketch is folded to the shorter.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, width)) for v in (x, y))
    most = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
    return (100 + percent) * most >= percent * (na + nb)
