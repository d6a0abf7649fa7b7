"""Vectorised word and shingle hashes for Arrow-batched tasks.

Words are hashed from the bytes of a text without making Python strings: a
prefix sum of ``byte * B**position`` (mod 2**64) gives every word's polynomial
by one subtraction, and a finaliser spreads it over 64 bits. Memory stays
bounded for texts of any length: bytes are taken in blocks cut at separators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, BLOCK + 1)
        for key, base in (("p", _BASE), ("q", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[key] = np.cumprod(table, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_classes(separators: str) -> np.ndarray:
    """Table of 256: True where a byte belongs to a word. ``separators`` are
    ASCII; every byte of a longer character belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators.encode("ascii"), dtype=np.uint8)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
BLANK_SEPARATED = byte_classes("\x20\x09\x0a\x0b\x0c\x0d")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALPHANUMERIC = byte_classes("".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def _block_words(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends


def word_hashes(data: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte after the last of every word of one text."""
    inside = word_bytes[data]
    if len(data) <= BLOCK:
        return _block_words(data, inside)
    found, at = [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~inside[at:end])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word fills the block: go on to where it ends
                after = np.flatnonzero(~inside[end:])
                end = end + int(after[0]) if len(after) else len(data)
        h, s, e = _block_words(data[at:end], inside[at:end])
        found.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found))


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, np.uint64(length), dtype=np.uint64)
    for k in range(length):
        total = total * np.uint64(0x9FB21C651E98DF25) + words[k : k + n]
    return mix(total)


def shingles(words: np.ndarray, length: int) -> np.ndarray:
    """Distinct shingles, sorted; fewer words than ``length`` are one shingle,
    no words none."""
    return np.unique(sequence_hashes(words, min(length, len(words)))) if len(words) else np.zeros(0, dtype=np.uint64)


def texts(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each value, without copying; None for null."""
    offsets_type = np.int64 if pa.types.is_large_string(column.type) else np.int32
    valid, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=offsets_type)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(len(column)):
        yield None if nulls is not None and nulls[i] else raw[bounds[i] : bounds[i + 1]]
