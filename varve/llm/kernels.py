"""Vectorised text kernels over Arrow buffers, used inside ``mapInArrow``.

A column of texts is taken in slices of about a megabyte; words are found on the
raw UTF-8 bytes of a slice at once and hashed by a prefix polynomial, so the
cost a word is a few dozen nanoseconds and memory stays a small multiple of the
slice.  One very long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of slices of a string column; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each text's words begin (one entry more than texts).

    ``inner`` tells for each of 256 bytes whether it is part of a word; by default all but blanks are.
    """
    inside = ~_SPACE[buf] if inner is None else inner[buf]
    cuts = offsets[1:-1]
    follows = np.empty(len(buf), bool)
    follows[:1] = False
    follows[1:] = inside[:-1]
    follows[cuts[cuts < len(buf)]] = False
    starts = np.flatnonzero(inside & ~follows)
    precedes = np.empty(len(buf), bool)
    precedes[-1:] = False
    precedes[:-1] = inside[1:]
    precedes[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~precedes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z folded."""
    return _LOWER[buf]


def distinct_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in order of appearance, and for each word which of them it is."""
    sizes = np.cumsum(ends - starts)
    marks = np.zeros(len(buf) + 1, np.int8)
    marks[starts] += 1
    marks[ends] -= 1
    body = buf[np.cumsum(marks[:-1], dtype=np.int8).view(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    offsets[1:] = sizes
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    coded = array.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order of appearance, and for each value which of them it is; hashed, not sorted."""
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of all spans one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def packed_numbers(values: np.ndarray) -> bytes:
    """Small unsigned numbers compressed: the low bytes of all, then the next."""
    values = np.ascontiguousarray(values, np.uint32)
    raw = b"".join((values >> np.uint32(shift)).astype(np.uint8).tobytes() for shift in (0, 8, 16, 24))
    return pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_numbers(packed: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``packed_numbers``."""
    raw = np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view(np.uint32).ravel()


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, piece: int = 1 << 22) -> np.ndarray:
    """A 64-bit hash of every word, A-Z folded if ``lower``; ``piece`` bytes are hashed at a time."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + piece, "right")))
        part = buf[base : ends[hi - 1]]
        power, inverse = _powers_to(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        codes = (_LOWER[part] if lower else part).astype(np.uint64)
        codes += np.uint64(1)
        codes *= power[: len(part)]
        np.cumsum(codes, out=sums[1:])
        first, last = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((sums[last] - sums[first]) * inverse[first])
        lo = hi
    return out


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and how many words its text has from there on.

    A text of fewer than ``k`` words has its whole sequence as its only shingle,
    at its first word.  Entries whose second value is under ``k`` are otherwise void.
    """
    n = len(h)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    out = np.zeros(n, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    for j in range(min(k, n)):
        part = h[j:] * np.uint64((2 * j + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        ok = left[: n - j] > j
        out[: n - j] = np.where(ok, out[: n - j] * step + part, out[: n - j])
    return mix(out), left


def run_hashes(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place of ``at`` on."""
    power, inverse = _powers_to(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=sums[1:])
    return mix((sums[at + n] - sums[at]) * inverse[at])


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's longs."""
    return np.ascontiguousarray(x).view(np.int64)


def trigram_counts(buf: np.ndarray, offsets: np.ndarray, dims: int, lower: bool, piece: int = 1 << 22) -> np.ndarray:
    """Counts of hashed byte trigrams, one row of ``dims`` (a power of two) for each text.

    Bytes are taken ``piece`` at a time, so a very long text needs no more memory than a short one.
    """
    texts = len(offsets) - 1
    out = np.zeros(texts * dims, np.int64)
    shift = np.uint32(32 - dims.bit_length() + 1)
    for lo in range(0, max(0, len(buf) - 2), piece):
        part = buf[lo : lo + piece + 2]
        b = (_LOWER[part] if lower else part).astype(np.uint32)
        h = ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> shift
        at = np.arange(lo, lo + len(h))
        text = np.searchsorted(offsets, at, "right") - 1 if texts > 1 else np.zeros(len(h), np.int64)
        ok = at + 2 < offsets[text + 1]
        out += np.bincount(text[ok] * dims + h[ok], minlength=texts * dims)
    return out.reshape(texts, dims)
