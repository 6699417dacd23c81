"""Vectorised word splitting and hashing over the UTF-8 bytes of an Arrow text column.

A batch of texts is one byte buffer with row offsets, so words, their hashes and their shingles come from a
few numpy passes, without a Python object for each word. Work goes in slices of about ``SLICE`` bytes so
that temporaries stay small; a slice always holds whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19

_U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit numbers, the same on every machine."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit hashes."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


_BYTES = _splitmix(256, 11)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_BASE = 0x9E3779B97F4A7C1B  # odd, 3 modulo 4
_BASE_INV = pow(_BASE, -1, 1 << 64)
_PLACES = _splitmix(64, 77) | _U(1)

#: Bytes of words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[at[0] : at[-1]]
    return raw, at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and for each row the index of its first word (one entry more than rows)."""
    inside = table[raw]
    first, last = inside.copy(), inside.copy()
    if len(raw):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] = inside[heads]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words; with ``lower``, A-Z count as a-z."""
    power, inverse = _pow(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum((_LOWER if lower else _BYTES)[raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words by row, and each row's first run; a row of fewer words is one run."""
    count = np.diff(first)
    runs = np.maximum(count - size + 1, (count > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(runs)))
    begin = np.repeat(first[:-1] - at[:-1], runs) + np.arange(at[-1])
    length = np.repeat(np.minimum(count, size), runs)
    out = length.astype(_U) * _U(0xC2B2AE3D27D4EB4F)
    full = length == size
    if full.all():
        for j in range(size):
            out += words[begin + j] * _PLACES[j]
    else:
        for j in range(size):
            has = length > j
            out[has] += words[begin[has] + j] * _PLACES[j]
    return mix(out), at


def exact_ids(part: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of pieces of text, equal only for equal bytes, and the pieces themselves.

    The pieces, one after the other, are the bytes of ``part`` where ``inside`` holds; ``lengths`` are theirs in bytes.
    """
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(part[inside].tobytes())])
    return pieces.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), pieces


def counts_in(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set in each range between two offsets."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]
