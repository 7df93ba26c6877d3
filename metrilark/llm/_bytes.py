"""Vectorised byte, word and hash primitives shared by the operators.

Everything here works on the flat UTF-8 buffer of an Arrow string column, so a
whole batch of documents costs a handful of numpy passes and no Python loop
over characters, words or rows. Callers feed batches through ``pieces`` first,
which bounds the temporary memory by the bytes of a piece and not by the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer document is a piece of its own.
PIECE_BYTES = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: 1 for bytes that belong to words: ASCII letters and digits, and all of a multi-byte character.
WORD_BYTE = np.zeros(256, np.uint8)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


#: Matches in a lower-case string what ``words`` finds in its bytes.
WORD = re.compile("[a-zA-Z0-9\u00c0-\u1fff\u2080-\u2fff\u3040-\U0010ffff]+")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(column: pa.Array) -> pa.Array:
    """Unicode lower case of a string array."""
    return pc.utf8_lower(column)


def word_mask(flat: np.ndarray) -> np.ndarray:
    """1 where a byte is part of a word; blanks and punctuation outside ASCII aren't."""
    mask = WORD_BYTE[flat]
    if len(flat) < 2:
        return mask
    lead = flat[:-1]
    for first, low, high, width in ((0xC2, 0x80, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3)):
        at = np.flatnonzero(lead == first)
        at = at[(flat[at + 1] >= low) & (flat[at + 1] <= high)] if len(at) else at
        for k in range(width if len(at) else 0):
            mask[np.minimum(at + k, len(flat) - 1)] = 0
    return mask


def spans_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of ones, which never cross from one row into the next."""
    if not len(mask):
        none = np.zeros(0, np.int64)
        return none, none, none
    begins = mask.copy()
    begins[1:] &= mask[:-1] ^ 1
    inner = offsets[1:-1]
    inner = inner[inner < len(mask)]
    begins[inner] = mask[inner]
    starts = np.flatnonzero(begins)
    stops = np.empty(len(mask), np.uint8)
    stops[-1] = 1
    stops[:-1] = mask[1:] ^ 1
    stops[inner[inner > 0] - 1] = 1
    ends = np.flatnonzero(stops & mask) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans_of(word_mask(flat), offsets)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE_BYTES + 1), base, _U)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=_U)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix(np.arange(256, dtype=_U), 77)


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of flat[start:end], by differences of one prefix sum over the buffer."""
    if not len(starts):
        return np.zeros(0, _U)
    n = len(flat)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE_VALUE[flat] * _power(_P, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_PINV, n + 1)[starts], 5)


def hash_text(text: str) -> int:
    """The hash that ``span_hashes`` gives this whole string."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) if len(raw) else 0


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a string array, in lower case."""
    flat, offsets = text_buffer(lowered(column))
    starts, ends, rows = words(flat, offsets)
    return span_hashes(flat, starts, ends), rows


def distinct_per_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (hash, row), ordered by row; 20 bits hold the row of a piece, 44 the hash."""
    if not len(hashes):
        return hashes, rows
    low, out_h, out_r = int(rows.min()), [], []
    for base in range(low, int(rows.max()) + 1, 1 << 20):
        keep = slice(*np.searchsorted(rows, [base, base + (1 << 20)]))
        key = ((rows[keep] - base).astype(_U) << _U(44)) | (hashes[keep] >> _U(20))
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        out_h.append(mix(key & _U((1 << 44) - 1), 9))
        out_r.append((key >> _U(44)).astype(np.int64) + base)
    return np.concatenate(out_h), np.concatenate(out_r)
