"""Texts as one block of UTF-8 bytes: words, hashes and shingles without a Python object per word.

Arrow hands a batch of texts over as one byte buffer and offsets. Everything here works on that
buffer with numpy. Batches are cut into blocks of about BLOCK_BYTES, so memory stays bounded
however many rows a batch has; a text is never cut, so one text longer than a block is a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 400_000

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: A-Z to a-z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word: all but the ASCII white space 0x20 and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of a word: ASCII letters, digits, and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        steps = np.full(size, base, dtype=U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U)
        if size > 4_000_000:  # a rare giant text: not kept
            del _powers[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, the start of each text and its length; a null text is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    length = np.diff(at)
    if column.null_count:
        length = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, length)
    return np.frombuffer(data, np.uint8), at[:-1], length


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row behind the last, the bytes of these rows, and row offsets in these bytes."""
    data, start, length = raw(column)
    total = np.concatenate([[0], np.cumsum(length)])
    i, n = 0, len(start)
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + size, "right")) - 1)
        lo, hi = int(start[i]), int(start[j - 1] + length[j - 1])
        if hi - lo == total[j] - total[i]:
            part = data[lo:hi]
        else:  # null rows that still have bytes
            part = np.concatenate([data[s : s + k] for s, k in zip(start[i:j], length[i:j], strict=True)])
        yield i, j, part, total[i : j + 1] - total[i]
        i = j


def words(part: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words up to each row (one more than rows)."""
    n = len(part)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[part]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[cut - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets, "left")


def prefix_hash(part: np.ndarray) -> np.ndarray:
    """Sums of byte * base**position, from which span_hash takes any span."""
    out = np.zeros(len(part) + 1, dtype=U)
    np.cumsum((part.astype(U) + U(1)) * _power(_BASE, len(part)), out=out[1:], dtype=U)
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, wherever it stands."""
    inverse = _power(_INVERSE, len(sums))
    h = (sums[end] - sums[start]) * inverse[start]
    return mix(h ^ ((end - start).astype(U) * U(0xD6E8FEB86659FD93)))


def shingles(w: np.ndarray, per_row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive words and their rows; a row of fewer words, but not none, is one shingle."""
    count = np.diff(per_row)
    factor = [int(x) | 1 for x in mix(np.arange(1, n + 1, dtype=U))]
    h = np.zeros(0, U)
    row = np.zeros(0, np.int64)
    total = len(w)
    if total >= n:
        acc = np.zeros(total - n + 1, dtype=U)
        for k in range(n):
            acc += w[k : total - n + 1 + k] * U(factor[k])
        rows = np.repeat(np.arange(len(count)), count)
        first = rows[: total - n + 1]
        whole = first == rows[n - 1 :]
        h, row = mix(acc[whole] ^ U(n)), first[whole]
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        short = np.zeros(len(few), dtype=U)
        for k in range(n - 1):
            has = count[few] > k
            short[has] += w[per_row[few[has]] + k] * U(factor[k])
        h = np.concatenate([h, mix(short ^ (count[few].astype(U) << U(32)))])
        row = np.concatenate([row, few])
    return h, row


def distinct(h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, ascending, rows one behind another; and how many up to each row."""
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    h, row = h[order], row[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(n_rows + 1), "left")


def list_column(values: np.ndarray, per_row: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), pa.array(values, type=kind))
