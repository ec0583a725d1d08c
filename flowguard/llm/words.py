"""Words of whole texts and hashes of word sequences, by numpy over the UTF-8 bytes of a slice of rows.

Tasks see their Arrow batches in slices of about ``SLICE_BYTES`` of text (one row at least), so the
memory of a task follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()
#: Bytes of a word: all but white space (space and 0x09-0x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of a word after lower-casing: digits, a-z and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 2), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
    return have[:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span, whatever stands around it; the length counts."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=total[1:])
    inner = (total[ends] - total[starts]) * _power(_INVERSE, len(values) + 1)[starts]
    return mix(inner + (ends - starts).astype(np.uint64))


class Words:
    """The words of a slice of rows.

    ``start`` and ``end`` are byte positions in ``data``, ``first[r]:first[r + 1]`` the words of
    row r, ``left`` how many words of its row stand at and after each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        own = kind[self.data]
        begins, stops = own.copy(), own.copy()
        begins[1:] &= ~own[:-1]
        stops[:-1] &= ~own[1:]
        cut = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends with its row
        begins[cut] = own[cut]
        stops[cut - 1] = own[cut - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.left = np.repeat(self.first[1:], self.count) - np.arange(len(self.start))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hash(_BYTE[self.data], self.start, self.end)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one space."""
        raw = self.data
        return b" ".join([raw[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b])])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """For each word the hash of the n words from it on; meaningful where ``left >= n``."""
    starts = np.arange(len(h))
    return span_hash(h, starts, np.minimum(starts + n, len(h)))


def running(x: np.ndarray, n: int, best=np.minimum) -> np.ndarray:
    """best of x[i:i + n], cut at the end."""
    out, have = x.copy(), 1
    while have < n:
        step = min(have, n - have)
        out[: len(out) - step] = best(out[: len(out) - step], out[step:]) if step < len(out) else out[: len(out) - step]
        have += step
    return out


def text_column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, where, raw = array.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts come to ``most`` bytes; no empty ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_column(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + (most or SLICE_BYTES), side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
