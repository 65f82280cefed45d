"""Vectorised byte-level text kernels for Arrow batches: word spans, word hashes, shingle hashes.

All functions take the UTF-8 bytes of many texts at once (`data`, `offsets`), as Arrow stores them, so
that a task does a handful of numpy passes over a few megabytes instead of a Python step for each word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes, which bounds a task's memory.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `size` bytes of text; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > size:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def spans(data: np.ndarray, offsets: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words are runs of non-space bytes, or of letters only."""
    inside = _LETTER[data] if letters else ~_SPACE[data]
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    first, last = np.ones(len(inside), bool), np.ones(len(inside), bool)
    first[1:] = ~inside[:-1]
    last[:-1] = ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    start = np.flatnonzero(inside & first)
    return start, np.flatnonzero(inside & last) + 1, np.searchsorted(offsets, start, "right") - 1


class Rolling:
    """Hashes of any byte ranges of `data` (A-Z lower-cased unless `exact`) in constant time each, from one prefix sum.

    Modulo 2^64, so texts can be made to collide: for features only, never for what decides that texts are equal (see Digests)."""

    _power = _inverse = None
    _base, _bytes = _ODD, _BYTE

    def __init__(self, data: np.ndarray, exact: bool = False):
        n = len(data) + 1
        self.ready(n)
        self._sums = np.zeros(n, np.uint64)
        np.cumsum(self._bytes[data if exact else _LOWER[data]] * self._power[: n - 1], out=self._sums[1:])

    @classmethod
    def ready(cls, n: int) -> None:
        """Powers of the base for at least n places."""
        if cls._power is None or len(cls._power) < n:
            size = max(n, SLICE_BYTES + 1)
            cls._power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, cls._base)]))
            cls._inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, np.uint64(pow(int(cls._base), -1, 1 << 64)))]))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


#: A prime; 2^61 leaves 1.
PRIME = (1 << 61) - 1
_P, _31, _30, _61 = np.uint64(PRIME), np.uint64(31), np.uint64(30), np.uint64(61)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _mod_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b modulo PRIME for values below it, by halves of 31 bits."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = ah * bl + al * bh
    return _reduce(((ah * bh) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW30) << _31) + _reduce(al * bl))


def _join(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high 2^31 + low modulo PRIME for any 64-bit values."""
    high, low = _reduce(high), _reduce(low)
    return _reduce(((high & _LOW30) << _31) + (high >> _30) + low)


class Digests:
    """Digests of ranges of bytes, or of rows of other digests, as polynomials modulo a prime at a secret point.

    The point follows from `key`, which a run draws for itself (see common.digest_key): two different ranges of n items agree at n of
    2^61 points at most, so no text can be made to collide on purpose. Any range takes constant time, from two prefix sums.
    """

    def __init__(self, key: int):
        draw = np.random.default_rng(key)
        self._point = int(draw.integers(1 << 32, PRIME))
        self._powers = np.ones(1, np.uint64)
        self._inverses = np.ones(1, np.uint64)

    def _ready(self, n: int) -> None:
        if len(self._powers) < n:
            n = 1 << (n - 1).bit_length()
            for name, point in (("_powers", self._point), ("_inverses", pow(self._point, -1, PRIME))):
                table = np.ones(n, np.uint64)
                done = 1
                while done < n:
                    more = min(done, n - done)
                    table[done : done + more] = _mod_product(table[:more], np.uint64(pow(point, done, PRIME)))
                    done += more
                setattr(self, name, table)

    def _ranges(self, high: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = _join(high[end] - high[start], low[end] - low[start])
        return mix(_mod_product(total, self._inverses[start]) ^ ((end - start).astype(np.uint64) << _61))

    def of_bytes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, exact: bool = False) -> np.ndarray:
        """Of byte ranges (A-Z lower-cased unless `exact`)."""
        n = len(data)
        self._ready(n + 1)
        values = (data if exact else _LOWER[data]).astype(np.uint16) + np.uint16(1)
        high, low = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        # In place: these are the largest arrays of a task.
        np.right_shift(self._powers[:n], _31, out=high[1:])
        np.bitwise_and(self._powers[:n], _LOW31, out=low[1:])
        for half in (high[1:], low[1:]):
            half *= values
            np.cumsum(half, out=half)
        return self._ranges(high, low, start, end)

    def of_rows(self, digests: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of rows of 64-bit digests."""
        n = len(digests)
        self._ready(n + 1)
        terms = _mod_product(_reduce(digests), self._powers[:n])
        high, low = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(terms >> _31, out=high[1:])
        np.cumsum(terms & _LOW31, out=low[1:])
        return self._ranges(high, low, first, first + size)


@functools.lru_cache(maxsize=4)
def digests_of(key: int) -> Digests:
    """The tables of a key, kept while a worker needs them."""
    return Digests(key)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5, key: int = 0) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of `width` words in a row; a shorter text is one shingle; no words, none. `key` is that of Digests."""
    start, end, row = spans(data, offsets)
    n_texts = len(offsets) - 1
    if not len(start):
        return [np.zeros(0, np.uint64)] * n_texts
    word = digests_of(key).of_bytes(data, start, end)
    count = np.bincount(row, minlength=n_texts)
    begin = np.concatenate([[0], np.cumsum(count)])
    out: list[np.ndarray] = []
    full = max(len(word) - width + 1, 0)
    chain = np.zeros(full, np.uint64)
    for k in range(width):
        chain += mix(word[k : k + full] + _PLACE[k]) * _PLACE[k + width]
    chain = mix(chain)
    for i in range(n_texts):
        a, n = begin[i], count[i]
        if n >= width:
            out.append(np.unique(chain[a : a + n - width + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for k in range(n):
                short = short * _ODD + word[a + k : a + k + 1] * _PLACE[k + 20]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
