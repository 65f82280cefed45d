"""An adaptive context-mixing range coder for token ids, over many independent blocks at once.

Three predictions are mixed for each id: the id that last followed the two ids before it (order 2), the one that
last followed the id before it (order 1), both learnt within the block, and the frequencies of the ids (order 0,
`Frequencies`, which the caller keeps beside the blocks). The mixing weights belong to the confidences of both
contexts and to whether they agree, and adapt to which prediction was right. The mixture drives a 64-bit range
coder. Every block starts from the same fresh model, so it decodes alone; numpy steps through the ids of up to
LANES blocks side by side.

Ids are given as ranks below RANKS, 0 being the most frequent.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
LANES = 2048
RANKS = 1 << 16
NOTHING = RANKS - 1  # what an empty context predicts
_H1, _H2 = 10, 11  # bits of the context tables
_TOTAL = 28  # bits of the whole of all shares
_U = np.uint64
_HEAD = np.array(32, _U)
_TOP, _LOW32 = _U(1 << 32), _U(0xFFFFFFFF)
_STEPS = 64  # ids of all blocks that are turned at a time
_MIXED = 32  # mixing contexts: three confidences of order 2, three of order 1, and whether they agree


def _int64(x: int) -> np.ndarray:
    """A constant as numpy takes it quickest."""
    return np.array(x, np.int64)


_RATE, _UNIT, _LAST_UNIT = _int64(4), np.array(_TOTAL, _U), np.array((1 << _TOTAL) - 1, _U)
_WHOLE, _RANK, _ABOVE = _int64(1 << _TOTAL), np.array(0xFFFF, np.int32), np.array(16, np.int32)
# Confidences stand above the rank of an entry, where the mixing context wants them.
_SEEN2, _SEEN1 = np.array(1 << 19, np.int32), np.array(1 << 17, np.int32)
# A weight pair is one number, order 2 above bit 32; both move 1/16 of the way to their aims.
_ONE, _FIELD, _FIELDS = _int64(32), _int64(0xFFFFFFFF), _int64((0xFFFFFFF << 32) | 0xFFFFFFF)
_START, _AIM2, _AIM1 = (20_000 << 44) | (6_000 << 12), _int64(2_500 << 44), _int64(1_000 << 12)
_MASK1, _MASK2, _FACTOR, _TURN, _DROP = _int64((1 << _H1) - 1), _int64((1 << _H2) - 1), _int64(40_503), _int64(5), _int64(7)


class Frequencies:
    """Order 0: each rank's share of 2^bits, at least 1."""

    def __init__(self, shares: np.ndarray):
        self.bits = int(shares.sum()).bit_length() - 1
        self.begin = np.concatenate([[0], np.cumsum(shares)]).astype(np.int64)

    @staticmethod
    def shares(counts: np.ndarray) -> np.ndarray:
        """Shares for descending counts, summing to a power of two that leaves rare ranks room."""
        if not len(counts):
            return np.ones(1, np.int64)
        whole = 1 << max(16, len(counts).bit_length() + 2)
        out = counts * (whole - len(counts)) // counts.sum() + 1
        out[0] += whole - out.sum()
        return out

    def ranks(self) -> np.ndarray:
        """The rank of every place of order 0."""
        return np.repeat(np.arange(len(self.begin) - 1, dtype=np.int32), np.diff(self.begin))


class Model:
    """The state of n blocks: context tables and mixing weights."""

    def __init__(self, n: int):
        self.t1, self.t2 = np.full(n << _H1, NOTHING, np.int32), np.full(n << _H2, NOTHING, np.int32)
        self.weights = np.full(n * _MIXED, _START, np.int64)
        self.base1, self.base2, self.base_mixed = (np.arange(n) * k for k in (1 << _H1, 1 << _H2, _MIXED))
        self.before, self.hashed = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def narrow(self, n: int) -> None:
        """Go on with the first n blocks."""
        self.base1, self.base2, self.base_mixed, self.before, self.hashed = (x[:n] for x in (self.base1, self.base2, self.base_mixed, self.before, self.hashed))

    def predict(self) -> None:
        """Set the predictions of the next ids and their shares of 2^28."""
        hashed = self.before * _FACTOR
        self.i1 = (self.before & _MASK1) + self.base1
        self.i2 = (((hashed ^ (self.hashed << _TURN)) >> _DROP) & _MASK2) + self.base2
        self.hashed = hashed
        e1, e2 = self.t1[self.i1], self.t2[self.i2]
        self.p1, self.p2 = e1 & _RANK, e2 & _RANK
        self.mixed = self.base_mixed + ((e2 >> _ABOVE) + (e1 >> _ABOVE)) + (self.p1 == self.p2)
        self.v = self.weights[self.mixed]
        self.share2, self.share1 = self.v >> _ONE, self.v & _FIELD
        self.base = self.share2 + self.share1
        self.room = _WHOLE - self.base

    def update(self, rank: np.ndarray, right2: np.ndarray, right1: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """right: int32 flags of predictions that came true; hit: int64 flags of those that the id was coded by."""
        narrow = rank.astype(np.int32)
        self.t1[self.i1] = narrow + _SEEN1 + right1 * _SEEN1
        self.t2[self.i2] = narrow + _SEEN2 + right2 * _SEEN2
        self.weights[self.mixed] = self.v - ((self.v >> _RATE) & _FIELDS) + hit2 * _AIM2 + hit1 * _AIM1
        self.before = rank


def _active(sizes: np.ndarray, width: int) -> list[int]:
    return np.searchsorted(-sizes, -np.arange(width), "left").tolist()


def encode(blocks: np.ndarray, sizes: np.ndarray, frequencies: Frequencies | None = None) -> list[bytes]:
    """Code the blocks (ranks; one row each, sizes descending); without frequencies all ranks are alike."""
    frequencies = frequencies or Frequencies(np.ones(RANKS, np.int64))
    n_blocks, width = blocks.shape
    model, begins, bits, lanes = Model(n_blocks), frequencies.begin, _int64(frequencies.bits), n_blocks
    ends = begins[1:]
    all_low, all_span = np.zeros(n_blocks, _U), np.full(n_blocks, _U(2**64 - 1))
    low, span = all_low, all_span
    out, at = np.zeros((n_blocks, width // 3 + 8), _U), np.zeros(n_blocks, np.int64)
    for t, n in enumerate(_active(sizes, width)):
        if n < lanes:
            all_low[:lanes], all_span[:lanes] = low, span
            model.narrow(n)
            low, span, lanes = low[:n], span[:n], n
            if not n:
                break
        if t % _STEPS == 0:
            columns = np.ascontiguousarray(blocks[:, t : t + _STEPS].T).astype(np.int64)
            if int(at.max()) + _STEPS + 4 > out.shape[1]:
                out = np.concatenate([out, np.zeros_like(out)], 1)
        rank = columns[t % _STEPS, :n]
        model.predict()
        right2, right1 = rank == model.p2, rank == model.p1
        hit2, hit1 = right2.astype(np.int64), (right1 > right2).astype(np.int64)
        missed = (right2 | right1) ^ True
        begin = (model.room * begins[rank] >> bits) + model.base
        size = (model.room * ends[rank] >> bits) + model.base - begin
        missed = missed.astype(np.int64)
        start = (begin * missed + model.share2 * hit1).view(_U)
        size = (size * missed + model.share2 * hit2 + model.share1 * hit1).view(_U)
        unit = span >> _UNIT
        moved = low + unit * start
        over = (moved < low).nonzero()[0]
        if len(over):
            out[over, at[over] - 1] += _U(1)
        narrowed = unit * size
        short = (narrowed < _TOP).nonzero()[0]
        if len(short):
            some, where = moved[short], at[short]
            out[short, where] = some >> _HEAD
            at[short] = where + 1
            moved[short] = some << _HEAD
            narrowed[short] <<= _HEAD
        low, span = moved, narrowed
        model.update(rank, right2, right1, hit2, hit1)
    all_low[:lanes] = low
    for k in (0, 1):
        out[np.arange(n_blocks), at + k] = all_low >> _HEAD if k == 0 else all_low & _LOW32
    for j in range(int(at.max(initial=0)) + 1, 0, -1):
        out[:, j - 1] += out[:, j] >> _HEAD
        out[:, j] &= _LOW32
    return [out[i, : at[i] + 2].astype("<u4").tobytes() for i in range(n_blocks)]


def decode(coded: list[bytes], sizes: np.ndarray, frequencies: Frequencies | None = None) -> np.ndarray:
    """The blocks that encode() coded with the same frequencies."""
    frequencies = frequencies or Frequencies(np.ones(RANKS, np.int64))
    n_blocks, width = len(coded), int(sizes.max(initial=0))
    words = np.zeros((n_blocks, max(map(len, coded), default=0) // 4 + 2), "<u4")
    for i, x in enumerate(coded):
        words[i, : len(x) // 4] = np.frombuffer(x, "<u4")
    model, begins, bits, lanes = Model(n_blocks), frequencies.begin, _int64(frequencies.bits), n_blocks
    ends, ranks = begins[1:], frequencies.ranks()
    code, at = words[:, 0].astype(_U) << _HEAD | words[:, 1], np.full(n_blocks, 2)
    span = np.full(n_blocks, _U(2**64 - 1))
    out, columns = np.zeros((n_blocks, width), np.uint16), np.zeros((_STEPS, n_blocks), np.uint16)
    one, zero = _int64(1), _int64(0)
    for t, n in enumerate(_active(sizes, width)):
        if n < lanes:
            model.narrow(n)
            code, span, lanes = code[:n], span[:n], n
        model.predict()
        unit = span >> _UNIT
        target = np.minimum(code // unit, _LAST_UNIT).view(np.int64)
        hit2, beyond = target < model.share2, target - model.base
        missed = beyond >= zero
        hit1 = missed == hit2
        # The largest place of order 0 whose range begins at or before the target: both numbers are exact in
        # floating point, and their quotient is further from the next whole number than its rounding.
        place = (((np.maximum(beyond, zero) + one << bits) - one) / model.room).astype(np.int64)
        rank = ranks[place]
        missed, hit2, hit1 = missed.astype(np.int64), hit2.astype(np.int64), hit1.astype(np.int64)
        rank = rank * missed + model.p2 * hit2 + model.p1 * hit1
        begin = (model.room * begins[rank] >> bits) + model.base
        size = (model.room * ends[rank] >> bits) + model.base - begin
        start = (begin * missed + model.share2 * hit1).view(_U)
        size = (size * missed + model.share2 * hit2 + model.share1 * hit1).view(_U)
        code, span = code - unit * start, unit * size
        short = (span < _TOP).nonzero()[0]
        if len(short):
            where = at[short]
            code[short] = code[short] << _HEAD | words[short, where]
            at[short] = where + 1
            span[short] <<= _HEAD
        columns[t % _STEPS, :n] = rank
        if t % _STEPS == _STEPS - 1 or t == width - 1:
            first = t - t % _STEPS
            out[:, first : t + 1] = columns[: t + 1 - first].T
        model.update(rank, rank == model.p2, rank == model.p1, hit2, hit1)
    return out
