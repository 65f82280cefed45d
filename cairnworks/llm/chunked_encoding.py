"""Encode texts with a tokenizer whose pieces never cross certain borders: cut there, encode each distinct chunk once.

The memory of chunks is a numpy hash table, so a task looks up a hundred thousand chunks in a few array operations.
Chunks of up to 16 bytes are known by all their bytes, longer ones by a dictionary: nothing rests on a hash alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_U = np.uint64
_WORD = 8
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(_WORD + 1)], _U)  # the bytes of a word that belong to a chunk
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
#: At most so many chunks, so many ids, and so many bytes of long chunks are remembered; then the memory starts anew.
MOST_CHUNKS, MOST_IDS, MOST_LONG_BYTES = 1 << 21, 1 << 23, 1 << 24
#: Chunks are looked up in pieces of about so many bytes; longer chunks are encoded each time and not remembered.
PIECE, BIG = 1 << 20, 1 << 16


class ChunkEncoder:
    """encode(data, offsets) by chunks.

    starts(data): where chunks begin within texts (bool for each byte). encode_chunks(chunks): (ids in a row, number
    of ids of each) of byte strings, asked once for each distinct chunk. whole(data, offsets): the texts, as bool,
    that must not be cut. share: of the memory's bounds.
    """

    def __init__(self, starts: Callable, encode_chunks: Callable, whole: Callable | None = None, share: float = 1.0):
        self.starts, self.encode_chunks, self.whole = starts, encode_chunks, whole
        # What a piece of text can bring always fits into an empty memory.
        self.most_chunks, self.most_ids = max(int(MOST_CHUNKS * share), PIECE // 2), max(int(MOST_IDS * share), PIECE + BIG)
        self.bits = self.most_chunks.bit_length()
        self._forget()

    def _forget(self) -> None:
        self.table = np.zeros(1 << self.bits, np.int32)
        self.rows = np.zeros((self.most_chunks + 1, 4), _U)  # word, word, number of bytes, place and number of ids
        self.rows[0, 2] = _U(255)  # row 0 is no chunk
        self.pool = np.zeros(self.most_ids, np.int32)
        self.n_rows, self.n_ids, self.long_bytes = 1, 0, 0
        self.long: dict[bytes, int] = {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, number of ids of each text) of UTF-8 texts."""
        n_texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n_texts, np.int64)
        first = self.starts(data)
        if self.whole is not None:
            for i in np.flatnonzero(self.whole(data, offsets)):
                first[offsets[i] : offsets[i + 1]] = False
        first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        start = np.flatnonzero(first)
        size = np.diff(start, append=len(data))
        big = np.flatnonzero(size > BIG)
        borders = np.unique(np.concatenate([np.searchsorted(start, np.arange(0, len(data), PIECE)), big, big + 1, [0, len(start)]]))
        parts, counts = [], np.zeros(len(start), np.int64)
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            if size[a] > BIG:
                found, _ = self.encode_chunks([data[start[a] : start[a] + size[a]].tobytes()])
                parts.append(np.asarray(found, np.int32))
                counts[a] = len(found)
                continue
            end = start[b - 1] + size[b - 1]
            meta = self._look_up(data[start[a] : end], start[a:b] - start[a], size[a:b])
            count, place = (meta & _U(0xFFFFFF)).astype(np.int64), (meta >> _U(24)).astype(np.int64)
            before = np.cumsum(count) - count
            parts.append(self.pool[np.repeat(place - before, count) + np.arange(before[-1] + count[-1])])
            counts[a:b] = count
        edges = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(start, offsets)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts), np.diff(edges)

    def _look_up(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        padded = np.concatenate([data, np.zeros(2 * _WORD, np.uint8)])
        words = np.ndarray(len(data) + _WORD, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        w0 = words[start] & _KEEP[np.minimum(size, _WORD)]
        w1 = words[start + np.minimum(size, _WORD)] & _KEEP[np.clip(size - _WORD, 0, _WORD)]
        n = size.astype(_U)
        meta = np.zeros(len(start), _U)
        hashed = w0 * _A
        hashed ^= hashed >> _U(29)
        hashed = (hashed + w1 * _B + n) * _C
        place = (hashed >> _U(64 - self.bits)).astype(np.int64)
        small = size <= 2 * _WORD
        missing = self._probe(w0, w1, n, place, meta, small)
        long = np.flatnonzero(~small)
        if not len(missing) and not len(long):
            return meta
        raw = data.tobytes()
        new: dict[bytes, int] = {}  # the place of one chunk of each kind
        for i in missing.tolist():
            new.setdefault(raw[start[i] : start[i] + size[i]], i)
        chunks = {i: raw[start[i] : start[i] + size[i]] for i in long.tolist()}
        for i, chunk in chunks.items():
            if chunk not in self.long:
                new.setdefault(chunk, i)
        if new:
            ids, counts = self.encode_chunks(list(new))
            at = np.fromiter(new.values(), np.int64, len(new))
            if self.n_rows + len(new) > self.most_chunks or self.n_ids + len(ids) > self.most_ids or self.long_bytes > MOST_LONG_BYTES:
                self._forget()
                return self._look_up(data, start, size)
            self.pool[self.n_ids : self.n_ids + len(ids)] = ids
            found = (np.cumsum(counts) - counts + self.n_ids).astype(_U) << _U(24) | counts.astype(_U)
            self.n_ids += len(ids)
            for k in np.flatnonzero(~small[at]).tolist():
                chunk = chunks[int(at[k])]
                self.long[chunk] = int(found[k])
                self.long_bytes += len(chunk)
            kept = np.flatnonzero(small[at])
            self._insert(w0[at[kept]], w1[at[kept]], n[at[kept]], place[at[kept]], found[kept])
            left = self._probe(w0, w1, n, place, meta, small, missing)
            if len(left):
                raise AssertionError("a chunk was not remembered")
        for i, chunk in chunks.items():
            meta[i] = self.long[chunk]
        return meta

    def _probe(self, w0, w1, n, place, meta, small, of: np.ndarray | None = None) -> np.ndarray:
        """Set the meta of known small chunks; the numbers of those that are not known."""
        missing, unknown = [], None
        left, step = of, 0
        while left is None or len(left):
            pick = (lambda x: x) if left is None else (lambda x, left=left: x[left])
            found = self.table[(pick(place) + step) & ((1 << self.bits) - 1)]
            rows = self.rows[found]
            same = (rows[:, 0] == pick(w0)) & (rows[:, 1] == pick(w1)) & (rows[:, 2] == pick(n))
            if left is None:
                np.copyto(meta, rows[:, 3], where=same)
                unknown = (found == 0) & small
                missing.append(np.flatnonzero(unknown))
                left = np.flatnonzero(~(same | unknown) & small)
            else:
                meta[left[same]] = rows[same, 3]
                missing.append(left[found == 0])
                left = left[~same & (found > 0)]
            step += 1
        return np.concatenate(missing) if missing else np.zeros(0, np.int64)

    def _insert(self, w0, w1, n, place, found) -> None:
        own = np.arange(self.n_rows, self.n_rows + len(w0))
        self.rows[own, 0], self.rows[own, 1], self.rows[own, 2], self.rows[own, 3] = w0, w1, n, found
        self.n_rows += len(own)
        left, step = np.arange(len(own)), 0
        while len(left):
            at = (place[left] + step) & ((1 << self.bits) - 1)
            free = self.table[at] == 0
            self.table[at[free]] = own[left[free]]
            left = left[self.table[at] != own[left]]
            step += 1
