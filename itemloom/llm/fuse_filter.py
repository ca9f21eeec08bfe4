"""Static binary-fuse filters: approximate sets of 64-bit digests, about 9 bits a key.

Three positions in neighbouring segments for each key; the array is filled in
the reverse of a peeling order, so that the xor of a key's three cells is its
8-bit fingerprint.  No false negatives; false positives about 1 in 256.
"""

from __future__ import annotations

import math

import numpy as np

from .words import mix


class BinaryFuseFilter:
    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        self.n = n
        if not n:
            return
        exponent = max(2, min(18, int(math.floor(math.log(n) / math.log(3.33) + 2.25)))) if n > 1 else 2
        self.segment = np.uint64(1 << exponent)
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        count = max(1, -(-int(math.ceil(n * factor)) // int(self.segment)) - 2)
        for seed in range(1, 200):
            # a few keys or an unlucky seed: more segments
            self.segments = np.uint64(count + (seed - 1) // 4)
            self.size = (int(self.segments) + 2) * int(self.segment)
            self.seed = np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            order = self._peel(keys)
            if order is not None:
                self._fill(keys, order)
                return
        raise RuntimeError("no peeling order found")

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + self.seed)
        first = ((h >> np.uint64(32)) * self.segments) >> np.uint64(32)
        low = self.segment - np.uint64(1)
        base = first * self.segment
        p0 = base + (h & low)
        p1 = base + self.segment + ((h >> np.uint64(18)) & low)
        g = mix(h)
        p2 = base + self.segment * np.uint64(2) + (g & low)
        return np.stack([p0, p1, p2]).astype(np.int64), (g >> np.uint64(56)).astype(np.uint8)

    def _peel(self, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the cell that is each one's own); later rounds are filled first."""
        places, _ = self._places(keys)
        n = len(keys)
        who = np.tile(np.arange(n), 3)
        flat = places.ravel()
        count = np.bincount(flat, minlength=self.size)
        xor = np.zeros(self.size, dtype=np.int64)
        np.bitwise_xor.at(xor, flat, who)
        left, rounds = n, []
        single = np.flatnonzero(count == 1)
        while len(single):
            key, at = np.unique(xor[single], return_index=True)
            cell = single[at]
            rounds.append((key, cell))
            left -= len(key)
            gone = places[:, key].ravel()
            np.subtract.at(count, gone, 1)
            np.bitwise_xor.at(xor, gone, np.tile(key, 3))
            near = np.unique(gone)
            single = near[count[near] == 1]
        return rounds if left == 0 else None

    def _fill(self, keys: np.ndarray, rounds: list[tuple[np.ndarray, np.ndarray]]) -> None:
        places, mark = self._places(keys)
        self.cells = np.zeros(self.size, dtype=np.uint8)
        for key, cell in reversed(rounds):
            p = places[:, key]
            # own cells of a round are in no other key of the same or a later-filled round
            value = self.cells[p[0]] ^ self.cells[p[1]] ^ self.cells[p[2]] ^ self.cells[cell]
            self.cells[cell] = value ^ mark[key]

    def to_bytes(self) -> bytes:
        """The filter as it is stored: four numbers, then the cells."""
        if not self.n:
            return np.zeros(4, np.uint64).tobytes()
        return np.array([self.n, self.segment, self.segments, self.seed], np.uint64).tobytes() + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuseFilter:
        out = cls.__new__(cls)
        head = np.frombuffer(data, np.uint64, 4)
        out.n, (out.segment, out.segments, out.seed) = int(head[0]), head[1:]
        out.cells = np.frombuffer(data, np.uint8, offset=32)
        return out

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], dtype=np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(keys), dtype=bool)
        p, mark = self._places(keys.astype(np.uint64))
        return (self.cells[p[0]] ^ self.cells[p[1]] ^ self.cells[p[2]]) == mark
