"""White-space chunks of many texts at once, with 64-bit hashes, and a hash table over such hashes (NumPy only)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text worked on together; a longer text makes a group of its own.
GROUP_BYTES = 1 << 19

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on every other."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Chunks:
    """``lo``..``hi``: the texts; ``first[i]``..``first[i + 1]``: the chunks of text ``lo + i``,
    which begins at byte ``offsets[i]`` of ``data``.  ``prefixes[k]``: hashes of the chunks' first bytes, as many as the k-th
    length asked for; 0 where a chunk is no longer than that."""

    lo: int
    hi: int
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    prefixes: list[np.ndarray]

    def chunk(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


#: For ``marks_apart``: ASCII marks become spaces.
_MARKS = bytes(32 if c < 128 and not chr(c).isalnum() and c > 32 else c for c in range(256))


def chunk_groups(texts: list[str | None], lower: bool = True, marks_apart: bool = False, prefixes: tuple[int, ...] = ()) -> Iterator[Chunks]:
    """Chunks ``[^\\x20\\x09-\\x0D]+`` of each text (null: none), with A-Z lowered where ``lower``.

    ``marks_apart``: ASCII marks count as white space.
    """
    lo, size, parts = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        raw = raw.translate(_MARKS) if marks_apart else raw
        if parts and size + len(raw) > GROUP_BYTES:
            yield _chunks(lo, parts, lower, prefixes)
            lo, size, parts = i, 0, []
        parts.append(raw)
        size += len(raw) + 1
    if parts:
        yield _chunks(lo, parts, lower, prefixes)


def _chunks(lo: int, parts: list[bytes], lower: bool, prefixes: tuple[int, ...]) -> Chunks:
    data = b"\n".join(parts) + b"\n"
    data = data.lower() if lower else data
    b = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[b]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(len(b) + 1)
    total = np.empty(len(b) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[b] * up[: len(b)], out=total[1:])

    def hashed(stops: np.ndarray, salt: int = 0) -> np.ndarray:
        h = mix((total[stops] - total[starts]) * down[starts] + (stops - starts + salt).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        h[h == 0] = 1
        return h

    first_bytes = [np.where(starts + n < ends, hashed(np.minimum(starts + n, ends), 1 << 32), _U(0)) for n in prefixes]
    offsets = np.concatenate(([0], np.cumsum(np.array([len(p) + 1 for p in parts], dtype=np.int64))))
    return Chunks(lo, lo + len(parts), data, starts, ends, np.searchsorted(starts, offsets), offsets, hashed(ends), first_bytes)


class HashIndex:
    """Open addressing from non-zero 64-bit hashes to 0, 1, 2 ... in order of insertion."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.zeros(1 << bits, dtype=np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes, -1 for those that are not held."""
        slots, mask = self._slots(h), (1 << self.bits) - 1
        there = self.keys[slots]
        out = np.where(there == h, self.values[slots], np.int32(-1))
        left = np.flatnonzero((there != h) & (there != 0))
        while len(left):
            slots_left = slots[left] = (slots[left] + 1) & mask
            there, want = self.keys[slots_left], h[left]
            hit = there == want
            out[left[hit]] = self.values[slots_left[hit]]
            left = left[~hit & (there != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Adds distinct hashes that are not held yet; their numbers go on from ``size``."""
        while 10 * (self.size + len(h)) > 7 << self.bits:
            held = self.keys != 0
            old_keys, old_values = self.keys[held], self.values[held]
            self.__init__(self.bits + 1)
            self._place(old_keys, old_values)
            self.size = len(old_keys)
        self._place(h, (self.size + np.arange(len(h))).astype(np.int32))
        self.size += len(h)

    def _place(self, h: np.ndarray, values: np.ndarray) -> None:
        slots, mask = self._slots(h), (1 << self.bits) - 1
        left = np.arange(len(h))
        while len(left):
            at = slots[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = h[left[free]]
            placed = free & (self.keys[at] == h[left])
            self.values[at[placed]] = values[left[placed]]
            left = left[~placed]
            slots[left] = (slots[left] + 1) & mask


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``starts[i] .. starts[i] + lengths[i]`` of all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
