"""Static binary fuse filters over 64-bit digests (Graf and Lemire, 2022), in numpy.

A key has one slot in each of three consecutive segments of one array of
bytes; the exclusive or of the three slots is the key's fingerprint byte. Keys
of the set always match, others once in 256. Slots are filled by peeling: a
slot that one key alone still uses is that key's to set. Peeling goes in
rounds, each a few array operations over the slots that the round before
touched, and slots are set in the opposite order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

U = np.uint64
#: Seeds tried; each fails with a small chance, apart from the others.
TRIES = 64


def _mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit multiply-and-shift hash."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


@dataclass(frozen=True)
class Fuse:
    seed: int
    bits: int  # a segment has 2^bits slots
    segments: int  # where a key's first slot may lie
    slots: np.ndarray  # bytes

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each digest (signed or unsigned 64-bit) may be in the set."""
        if not self.segments:
            return np.zeros(len(keys), dtype=bool)
        a, b, c, mark = _places(keys.view(np.uint64), self.seed, self.bits, self.segments)
        return (self.slots[a] ^ self.slots[b] ^ self.slots[c]) == mark


def _places(keys: np.ndarray, seed: int, bits: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = _mix(keys + U(seed))
    g = _mix(h ^ U(0x9E3779B97F4A7C15))
    start = ((h >> U(32)) * U(segments)) >> U(32)
    mask = U((1 << bits) - 1)
    at = [(((start + U(i)) << U(bits)) + ((g >> U(21 * i)) & mask)).astype(np.int64) for i in range(3)]
    return at[0], at[1], at[2], (h & U(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> Fuse:
    """The filter of distinct digests; no keys give one that holds nothing."""
    n = len(keys)
    if not n:
        return Fuse(0, 0, 0, np.zeros(0, dtype=np.uint8))
    keys = keys.view(np.uint64)
    bits = min(18, max(2, math.floor(math.log(n) / math.log(3.33) + 2.25)))
    room = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * room / (1 << bits)) - 2)
    for seed in range(1, TRIES + 1):
        if (slots := _filled(keys, seed, bits, segments)) is not None:
            return Fuse(seed, bits, segments, slots)
    raise ValueError("no seed peels these digests; are they distinct?")


def _filled(keys: np.ndarray, seed: int, bits: int, segments: int) -> np.ndarray | None:
    n, size = len(keys), (segments + 2) << bits
    a, b, c, mark = _places(keys, seed, bits, segments)
    slots_of = np.stack([a, b, c], axis=1)
    degree = np.bincount(slots_of.ravel(), minlength=size)
    sole = np.zeros(size, dtype=np.int64)  # exclusive or of the keys that still use a slot
    each = np.repeat(np.arange(n), 3)
    np.bitwise_xor.at(sole, slots_of.ravel(), each)
    rounds, left, near = [], n, np.flatnonzero(degree == 1)
    while len(near):
        key, first = np.unique(sole[near], return_index=True)
        own = near[first]
        rounds.append((key, own))
        left -= len(key)
        touched = slots_of[key].ravel()
        np.subtract.at(degree, touched, 1)
        np.bitwise_xor.at(sole, touched, np.repeat(key, 3))
        touched = np.unique(touched)
        near = touched[degree[touched] == 1]
    if left:
        return None
    out = np.zeros(size, dtype=np.uint8)
    for key, own in reversed(rounds):
        three = slots_of[key]
        out[own] = 0
        out[own] = mark[key] ^ out[three[:, 0]] ^ out[three[:, 1]] ^ out[three[:, 2]]
    return out
