"""Counting quotient filters over whole keys: compact, sorted, lossless counters that merge.

A key of ``bits`` bits is permuted by an invertible mix, so that keys spread
evenly whatever they are, and split: the leading bits are its quotient, all the
others its remainder. A filter keeps its slots in order of (quotient,
remainder): one bit a quotient says that it has slots, one bit a slot that it is
its quotient's last, and each slot holds the full remainder and a counter. No
bit of a key is lost, so counts are exact, and two filters merge in one pass
over their slots.
"""

from __future__ import annotations

import struct

import numpy as np

FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so invertible modulo a power of two
WIDE = 255  # a counter byte that stands for a wide counter


class Permutation:
    """An invertible mix of numbers below 2 ** bits."""

    def __init__(self, bits: int):
        self.bits, self.shift = bits, np.uint64(max(1, (bits + 1) // 2))
        self.mask = np.uint64(2**bits - 1)
        self.forth = [np.uint64(f % 2**bits) for f in FACTORS]
        self.back = [np.uint64(pow(f, -1, 2**bits)) for f in FACTORS]

    def mix(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64)
        for factor in self.forth:
            x = (x * factor) & self.mask
            x ^= x >> self.shift
        return x

    def unmix(self, mixed: np.ndarray) -> np.ndarray:
        x = mixed.copy()
        for factor in self.back[::-1]:
            x ^= x >> self.shift  # at least half the bits wide, so it undoes itself
            x = (x * factor) & self.mask
        return x


def tally(sorted_keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of a sorted array with the sums of their counts."""
    if not len(sorted_keys):
        return sorted_keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    sums = np.diff(np.append(at, len(sorted_keys))) if counts is None else np.add.reduceat(counts, at)
    return sorted_keys[at], sums.astype(np.int64)


def merge(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One filter's slots from those of several, all in order."""
    if len(filters) == 1:
        return filters[0]
    keys = np.concatenate([k for k, _ in filters])
    order = np.argsort(keys, kind="stable")  # a merge of the sorted runs
    return tally(keys[order], np.concatenate([n for _, n in filters])[order])


def pack(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A filter's slots, in order, as one value: quotients as bits, remainders in whole bytes, counters."""
    n = len(keys)
    room = max(0, bits - max(0, n - 1).bit_length())
    rest = min(-(-room // 8), bits // 8)  # bytes of a remainder
    quotient_bits = bits - 8 * rest
    quotient = (keys >> np.uint64(8 * rest)).astype(np.int64) if rest < 8 else np.zeros(n, np.int64)
    used = np.zeros(2**quotient_bits, bool)
    used[quotient] = True
    last = np.append(quotient[1:] != quotient[:-1], True)[:n]
    remainder = np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(n, 8)[:, :rest]
    wide = counts[counts >= WIDE]
    return b"".join([struct.pack("<IBBI", n, quotient_bits, rest, len(wide)), np.packbits(used).tobytes(),
                     np.packbits(last).tobytes(), remainder.tobytes(),
                     np.minimum(counts, WIDE).astype(np.uint8).tobytes(), wide.astype("<i8").tobytes()])


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a packed filter, in order."""
    n, quotient_bits, rest, n_wide = struct.unpack_from("<IBBI", data)
    at = struct.calcsize("<IBBI")

    def part(size):
        nonlocal at
        at += size
        return np.frombuffer(data, np.uint8, size, at - size)

    used = np.flatnonzero(np.unpackbits(part(-(-2**quotient_bits // 8)), count=2**quotient_bits))
    last = np.unpackbits(part(-(-n // 8)), count=n)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :rest] = part(n * rest).reshape(n, rest)
    counts = part(n).astype(np.int64)
    counts[counts == WIDE] = np.frombuffer(data, "<i8", n_wide, at)
    whole = keys.reshape(-1).view("<u8").astype(np.uint64)
    if n and rest < 8:
        whole |= used[np.cumsum(last) - last].astype(np.uint64) << np.uint64(8 * rest)
    return whole, counts


class Counter:
    """A growing filter in one task: keys are gathered, sorted and merged in; ``take`` hands the slots over."""

    def __init__(self, bits: int, buffer: int):
        self.permutation, self.buffer = Permutation(bits), buffer
        self.waiting: list[np.ndarray] = []
        self.size = 0
        self.slots = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def add(self, keys: np.ndarray) -> bool:
        """True when as many slots as the buffer are in use."""
        self.waiting.append(self.permutation.mix(keys))
        self.size += len(keys)
        if self.size >= self.buffer:
            self._settle()
        return len(self.slots[0]) >= self.buffer

    def _settle(self) -> None:
        if self.waiting:
            fresh = tally(np.sort(np.concatenate(self.waiting)))
            self.slots = merge([self.slots, fresh]) if len(self.slots[0]) else fresh
        self.waiting, self.size = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        slots, self.slots = self.slots, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return slots
