"""Counting quotient filters without loss: compact counters of packed word numbers.

An item packs up to `WORDS` word numbers of `width` bits, which is as wide as the vocabulary needs (no
number is zero, so the length shows). It is cut into two halves, of a word each for pairs and of half the packed bits for
longer items, and a Feistel network permutes it invertibly. The first bits of the permuted item are its range, the next its
quotient, and the rest is kept in full as the remainder, so items come back exactly. A filter
holds the items of one range in ascending order: how many each quotient has, in unary (the runs of a
quotient filter), the remainders, and the counters (a byte each, larger ones aside).
"""

from __future__ import annotations

import numpy as np

#: Bits of a word number at most.
WIDTH = 25
WORDS = 5
MOST = (1 << WIDTH) - 1

_KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def permute(high: np.ndarray, low: np.ndarray, half: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Items of two halves of `half` bits; back: undoes it."""
    cut = np.uint64(64 - half)
    for i in (2, 1, 0) if back else (0, 1, 2):
        if i == 1:
            high = high ^ _mix(low, _KEYS[i]) >> cut
        else:
            low = low ^ _mix(high, _KEYS[i]) >> cut
    return high, low


def halves(width: int) -> int:
    """Bits of a half of an item of `WORDS` words."""
    return -(-WORDS * width // 2)


def pack(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, up to WORDS) numbers, zero behind the last one, as high and low halves."""
    half = halves(width)
    high, low = (np.zeros(len(words), np.uint64) for _ in range(2))
    for j in range(words.shape[1]):
        word, at = words[:, j].astype(np.uint64), width * j
        if at < half:
            low |= word << np.uint64(at)
        if at + width > half:
            high |= word >> np.uint64(half - at) if at < half else word << np.uint64(at - half)
    return high, low & np.uint64((1 << half) - 1)


def unpack(high: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """(rows, WORDS) numbers."""
    half, mask = halves(width), np.uint64((1 << width) - 1)
    out = []
    for at in range(0, WORDS * width, width):
        word = low >> np.uint64(at) if at < half else high >> np.uint64(at - half)
        if at < half < at + width:
            word = word | high << np.uint64(half - at)
        out.append((word & mask).astype(np.int64))
    return np.stack(out, axis=1)


class Filter:
    """Ascending permuted items of one range with their counts."""

    def __init__(self, high: np.ndarray, low: np.ndarray, count: np.ndarray, half: int):
        self.high, self.low, self.count, self.half = high, low, count, half

    def __len__(self) -> int:
        return len(self.high)

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, half: int, count: np.ndarray | None = None) -> Filter:
        """Counts permuted items, in any order and with repeats; count: how often each occurs, 1 by default."""
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))[: len(high)])
        if count is None:
            count = np.diff(np.append(new, len(high)))
        elif len(new):
            count = np.add.reduceat(count[order], new)
        return cls(high[new], low[new], count.astype(np.int64), half)

    @classmethod
    def merged(cls, filters: list[Filter]) -> Filter:
        parts = [np.concatenate([getattr(f, name) for f in filters]) for name in ("high", "low", "count")]
        return cls.of(parts[0], parts[1], filters[0].half, parts[2])

    def ranges(self, bits: int) -> list[tuple[int, Filter]]:
        """The filter of each range that has items."""
        number = (self.high >> np.uint64(self.half - bits)).astype(np.int64) if bits else np.zeros(len(self), np.int64)
        at = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))[: len(number)]).tolist()
        edges = zip(at, [*at[1:], len(number)])
        return [(int(number[a]), Filter(self.high[a:b], self.low[a:b], self.count[a:b], self.half)) for a, b in edges]

    def at_least(self, least: int) -> Filter:
        keep = self.count >= least
        return Filter(self.high[keep], self.low[keep], self.count[keep], self.half)

    def within(self, other: Filter) -> Filter:
        """The items that the other filter also has."""
        if self.half <= 32:
            own, also = (f.high << np.uint64(32) | f.low for f in (self, other))
            keep = np.isin(own, also, assume_unique=True)
        else:
            kind = np.dtype([("high", np.uint64), ("low", np.uint64)])
            own, also = np.empty(len(self), kind), np.empty(len(other), kind)
            for made, f in ((own, self), (also, other)):
                made["high"], made["low"] = f.high, f.low
            keep = np.isin(own, also, assume_unique=True)
        return Filter(self.high[keep], self.low[keep], self.count[keep], self.half)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The halves of the items before they were permuted."""
        return permute(self.high, self.low, self.half, back=True)

    def to_bytes(self, bits: int) -> bytes:
        """bits: of the range, which all items share."""
        n, left = len(self), self.half - bits
        size = max(0, (left - max(1, n.bit_length())) // 8)  # bytes of a remainder's first half
        quotient_bits = left - 8 * size
        quotient_bits, size = (quotient_bits, size) if quotient_bits <= n.bit_length() + 4 else (quotient_bits - 8, size + 1)
        quotient_bits = max(quotient_bits, 0)
        mask = np.uint64((1 << quotient_bits) - 1)
        quotient = (self.high >> np.uint64(8 * size) & mask).astype(np.int64) if 8 * size < 64 else np.zeros(n, np.int64)
        runs = np.zeros(n + (1 << quotient_bits), np.uint8)
        runs[np.arange(n) + quotient] = 1  # one for each item, a zero behind each quotient
        first = self.high.astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - size :]
        second = self.low.astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - -(-self.half // 8) :]
        small = np.minimum(self.count, 255).astype(np.uint8)
        over = self.count[small == 255]
        range_ = int(self.high[0]) >> left if n and left < self.half else 0
        head = np.array([n, quotient_bits, size, bits, range_, self.half, len(over)], "<u8")
        parts = [head, np.packbits(runs), np.ascontiguousarray(first), np.ascontiguousarray(second), small, over.astype("<i8")]
        return b"".join(part.tobytes() for part in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Filter:
        head = np.frombuffer(data, "<u8", 7).tolist()
        n, quotient_bits, size, bits, range_, half, over = head
        at = 56

        def take(length: int) -> np.ndarray:
            nonlocal at
            at += length
            return np.frombuffer(data, np.uint8, length, at - length)

        slots = n + (1 << quotient_bits)
        runs = np.unpackbits(take(-(-slots // 8)), count=slots)
        where = np.flatnonzero(runs)
        quotient = (where - np.arange(n)).astype(np.uint64)
        first, second = np.zeros((n, 8), np.uint8), np.zeros((n, 8), np.uint8)
        first[:, 8 - size :] = take(n * size).reshape(n, size)
        wide = -(-half // 8)
        second[:, 8 - wide :] = take(n * wide).reshape(n, wide)
        high, low = (x.reshape(-1).view(">u8").astype(np.uint64) for x in (first, second))
        high = high | quotient << np.uint64(8 * size) if 8 * size < 64 else high
        if half - bits < 64:
            high = high | np.uint64(range_) << np.uint64(half - bits)
        count = take(n).astype(np.int64)
        count[count == 255] = np.frombuffer(take(8 * over).tobytes(), "<i8")
        return cls(high, low, count, half)
