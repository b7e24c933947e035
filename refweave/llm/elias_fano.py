"""Elias-Fano sequences in numpy, for queries of many values at once on memory-mapped arrays.

A sorted sequence of n numbers below a bound is split into l low bits each, packed, and
the high parts in unary: number k sets bit (high part + k) of a bit vector. ``get`` selects
the k-th one; ``find`` selects the zero in front of a value's high part, where its
bucket begins, and searches the bucket's low bits by halving. A count of ones before each word
of 64 bits supports both; all parts are read where they are used only.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_STEP = 1 << 18
#: Place of the r-th one of a byte: 8 for fewer ones.
_SELECT = np.array([[([i for i in range(8) if x >> i & 1] + [8] * 8)[r] for r in range(8)] for x in range(256)], dtype=np.int64).ravel()
_FIVES, _THREES, _NIBBLES, _ONES, _TOPS = (_U(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th (from 0) one of each 64-bit word, which has as many (Vigna 2008)."""
    sums = word - ((word >> _U(1)) & _FIVES)
    sums = (sums & _THREES) + ((sums >> _U(2)) & _THREES)
    sums = ((sums + (sums >> _U(4))) & _NIBBLES) * _ONES  # each byte: the ones up to its end
    octet = np.bitwise_count(((r * _ONES | _TOPS) - sums) & _TOPS).astype(_U) << _U(3)
    octet = np.minimum(octet, _U(56))
    inside = r - (((sums << _U(8)) >> octet) & _U(0xFF))
    return octet.astype(np.int64) + _SELECT[(((word >> octet) & _U(0xFF)) << _U(3) | np.minimum(inside, _U(7))).astype(np.int64)]


def _width(n: int, bound: int) -> int:
    return max(0, (bound // max(1, n)).bit_length() - 1)


def encode(values: np.ndarray, bound: int) -> dict[str, np.ndarray]:
    """Arrays of a sorted uint64 sequence below ``bound``."""
    values = values.astype(_U)
    n = len(values)
    low = _width(n, bound)
    words = np.zeros(n * low // 64 + 2, _U)
    for lo in range(0, n if low else 0, _STEP):  # in slices, for memory
        own = values[lo : lo + _STEP]
        at = np.arange(lo, lo + len(own), dtype=np.int64) * low
        part = own & _U((1 << low) - 1)
        word, off = at >> 6, (at & 63).astype(_U)
        np.bitwise_or.at(words, word, part << off)
        over = (at & 63) + low > 64
        np.bitwise_or.at(words, word[over] + 1, part[over] >> (_U(64) - off[over]))
    size = (bound >> low) + n + 65
    bits = np.zeros(size // 64 + 1, _U)
    for lo in range(0, n, _STEP):
        highs = (values[lo : lo + _STEP] >> _U(low)).astype(np.int64) + np.arange(lo, min(n, lo + _STEP))
        np.bitwise_or.at(bits, highs >> 6, _U(1) << (highs & 63).astype(_U))
    ones = np.bitwise_count(bits).astype(np.int64)
    return {"low": words, "bits": bits, "before": np.concatenate([[0], np.cumsum(ones)]).astype(np.int64), "head": np.array([n, low, bound], dtype=_U)}


class Sequence:
    """A read-only view of ``encode``'s arrays."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.bits, self.before = arrays["low"], arrays["bits"], arrays["before"]
        self.n, self.width, self.bound = (int(x) for x in arrays["head"])
        self.zeros: np.ndarray | None = None

    def __len__(self) -> int:
        return self.n

    def _lows(self, k: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(k), _U)
        at = k * self.width
        word, off = at >> 6, (at & 63).astype(_U)
        value = self.low[word] >> off
        over = (at & 63) + self.width > 64
        if over.any():
            value[over] |= self.low[word[over] + 1] << (_U(64) - off[over])
        return value & _U((1 << self.width) - 1)

    def _select(self, r: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the r-th (from 0) one, or zero, of the bits."""
        if zeros:
            if self.zeros is None:  # an eighth of the bits, made once
                self.zeros = 64 * np.arange(len(self.before), dtype=np.int64) - self.before
            at = np.searchsorted(self.zeros, r, side="right") - 1
            return 64 * at + _select_in_word(~self.bits[at], (r - self.zeros[at]).astype(_U))
        at = np.searchsorted(self.before, r, side="right") - 1
        return 64 * at + _select_in_word(self.bits[at], (r - self.before[at]).astype(_U))

    def _run(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand from each place on, up to 64."""
        word, off = at >> 6, (at & 63).astype(_U)
        window = self.bits[word] >> off
        rest = np.where(off > 0, self.bits[np.minimum(word + 1, len(self.bits) - 1)] << ((_U(64) - off) & _U(63)), _U(0))
        zero = ~(window | rest)
        return np.bitwise_count((zero & (~zero + _U(1))) - _U(1)).astype(np.int64)

    def get(self, k: np.ndarray) -> np.ndarray:
        """The numbers at places k."""
        k = np.asarray(k, np.int64)
        if not len(k):
            return np.zeros(0, _U)
        high = (self._select(k, False) - k).astype(_U)
        return (high << _U(self.width)) | self._lows(k)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1; of equal numbers the first."""
        out = np.full(len(values), -1, np.int64)
        fits = np.flatnonzero(values < _U(self.bound)) if self.n else np.zeros(0, np.int64)
        if not len(fits):
            return out
        v = values[fits].astype(_U)
        high = (v >> _U(self.width)).astype(np.int64)
        low = v & _U((1 << self.width) - 1)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) + 1, 0)
        run = self._run(start)
        if len(long := np.flatnonzero(run > 63)):  # a bucket that goes on beyond the window
            run[long] = self._select(high[long], True) - start[long]
        lo = start - high
        end = lo + run
        hi = end.copy()
        while (open_ := lo < hi).any():
            act = np.flatnonzero(open_)
            mid = (lo[act] + hi[act]) >> 1
            less = self._lows(mid) < low[act]
            lo[act], hi[act] = np.where(less, mid + 1, lo[act]), np.where(less, hi[act], mid)
        inside = np.flatnonzero(lo < end)
        hit = inside[self._lows(lo[inside]) == low[inside]]
        out[fits[hit]] = lo[hit]
        return out
