"""Monotone sequences in Elias-Fano form, as flat arrays that can be memory-mapped.

A value's low bits are packed; its high bits stand in unary in a bit vector.  All look-ups work
on arrays of queries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_ONE = np.uint64(1)
_BLOCK = 2  # words of 64 bits between two entries of the directory; look-ups below count on two
_LOOKS = 4  # values of a bucket that are looked at one by one before it is searched
#: Position of the k-th set bit of a byte.
_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


_EACH, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_PAIRS, _FOURS, _HALVES = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def _in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th one (from 0) of each word; the ones of its bytes are summed up within the word."""
    ones = x - ((x >> _ONE) & _PAIRS)
    ones = (ones & _FOURS) + ((ones >> np.uint64(2)) & _FOURS)
    sums = ((ones + (ones >> np.uint64(4))) & _HALVES) * _EACH
    k = np.clip(k, 0, 63).astype(np.uint64)
    octet = np.minimum(np.bitwise_count(((k * _EACH | _TOPS) - sums) & _TOPS), 7)
    shift = octet.astype(np.uint64) << np.uint64(3)
    left = k - (((sums << np.uint64(8)) >> shift) & np.uint64(255))
    return shift.astype(np.int64) + _SELECT[(x >> shift) & np.uint64(255), np.minimum(left, 7)]


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of each value, packed into words (one spare word at the end)."""
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits and len(values):
        low = values & ((_ONE << np.uint64(bits)) - _ONE)
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        first = np.flatnonzero(np.diff(word, prepend=-1))  # words ascend, so each one's values stand together
        out[word[first]] = np.bitwise_or.reduceat(low << shift, first)
        out[word[first] + 1] |= np.bitwise_or.reduceat((low >> _ONE) >> (np.uint64(63) - shift), first)
    return out


def unpack(words: np.ndarray, i: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), np.uint64)
    at = i * bits
    word, shift = at >> 6, (at & 63).view(np.uint64)
    both = (words[word] >> shift) | ((words[word + 1] << _ONE) << (np.uint64(63) - shift))
    return both & ((_ONE << np.uint64(bits)) - _ONE)


class EliasFano:
    """``low``, ``high`` and ``zeros`` are the arrays to be stored; ``n`` and ``bits`` go with them."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: ascending uint64."""
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = min(63, max(0, (top // max(n, 1)).bit_length() - 1))
        upper = (values >> np.uint64(bits)).astype(np.int64)
        size = -(-(n + (int(upper[-1]) if n else 0) + 2) // (64 * _BLOCK)) * 64 * _BLOCK
        flag = np.zeros(size, bool)
        flag[upper + np.arange(n)] = True
        high = np.packbits(flag, bitorder="little").view(np.uint64)
        per = 64 * _BLOCK - np.bitwise_count(high).astype(np.int64).reshape(-1, _BLOCK).sum(axis=1)
        return cls(n, bits, pack(values, bits), high, np.concatenate([[0], np.cumsum(per)]).astype(np.int64))

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0) of the bit vector."""
        block = np.searchsorted(self.zeros, k, side="right") - 1
        block = np.minimum(block, len(self.zeros) - 2)
        left = k - self.zeros[block]
        return self._in_block(block, left, True)

    def _in_block(self, block: np.ndarray, left: np.ndarray, zeros: bool) -> np.ndarray:
        """Position of the one or zero with that number (from 0) within a block."""
        first, second = self.high[block * _BLOCK], self.high[block * _BLOCK + 1]
        if zeros:
            first, second = ~first, ~second
        ones = np.bitwise_count(first).astype(np.int64)
        later = left >= ones
        return (block * _BLOCK + later) * 64 + _in_word(np.where(later, second, first), left - np.where(later, ones, 0))

    def bucket(self, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 index of the values whose high part is ``upper``."""
        k = np.minimum(upper.astype(np.int64), int(self.zeros[-1]) - 1)
        at = np.where(k > 0, self._select0(np.maximum(k - 1, 0)) + 1, 0)
        # the ones up to the next zero; a run of ones that leaves the word is looked up again
        rest = ~self.high[at >> 6] >> (at & 63).astype(np.uint64)
        ones = np.bitwise_count((rest & (~rest + _ONE)) - _ONE).astype(np.int64)
        out = (at & 63) + ones >= 64
        if out.any():
            ones[out] = self._select0(k[out]) - at[out]
        lo = at - k
        return np.minimum(lo, self.n), np.minimum(lo + ones, self.n)

    def _within(self, target: np.ndarray, first: np.ndarray | None, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value of the target's bucket that is not less, and the bucket's end."""
        lo, hi = self.bucket(np.minimum(target >> np.uint64(self.bits), np.uint64(1 << 62)))
        if first is not None:
            lo, hi = np.clip(lo, first, last), np.clip(hi, first, last)
        return self._least(lo, hi, target & ((_ONE << np.uint64(self.bits)) - _ONE)), hi

    def _least(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Index of the first value in [lo, hi) whose low part is not less."""
        lo, hi = lo.copy(), hi.copy()
        go = np.flatnonzero(lo < hi)
        while len(go):
            mid = (lo[go] + hi[go]) >> 1
            less = unpack(self.low, mid, self.bits) < low[go]
            lo[go[less]] = mid[less] + 1
            hi[go[~less]] = mid[~less]
            go = go[lo[go] < hi[go]]
        return lo

    def successor(self, target: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of the first value that is at least ``target``, within [first, last) where these are given."""
        return self._within(target, first, last)[0]

    def find(self, target: np.ndarray, within: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """Index of ``target``, -1 where it is not there.

        Most buckets have few values or none, and a few looks settle them.  For the others ``within`` says, by indices of
        targets, in which [first, last) theirs can be.
        """
        out = np.full(len(target), -1, np.int64)
        if not self.n or not len(target):
            return out
        lo, hi = self.bucket(np.minimum(target >> np.uint64(self.bits), np.uint64(1 << 62)))
        go = np.flatnonzero(lo < hi)
        lo, hi, low = lo[go], hi[go], target[go] & ((_ONE << np.uint64(self.bits)) - _ONE)
        for _ in range(_LOOKS):
            value = unpack(self.low, lo, self.bits)
            same = value == low
            out[go[same]] = lo[same]
            more = np.flatnonzero((value < low) & (lo + 1 < hi))
            go, lo, hi, low = go[more], lo[more] + 1, hi[more], low[more]
            if not len(go):
                break
        else:
            if within is not None:
                first, last = within(go)
                lo, hi = np.clip(lo, first, last), np.clip(hi, first, last)
            at = self._least(lo, hi, low)
            same = (at < hi) & (unpack(self.low, np.minimum(at, self.n - 1), self.bits) == low)
            out[go[same]] = at[same]
        return out

    def _select1(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one (from 0)."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 * _BLOCK - self.zeros
        block = np.minimum(np.searchsorted(ones, k, side="right") - 1, len(ones) - 2)
        left = k - ones[block]
        return self._in_block(block, left, False)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at indices."""
        high = (self._select1(i.astype(np.int64)) - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | unpack(self.low, i, self.bits)

    def both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at indices and at the next ones."""
        at = self._select1(i.astype(np.int64))
        after = at + 1
        rest = self.high[after >> 6] >> (after & 63).astype(np.uint64)
        far = rest == 0  # the next one is in another word
        after += np.bitwise_count((rest & (~rest + _ONE)) - _ONE).astype(np.int64)
        if far.any():
            after[far] = self._select1(i[far].astype(np.int64) + 1)
        bits = np.uint64(self.bits)
        first, second = (at - i).astype(np.uint64) << bits, (after - i - 1).astype(np.uint64) << bits
        return first | unpack(self.low, i, self.bits), second | unpack(self.low, i + 1, self.bits)
