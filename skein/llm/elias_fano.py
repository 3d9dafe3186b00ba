"""Elias-Fano coded monotone sequences and an n-gram trie of them, kept as flat arrays that can be memory-mapped."""

from __future__ import annotations

import json
import tempfile

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: _SELECT[byte, k]: the place of the byte's k-th set bit, from 0.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _SELECT[_b, : len(_at)] = _at


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers.

    The low ``l`` bits of each number are packed; the high parts stand in a bit vector, a one
    for each number after as many zeros as its high part says. A directory counts the ones
    before every byte of 8 words, so that select needs one search and a few table look-ups.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.before, meta = (arrays[k] for k in ("low", "high", "before", "meta"))
        self.n, self.l, self.zeros = (int(x) for x in meta)

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        l = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(l)).astype(np.int64)
        zeros = int(high[-1]) + 1 if n else 1
        bits = np.zeros(-(-(n + zeros) // 8) + 8, np.uint8)
        at = high + np.arange(n)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        packed = np.zeros(n * l // 64 + 2, np.uint64)
        if l:
            low = values & np.uint64((1 << l) - 1)
            place = np.arange(n, dtype=np.int64) * l
            word, shift = place >> 6, (place & 63).astype(np.uint64)
            np.bitwise_or.at(packed, word, low << shift)
            over = (place & 63) + l > 64
            np.bitwise_or.at(packed, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        before = np.concatenate([[0], np.cumsum(_ONES[bits])]).astype(np.uint32 if n < 1 << 32 else np.uint64)
        return {"low": packed, "high": bits, "before": before, "meta": np.array([n, l, zeros], np.int64)}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        place = i.astype(np.int64) * self.l
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        out = self.low[word] >> shift
        over = shift + np.uint64(self.l) > np.uint64(64)
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.l) - 1)

    def _select1(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th one."""
        byte = np.searchsorted(self.before, i, "right") - 1
        return byte * 8 + _SELECT[self.high[byte], (i - self.before[byte]).astype(np.int64)]

    def _ones_before_zero(self, j: np.ndarray) -> np.ndarray:
        """Ones in front of the j-th zero: how many numbers have a high part up to j."""
        lo, hi = np.zeros(len(j), np.int64), np.full(len(j), len(self.high) - 1, np.int64)
        while (lo < hi).any():  # the last byte with at most j zeros before it
            mid = (lo + hi + 1) >> 1
            right = mid * 8 - self.before[mid].astype(np.int64) <= j
            lo, hi = np.where(right, mid, lo), np.where(right, hi, mid - 1)
        rest = j - (lo * 8 - self.before[lo].astype(np.int64))
        place = lo * 8 + _SELECT[255 - self.high[lo], rest]
        return place - j

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        i = np.asarray(i, np.int64)
        return ((self._select1(i) - i).astype(np.uint64) << np.uint64(self.l)) | self._low(i)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Place of each ``x``, -1 where it isn't there; a successor search, within [lo, hi) where given."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        h = (x >> np.uint64(self.l)).astype(np.int64)
        ask = np.flatnonzero((h < self.zeros) & (h >= 0))
        h, x = h[ask], x[ask]
        first = np.where(h > 0, self._ones_before_zero(np.maximum(h - 1, 0)), 0)
        last = self._ones_before_zero(h)
        if lo is not None:
            first, last = np.maximum(first, lo[ask]), np.minimum(last, hi[ask])
        want, end = x & np.uint64((1 << self.l) - 1), last.copy()
        while (go := np.flatnonzero(first < last)).size:
            mid = (first[go] + last[go]) >> 1
            less = self._low(mid) < want[go]
            first[go], last[go] = np.where(less, mid + 1, first[go]), np.where(less, last[go], mid)
        ok = np.flatnonzero(first < end)
        ok = ok[self._low(first[ok]) == want[ok]]
        out[ask[ok]] = first[ok]
        return out


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one byte for each value, 256 values at most): equal bins, each standing for the mean of what is in it."""
    distinct = np.unique(values)
    if len(distinct) <= 256:
        return np.searchsorted(distinct, values).astype(np.uint8), distinct.astype(np.float64)
    low, high = distinct[0], distinct[-1]
    code = np.minimum((values - low) * (256 / (high - low)), 255).astype(np.int64)
    n, total = np.bincount(code, minlength=256), np.bincount(code, weights=values, minlength=256)
    return code.astype(np.uint8), total / np.maximum(n, 1)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One blob: a JSON head with name, type, place and length of each array, then the arrays."""
    head, at = [], 0
    for name, a in arrays.items():
        head.append([name, a.dtype.str, at, len(a)])
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([len(text).to_bytes(8, "little"), text, *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())])


def mapped(blob: bytes) -> dict[str, np.ndarray]:
    """The arrays of a blob, memory-mapped from a file without a name, which goes with the last map of it."""
    with tempfile.TemporaryFile() as f:
        f.write(blob)
        f.flush()
        data = np.memmap(f, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    base = 8 + size
    return {name: data[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for name, kind, at, n in json.loads(data[8:base].tobytes())}


class Trie:
    """Two levels: words with count, back-off and pointer; successors of each word with the probability's gain.

    A successor's key is its word's place times 2^32 plus 32 bits of its own hash, so the
    whole level is monotone and a search stays in the range that the pointers give.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        part = lambda p: EliasFano({k.removeprefix(p): v for k, v in arrays.items() if k.startswith(p)})
        self.words, self.pointers, self.next = part("words."), part("pointers."), part("next.")
        self.count, self.backoff, self.backoffs = arrays["count"], arrays["backoff"], arrays["backoffs"]
        self.gain, self.gains = arrays["gain"], arrays["gains"]

    @staticmethod
    def build(words: np.ndarray, count: np.ndarray, backoff: np.ndarray, place: np.ndarray, successor: np.ndarray, gain: np.ndarray) -> dict[str, np.ndarray]:
        """``words`` sorted; successors (place of their word, 32 bits) in any order."""
        key = (place.astype(np.uint64) << np.uint64(32)) | successor.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(place.astype(np.int64), minlength=len(words)))])
        out = {}
        for p, v in (("words.", words), ("pointers.", starts), ("next.", key[order])):
            out |= {p + k: a for k, a in EliasFano.build(v).items()}
        out["count"] = count.astype(np.uint32 if not len(count) or count.max() < 1 << 32 else np.uint64)
        out["backoff"], out["backoffs"] = quantise(backoff)
        out["gain"], out["gains"] = quantise(gain[order])
        return out

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place or -1, count, log10 back-off) of each word."""
        place = self.words.find(words)
        known = place >= 0
        count, backoff = np.zeros(len(words), np.int64), np.zeros(len(words))
        count[known] = self.count[place[known]]
        backoff[known] = self.backoffs[self.backoff[place[known]]]
        return place, count, backoff

    def gain_of(self, place: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """What log10 probability a stored successor has more than by backing off; 0 for others."""
        out = np.zeros(len(place))
        known = np.flatnonzero(place >= 0)
        if not len(known) or not self.next.n:
            return out
        p = place[known]
        lo, hi = self.pointers.at(p).astype(np.int64), self.pointers.at(p + 1).astype(np.int64)
        some = np.flatnonzero(lo < hi)
        key = (p[some].astype(np.uint64) << np.uint64(32)) | successor[known[some]].astype(np.uint64)
        at = self.next.find(key, lo[some], hi[some])
        found = at >= 0
        out[known[some[found]]] = self.gains[self.gain[at[found]]]
        return out
