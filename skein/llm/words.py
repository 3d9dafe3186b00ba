"""Words of whole Arrow batches at once: byte classes, word bounds and 64-bit word hashes in numpy.

UTF-8 keeps every byte of a non-ASCII character at 0x80 or above, so classes over
ASCII can be decided byte by byte.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _table(separators: list[int]) -> np.ndarray:
    """Byte to lower-cased byte (A-Z only), separators to 0xFF (a byte that UTF-8 never has)."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[separators] = 0xFF
    return t


#: Words of letters, digits and non-ASCII characters: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
PLAIN = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Words between ASCII white space: [^\x20\x09-\x0D]+ after lower-casing A-Z.
SPACED = _table([0x20, *range(0x09, 0x0E)])


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(f: Callable) -> Callable:
    """A mapInArrow function that gives freed memory back to the system when it ends: workers wait idle for later tasks."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


class Hasher:
    """Word bounds and hashes of slices of at most about ``slice_bytes`` (a longer text is a slice of its own)."""

    def __init__(self, table: np.ndarray, slice_bytes: int = 1 << 20):
        self.table, self.slice_bytes = table, slice_bytes
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) > n:
            return
        self.up, self.down = np.full(n + 1, _P, np.uint64), np.full(n + 1, pow(_P, -1, 1 << 64), np.uint64)
        self.up[0] = self.down[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, last text + 1, bytes, offsets of the texts in them); null is an empty text."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        for at in range(0, len(texts), 256):
            part = pc.fill_null(texts.slice(at, 256).cast(pa.large_binary()), b"")
            _, offs, data = part.buffers()
            offs = np.frombuffer(offs, np.int64)[part.offset : part.offset + len(part) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            lo = 0
            while lo < len(part):
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + self.slice_bytes, "right")) - 1)
                yield at + lo, at + hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                lo = hi

    def bounds(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-cased bytes, word starts, word ends, index of each text's first word, one more than texts)."""
        low = self.table[data]
        inside = np.zeros(len(low) + 2, bool)
        np.not_equal(low, 0xFF, out=inside[1:-1])
        start = inside[1:] & ~inside[:-1]
        end = inside[:-1] & ~inside[1:]
        cut = offs[1:-1]
        cut = cut[inside[cut] & inside[cut + 1]]  # a word may not run on into the next text
        start[cut] = True
        end[cut] = True
        starts, ends = np.flatnonzero(start[:-1]), np.flatnonzero(end)
        return low, starts, ends, np.searchsorted(starts, offs)

    def running(self, low: np.ndarray) -> np.ndarray:
        """Running polynomial of the bytes, from which any stretch's hash can be taken."""
        self._powers(len(low) + 1)
        run = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.up[: len(low)], out=run[1:])
        return run

    def stretches(self, run: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
        """A well-mixed 64-bit hash of each stretch of bytes; hashes of different kinds differ."""
        return mix((run[ends] - run[starts]) * self.down[starts] ^ np.uint64(kind))

    def hashes(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.stretches(self.running(low), starts, ends)

    def with_prefixes(self, texts: pa.Array, lengths: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, last + 1, first word of each text, hashes): a row of word hashes, then one for each prefix length in bytes."""
        for lo, hi, data, offs in self.slices(texts):
            low, starts, ends, first = self.bounds(data, offs)
            run = self.running(low)
            yield lo, hi, first, np.stack([self.stretches(run, starts, ends), *(self.stretches(run, starts, np.minimum(starts + n, ends), n) for n in lengths)])

    def words(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, last + 1, lower-cased bytes, starts, ends, first word of each text, hashes) of each slice."""
        for lo, hi, data, offs in self.slices(texts):
            low, starts, ends, first = self.bounds(data, offs)
            yield lo, hi, low, starts, ends, first, self.hashes(low, starts, ends)


def mix(h: np.ndarray) -> np.ndarray:
    h = np.array(h, np.uint64)
    for mult in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> np.uint64(33)
        h *= np.uint64(mult)
    h ^= h >> np.uint64(33)
    return h


def text_of(low: np.ndarray, start: int, end: int) -> str:
    return low[start:end].tobytes().decode("utf-8", "replace")


def plain_words(text: str | None) -> list[str]:
    """The words of one text under PLAIN, for small inputs such as benchmark items."""
    if not text:
        return []
    return [w.decode("utf-8") for w in PLAIN[np.frombuffer(text.encode(), np.uint8)].tobytes().split(b"\xff") if w]
