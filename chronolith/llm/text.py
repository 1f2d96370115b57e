"""Vectorised text kernels: words, word hashes and word windows of Arrow string columns.

Every function works on the raw UTF-8 bytes of a run of texts at once.  Lower-casing
touches A-Z only and word classes are sets of bytes, so no decoding takes place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomial word hash and of the mixers.
BASE, MIX_A, MIX_B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes of text handled at once.
RUN_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


_bytes = np.arange(256, dtype=np.uint8)
UPPER = (_bytes >= 65) & (_bytes <= 90)
LOWER = _bytes.copy()
LOWER[UPPER] += 32
#: `[^\x20\x09-\x0D]+`
NON_SPACE = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
ALNUM = (LOWER >= 128) | ((LOWER >= 97) & (LOWER <= 122)) | ((LOWER >= 48) & (LOWER <= 57))
_plain = mix(np.arange(1, 257, dtype=np.uint64) * MIX_B)
_folded = _plain[LOWER]
_inverse = U(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(BASE, RUN_BYTES), _powers(_inverse, RUN_BYTES)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if n <= RUN_BYTES:
        return _up, _down
    return _powers(BASE, n), _powers(_inverse, n)


@dataclass
class Run:
    """Texts first..last of a batch as one byte array; text i spans bounds[i]..bounds[i + 1]."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def runs(column: pa.Array, size: int = RUN_BYTES) -> Iterator[Run]:
    """Cuts a string column (nulls count as empty) into runs of about `size` bytes, whole texts each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        last = min(last, n)
        yield Run(first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


@dataclass
class Words:
    """Words of a run: byte spans, and for text i the words at index[i]..index[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    index: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.index) - 1), np.diff(self.index))


def words(run: Run, word_bytes: np.ndarray) -> Words:
    inside = np.zeros(len(run.data) + 2, bool)
    inside[1:-1] = word_bytes[run.data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = run.bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(run.data))]
    joined = cuts[inside[cuts] & inside[cuts + 1]]  # texts that meet inside a word
    starts[joined] = True
    ends[joined - 1] = True
    start = np.flatnonzero(starts)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, run.bounds))


def word_hashes(run: Run, w: Words, fold: bool) -> np.ndarray:
    """64-bit hashes of the words; with fold, A-Z count as a-z."""
    up, down = powers(len(run.data) + 1)
    sums = np.zeros(len(run.data) + 1, np.uint64)
    np.cumsum((_folded if fold else _plain)[run.data] * up[: len(run.data)], out=sums[1:])
    return mix((sums[w.end] - sums[w.start]) * down[w.start] + (w.end - w.start).astype(np.uint64))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each word; the last k - 1 entries are missing."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * BASE
    for i in range(1, k):
        out = mix(out) + h[i : n + i] * U(2 * i + 1)
    return mix(out)


def sequence_hash(h: np.ndarray) -> np.ndarray:
    """Hash of a whole word sequence shorter than a window, in a value space of its own by length."""
    out = np.array([len(h)], np.uint64) * MIX_B
    for i in range(len(h)):
        out = mix(out + h[i : i + 1] * BASE)
    return out[0]
