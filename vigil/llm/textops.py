"""Vectorised word hashing shared by the operators that work on word windows.

A batch of UTF-8 texts is handled as one byte buffer; words, word hashes and
hashes of runs of words come out of a handful of numpy passes, in chunks of
``CHUNK`` bytes so that the scratch arrays stay small however long a batch is.
Of a text longer than a chunk, words and runs are hashed segment by segment, so
that the tables of powers never outgrow a chunk (or the longest word).
All hashes are deterministic 64-bit values (no per-process seed), so they can
be shuffled and compared between executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
#: Words whose runs are hashed in one pass.
RUN_WORDS = 1 << 18

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xD1342543DE82EF95 | 1
_WORD = 0xA0761D6478BD642F | 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_values() -> np.ndarray:
    return _mix((np.arange(256, dtype=np.uint64) + U64(1)) * U64(_BASE))


def _space_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


BYTE, SPACE, LOWER = _byte_values(), _space_table(), _lower_table()


class _Powers:
    """base**j and base**-j modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                full = np.full(size, U64(b))
                full[0] = U64(1)
                setattr(self, name, np.multiply.accumulate(full))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS, _WORDS2 = _Powers(_BASE), _Powers(_WORD), _Powers(_BASE2)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]: offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: (first, end, bytes, offsets)."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo]: offs[hi]], offs[lo: hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte of each word of all texts, and the first word of each
    text plus the total.  Words are runs of bytes other than ASCII white space."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    space = SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    edge = offs[(offs > 0) & (offs < n)]
    before[edge] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[edge - 1] = True
    word = ~space
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & after) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each word, in segments of whole words of about
    ``CHUNK`` bytes."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + CHUNK, "right")))
        first, last = start[lo], end[hi - 1]
        up, down = _BYTES.to(int(last - first) + 1)
        total = np.empty(last - first + 1, np.uint64)
        total[0] = 0
        np.cumsum(BYTE[data[first:last]] * up[: last - first], out=total[1:])
        s, e = start[lo:hi] - first, end[lo:hi] - first
        out[lo:hi] = _mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def _sums_of_runs(words: np.ndarray, width: int, powers: _Powers) -> np.ndarray:
    n = len(words) - width + 1
    up, down = powers.to(len(words) + 1)
    total = np.empty(len(words) + 1, np.uint64)
    total[0] = 0
    np.cumsum(words * up[: len(words)], out=total[1:])
    return (total[width:] - total[:n]) * down[:n]


def run_hashes(words: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (texts not yet told apart:
    entry i covers words i .. i + width - 1)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = _WORDS2 if second else _WORDS
    if width <= 8:
        up, _ = powers.to(width)
        h = words[:n].copy()
        for t in range(1, width):
            h += words[t: n + t] * up[t]
        return _mix(h)
    h = np.empty(n, np.uint64)
    for lo in range(0, n, RUN_WORDS):
        hi = min(n, lo + RUN_WORDS)
        h[lo:hi] = _sums_of_runs(words[lo: hi + width - 1], width, powers)
    return _mix(h)


def whole_hash(words: np.ndarray) -> int:
    """Hash of a whole word sequence shorter than a shingle."""
    up, _ = _WORDS.to(len(words) + 1)
    with np.errstate(over="ignore"):
        return int(_mix(np.array([np.sum(words * up[: len(words)]) + U64(len(words)) * U64(_BASE2)], np.uint64))[0])


def shingle_sets(column, width: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes (uint64); a text of
    fewer than ``width`` words, but not none, has its whole sequence as one."""
    data, offs = text_buffer(column)
    for _, _, part, at in chunks(data, offs):
        if lower:
            part = LOWER[part]
        start, end, first = word_spans(part, at)
        words = word_hashes(part, start, end)
        runs = run_hashes(words, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield np.unique(runs[a: b - width + 1])
            elif b > a:
                yield np.array([whole_hash(words[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def as_long(values: np.ndarray) -> np.ndarray:
    """uint64 hashes as the signed longs Spark holds."""
    return np.ascontiguousarray(values).view(np.int64)
