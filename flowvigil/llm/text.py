"""Texts as byte arrays: what tasks use to look at many documents at once.

Arrow hands a column of texts over as one run of UTF-8 bytes with offsets. The helpers
here keep that form and work on all documents of a block with array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

# Bytes of text that are looked at in one go; a document is never cut by ``blocks``.
BLOCK = 2 << 20
# Span of one pass of ``poly`` over values (a single item may be longer).
SPAN = 1 << 18

U64 = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def lut(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags that are set in the given byte ranges (ends included)."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


# Words of most contracts: everything but blanks and the controls tab to carriage return.
WORD = ~lut((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(30))
        h = h * U64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> U64(27))
        h = h * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


class Texts:
    """Documents as one byte array ``data`` with ``off`` (one more than documents)."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        self.nulls = column.is_null().to_numpy(zero_copy_only=False)
        if column.type != pa.large_binary():
            column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        n, (_, offsets, data) = len(column), column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = whole[off[0]:off[-1]]
        self.off = off - off[0]

    def __len__(self) -> int:
        return len(self.off) - 1

    @classmethod
    def of(cls, data: np.ndarray, off: np.ndarray) -> Texts:
        made = cls.__new__(cls)
        made.data, made.off, made.nulls = data, off, np.zeros(len(off) - 1, bool)
        return made

    def lowered(self) -> Texts:
        """With A-Z in lower case; other letters stay."""
        self.data = LOWER[self.data]
        return self


def blocks(table: pa.Table | pa.RecordBatch, column: str = "text", limit: int = BLOCK) -> Iterator:
    """Slices of ``table`` of at most ``limit`` bytes of text, or of one row that is longer."""
    if isinstance(table, pa.Table):
        table = table.combine_chunks()
    sizes = pa.compute.fill_null(pa.compute.binary_length(table[column]), 0).to_numpy()
    ends = np.cumsum(sizes)
    start, n = 0, len(ends)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield table.slice(start, stop - start)
        start = stop


def words(texts: Texts, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and for each document the number of words before it."""
    inside = table[texts.data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts.off), np.int64)
    cuts = texts.off[texts.off < len(inside)]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, texts.off)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SPAN + 1)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, x, U64)])) for x in (base, inverse))
        if size <= 4 * SPAN:
            _POWERS[base] = have
    return have


def poly(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0],
         table: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each ``values[start:end]`` (ends ascending with starts), looked up in ``table`` first."""
    out = np.empty(len(starts), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            low = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, low + SPAN, "right")))
            high = int(ends[j - 1])
            part = values[low:high] if table is None else table[values[low:high]]
            powers, inverses = _powers(base, high - low + 1)
            sums = np.zeros(high - low + 1, U64)
            np.cumsum(part * powers[:high - low], out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (sums[e] - sums[s]) * inverses[s] + (e - s).astype(U64) * U64(0xA24BAED4963EE407)
            i = j
    return mix(out)


def word_hashes(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return poly(texts.data, starts, ends, table=BYTE_VALUES)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` values: as many as ``len(values) - k + 1``."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, covered, part, size = None, 0, values, 1
    with np.errstate(over="ignore"):
        while True:
            factor = mix(np.array([size * 2 + 1], U64))[0] | U64(1)
            if k & size:
                out = part[:n] if out is None else out[:n] * factor + part[covered:covered + n]
                covered += size
            if covered == k:
                return mix(out)
            part = part[:-size] * (factor ^ U64(0x5555555555555554)) + part[size:]
            size *= 2


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:n], v[w - size:w - size + n]) if size < w else v


def bytes_column(data: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    """Arrow column over ``data`` cut at ``offsets``."""
    kind = kind or pa.binary()
    width = np.int64 if kind in (pa.large_binary(), pa.large_string()) else np.int32
    return pa.Array.from_buffers(kind, len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets, width)), pa.py_buffer(np.ascontiguousarray(data))])


def runs(flags: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set flags, cut at ``off``, and the runs before each cut."""
    return words(Texts.of(flags.view(np.uint8), off), np.arange(256) > 0)
