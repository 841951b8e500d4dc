"""Suffix-array dedup: depth-limited radix sort over bytes.

Suffixes are put in order only through ``width`` bytes. The first digit is the anchor that
``repeats`` files a window under and the window's distance to it; each further pass sorts what
is left by the next eight bytes inside its group and drops suffixes that are alone. The groups
left after the last byte are exactly the repeated windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowvigil.llm.repeats import repeats
from flowvigil.llm.text import bytes_column, runs

SCHEMA = "doc_id long, n_bytes long, n_removed long, starts array<int>, ends array<int>, kept binary"


def _alone_dropped(alive: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without groups of one; ``group`` is sorted and gets numbers from 0."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(first, append=len(group))
    many = np.repeat(size > 1, size)
    return alive[many], np.repeat(np.arange(len(first)), size)[many]


def radix_groups(tokens: np.ndarray, start: np.ndarray, gid: np.ndarray, width: int) -> np.ndarray:
    """Number of the group of equal windows of each start, -1 for windows that are alone."""
    order = np.argsort(gid, kind="stable")
    alive, group = _alone_dropped(order, gid[order])
    padded = np.concatenate([tokens, np.zeros(8, np.uint8)])
    digits = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(tokens) + 1,), (1,))
    for depth in range(0, width, 8):
        if not len(alive):
            break
        digit = digits[start[alive] + depth].astype(np.uint64)
        if width - depth < 8:
            digit &= np.uint64((1 << 8 * (width - depth)) - 1)
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
        alive, group = _alone_dropped(alive, np.cumsum(new))
    label = np.full(len(start), -1, np.int64)
    label[alive] = group
    return label


def _finish(pack, covered):
    if pack is None:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()),
                         "n_removed": pa.array([], pa.int64()), "starts": pa.array([], pa.list_(pa.int32())),
                         "ends": pa.array([], pa.list_(pa.int32())), "kept": pa.array([], pa.binary())})
    off = pack.off
    gone = np.concatenate([[0], np.cumsum(covered)])[off]
    s, e, before = runs(covered, off)
    doc = np.searchsorted(off, s, "right") - 1
    lists = lambda v: pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(v - off[doc], pa.int32()))
    return pa.table({"doc_id": pack.table["doc_id"], "n_bytes": pa.array(np.diff(off), pa.int64()),
                     "n_removed": pa.array(np.diff(gone), pa.int64()), "starts": lists(s), "ends": lists(e),
                     "kept": bytes_column(pack.texts.data[~covered], off - gone)})


def remove_repeated_bytes(docs: DataFrame, width: int = 50, k: int | None = None, **options) -> DataFrame:
    """Remove every byte covered by a string of ``width`` bytes that also starts in a document with a smaller doc_id.

    Texts are UTF-8; matches stay inside documents and are judged on the input. Returns a row
    for each row of ``docs``: doc_id, n_bytes, n_removed, starts and ends (removed runs in
    bytes), kept (the other bytes; may cut characters).

    Null and empty texts have no bytes; a null doc_id comes after all others; rows with the
    same doc_id never remove each other's bytes. Other columns are not looked at; an empty
    table gives an empty result.
    """
    return repeats(docs.select("doc_id", "text"), width=width, k=k or max(1, width * 2 // 5), unit="bytes", within=False,
                   same=radix_groups, finish=_finish, schema=SCHEMA, halves=True, **options)
