"""Substring dedup: prefix-partitioned suffix trees over words.

The suffixes that can repeat are gathered by ``repeats`` (same anchor, same distance to it).
Groups of suffixes that are too large for memory are split by longer and longer prefixes, so
prefixes have the length that their group needs. For each group the suffix tree is built in
the usual way from the sorted suffixes and the lengths of their common prefixes: an internal
node is a stretch of neighbours that share a prefix, and the nodes at least ``width`` deep
are the repeats of at least ``width`` words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowvigil.llm.repeats import repeats
from flowvigil.llm.text import bytes_column, runs

GROUP_SUFFIXES = 100_000
SCHEMA = "doc_id long, n_words long, n_removed long, starts array<int>, ends array<int>, kept binary"


def _regroup(gid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group, and the sizes of the groups in that order."""
    order = np.argsort(gid, kind="stable")
    first = np.flatnonzero(np.diff(gid[order], prepend=-1))
    return order, np.diff(first, append=len(order))


def deep_nodes(tokens: np.ndarray, start: np.ndarray, gid: np.ndarray, width: int,
               limit: int = GROUP_SUFFIXES) -> np.ndarray:
    """Number of the tree node of depth ``width`` above each suffix, -1 where there is none.

    Suffixes of different groups ``gid`` have different prefixes already.
    """
    label = np.full(len(start), -1, np.int64)
    todo, depth, count = np.arange(len(start)), 0, 0
    group = gid.astype(np.int64)
    while len(todo):
        order, sizes = _regroup(group)
        todo, number = todo[order], np.repeat(np.arange(len(sizes)), sizes)
        size = np.repeat(sizes, sizes)
        small = np.flatnonzero((size > 1) & ((size <= limit) | (depth >= width)))
        for rows, names in _batches(todo[small], number[small], limit):
            count += _tree(tokens, start, rows, names, depth, width, label, count)
        large = (size > limit) & (depth < width)
        todo = todo[large]
        if len(todo):  # these prefixes become one word longer
            word = tokens[start[todo] + depth]
            order = np.lexsort((word, number[large]))
            todo, word, number = todo[order], word[order], number[large][order]
            group = np.cumsum(np.concatenate([[True], (word[1:] != word[:-1]) | (number[1:] != number[:-1])]))
            depth += 1
    return label


def _batches(rows: np.ndarray, names: np.ndarray, limit: int):
    """Whole groups, together at most about ``limit`` suffixes, or one group of full depth."""
    start = 0
    while start < len(rows):
        stop = min(len(rows), start + limit)
        if stop < len(rows):
            cut = int(np.searchsorted(names, names[stop], "left"))
            stop = cut if cut > start else int(np.searchsorted(names, names[start], "right"))
        yield rows[start:stop], names[start:stop]
        start = stop


def _tree(tokens, start, rows, names, depth, width, label, count) -> int:
    """Label the suffixes under the nodes of depth ``width``; the number of nodes."""
    columns = [tokens[start[rows] + i] for i in range(depth, width)]
    order = np.lexsort((*reversed(columns), names))
    lcp = np.where(names[order][1:] == names[order][:-1], depth, -1)  # with the neighbour before
    for i, column in enumerate(columns):
        sorted_words = column[order]
        lcp += (lcp == depth + i) & (sorted_words[1:] == sorted_words[:-1])
    deep = lcp >= width
    node = np.cumsum(np.concatenate([[True], ~deep])) - 1
    inside = np.concatenate([[False], deep]) | np.concatenate([deep, [False]])
    label[rows[order[inside]]] = node[inside] + count
    return int(node[-1]) + 1


def _finish(pack, covered):
    if pack is None:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                         "n_removed": pa.array([], pa.int64()), "starts": pa.array([], pa.list_(pa.int32())),
                         "ends": pa.array([], pa.list_(pa.int32())), "kept": pa.array([], pa.binary())})
    texts, off = pack.texts, pack.off
    n_words = np.diff(off)
    removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[off])
    s, e, before = runs(covered, off)
    doc = np.searchsorted(off, s, "right") - 1
    kept = np.flatnonzero(~covered)
    data = texts.data.copy()
    change = np.zeros(len(data) + 1, np.int8)
    change[pack.starts[kept]] += 1
    change[pack.ends[kept]] -= 1
    take = np.cumsum(change[:-1], dtype=np.int8) > 0
    kept_doc = np.searchsorted(off, kept, "right") - 1
    joined = pack.ends[kept[:-1][kept_doc[:-1] == kept_doc[1:]]]  # a separator follows these words
    data[joined] = 0x20
    take[joined] = True
    kept_off = np.concatenate([[0], np.cumsum(take)])[texts.off]
    lists = lambda v: pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(v - off[doc], pa.int32()))
    return pa.table({"doc_id": pack.table["doc_id"], "n_words": pa.array(n_words, pa.int64()),
                     "n_removed": pa.array(removed, pa.int64()), "starts": lists(s), "ends": lists(e),
                     "kept": bytes_column(data[take], kept_off)})


def remove_repeats(docs: DataFrame, width: int = 20, k: int | None = None, **options) -> DataFrame:
    """Remove the words of every window of ``width`` words that also starts earlier in the corpus.

    Earlier: in a document with a smaller doc_id, or before in the same document. Windows are
    judged on the input. Returns a row for each row of ``docs``: doc_id, n_words, n_removed,
    starts and ends (removed runs in words), kept (the other words joined by single blanks, UTF-8).

    Null and empty texts have no words; a null doc_id comes after all others; rows that repeat
    a doc_id count as one document whose places are told apart by position, and equal places do
    not remove each other. Other columns of ``docs`` are not looked at; an empty table gives an empty result.
    """
    return repeats(docs.select("doc_id", "text"), width=width, k=k or max(1, width * 2 // 5), unit="words", within=True,
                   same=deep_nodes, finish=_finish, schema=SCHEMA, **options)
