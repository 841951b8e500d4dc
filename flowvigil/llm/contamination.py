"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets. Each keeps a MinHash sketch: its
shingles with the smallest hashes, as many as a document that holds ``share`` of the item can't
all miss. A document is looked up by all its shingles in the sketches of the partitions whose
items it is large enough to hold, so a short item is found inside a document of any length.
Candidates are verified by exact containment of the item's shingle set. Items of fewer words than a shingle are one
more partition for each number of words: a document is looked up by all its runs of so many words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowvigil.llm.tasks import keep_rows, map_blocks
from flowvigil.llm.text import U64, Texts, grams, mix, word_hashes, words

SHINGLE = 5
SHARE_PERCENT = 80
# Bytes of items' shingle hashes that a pass over the documents broadcasts.
BLOCK_BYTES = 32 << 20


def shingles(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles in order, and offsets of the documents. Fewer words: the whole text as one."""
    starts, ends, off = words(texts)
    h = word_hashes(texts, starts, ends)
    n = np.diff(off)
    g = grams(h, size)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(off[:-1] - out_off[:-1], count)
    index = first + np.arange(out_off[-1])
    out = g[np.minimum(index, max(len(g) - 1, 0))] if len(g) else np.zeros(len(index), U64)
    for d in np.flatnonzero((n > 0) & (n < size)):
        out[out_off[d]] = mix(grams(h[off[d]:off[d + 1]], int(n[d])) ^ U64(n[d]))[0]
    return out, out_off


def runs_of(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, each as ``shingles`` hashes a text of only these words, and offsets of the documents."""
    starts, ends, off = words(texts)
    g = grams(word_hashes(texts, starts, ends), size)
    count = np.maximum(np.diff(off) - size + 1, 0)
    out_off = np.concatenate([[0], np.cumsum(count)])
    return mix(g[np.repeat(off[:-1] - out_off[:-1], count) + np.arange(out_off[-1])] ^ U64(size)), out_off


def _item_sets(items: DataFrame, size: int) -> DataFrame:
    def run(block):
        texts = Texts(block["text"]).lowered()
        h, off = shingles(texts, size)
        sets = [np.unique(h[a:b]) for a, b in zip(off[:-1], off[1:])]
        return pa.table({"item_id": block["item_id"], "n": pa.array(map(len, sets), pa.int64()), "n_words": pa.array(np.diff(words(texts)[2]), pa.int64()),
                         "h": pa.array([s.tobytes() for s in sets], pa.binary())})
    return map_blocks(items.select("item_id", "text"), run, "item_id long, n long, n_words long, h binary").filter("n > 0")


def sketch_size(n: int, percent: int) -> int:
    """One more than the shingles that a document with ``percent`` of an item may lack."""
    return n - (percent * n + 99) // 100 + 1


def _index(sets: list[tuple[int, np.ndarray]], percent: int):
    """Per partition of sizes (powers of two): smallest size, sketch hashes in order, and their items."""
    parts: dict[int, list[int]] = {}
    for i, (_, h) in enumerate(sets):
        parts.setdefault(len(h).bit_length(), []).append(i)
    out = []
    for _, members in sorted(parts.items()):
        hashes = np.concatenate([sets[i][1][:sketch_size(len(sets[i][1]), percent)] for i in members])
        owners = np.concatenate([np.full(sketch_size(len(sets[i][1]), percent), i) for i in members])
        order = np.argsort(hashes, kind="stable")
        out.append((min(len(sets[i][1]) for i in members), hashes[order], owners[order]))
    return out


def contained(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, percent: int = SHARE_PERCENT,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and an item of whose distinct shingles it holds at least ``percent``.

    Returns doc_id, item_id, n_shingles of the item, n_found. Words are runs of anything but
    ASCII white space, A-Z in lower case. An item of fewer than ``shingle`` words is one shingle, and a document holds it that
    has its words as a run.
    Null or blank texts hold nothing and are in nothing; rows that share an id are looked at each
    on their own; empty tables give no pairs. Items are searched in blocks of ``block_bytes`` of
    hashes: a larger benchmark takes more passes over the documents, never more memory.
    """
    found = None
    for shared in _item_blocks(items, shingle, block_bytes):
        search = _searcher(shared, shingle, percent)

        def run(block, search=search):
            ids = block["doc_id"].to_pylist()
            rows = [(ids[d], *rest) for d, *rest in search(block)]
            return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "item_id", "n_shingles", "n_found"), zip(*rows) if rows else [()] * 4)})
        pairs = map_blocks(docs.select("doc_id", "text"), run, "doc_id long, item_id long, n_shingles long, n_found long")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def without_items(docs: DataFrame, items: DataFrame, keep_docs, shingle: int = SHINGLE, percent: int = SHARE_PERCENT,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item as ``contained`` finds it, with all their columns; a row goes by its own text, whatever its id.

    ``keep_docs`` writes a table once and returns it; it is used between the passes of a benchmark of several blocks.
    """
    for number, shared in enumerate(_item_blocks(items, shingle, block_bytes)):
        search = _searcher(shared, shingle, percent)

        def keep(block, search=search):
            out = np.ones(block.num_rows, bool)
            out[[d for d, *_ in search(block)]] = False
            return pa.array(out)
        docs = keep_rows(keep_docs(docs) if number else docs, keep)
    return docs


def _item_blocks(items: DataFrame, shingle: int, block_bytes: int):
    """Broadcasts, each with about ``block_bytes`` of hashes: a list of (item_id, sorted shingles), and for each number of
    words under ``shingle`` (hash, item_id) of the items that have so many."""
    sets = _item_sets(items, shingle)
    total = sets.agg(F.sum(F.octet_length("h"))).first()[0] or 0
    passes = max(1, -(-total // block_bytes))
    for number in range(passes):
        mine = sets if passes == 1 else sets.filter(F.pmod(F.xxhash64("item_id", "h"), F.lit(passes)) == number)
        long, short = [], {}
        for r in mine.select("item_id", "n_words", "h").toLocalIterator():
            h = np.frombuffer(r.h, U64)
            if r.n_words < shingle:
                short.setdefault(r.n_words, []).append((h[0], r.item_id))
            else:
                long.append((r.item_id, h))
        yield items.sparkSession.sparkContext.broadcast((long, short))


def _searcher(shared, shingle: int, percent: int):
    """A function from a block of texts to its rows (row of the block, item_id, n_shingles of the item, n_found)."""
    made = {}

    def search(block):
        sets, short = shared.value
        if "index" not in made:
            made["index"] = _index(sets, percent)
            made["short"] = {size: sorted(pairs, key=lambda p: p[0]) for size, pairs in short.items()}
        texts = Texts(block["text"]).lowered()
        h, off = shingles(texts, shingle)
        n_doc = np.diff(off)
        doc = np.repeat(np.arange(len(n_doc)), n_doc)
        pairs = set()
        for least, hashes, owners in made["index"]:
            low = np.searchsorted(hashes, h)
            hit = np.flatnonzero((hashes[np.minimum(low, len(hashes) - 1)] == h) & (n_doc[doc] * 100 >= percent * least))
            high = np.searchsorted(hashes, h[hit], "right")
            for d, a, b in set(zip(doc[hit].tolist(), low[hit].tolist(), high.tolist())):
                pairs.update((d, int(i)) for i in owners[a:b])
        rows, have = [], (-1, None)
        for d, i in sorted(pairs):
            if have[0] != d:
                have = (d, np.unique(h[off[d]:off[d + 1]]))
            item, want = sets[i]
            common = int(np.isin(want, have[1], assume_unique=True).sum())
            if 100 * common >= percent * len(want):
                rows.append((d, item, len(want), common))
        for size, pairs in made["short"].items():
            known = np.array([h for h, _ in pairs], U64)
            h, off = runs_of(texts, size)
            low, high = np.searchsorted(known, h), np.searchsorted(known, h, "right")
            hit = np.flatnonzero(low < high)
            doc = np.searchsorted(off, hit, "right") - 1
            for d, a, b in sorted(set(zip(doc.tolist(), low[hit].tolist(), high[hit].tolist()))):
                rows += [(d, item, 1, 1) for _, item in pairs[a:b]]
        return rows
    return search
