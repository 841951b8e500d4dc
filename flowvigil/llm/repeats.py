"""Windows that repeat somewhere else in the corpus, found without shuffling every window.

Each window of ``width`` tokens is filed under its *anchor*: the run of ``k`` tokens in it
with the smallest hash. Equal windows have equal anchors, and neighbouring windows mostly
share one, so a run of windows travels as one short piece of text.

1. ``packs``: documents are dealt into packs of a few MB by a hash of the id.
2. Each pack sends the distinct hashes of its anchors (or of anchors with half of what a window has
   beside them) to buckets; a bucket answers which of them are in two packs or more. All others
   are settled inside their pack.
3. Each pack sends the distinct pieces around shared anchors, each with its smallest owner:
   however often a passage is copied, it counts once a pack. Anchors in very many packs are
   sent window by window and dealt by the window, so no bucket gathers a frequent anchor.
4. A bucket groups equal windows (the ``same`` function: a suffix tree or radix passes) and
   answers which windows of which piece have an owner before their own.
5. The pack marks what these windows cover.

Every step is a shuffle of Spark over rows bounded by the pack and bucket sizes; the number
of packs and buckets follows the bytes of the table. All steps are deterministic, so lost
tasks are simply run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowvigil.llm.text import BASES, BYTE_VALUES, U64, Texts, grams, mix, poly, sliding_min, word_hashes, words

PACK_BYTES = 2 << 20
BUCKET_BYTES = 6 << 20
# An anchor in this many packs is dealt by window.
HOT_PACKS = 200
STEP = 1 << 18
LAST_ID = np.iinfo(np.int64).max
_POS = 24
_LOW = U64((1 << _POS) - 1)

GRAMS = "bucket int, pack int, grams binary"
SHARED = "pack int, kind int, a binary, b binary"
PIECES = "bucket int, pack int, base int, doc binary, pos binary, off binary, cnt binary, size binary, raw int, text binary"
_SHORT = U64(16)  # anchors are told apart by the upper 48 bits of their hash


@dataclass(frozen=True)
class Plan:
    """What the tasks need to know. ``same`` groups equal windows, ``within`` says whether an
    earlier place in the same document counts as an owner."""
    width: int
    k: int
    unit: str
    within: bool
    buckets: int
    hot_packs: int
    same: Callable[..., np.ndarray]
    halves: bool = False


class Pack:
    """The documents of a pack in order of id, as tokens."""

    def __init__(self, plan: Plan, table: pa.Table):
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.plan, self.table, self.texts = plan, table, Texts(table["text"])
        ids = table["doc_id"]
        self.ids = ids.fill_null(LAST_ID).to_numpy()
        if plan.unit == "words":
            self.starts, self.ends, self.off = words(self.texts)
            self.tokens = word_hashes(self.texts, self.starts, self.ends)
            self.values = None
        else:
            self.off, self.tokens, self.values = self.texts.off, self.texts.data, BYTE_VALUES

    def pieces(self) -> None:
        """Anchor ``a``, first window ``p`` and number of windows ``c`` of each piece, and the anchor's hash ``g``."""
        plan, n = self.plan, len(self.tokens)
        width, k = plan.width, plan.k
        valid = np.ones(n, bool)
        for s, e in zip(self.off[:-1], self.off[1:]):
            valid[max(s, e - width + 1):e] = False
        parts = []
        for s in range(0, n - width + 1, STEP):
            tokens = self.tokens[s:s + STEP + width - 1]
            h = grams(tokens if self.values is None else self.values[tokens], k)
            low = sliding_min((h & ~_LOW) | np.arange(len(h), dtype=U64), width - k + 1)
            where = np.flatnonzero(valid[s:s + len(low)])
            anchor = (low[where] & _LOW).astype(np.int64)
            first = np.flatnonzero(np.diff(anchor, prepend=-1))
            parts.append((anchor[first] + s, where[first] + s, np.diff(first, append=len(anchor)), h[anchor[first]]))
        a, p, c, g = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [()] * 4))
        first = np.flatnonzero(np.diff(a, prepend=-1))  # pieces cut by STEP become one again
        self.a, self.p, self.g = a[first], p[first], g[first].astype(U64)
        self.c = np.add.reduceat(c, first) if len(first) else c
        self.anchor = self.g
        if plan.halves and len(first):
            self._halve()

    def _halve(self) -> None:
        """Cut each piece in two, by whether its windows reach further to the left or to the right of the anchor.

        ``g`` becomes the hash of the anchor with what all windows of the half have beside it. Equal windows
        have equal anchors at equal distances, so they are in halves of equal hashes.
        """
        plan = self.plan
        left = (plan.width - plan.k + 1) // 2
        right = plan.width - plan.k - left + 1
        first = np.clip(self.a - self.p - left + 1, 0, self.c)
        a, anchor = np.repeat(self.a, 2), np.repeat(self.anchor, 2)
        p = np.column_stack([self.p, self.p + first]).ravel()
        c = np.column_stack([first, self.c - first]).ravel()
        g = np.zeros((len(first), 2), U64)
        for side, (before, after) in enumerate(((left, 0), (0, right))):
            some = np.flatnonzero(c[side::2])
            at = self.a[some]
            g[some, side] = mix(poly(self.tokens, at - before, at + plan.k + after, BASES[1], self.values) + U64(side))
        real = c > 0
        self.a, self.p, self.c, self.g, self.anchor = a[real], p[real], c[real], g.ravel()[real], anchor[real]

    def select(self, where: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
        """The pieces at ``where``, two halves as one; those flagged in ``hot`` window by window."""
        a, p, c, g = self.a[where], self.p[where], self.c[where], self.anchor[where]
        second = np.zeros(len(a) + 1, bool)
        second[1:-1] = (a[1:] == a[:-1]) & ~hot[1:] & ~hot[:-1]
        c = c + np.where(second[1:], np.append(c[1:], 0), 0) if len(c) else c
        a, p, c, g, hot = (v[~second[:-1]] for v in (a, p, c, g, hot))
        times = np.where(hot, c, 1)
        row = np.repeat(np.arange(len(a)), times)
        step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        a, p, g, c = a[row], p[row] + step, g[row], np.where(hot, 1, c)[row]
        ends = p + c + self.plan.width - 1
        h1, h2 = _identity(self.tokens, self.values, p, ends, a - p, c)
        doc = np.searchsorted(self.off, p, "right") - 1
        pos = a - self.off[doc] if self.plan.within else np.zeros(len(a), np.int64)
        return {"g": g, "doc": self.ids[doc], "pos": pos, "off": a - p, "cnt": c, "h1": h1, "h2": h2, "start": p, "end": ends, "hot": hot[row]}

    def texts_at(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the given runs of tokens, and their sizes."""
        if self.plan.unit == "words":
            start, end = self.starts[start], self.ends[end - 1]
        size = end - start
        return self.texts.data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


def _identity(tokens, values, start, end, off, cnt) -> list[np.ndarray]:
    """Two hashes of the tokens of each piece and of the place of its anchor."""
    shape = mix((off * 64 + cnt).astype(U64))
    return [mix(poly(tokens, start, end, base, values) ^ shape) for base in BASES]


def _order(plan: Plan, x: dict[str, np.ndarray], reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pieces of a pack in the order they are sent, and their buckets."""
    bucket = _bucket(np.where(x["hot"][reps], x["h1"][reps], x["g"][reps]), plan.buckets)
    order = np.lexsort((x["start"][reps], bucket))
    return order, bucket[order]


def distinct(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For equal pieces the one with the smallest owner: its index, and for each piece its number among these."""
    order = np.lexsort((x["pos"], x["doc"], x["h2"], x["h1"]))
    h1, h2 = x["h1"][order], x["h2"][order]
    new = np.ones(len(order), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def later(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the owners at ``i`` come after those at ``j``."""
    return (x["doc"][i] > x["doc"][j]) | ((x["doc"][i] == x["doc"][j]) & (x["pos"][i] > x["pos"][j]))


def ones(count: np.ndarray) -> np.ndarray:
    return (U64(1) << count.astype(U64)) - U64(1)


def settle(x: dict[str, np.ndarray], tokens: np.ndarray, width: int, same) -> np.ndarray:
    """For each piece the bits of its windows that have an owner before the piece's own."""
    if not len(x["g"]):
        return np.zeros(0, U64)
    reps, number = distinct(x)
    bits = np.where(later(x, np.arange(len(number)), reps[number]), ones(x["cnt"]), U64(0))
    order = np.argsort(x["g"][reps], kind="stable")
    reps_by_g = reps[order]
    g = x["g"][reps_by_g]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(first, append=len(g))
    many = np.repeat(size > 1, size)
    chosen, gid = reps_by_g[many], np.repeat(np.arange(len(first)), size)[many]
    marks = np.zeros(len(x["g"]), U64)
    # batches of whole groups with about STEP windows each
    total = np.cumsum(x["cnt"][chosen])
    start = 0
    while start < len(chosen):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + STEP, "right")))
        while stop < len(chosen) and gid[stop] == gid[stop - 1]:
            stop += 1
        rows = chosen[start:stop]
        count = x["cnt"][rows]
        piece = np.repeat(rows, count)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        label = same(tokens, x["start"][piece] + step, np.repeat(gid[start:stop], count) * 64 + x["off"][piece] - step, width)
        shared = np.flatnonzero(label >= 0)
        order = shared[np.lexsort((x["pos"][piece[shared]], x["doc"][piece[shared]], label[shared]))]
        if len(order):
            head = np.concatenate([[True], label[order][1:] != label[order][:-1]])
            owner = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
            late = order[later(x, piece[order], piece[owner])]
            np.bitwise_or.at(marks, piece[late], U64(1) << step[late].astype(U64))
        start = stop
    # an equal piece of the same owner shares the marks; a later one is marked whole
    return bits | np.where(bits == 0, marks[reps[number]], U64(0))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    # anchors have small hashes, so these are mixed once more
    return ((mix(h) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _split(keys: np.ndarray) -> list[tuple[int, slice]]:
    """Slices of equal keys in a sorted array."""
    cuts = np.flatnonzero(np.diff(keys, prepend=-1))
    return [(int(keys[a]), slice(a, b)) for a, b in zip(cuts, [*cuts[1:], len(keys)])]


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[t]) for (n, t), c in zip(fields, columns)})


def _whole(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _send_grams(plan: Plan):
    def run(key, table):
        pack = Pack(plan, table)
        pack.pieces()
        g = np.unique(pack.g >> _SHORT)
        bucket = _bucket(g, plan.buckets)
        order = np.argsort(bucket, kind="stable")
        short = np.ascontiguousarray(g[order].view(np.uint16).reshape(-1, 4)[:, :3])
        return _rows(GRAMS, [(b, key[0].as_py(), short[s].tobytes()) for b, s in _split(bucket[order])])
    return run


def _shared_grams(plan: Plan):
    return lambda key, table: _shared(table, plan.hot_packs)


def _shared(table, hot_packs: int):
    blobs = table["grams"].to_pylist()
    packs = np.repeat(table["pack"].to_numpy(), [len(b) // 6 for b in blobs])
    g = _long(b"".join(blobs))
    order = np.argsort(g, kind="stable")
    s = g[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(first, append=len(s))
    count = np.repeat(size, size)
    keep = count > 1
    where = order[keep]
    by = np.argsort(packs[where], kind="stable")
    packs, g, hot = packs[where][by], g[where][by], (count[keep] >= hot_packs).astype(np.uint8)[by]
    short = np.ascontiguousarray(g.view(np.uint16).reshape(-1, 4)[:, :3])
    return _rows(SHARED, [(p, 0, short[s].tobytes(), hot[s].tobytes()) for p, s in _split(packs)])


def _long(data: bytes) -> np.ndarray:
    """48-bit numbers as 64-bit ones."""
    out = np.zeros((len(data) // 6, 4), np.uint16)
    out[:, :3] = np.frombuffer(data, np.uint16).reshape(-1, 3)
    return out.view(U64).ravel()


def _known(plan: Plan, left: pa.Table, right: pa.Table):
    """The pack with its pieces, and those with shared anchors."""
    pack = Pack(plan, left)
    pack.pieces()
    told = right.filter(pa.compute.equal(right["kind"], 0))
    g, hot = _long(b"".join(told["a"].to_pylist())), _whole(told["b"], np.uint8)
    order = np.argsort(g)
    g, hot = g[order], hot[order] > 0
    mine = pack.g >> _SHORT
    at = np.minimum(np.searchsorted(g, mine), max(len(g) - 1, 0))
    shared = g[at] == mine if len(g) else np.zeros(len(pack.g), bool)
    where = np.flatnonzero(shared)
    x = pack.select(where, hot[at[where]])
    return pack, shared, x


_FIELDS = (("doc", np.int64), ("pos", np.int32), ("off", np.uint8), ("cnt", np.uint8))


def _send_pieces(plan: Plan):
    def run(key, left, right):
        if not left.num_rows:
            return _rows(PIECES, [])
        pack, _, x = _known(plan, left, right)
        reps, _ = distinct(x)
        order, bucket = _order(plan, x, reps)
        out = []
        for b, s in _split(bucket):
            rows = reps[order[s]]
            text, size = pack.texts_at(x["start"][rows], x["end"][rows])
            out.append((b, key[0].as_py(), s.start, *(x[n][rows].astype(t).tobytes() for n, t in _FIELDS),
                        size.astype(np.int32).tobytes(), len(text), pa.compress(text.tobytes(), "zstd", asbytes=True)))
        return _rows(PIECES, out)
    return run


def _settle_bucket(plan: Plan):
    def run(key, table):
        x = {n: _whole(table[n], t).astype(np.int64) for n, t in _FIELDS}
        counts = [len(b) for b in table["cnt"].to_pylist()]
        packs = np.repeat(table["pack"].to_numpy(), counts)
        number = np.arange(len(packs)) - np.repeat(np.cumsum(counts) - counts - table["base"].to_numpy(), counts)
        data = b"".join(pa.decompress(t, n, "zstd", asbytes=True) for t, n in zip(table["text"].to_pylist(), table["raw"].to_pylist()))
        off = np.concatenate([[0], np.cumsum(_whole(table["size"], np.int32), dtype=np.int64)])
        tokens = np.frombuffer(data, np.uint8)
        values = BYTE_VALUES
        if plan.unit == "words":
            texts = Texts.of(tokens, off)
            starts, ends, off = words(texts)
            tokens, values = word_hashes(texts, starts, ends), None
        x["start"] = off[:-1]
        anchor = x["start"] + x["off"]
        x["g"] = poly(tokens, anchor, anchor + plan.k, BASES[0], values)
        x["h1"], x["h2"] = _identity(tokens, values, off[:-1], off[1:], x["off"], x["cnt"])
        bits = settle(x, tokens, plan.width, plan.same)
        where = np.flatnonzero(bits)
        where = where[np.argsort(packs[where], kind="stable")]
        return _rows(SHARED, [(p, 1, number[where[s]].astype(np.int32).tobytes(), bits[where[s]].astype(np.uint32).tobytes())
                              for p, s in _split(packs[where])])
    return run


def _mark(plan: Plan, finish):
    def run(key, left, right):
        if not left.num_rows:
            return finish(None, None)
        pack, shared, x = _known(plan, left, right)
        reps, number = distinct(x)
        told = right.filter(pa.compute.equal(right["kind"], 1))
        marks = np.zeros(len(reps), U64)
        marks[_order(plan, x, reps)[0][_whole(told["a"], np.int32)]] = _whole(told["b"], np.uint32)
        all_bits = later(x, np.arange(len(number)), reps[number]) if len(number) else np.zeros(0, bool)
        bits = [np.where(all_bits, ones(x["cnt"]), marks[number])]
        starts, counts = [x["start"]], [x["cnt"]]
        # anchors of this pack alone
        own = np.flatnonzero(~shared)
        if len(own):
            g = pack.g[own]
            values, inverse, times = np.unique(g, return_inverse=True, return_counts=True)
            own = own[times[inverse] > 1]
        y = pack.select(own, np.zeros(len(own), bool))
        bits.append(settle(y, pack.tokens, plan.width, plan.same))
        starts.append(y["start"])
        counts.append(y["cnt"])
        bits, starts, counts = (np.concatenate(v) for v in (bits, starts, counts))
        flag = np.zeros(len(pack.tokens) + 1, np.int32)
        for i in range(int(counts.max()) if len(counts) else 0):
            flag[starts[(bits >> U64(i)) & U64(1) > 0] + i] = 1
        total = np.cumsum(flag)
        covered = total[:len(pack.tokens)].copy()
        covered[plan.width:] -= total[:max(0, len(pack.tokens) - plan.width)]
        return finish(pack, covered > 0)
    return run


def repeats(docs: DataFrame, *, width: int, k: int, unit: str, within: bool, same, finish, schema: str,
            pack_bytes: int = PACK_BYTES, hot_packs: int = HOT_PACKS, halves: bool = False) -> DataFrame:
    """Apply ``finish(pack, covered)`` to every pack, ``covered`` flagging the tokens that repeated windows cover.

    ``docs`` has columns doc_id (long) and text; null ids come after all others. With ``halves`` packs tell each
    other the anchors with what stands left or right of them: more hashes, but few pieces that share a short phrase only.
    """
    sized = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    packs = max(1, -(-sized // pack_bytes))
    k = max(k, width - 31)  # the windows of an anchor are the bits of 32
    plan = Plan(width, k, unit, within, max(8, -(-sized // BUCKET_BYTES)), hot_packs, same, halves)
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(packs)).cast("int").alias("pack"))
    by_pack = dealt.groupBy("pack")
    shared = (by_pack.applyInArrow(_send_grams(plan), GRAMS)
              .groupBy("bucket").applyInArrow(_shared_grams(plan), SHARED))
    settled = (by_pack.cogroup(shared.groupBy("pack")).applyInArrow(_send_pieces(plan), PIECES)
               .groupBy("bucket").applyInArrow(_settle_bucket(plan), SHARED))
    return by_pack.cogroup(shared.unionByName(settled).groupBy("pack")).applyInArrow(_mark(plan, finish), schema)
