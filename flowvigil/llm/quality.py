"""Quality rules: gradient-boosted trees over document statistics.

The statistics of all documents are computed without a shuffle and written once. The trees are
fitted on a bounded sample of labelled documents, with monotonic constraints: repetition and
symbols can only lower the score. They are flattened into arrays of nodes, and all rows of a
batch walk down a tree together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowvigil.llm.tasks import keep_rows, map_blocks
from flowvigil.llm.text import U64, Texts, grams, lut, mix, poly, word_hashes, words

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
LETTER = lut((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct",
          "n_letters", "n_digits", "n_closed_lines")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "distinct", "letters", "digits", "closed_lines")
#: 1: a higher value never lowers the score, -1: never raises it, 0: free
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, 0)
LABELLED = 20_000   # labelled documents that the fit reads at most, by hash of the id
TREES, DEPTH, BINS, RATE, LEAF = 60, 3, 32, 0.15, 20
# Share of the good labelled documents that the verdict may reject.
LOST = 0.001


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off])


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each document. A key's low bits are the document's number, as many as ``n`` documents need."""
    bits = U64(max(12, n.bit_length()))
    with np.errstate(over="ignore"):
        own = np.sort(mix(keys + (doc.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)) >> bits << bits | doc.astype(U64))
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    return np.bincount((own[new] & ((U64(1) << bits) - U64(1))).astype(np.int64), minlength=n)


def _repeat_words(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Flags of the words in three-word windows that the same document holds twice or more."""
    flags = np.zeros(len(h), bool)
    g = grams(h, 3)
    if not len(g):
        return flags
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    where = np.flatnonzero(doc[2:] == doc[:-2])
    with np.errstate(over="ignore"):
        key = mix(g[where] + (doc[where].astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(s), bool)
    again[1:] |= same
    again[:-1] |= same
    at = where[order[again]]
    for i in range(3):
        flags[at + i] = True
    return flags


def _statistics(block) -> pa.Table:
    texts = Texts(block["text"])
    data, n = texts.data, len(texts)
    starts, ends, off = words(texts)
    h = word_hashes(texts, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(off))
    begins = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(begins)])
    # lines that hold a word: runs between line breaks
    line_start, line_end, line_off = words(texts, ~lut((0x0A, 0x0A)))
    has = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_doc = np.repeat(np.arange(n), np.diff(line_off))[has]
    lines = poly(data, line_start[has], line_end[has], table=_LINE)
    n_lines = np.bincount(line_doc, minlength=n)
    last = data[line_end[has] - 1] if has.any() else np.zeros(0, np.uint8)
    columns = (
        np.diff(off), np.bincount(doc, weights=chars[ends] - chars[starts], minlength=n).astype(np.int64),
        _sums(SYMBOLS[data], texts.off), n_lines - _distinct(lines, line_doc, n), _sums(_repeat_words(h, off), off),
        _sums(begins, texts.off), n_lines, _distinct(h, doc, n), _sums(LETTER[data] & begins, texts.off),
        _sums((data >= 0x30) & (data <= 0x39), texts.off),
        np.bincount(line_doc, weights=np.isin(last, list(b".!?\"")), minlength=n).astype(np.int64))
    return pa.table({"doc_id": block["doc_id"], **{c: pa.array(v, pa.int64()) for c, v in zip(COUNTS, columns)}})


_LINE = mix(np.arange(1, 257, dtype=U64)) | U64(1)


def statistics(docs: DataFrame) -> DataFrame:
    """A row of COUNTS for each row; a null or empty text has zeros; rows with one doc_id stay apart."""
    return map_blocks(docs.select("doc_id", "text"), _statistics, STATS)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(counts[k], float) for k in COUNTS}
    share = lambda a, b: c[a] / np.maximum(c[b], 1)
    return np.stack([np.log1p(c["n_words"]), share("word_chars", "n_words"), share("n_symbols", "n_chars"),
                     share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_distinct", "n_words"),
                     share("n_letters", "n_chars"), share("n_digits", "n_chars"), share("n_closed_lines", "n_lines")], 1)


@dataclass(frozen=True)
class Trees:
    """All trees as arrays of nodes; a leaf points to itself. ``least`` is the verdict's smallest score."""
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int
    least: float = -np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.split[node], self.left[node], self.right[node])
            total += self.value[node]
        return total


def fit(x: np.ndarray, good: np.ndarray, monotone=MONOTONE, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
        leaf: int = LEAF) -> Trees:
    """Boosting on the log loss. A split that breaks a constraint is not taken, and a node's
    children stay on their sides of the middle between them. One class only: no trees."""
    y = good.astype(float)
    mean = min(max(y.mean() if len(y) else 1.0, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    nodes: list[list[float]] = []  # feature, split, left, right, value
    roots = []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(monotone))]
    binned = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
    total = np.full(len(x), base)

    def grow(rows, level, low, high, g, h):
        number = len(nodes)
        value = float(np.clip(g[rows].sum() / (h[rows].sum() + 1.0), low, high))
        nodes.append([0, np.inf, number, number, rate * value])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * leaf:
            for f, c in enumerate(cuts):
                b = binned[f][rows]
                gs, hs, ns = (np.bincount(b, w, len(c) + 1).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gr, hr = g[rows].sum() - gs, h[rows].sum() - hs
                lv, rv = np.clip(gs / (hs + 1), low, high), np.clip(gr / (hr + 1), low, high)
                gain = gs * lv - (hs + 1) * lv**2 / 2 + gr * rv - (hr + 1) * rv**2 / 2 - g[rows].sum() * value + (h[rows].sum() + 1) * value**2 / 2
                gain[(ns < leaf) | (len(rows) - ns < leaf) | (monotone[f] * (rv - lv) < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), (f, k, (lv[k] + rv[k]) / 2))
        if best[1]:
            f, k, middle = best[1]
            on_left = binned[f][rows] <= k
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high),) * 2}[monotone[f]]
            nodes[number][:2] = [f, cuts[f][k]]
            nodes[number][2] = grow(rows[on_left], level + 1, *bounds[0], g, h)
            nodes[number][3] = grow(rows[~on_left], level + 1, *bounds[1], g, h)
        return number

    made = lambda: Trees(*(np.array([n[i] for n in nodes], t) for i, t in enumerate((int, float, int, int, float))),
                         np.array(roots, int), base, depth)
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        first = len(nodes)
        roots.append(grow(np.arange(len(x)), 0, -4.0, 4.0, y - p, p * (1 - p)))
        one = made()
        total += Trees(one.feature, one.split, one.left, one.right, one.value, np.array([first]), 0.0, depth).score(x)
    return made()


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _sample(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids (smallest hashes); of several labels of one id the lowest counts."""
    one = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit_on(stats: DataFrame, labels: DataFrame, limit: int = LABELLED, lost: float = LOST) -> Trees:
    """Trees fitted on at most ``limit`` labelled rows (smallest hashes of doc_id); labels without quality are left out.

    Of rows that share a labelled id the one with the smallest statistics is taken, so the fit depends on no order of rows.
    The least score lets through all but ``lost`` of the good ones, and is never above even odds.
    """
    sample = _sample(labels, limit)
    one = stats.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("least"))
    rows = one.select("doc_id", "quality", "least.*").toPandas().sort_values("doc_id", kind="stable")
    x, good = features(rows), rows["quality"].to_numpy() > 0
    model = fit(x, good)
    passed = good & (rows["n_words"].to_numpy() >= 50) & (100 * rows["n_repeat_words"].to_numpy() <= 50 * rows["n_words"].to_numpy())
    scores = np.sort(model.score(x[passed]))
    least = min(0.0, float(scores[int(lost * len(scores))])) - 1e-9 if len(scores) and len(model.roots) else -np.inf
    return Trees(**{**model.__dict__, "least": least})


def judge(stats: DataFrame, model: Trees) -> DataFrame:
    """``stats`` with ``base_failed``, ``score`` (log odds of good quality) and ``kept``."""
    def run(batches):
        for batch in batches:
            score = model.score(features({c: batch[c].to_numpy() for c in COUNTS}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(score >= model.least)],
                                             [*batch.schema.names, "score", "passed"])
    scored = stats.mapInArrow(run, STATS + ", score double, passed boolean")
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("passed")).drop("passed")


def verdicts(docs: DataFrame, labels: DataFrame, keep_stats) -> DataFrame:
    """The judged statistics of every row of ``docs``. ``keep_stats`` writes a table once and returns it.

    An empty table gives an empty result; without labels of both classes only the base rule rejects.
    """
    stats = keep_stats(statistics(docs))
    return judge(stats, fit_on(stats, labels))


def passing(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` keeps, with all their columns: each row is judged by its own text, whatever its id."""
    labelled = docs.select("doc_id", "text").join(F.broadcast(_sample(labels, limit).select("doc_id")), "doc_id", "left_semi")
    model = fit_on(statistics(labelled), labels, limit)

    def keep(block):
        made = _statistics(block)
        c = {name: made[name].to_numpy() for name in COUNTS}
        failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
        return pa.array(~failed & (model.score(features(c)) >= model.least))
    return keep_rows(docs, keep)
