"""Quality classifier: supervised subword embeddings.

The words of a document, their character n-grams and runs of two words are hashed into buckets; each bucket has a
learned vector, a document is the average of its buckets' vectors, and a softmax over two classes reads
it. Vectors and output are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled
documents. As averaging and output are linear, scoring needs one number a bucket, the difference of
both classes; it is looked up for all documents, whole texts, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowvigil.llm.tasks import map_blocks
from flowvigil.llm.text import BYTE_VALUES, U64, Texts, grams, mix, word_hashes, words

BUCKETS, DIM = 1 << 18, 16
GRAMS = (3, 4)             # lengths of character n-grams in bytes, with marks at a word's start and end
LABELLED = 8000            # labelled documents that the fit reads at most, by hash of the id
EPOCHS, RATE = 6, 0.5
EVERY = 1                  # bucket that every document has once, so that empty ones have a vector
SAME = U64(0x7F4A7C159E3779B9)  # stands for the second word of a run that repeats the first
_START, _END = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)


@dataclass
class Features:
    """Buckets of a block of texts: those of each distinct word, the word of each token, and those of runs of two words."""

    word_of: np.ndarray     # each token's distinct word
    doc_of: np.ndarray      # each token's document
    part_of: np.ndarray     # the word of each bucket in ``parts``
    parts: np.ndarray
    pairs: np.ndarray       # bucket of each run of two words
    pair_doc: np.ndarray
    n: int                  # documents


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % U64(BUCKETS)).astype(np.int64)


def features(texts: Texts) -> Features:
    starts, ends, before = words(texts)
    h = word_hashes(texts, starts, ends)
    doc = np.repeat(np.arange(len(texts)), np.diff(before))
    names, first, word_of = np.unique(h, return_index=True, return_inverse=True)
    # the distinct words one after the other, each between two marks
    size = ends[first] - starts[first] + 2
    off = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(names)), size)
    at = np.arange(off[-1]) - off[owner]
    values = np.empty(off[-1], U64)
    inner = (at > 0) & (at < size[owner] - 1)
    values[inner] = BYTE_VALUES[texts.data[(starts[first][owner] + at - 1)[inner]]]
    values[off[:-1]], values[off[1:] - 1] = _START, _END
    part_of, parts = [np.arange(len(names))], [_bucket(names)]
    for k in GRAMS:
        g = grams(values, k)
        whole = owner[:len(g)] == owner[k - 1:]
        part_of.append(owner[:len(g)][whole])
        parts.append(_bucket(g[whole]))
    next_to = doc[1:] == doc[:-1]
    left, right = h[:-1][next_to], h[1:][next_to]
    again = left == right
    with np.errstate(over="ignore"):
        pairs = mix(np.where(again, SAME, left * U64(3)) + np.where(again, SAME, mix(right)))
    return Features(word_of, doc, np.concatenate(part_of), np.concatenate(parts), _bucket(pairs), doc[:-1][next_to], len(texts))


def sums(f: Features, table: np.ndarray) -> np.ndarray:
    """For each document the average of ``table`` over its buckets, added up in the order of the text."""
    value = np.bincount(f.part_of, table[f.parts], len(f.word_of) and int(f.word_of.max()) + 1)
    count = np.bincount(f.part_of, minlength=len(value))
    total = np.bincount(f.doc_of, value[f.word_of], f.n) + np.bincount(f.pair_doc, table[f.pairs], f.n) + table[EVERY]
    number = np.bincount(f.doc_of, count[f.word_of], f.n) + np.bincount(f.pair_doc, minlength=f.n) + 1
    return total / number


def bags(f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each document, their shares of all its buckets, and where each document begins."""
    by_word = np.argsort(f.part_of, kind="stable")
    count = np.bincount(f.part_of, minlength=1)
    begin = np.concatenate([[0], np.cumsum(count)])
    n = count[f.word_of] if len(f.word_of) else np.zeros(0, np.int64)
    token = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    bucket = np.concatenate([f.parts[by_word[begin[f.word_of[token]] + inside]], f.pairs, np.full(f.n, EVERY)])
    doc = np.concatenate([f.doc_of[token], f.pair_doc, np.arange(f.n)])
    keys, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
    doc = keys // BUCKETS
    size = np.bincount(doc, times, f.n)
    return keys % BUCKETS, (times / size[doc]).astype(np.float32), np.searchsorted(doc, np.arange(f.n + 1))


@dataclass
class Embeddings:
    """Vectors of the buckets and the output layer (a column a class)."""

    vectors: np.ndarray
    output: np.ndarray

    def table(self) -> np.ndarray:
        """What each bucket adds to the odds of class 1."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)


def train(docs: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Embeddings:
    """Gradient descent, a document a step, on the log loss of the softmax; the rate falls to 0. No documents: even odds for all."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output = np.zeros((DIM, 2), np.float32)
    steps = max(1, epochs * len(docs))
    for epoch in range(epochs):
        for step, i in enumerate(rng.permutation(len(docs)), epoch * len(docs)):
            ids, share = docs[i]
            own = vectors[ids]
            hidden = share @ own
            odds = hidden @ output
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[int(good[i])] -= 1
            g = (rate * (1 - step / steps) * p).astype(np.float32)
            back = output @ g
            output -= np.outer(hidden, g)
            # weighted by their number, so that a step moves a long text's buckets as far as a short one's
            vectors[ids] = own - np.outer(share * np.float32(min(len(ids), 100)), back)
    return Embeddings(vectors, output)


def held_out() -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is divisible by 5. A row without id has no label either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, epochs: int = EPOCHS, rate: float = RATE) -> Embeddings:
    """Embeddings fitted on at most ``limit`` labelled documents that are not held out (smallest hashes of doc_id), whole texts.

    Labels without id or quality are left out; of several labels of one id the lowest counts, of several rows of one id the
    smallest text. Buckets are found everywhere; the steps run one after the other in one task, over the bounded sample in order
    of the hash, so the fit is repeatable. Without labels every text has even odds.
    """
    known = labels.select("doc_id", "quality").dropna().filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def bag(block):
        ids, share, off = bags(features(Texts(block["text"])))
        off = pa.array(off.astype(np.int32))
        return pa.table({"doc_id": block["doc_id"], "quality": block["quality"], "ids": pa.ListArray.from_arrays(off, pa.array(ids.astype(np.int32))),
                         "share": pa.ListArray.from_arrays(off, pa.array(share))})

    def learn(batches):
        texts, good = [], []
        for batch in batches:
            ids, share = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch["ids"], batch["share"]))
            texts += [(ids[0][a:b].copy(), share[0][a:b].copy()) for a, b in zip(ids[1][:-1], ids[1][1:])]
            good += batch["quality"].to_pylist()
        model = train(texts, np.array(good, int) > 0, epochs, rate)
        yield pa.RecordBatch.from_arrays([pa.array([model.vectors.tobytes()]), pa.array([model.output.tobytes()])], ["vectors", "output"])

    bagged = map_blocks(rows, bag, "doc_id long, quality int, ids array<int>, share array<float>")
    made = bagged.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(learn, "vectors binary, output binary").first()
    if made is None:
        return train([], np.zeros(0, bool), epochs, rate)
    return Embeddings(np.frombuffer(made["vectors"], np.float32).reshape(BUCKETS, DIM), np.frombuffer(made["output"], np.float32).reshape(DIM, 2))


def score(docs: DataFrame, model: Embeddings) -> DataFrame:
    """doc_id and ``score``, the probability of class 1, of every row's whole text; null and empty texts are alike.

    Rows with one id are scored each; other columns, of any name, are not looked at; very long texts are a block of their own.
    An empty table gives no rows.
    """
    table = model.table()

    def run(block):
        odds = sums(features(Texts(block["text"])), table)
        return pa.table({"doc_id": block["doc_id"], "score": 1 / (1 + np.exp(-np.clip(odds, -500, 500)))})
    return map_blocks(docs.select("doc_id", "text"), run, "doc_id long, score double")
