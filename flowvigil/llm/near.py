"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. A pass over the texts makes each document's shingle set, an exact key of the set, and a
   one-permutation MinHash of ``BINS`` bins; empty bins are filled by optimal densification.
   Documents with equal sets become one class at once.
2. Classes meet in banded buckets. A bucket proposes a star: its smallest member with each other.
3. Proposed links are confirmed on the full sets, read again for these documents only (a broadcast
   table of bits of bounded size keeps most other texts out; no text is shuffled), and components are
   found by contracting stars (no list of neighbours, nothing on the driver).
4. A star alone can miss a link between two members that both differ from its centre. So in
   buckets whose members are still in several components, all pairs across components that
   the sizes of their shared shingles allow are tried too, block against block inside tasks; no
   rows of pairs are made. With that, no link between documents that meet in any bucket is lost.

Steps are written to the shared folder and removed once the steps that read them are written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowvigil.llm.contamination import shingles
from flowvigil.llm.tasks import map_blocks
from flowvigil.llm.text import U64, Texts, mix
from flowvigil.session import scratch_path
from flowvigil.sources.folders import Folders

BINS, ROWS = 128, 4
_EMPTY = np.iinfo(np.uint64).max
SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
LAST_ID = np.iinfo(np.int64).max
# Members of a star or of a block of a bucket that a task confirms at a time, and their shingles (8 bytes each).
STAR_PART = 400
STAR_SHINGLES = 4 << 20
# Rows, of 64 bits each, of the broadcast table that ids are looked up in while texts are read.
MARKS = 1 << 20


class Steps:
    """Steps of a job, written as Parquet to the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "near")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *steps: DataFrame) -> None:
        """Remove steps that nothing reads any more."""
        for step in steps:
            Folders(self.spark).delete(self.paths.pop(id(step))[1])


def _gap(docs: DataFrame) -> int:
    """A number that no doc_id is: the largest one, or else one of a few others."""
    tried = [LAST_ID, -LAST_ID - 1, *((0x5851F42D4C957F2D * n + 0x14057B7EF767814F) % LAST_ID for n in range(6))]
    used = docs.agg(*(F.max(F.col("doc_id") == F.lit(n)).alias(f"u{i}") for i, n in enumerate(tried))).first()
    return next(n for n, u in zip(tried, used) if not u)


def _likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is a ``v`` of ``ids``, and some others; no text is shuffled.

    Each id is one bit of a table of MARKS words, which is broadcast, and rows without their bit are left out. The more ids,
    the more other rows get through; the joins that follow leave them out. None that is wanted is lost.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS * 64))
    marks = (ids.select(bit("v").alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("marks")))
    dealt = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "text").withColumn("bit", bit("doc_id"))
    return dealt.join(F.broadcast(marks), F.shiftright("bit", 6) == F.col("word")).filter(
        "shiftright(marks, cast(bit & 63 as int)) & 1 = 1").select("doc_id", "text")


def _parts(size: str) -> F.Column:
    """In how many parts a group is cut: by its members, and by the shingles that they have together."""
    return F.greatest(F.ceil(F.count("*") / F.lit(STAR_PART)), F.ceil(F.sum(size) / F.lit(STAR_SHINGLES))).cast("int")


def _sets(block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each document, and offsets."""
    h, off = shingles(Texts(block["text"]).lowered(), size)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[off[:-1][off[:-1] < len(h)]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[off]


def one_permutation(h: np.ndarray, off: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Smallest hash of each bin; an empty bin takes that of the first bin, in an order of its own, which is not empty."""
    n = len(off) - 1
    low = np.full(n * bins, _EMPTY, U64)
    doc = np.repeat(np.arange(n), np.diff(off))
    mixed = mix(h ^ U64(0x2545F4914F6CDD1D))
    np.minimum.at(low, doc * bins + (mixed % U64(bins)).astype(np.int64), mixed // U64(bins))
    low = low.reshape(n, bins)
    full = low != _EMPTY
    rows, at = np.nonzero(~full & full.any(1)[:, None])
    attempt = 1
    while len(rows):
        other = (mix(at.astype(U64) * U64(1 << 32) + U64(attempt)) % U64(bins)).astype(np.int64)
        good = full[rows, other]
        low[rows[good], at[good]] = low[rows[good], other[good]]
        rows, at = rows[~good], at[~good]
        attempt += 1
    return low


def sketches(docs: DataFrame, shingle: int, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    def run(block):
        h, off = _sets(block, shingle)
        low = one_permutation(h, off, bins)
        bands = np.zeros((len(low), bins // rows), U64)
        with np.errstate(over="ignore"):
            for i in range(rows):
                bands = mix(bands * U64(0x9E3779B97F4A7C15) + low[:, i::rows])
            bands = mix(bands + np.arange(bins // rows, dtype=U64))
            total = lambda v: np.diff(np.concatenate([[U64(0)], np.cumsum(v, dtype=U64)])[off]).view(np.int64)
            s1, s2 = total(mix(h)), total(mix(h * U64(3) + U64(1)))
        n = np.diff(off)
        flat = pa.array(bands.view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1) * (bins // rows), pa.int32()), flat)
        ids = block["doc_id"].fill_null(LAST_ID)
        return pa.table({"doc_id": ids, "n_shingles": pa.array(n, pa.int64()), "s1": pa.array(s1), "s2": pa.array(s2), "bands": lists})
    return map_blocks(docs.select("doc_id", "text"), run, SKETCH)


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(block):
        h, off = _sets(block, shingle)
        return pa.table({"v": block["doc_id"].fill_null(LAST_ID), "h": pa.array([h[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())})
    return map_blocks(docs.select("doc_id", "text"), run, "v long, h binary")


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, steps: Steps) -> DataFrame:
    """The pairs (v, c) of ``pairs`` (v, c, n: shingles of v) whose sets have 100 * intersection >= percent * union."""
    needed = pairs.select("v").union(pairs.select("c")).distinct()
    sets = steps.write(full_sets(_likely(docs, needed), shingle))
    parts = pairs.groupBy("c").agg(_parts("n").alias("parts"))
    centres = (parts.join(sets.withColumnRenamed("v", "c"), "c")
               .select(F.col("c").alias("k"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("kpart"), F.col("h").alias("kh")))
    members = (pairs.join(parts, "c").join(sets, "v")
               .select("c", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), "v", "h"))

    def run(key, left, right):
        good = []
        for centre in right["kh"].to_pylist():
            a = np.frombuffer(centre, U64)
            for v, h in zip(left["v"].to_pylist(), left["h"]):
                if _linked(a, np.frombuffer(h.as_buffer(), U64), percent):
                    good.append(v)
        return pa.table({"v": pa.array(good, pa.int64()), "c": pa.array([key[0].as_py()] * len(good), pa.int64())})
    links = steps.write(members.groupBy("c", "part").cogroup(centres.groupBy("k", "kpart")).applyInArrow(run, "v long, c long").distinct())
    steps.drop(sets)
    return links


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(v, component) of every vertex of ``edges`` (v, c); the component is its smallest vertex.

    Alternates the two star contractions until the edges stay the same; each round is written to the shared folder.
    """
    now = steps.write(edges.select(F.greatest("v", "c").alias("v"), F.least("v", "c").alias("c")).filter("v > c").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, c))")).first()
        if state == before:
            found = steps.write(now.select("v", F.col("c").alias("component")).union(now.select("c", "c").distinct()))
            steps.drop(now)
            return found
        before = state
        both = now.union(now.select("c", "v"))
        large = (both.join(both.groupBy("v").agg(F.least(F.min("c"), F.col("v")).alias("m")), "v")
                 .filter("c > v").select(F.col("c").alias("v"), F.col("m").alias("c")).filter("v > c").distinct())
        low = large.groupBy("v").agg(F.min("c").alias("m"))
        last, now = now, steps.write(large.join(low, "v").filter("c > m").select(F.col("c").alias("v"), F.col("m").alias("c"))
                                     .union(low.select("v", "m")).distinct())
        steps.drop(last)


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept for each row.

    Documents are linked if 100 * intersection >= percent * union of their sets of word
    shingles (A-Z in lower case; fewer words are one shingle). Null, empty and blank texts have an
    empty set and no links. Rows that share a doc_id count as one document: linked with each other,
    and with what any of them is linked with. Null ids count as one id after all others; it is null
    in the result, and kept if alone. Other columns are not looked at; an empty table gives none.
    """
    steps, gap, id_ = Steps(docs.sparkSession), _gap(docs), F.col("doc_id")
    # ids above the gap move down by one, so that the largest number is free for null
    docs = docs.select(F.when(id_.isNull(), LAST_ID).when(id_ > gap, id_ - 1).otherwise(id_).alias("doc_id"), "text")
    made = steps.write(sketches(docs, shingle, bins, rows))
    some = made.filter("n_shingles > 0")
    classes = steps.write(some.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("v"), F.first("bands").alias("bands")))
    sets = steps.write(made.drop("bands"))
    steps.drop(made)
    members = classes.select("v", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.min("v").alias("c"), F.max("v").alias("other")).filter("c < other").drop("other")
    members = steps.write(members.join(crowded, "bucket").select("bucket", "v", "n", "c"))
    possible = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    sizes = classes.select(F.col("v").alias("c"), F.col("n_shingles").alias("cn"))
    pairs = members.filter("v > c").select("v", "c", "n").distinct().join(sizes, "c").filter(possible(F.col("n"), F.col("cn")))
    pairs = steps.write(pairs.select("v", "c", "n").distinct())
    links = confirm(pairs, docs, shingle, percent, steps)
    steps.drop(pairs)
    groups = components(links, steps)
    named = members.select("bucket", "v", "n").join(groups, "v", "left").withColumn("component", F.coalesce("component", "v"))
    split = named.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("bucket")
    named = steps.write(named.join(split, "bucket"))
    steps.drop(members)
    more = _rest(named, classes, docs, shingle, percent, steps)
    steps.drop(named)
    if not more.isEmpty():
        steps.drop(groups)
        groups = components(links.union(more), steps)
    ids = classes.select("s1", "s2", "n_shingles", "v").join(groups, "v", "left").select(
        "s1", "s2", "n_shingles", F.coalesce("component", "v").alias("component"))
    ids = steps.write(ids)
    steps.drop(classes, groups, links, more)
    out = (sets.join(ids, ["s1", "s2", "n_shingles"], "left")
           .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
    real = lambda c: F.when(F.col(c) < LAST_ID, F.when(F.col(c) >= gap, F.col(c) + 1).otherwise(F.col(c)))
    return out.select(real("doc_id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"),
                      (F.col("doc_id") == F.col("component_id")).alias("kept"))


def own_shingles(members: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(v, own): how many shingles of each member stand in no other member (or fewer: some other documents may be looked at too)."""
    def run(block):
        h, off = _sets(block, shingle)
        lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(h.view(np.int64)))
        return pa.table({"v": block["doc_id"].fill_null(LAST_ID), "hs": lists})
    single = (map_blocks(_likely(docs, members.select("v").distinct()), run, "v long, hs array<long>").select("v", F.explode("hs").alias("h"))
              .groupBy("h").agg(F.min("v").alias("v"), F.count("*").alias("times")).filter("times = 1"))
    return single.groupBy("v").agg(F.count("*").alias("own"))


def _pairs(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a block pair that can be links and meet in no earlier band than this bucket's."""
    get = lambda c: table[c].to_numpy()
    n, most, component, own, bucket = get("n"), get("most"), get("component"), get("own"), get("bucket")[0]
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(n), -1)
    i, k = get("i")[0], get("k")[0]
    left = np.flatnonzero(own == i)
    right = np.flatnonzero(own == k)
    out = []
    for x in left.tolist():
        y = right[right > x] if i == k else right
        y = y[(component[y] != component[x]) & ((100 + percent) * np.minimum(most[y], most[x]) >= percent * (n[y] + n[x]))]
        if len(y):
            first = (bands[y] == bands[x]).argmax(1)
            y = y[bands[x, first] == bucket]
            out.append((np.full(len(y), x), y))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int),) * 2


def _rest(named: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int, steps: Steps) -> DataFrame:
    """Links (v, c) between members of one bucket that are in different components.

    Shingles that only one of these members has are in no intersection, so copies that were
    each edited on their own drop out by the sizes of what is left of their sets. A bucket is cut
    into blocks by members and shingles; a task looks at one pair of blocks, first without the
    sets, then with the sets of those members that have a pair left.
    """
    rest = named.join(own_shingles(named, docs, shingle), "v", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    rest = steps.write(rest.filter(100 * F.col("most") >= percent * F.col("n")))
    parts = rest.groupBy("bucket").agg(_parts("n").alias("parts"), F.min("component").alias("a"),
                                       F.max("component").alias("b")).filter("a < b").drop("a", "b")
    bands = classes.select(F.col("v").alias("bv"), "bands")
    blocks = (rest.join(parts, "bucket").withColumn("own", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .join(bands, F.col("v") == F.col("bv"))
              .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("k"), "own", "v", "n", "most", "component", "bands"))
    kind = "bucket long, i int, k int, own int, v long, n long, most long, component long, bands array<long>"

    def involved(key, table):
        table = table.combine_chunks()
        return table.take(pa.array(np.unique(np.concatenate(_pairs(table, percent)))))
    left = steps.write(blocks.groupBy("bucket", "i", "k").applyInArrow(involved, kind))
    sets = full_sets(_likely(docs, left.select("v").distinct()), shingle).select(F.col("v").alias("sv"), "h")

    def linked(key, table):
        table = table.combine_chunks()
        h = [np.frombuffer(x.as_buffer(), U64) for x in table["h"]]
        v = table["v"].to_numpy()
        good = [(max(v[x], v[y]), min(v[x], v[y])) for x, y in zip(*(c.tolist() for c in _pairs(table, percent))) if _linked(h[x], h[y], percent)]
        return pa.table({"v": pa.array([g[0] for g in good], pa.int64()), "c": pa.array([g[1] for g in good], pa.int64())})
    found = steps.write(left.join(sets, F.col("v") == F.col("sv")).drop("sv").groupBy("bucket", "i", "k").applyInArrow(linked, "v long, c long").distinct())
    steps.drop(rest, left)
    return found


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
