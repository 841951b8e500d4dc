"""Merkle manifest of a data set: a tree per part (language), a tree over the parts, a proof per row.

Rows are hashed in the scan; only digests are shuffled after that. Trees are built ten levels at
a time from aligned blocks of 1024 nodes. Proofs come from pointer jumping: every node holds the
siblings on the way to an ancestor, and a self-join with the nodes that stand at the end of these
ways doubles the distance and concatenates the segments, until every leaf has reached its root.
After round j only nodes on levels divisible by 2**j are needed, so the side that is looked up
shrinks to its square root from round to round.

A segment is a run of entries of ENTRY bytes, one a level: a mark (no sibling, one on the left, one on
the right) and the sibling's digest.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowvigil.operators.skew import attach_by_key, number_rows
from flowvigil.session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = 10                    # levels built from one shuffle
ENTRY = 33
ALONE, LEFT, RIGHT = b"\0" * ENTRY, b"\1", b"\2"
BROADCAST = 32 << 20         # bytes that a side may have at most to be broadcast
NODES = "tree long, n long, level int, idx long, digest string, seg binary"


def field(c: Column) -> Column:
    """``-`` for null, else length in bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(**changed: Column) -> Column:
    """Digest of a row; ``changed`` replaces columns."""
    return digest(*(field(changed.get(c, F.col(c))) for c in FIELDS))


def _block(base: int):
    def run(key, table):
        table = table.sort_by("idx")
        tree, n = table["tree"][0].as_py(), table["n"][0].as_py()
        now, first, out = table["digest"].to_pylist(), table["idx"][0].as_py(), []
        for level in range(base, base + STEP):
            size = (n + (1 << level) - 1) >> level
            if size == 1:
                break
            for i, own in enumerate(now):
                pair = i ^ 1
                seg = ALONE if pair >= len(now) else (RIGHT if pair > i else LEFT) + bytes.fromhex(now[pair])
                out.append((tree, n, level, first + i, own, seg))
            now = [hashlib.sha256("".join(now[i:i + 2]).encode()).hexdigest() for i in range(0, len(now), 2)]
            first >>= 1
        else:
            level = base + STEP
        top = ((n + (1 << level) - 1) >> level) == 1
        out.append((tree, n, level, first, now[0], b"" if top else None))
        names, kinds = [x.split()[0] for x in NODES.split(",")], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    return run


def build(leaves: DataFrame, largest: int) -> DataFrame:
    """All nodes of the trees over ``leaves`` (tree, n leaves in it, idx from 0, digest), the largest with ``largest`` leaves.

    ``seg`` has a node's own sibling; a root's is empty. Groups have 2**STEP rows at most, whatever the size of a tree.
    """
    now, done, base = leaves.select("tree", "n", "idx", "digest"), None, 0
    while True:
        made = materialise(now.groupBy("tree", F.shiftright("idx", STEP).alias("block")).applyInArrow(_block(base), NODES))
        nodes = made.filter("seg is not null")
        done = nodes if done is None else done.unionByName(nodes)
        base += STEP
        if largest <= 1 << base:
            return done
        now = made.filter("seg is null").select("tree", "n", "idx", "digest")


def proofs(nodes: DataFrame, leaves: int, largest: int) -> DataFrame:
    """(tree, idx, seg) of every leaf: its siblings from the leaf to the root, by doubling.

    ``leaves`` in all trees bound the looked-up side: of levels of at least d there are less than 3 * leaves / 2**d nodes
    in trees that high. It is broadcast only where this bound times the length of its segments is small.
    """
    held, d = nodes.select("tree", "level", "idx", "seg"), 1
    while 1 << d < largest:
        left = held.filter(F.col("level") % (2 * d) == 0)
        # written, so that the next rounds' plans do not hold this one twice
        right = materialise(held.filter(F.col("level") % (2 * d) == d).select(
            "tree", (F.col("level") - d).alias("level"), F.col("idx").alias("up"), F.col("seg").alias("more")))
        if 3 * (leaves >> d) * (ENTRY * d + 60) <= BROADCAST:
            right = F.broadcast(right)
        joined = left.withColumn("up", F.shiftright("idx", d)).join(right, ["tree", "level", "up"], "left")
        held = joined.select("tree", "level", "idx", F.concat("seg", F.coalesce("more", F.lit(b""))).alias("seg"))
        d *= 2
    return held.filter("level = 0").select("tree", "idx", "seg")


def _steps(seg: Column) -> Column:
    n = (F.octet_length(seg) / ENTRY).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _mark(seg: Column, i: Column) -> Column:
    return F.substring(seg, i * ENTRY + 1, F.lit(1))


def _sibling(seg: Column, i: Column) -> Column:
    return F.lower(F.hex(F.substring(seg, i * ENTRY + 2, F.lit(ENTRY - 1))))


def siblings(seg: Column) -> Column:
    """The siblings' digests of a proof in hex, from the leaf upwards."""
    return F.transform(F.filter(_steps(seg), lambda i: _mark(seg, i) != F.lit(b"\0")), lambda i: _sibling(seg, i))


def fold(start: Column, seg: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    def up(own: Column, i: Column) -> Column:
        mark = _mark(seg, i)
        return digest(F.when(mark == F.lit(LEFT), _sibling(seg, i)).otherwise(""), own,
                      F.when(mark == F.lit(RIGHT), _sibling(seg, i)).otherwise(""))
    return F.aggregate(_steps(seg), start, up)


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root and proof (a segment from leaf to root) of every row of ``docs``, and ``carry``'s columns.

    ``docs`` has the columns FIELDS; others, of any name, are not looked at. Leaves of a language (null is one) are ordered by
    doc_id, nulls first; rows that share an id by digest, so equal rows take neighbouring places. Texts are hashed
    whole, of any length, and never shuffled; empty and null texts differ. An empty table has no root and gives no rows.
    """
    carry = carry or {}
    rows = materialise(docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("part"), leaf().alias("leaf"),
                                   *(c.alias(f"carry_{name}") for name, c in carry.items()), F.monotonically_increasing_id().alias("row")))
    # the part without a language is "", which sorts first; the row's number lets a run of equal rows be cut between tasks
    placed = number_rows(rows, [F.asc_nulls_first("part"), F.asc_nulls_first("doc_id"), "leaf", "row"], "place")
    parts = placed.groupBy("part").agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    parts = materialise(number_rows(parts, ["part"], "tree"))
    n_parts, n_rows, largest = parts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    few = n_parts * 400 <= BROADCAST
    of_part = lambda left, right: left.join(F.broadcast(right), "part") if few else attach_by_key(left, right, "part", "place")
    leaves = of_part(placed, parts).withColumn("idx", F.col("place") - F.col("begin")).withColumn("digest", F.col("leaf"))
    nodes = build(leaves, largest)
    lower = proofs(nodes, n_rows, largest)

    subroots = nodes.filter("octet_length(seg) = 0").select("tree", F.col("digest").alias("subroot"))
    tops = subroots.select(F.lit(-1).cast("long").alias("tree"), F.lit(n_parts).cast("long").alias("n"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"))
    upper = build(tops, n_parts)
    ways = proofs(upper, n_parts, n_parts).select(F.col("idx").alias("tree"), F.col("seg").alias("rest"))
    root = upper.filter("octet_length(seg) = 0").select(F.col("digest").alias("root"))
    known = parts.select("part", "tree").join(subroots, "tree").join(ways, "tree").drop("tree")

    out = of_part(leaves.select("doc_id", "leaf", "part", "place", "tree", "idx", *(f"carry_{c}" for c in carry)).join(lower, ["tree", "idx"]), known)
    value = root.first()
    return out.select("doc_id", "leaf", "subroot", F.lit(value["root"] if value else None).alias("root"), F.concat("seg", "rest").alias("proof"),
                      *(F.col(f"carry_{c}").alias(c) for c in carry))


def verify(docs: DataFrame, tampered: Column) -> DataFrame:
    """``manifest`` with ``folded_root`` and ``verified``, where rows for which ``tampered`` is true have one more in n_chars.

    The changed rows are hashed again and folded with the proofs of the original ones; a null in n_chars stays null.
    """
    changed = F.when(tampered, leaf(n_chars=F.col("n_chars") + 1)).otherwise(leaf())
    folded = manifest(docs, {"now": changed}).withColumn("folded_root", fold(F.col("now"), F.col("proof")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root")).drop("now")
