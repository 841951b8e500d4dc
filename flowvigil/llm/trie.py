"""Prefix trie of conversations: shared openings, subtree totals by time-forward processing.

A turn is known by its digest and size; texts are not shuffled. The prefix of a conversation up to a
depth is known by running sums of digests of (depth, turn), four of 32 bits, so that also a conversation
with a third of all turns is summed up in pieces. Nodes are the distinct prefixes. A node is named by its
smallest member and its depth; all nodes of one name form a path to that conversation's end.

Nodes with one child and no conversation of their own end there ("plain") have the members of the next node
that branches or ends one; totals are passed only between those ("stops"), at most two a conversation, and plain
nodes then read theirs from the next stop.

Totals are passed by time-forward processing: a shard's stops come in reverse level order from Spark's external sort, each
takes its children's messages from a priority queue that spills, and sends its own to its parent. A shard holds whole
subtrees under nodes with few members. There are fewer than SHARDS nodes above those (of more than rows / SHARDS
conversations each); they take what the shards' roots send, summed up by Spark, in a last small pass of the same kind.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowvigil.operators.skew import attach_by_key, find_hot, scan_in_order
from flowvigil.session import materialise

SHARDS = 1024
QUEUE = 1_000_000           # messages that a queue holds in memory
CHUNK = 1 << 20             # bytes of ids that are digested at a time
LIMBS = ("s0", "s1", "s2", "s3")


def _key(depth, *sums):
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums)))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, said, size): digest of role and text, UTF-8 bytes of the text; null role or text is empty.

    Rows without conv_id belong to no conversation and are left out. Other columns, of any name, are not looked at.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.md5(F.concat(F.octet_length(role), F.lit(":"), role, text)))
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), said.alias("said"), F.octet_length(text).cast("long").alias("size"))


def share_openings(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c rebuilt: the first h turns of c - c % ``group``, then its own after its first h; h = crc32(c) % ``most``.

    Returns (conv_id, depth, said, size, length) with a row of depth 0 for every conversation, also for those without turns.
    Turns are in order of ``turn``, nulls first; equal ones by digest, so equal rows are turns each.
    """
    hot = find_hot(turns, ["conv_id"], "turn")
    placed = materialise(scan_in_order(turns, "conv_id", ["turn", "said"], sums={"i": F.lit(1)}, hot=hot).drop("turn"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group})
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = materialise(convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn(
        "length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "taken", "length"))
    heads = placed.filter((F.col("i") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    opening = convs.join(heads, "base").filter("i <= h").select("conv_id", F.col("i").alias("depth"), "said", "size", "length")
    late = placed.filter(F.col("i") > h)
    own = attach_by_key(late, convs.select("conv_id", "h", "taken", "length"), "conv_id", "i", hot=hot)
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("depth"), "said", "size", "length")
    start = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("said"), F.lit(0).cast("long").alias("size"), "length")
    return opening.unionByName(own).unionByName(start)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, key, up, size, upto, ends): the node of each prefix, its parent's key, the bytes so far, 1 at the last turn."""
    mark = F.md5(F.concat_ws(":", "depth", F.hex("said")))
    limbs = {f"m{i}": F.conv(F.substring(mark, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
    marked = rebuilt.withColumns(limbs)
    summed = scan_in_order(marked, "conv_id", ["depth"], sums={**{s: F.col(f"m{i}") for i, s in enumerate(LIMBS)}, "upto": F.col("size")})
    up = _key(F.col("depth") - 1, *(F.col(s) - F.col(f"m{i}") for i, s in enumerate(LIMBS)))
    return summed.select("conv_id", "depth", _key(F.col("depth"), *LIMBS).alias("key"), F.when(F.col("depth") > 0, up).alias("up"),
                         "size", "upto", (F.col("depth") == F.col("length")).cast("long").alias("ends"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """The nodes: their name (conv_id, depth), members, ends and children, the name of their parent, and the stops of each path numbered.

    ``stop`` is the number, on the path of the node's name, of the stop that the node is or that follows it.
    """
    nodes = materialise(rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("ends").alias("n_ends"),
        *(F.max(c).alias(c) for c in ("depth", "up", "size", "upto"))))
    children = nodes.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("is_stop", (F.col("n_ends") > 0) | (F.col("n_children") != 1) | (F.col("depth") == 0))
    paths = materialise(scan_in_order(nodes, "conv_id", ["depth"], lags={"before": "depth"}, sums={"stop": F.col("is_stop").cast("long")}).withColumn(
        "stop", F.col("stop") + F.when(F.col("is_stop"), 0).otherwise(1)))
    tops = paths.filter("before is null").select("conv_id", "depth", "up", (F.col("upto") - F.col("size")).alias("up_upto"))
    tops = materialise(attach_by_key(tops, paths.select(F.col("key").alias("up"), F.col("conv_id").alias("parent")), "up", "conv_id").drop("up"))
    named = paths.join(tops.select("conv_id", "depth", "parent"), ["conv_id", "depth"], "left")
    named = named.withColumn("parent_conv_id", F.when(F.col("before").isNull(), F.col("parent")).otherwise(F.col("conv_id")))
    # the parent among the stops: the stop before on the path, or what the path's top hangs on (which branches or ends one)
    stops = named.filter("is_stop").select("conv_id", "depth", "n_convs", "n_children", "size", "upto", "stop")
    linked = scan_in_order(stops, "conv_id", ["depth"], lags={"above": F.struct("depth", "upto")})
    linked = linked.join(tops.select("conv_id", "parent", (F.col("depth") - 1).alias("top_depth"), "up_upto"), "conv_id")
    on_path = F.col("above").isNotNull()
    linked = linked.select("conv_id", "depth", "n_convs", "n_children", "size", "upto", "stop",
                           F.when(on_path, F.col("conv_id")).otherwise(F.col("parent")).alias("up_conv"),
                           F.when(on_path, F.col("above.depth")).otherwise(F.col("top_depth")).alias("up_depth"),
                           (F.col("upto") - F.col("size") - F.when(on_path, F.col("above.upto")).otherwise(F.col("up_upto"))).alias("between"))
    return named.drop("before", "parent", "up"), linked


class Messages:
    """Priority queue of (-depth, conv_id, leaves, saved), smallest first; above ``limit`` sorted runs go to Spark's spill folder.

    A run is an unlinked file of the task's own executor, like the runs of Spark's sorts: it ends with the task, which starts anew if lost.
    """

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, message: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            rows = np.array(sorted(self.heap), np.int64)
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            run = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
            rows.tofile(run)
            run.seek(0)
            self.heap = []
            self._next(self._read(run))

    @staticmethod
    def _read(run):
        while (rows := np.fromfile(run, np.int64, 4 * 4096)).size:
            yield from map(tuple, rows.reshape(-1, 4).tolist())
        run.close()

    def _next(self, run) -> None:
        if (first := next(run, None)) is not None:
            heapq.heappush(self.runs, (first, id(run), run))

    def take(self, place: tuple[int, int]) -> tuple[int, int]:
        """The sums of all messages for ``place``."""
        leaves = saved = 0
        while self.heap and self.heap[0][:2] == place:
            _, _, a, b = heapq.heappop(self.heap)
            leaves, saved = leaves + a, saved + b
        while self.runs and self.runs[0][0][:2] == place:
            (_, _, a, b), _, run = heapq.heappop(self.runs)
            leaves, saved = leaves + a, saved + b
            self._next(run)
        return leaves, saved


TOTALS = "conv_id long, depth long, n_leaves long, saved long, up_conv long, up_depth long, up_leaves long, up_saved long"


def pass_up(stops: DataFrame, limit: int = QUEUE) -> DataFrame:
    """Subtree totals of ``stops`` (partitions in order of falling depth, then conv_id), by time-forward processing.

    ``inside`` says that the parent is in the same partition; else the message for it is returned in the up_ columns.
    ``got_leaves`` and ``got_saved`` are sums of messages from elsewhere.
    """
    names = ("conv_id", "depth", "n_convs", "n_children", "size", "between", "up_conv", "up_depth", "inside", "got_leaves", "got_saved")
    fields = [x.split() for x in TOTALS.split(", ")]

    def run(batches):
        queue = Messages(limit)
        for batch in batches:
            out = []
            for conv, depth, n, children, size, between, up_conv, up_depth, inside, got, got_saved in zip(*(batch[c].to_pylist() for c in names)):
                leaves, saved = queue.take((-depth, conv))
                leaves = leaves + got if children else 1
                saved += got_saved + (n - 1) * size
                sent = (leaves, saved + (n - 1) * between)
                if inside:
                    queue.push((-up_depth, up_conv, *sent))
                    sent = (None, None)
                out.append((conv, depth, leaves, saved, up_conv, up_depth, *sent))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 8)], [n for n, _ in fields])
    return stops.select(*names).mapInArrow(run, TOTALS)


def subtree_totals(rows: DataFrame, nodes: DataFrame, stops: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved) of every stop."""
    few = rows.count() // SHARDS + 1
    heavy = nodes.filter(F.col("n_convs") > few).select("key", F.lit(True).alias("heavy"))  # fewer than SHARDS, as each has more than few rows
    cut = F.min(F.when(F.col("heavy").isNull(), F.struct("depth", "key")))
    shard = rows.select("conv_id", "depth", "key").join(F.broadcast(heavy), "key", "left").groupBy("conv_id").agg(cut.alias("cut"))
    zero = F.lit(0).cast("long")
    light = stops.filter(F.col("n_convs") <= few).join(shard, "conv_id").withColumns({
        "inside": F.col("up_depth") >= F.col("cut.depth"), "got_leaves": zero, "got_saved": zero})
    order = [F.desc("depth"), "conv_id"]
    low = materialise(pass_up(light.repartition(F.col("cut.key")).sortWithinPartitions(*order)))
    sent = low.filter("up_leaves is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(
        F.sum("up_leaves").alias("got_leaves"), F.sum("up_saved").alias("got_saved"))
    crown = stops.filter(F.col("n_convs") > few).join(sent, ["conv_id", "depth"], "left").withColumns({
        "inside": F.col("depth") > 0, **{c: F.coalesce(c, zero) for c in ("got_leaves", "got_saved")}})
    high = pass_up(crown.repartition(1).sortWithinPartitions(*order))
    return low.unionByName(high).select("conv_id", "depth", "n_leaves", "saved")


def end_digests(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256): digest of the ids, ascending, joined by commas, of the conversations that end at each node.

    Ids are put in order and joined to chunks everywhere; the digest itself is sequential and reads a node's chunks one after the other.
    """
    def join(batches):
        key, ids, size, seq = None, [], 0, 0
        for batch in batches:
            out = []
            for k, i in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist()):
                if k != key or size > CHUNK:
                    if ids:
                        out.append((key, seq, ",".join(ids)))
                    key, ids, size, seq = k, [], 0, seq + 1
                ids.append(str(i))
                size += len(ids[-1]) + 1
            yield chunks(out)
        if ids:
            yield chunks([(key, seq, ",".join(ids))])

    def chunks(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.binary(), pa.int64(), pa.string()))], ["key", "seq", "ids"])

    def read(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k, text in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
                if state is None or k != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield digests(out)
        if state is not None:
            yield digests([(key, state.hexdigest())])

    def digests(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 2, (pa.binary(), pa.string()))], ["key", "ends_sha256"])

    ends = rows.filter("ends = 1").select("key", "conv_id")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ends.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = ordered.mapInArrow(join, "key binary, seq long, ids string").withColumn("part", F.spark_partition_id())
    return joined.repartition("key").sortWithinPartitions("key", "part", "seq").drop("part", "seq").mapInArrow(read, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """One row a node of the trie of the rebuilt ``conversations`` (conv_id, turn, role, text), see ``share_openings``.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 as longs and text.
    Null and empty roles and texts are equal; very long texts count by digest and size; an empty table has no node, not even the root.
    """
    rows = materialise(prefixes(share_openings(materialise(turns_of(conversations)), group, most)))
    nodes, stops = nodes_of(rows)
    totals = stops.select("conv_id", "depth", "stop", F.col("size").alias("stop_size"), F.col("upto").alias("stop_upto")).join(
        subtree_totals(rows, nodes, stops), ["conv_id", "depth"]).drop("depth")
    between = F.col("stop_upto") - F.col("stop_size") - F.col("upto") + F.col("size")
    return nodes.join(totals, ["conv_id", "stop"]).join(end_digests(rows), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * between).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
