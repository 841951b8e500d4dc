"""At most one message per key and cool-down, counted from the last message *sent*.

Whether a row is sent depends on the row sent before it, so this is a walk in time
order, not a window. Keys that are not hot are walked whole. A hot key is walked in
time chunks at once: every chunk first says how it would end for each state it could
be entered with. These are nodes, each pointing at the node of a later chunk that its
end leads to. The nodes that are really passed are found by doubling the pointers, a
logarithm of the chunks in rounds of equi-joins, and then each chunk that is passed is
walked from the state it is entered with. No group holds more than a chunk's rows or
``GROUP_ROWS``, however long the cool-down is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowvigil.operators.skew import AUTO, find_hot, null_safe_join, with_chunks
from flowvigil.session import materialise

NEVER = -(2 ** 62)
GROUP_ROWS = 100_000  # pointers looked up in one chunk by one task


def walk(times: np.ndarray, open_at: int, gap: int) -> np.ndarray:
    """Positions in the sorted ``times`` that are sent when sending is open from ``open_at``."""
    picked = []
    i = int(np.searchsorted(times, open_at, "left"))
    while i < len(times):
        picked.append(i)
        i = int(np.searchsorted(times, times[i] + gap, "left"))
    return np.array(picked, dtype=int)


def chunk_ends(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row that may be sent first: its time and the time of the last row then sent.

    A chunk can only be entered with sending closed until less than ``gap`` after its
    first row, so later rows need no entry; neighbours with the same end are merged.
    """
    n = len(times)
    following = np.searchsorted(times, times + gap, "left")
    last = np.where(following < n, following, np.arange(n))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    first = np.arange(int(np.searchsorted(times, times[0] + gap, "right")) + 1)
    first = first[first < n]
    ends = times[last[first]]
    keep = np.append(ends[1:] != ends[:-1], True)
    return times[first][keep], ends[keep]


def sent_rows(df: DataFrame, key: str, at: str, row_id: str, seconds: float,
              hot: DataFrame | str | None = AUTO) -> DataFrame:
    """(key, at, row_id) of the rows that are sent; ties in time go to the lowest id.

    Rows without a time are never sent; without a cool-down (0 seconds) all others are.
    """
    gap = int(seconds * 1_000_000)
    rows = df.select(key, at, row_id, F.unix_micros(at).alias("_t")).where(F.col(at).isNotNull())
    if gap <= 0:
        return rows.drop("_t")
    if isinstance(hot, str):
        hot = find_hot(rows, [key], at)
    kept_schema = rows.drop("_t").schema

    def walk_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", row_id])
        open_at = int(pdf["_open"].iloc[0]) if "_open" in pdf else NEVER
        return pdf.iloc[walk(pdf["_t"].to_numpy(), open_at, gap)][[key, at, row_id]]

    if hot is None:
        return rows.groupBy(key).applyInPandas(walk_group, kept_schema)

    marks = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    marked = null_safe_join(rows, marks, [key], "left")
    cold = marked.where(F.col("_hot").isNull()).drop("_hot")
    # of the rows of one time only the first can be sent
    chunked = with_chunks(marked.where(F.col("_hot")).drop("_hot"), [key], at, hot).groupBy(key, "_chunk", at, "_t").agg(
        F.min(row_id).alias(row_id)).select(*rows.columns, "_chunk")

    key_type = rows.schema[key].dataType.simpleString()

    def ends_of_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        until, end = chunk_ends(np.sort(pdf["_t"].to_numpy()), gap)
        return pd.DataFrame({key: pdf[key].iloc[0], "_chunk": pdf["_chunk"].iloc[0],
                             "_until": until, "_end": end})

    ends = chunked.groupBy(key, "_chunk").applyInPandas(
        ends_of_chunk, f"`{key}` {key_type}, _chunk int, _until long, _end long")

    opens = passed_nodes(materialise(ends), key, gap, hot)  # one row per chunk of a hot key at most
    walked = null_safe_join(chunked, F.broadcast(opens), [key, "_chunk"], "inner").groupBy(
        key, "_chunk").applyInPandas(walk_group, kept_schema)
    return cold.groupBy(key).applyInPandas(walk_group, kept_schema).unionByName(walked)


def pointers(nodes: DataFrame, key: str, gap: int, hot: DataFrame) -> DataFrame:
    """(key, _chunk, _until, _next_chunk, _next_until, _open): where each node's end leads to.

    ``nodes`` are (key, _chunk, _until, _end). Sending is open again at ``_open``; the next
    node is the first one at or after it, in the chunk of that time or else the first node of
    the next chunk that has any. Nodes that lead nowhere are left out. The pointers into one
    chunk are looked up in groups of about ``GROUP_ROWS``, each with the chunk's nodes.
    """
    at = [key, "_chunk"]
    ends = nodes.groupBy(*at).agg(F.min("_until").alias("_first"), F.max("_until").alias("_last"))
    asked = with_chunks(nodes.select(key, F.col("_chunk").alias("_from"), "_until", (F.col("_end") + gap).alias("_open")), [key], "_open", hot)
    asked = null_safe_join(asked, ends.drop("_first"), at, "left").withColumn("_inside", F.coalesce(F.col("_open") <= F.col("_last"), F.lit(False)))

    # one row per chunk of a hot key: the next chunk that has nodes
    in_key = Window.partitionBy(key).orderBy("_chunk")
    following = ends.withColumn("_before", F.coalesce(F.lag("_chunk").over(in_key), F.lit(0))).where(F.col("_before") < F.col("_chunk")).select(
        key, F.explode(F.sequence(F.col("_before"), F.col("_chunk") - 1)).alias("_at"), F.col("_chunk").alias("_next_chunk"), F.col("_first").alias("_next_until"))
    outside = null_safe_join(asked.where(~F.col("_inside")).withColumnRenamed("_chunk", "_at"), following, [key, "_at"], "inner")

    inside = asked.where("_inside")
    groups = inside.groupBy(*at).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("_groups"))
    dealt = null_safe_join(inside, groups, at, "inner").select(
        *at, F.pmod(F.xxhash64("_open"), F.col("_groups")).cast("int").alias("_group"), F.col("_open").alias("_x"), F.struct("_from", "_until").alias("_source"))
    copies = null_safe_join(nodes, groups, at, "inner").select(
        *at, F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_group"), F.col("_until").alias("_x"), F.lit(None).cast(dealt.schema["_source"].dataType).alias("_source"))
    from_the_end = Window.partitionBy(*at, "_group").orderBy(F.col("_x").desc(), F.col("_source").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    node_time = F.when(F.col("_source").isNull(), F.col("_x"))
    found = copies.unionByName(dealt).withColumn("_next_until", F.last(node_time, ignorenulls=True).over(from_the_end)).where(F.col("_source").isNotNull())

    out = [key, F.col("_from").alias("_chunk"), "_until", "_next_chunk", "_next_until", "_open"]
    return found.select(key, "_source.*", F.col("_chunk").alias("_next_chunk"), "_next_until", F.col("_x").alias("_open")).select(*out).unionByName(
        outside.select(*out))


def passed_nodes(nodes: DataFrame, key: str, gap: int, hot: DataFrame) -> DataFrame:
    """(key, _chunk, _open): the chunks in which something is sent, and from when sending is open there.

    After round k the nodes of the first 2**k steps are known and every pointer spans 2**k
    steps; both are written to the shared folder, so a lost executor costs one re-read.
    """
    node = [key, "_chunk", "_until"]
    jumps = materialise(pointers(nodes, key, gap, hot))
    known = nodes.groupBy(key).agg(F.min(F.struct("_chunk", "_until")).alias("_n")).select(key, "_n.*", F.lit(NEVER).alias("_open"))
    while True:
        reached = null_safe_join(known.drop("_open"), jumps, node, "inner").select(
            key, F.col("_next_chunk").alias("_chunk"), F.col("_next_until").alias("_until"), "_open")
        reached = materialise(reached)
        if reached.isEmpty():
            return known.drop("_until")
        known = materialise(known.unionByName(reached))
        onward = jumps.select(key, F.col("_chunk").alias("_next_chunk"), F.col("_until").alias("_next_until"), F.col("_next_chunk").alias("_far_chunk"),
                              F.col("_next_until").alias("_far_until"), F.col("_open").alias("_far_open"))
        jumps = materialise(null_safe_join(jumps, onward, [key, "_next_chunk", "_next_until"], "inner").select(
            *node, F.col("_far_chunk").alias("_next_chunk"), F.col("_far_until").alias("_next_until"), F.col("_far_open").alias("_open")))


def notifications(alerts: DataFrame, key: str = "src_ip", seconds: float = 60,
                  severities: tuple[str, ...] = ("high", "critical"), hot=AUTO) -> DataFrame:
    """Alerts of an allowed severity, at most one per key and cool-down."""
    return sent_rows(alerts.where(F.col("severity").isin(*severities)), key, "ts", "seq", seconds, hot)
