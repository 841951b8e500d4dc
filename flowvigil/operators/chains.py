"""Attack chains: what one source did over time, as kill-chain stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowvigil import dims
from flowvigil.operators.history import detail
from flowvigil.operators.skew import AUTO, scan_in_order


def chain_key(history: DataFrame) -> Column:
    """The source address, else the user, else 'unknown'."""
    known = history.schema["result"].dataType["threat_details"].dataType.names

    def given(name: str) -> Column:
        value = detail(name).cast("string")
        return F.when(value != "", value)

    return F.coalesce(*[given(c) for c in ("src_ip", "user_id") if c in known], F.lit("unknown"))


def chain_input(history: DataFrame, by_day: bool = False) -> DataFrame:
    """One row per history entry with its chain; ``by_day`` starts a new chain every day."""
    rows = history.select(
        chain_key(history).alias("chain_key"), "timestamp", "seq", "threat_id", detail("src_ip").alias("src_ip"),
        detail("dst_ip").alias("dst_ip"), detail("dst_port").alias("dst_port"),
        detail("threat_class").alias("threat_class"), "severity", "risk_score", "action")
    if by_day:
        rows = rows.withColumn("chain_key", F.concat_ws("/", "chain_key", F.date_format("timestamp", "yyyy-MM-dd")))
    return rows


def attack_chains(events: DataFrame) -> DataFrame:
    """One row per chain: event count, stages in kill-chain order, duration, severity.

    Only mergeable aggregates, so a source with a third of all events is combined
    map-side; the ordered events are in ``chain_events``.
    """
    shown = [F.bool_or(F.col("threat_class") == cls).alias(f"_s{ord_}") for ord_, cls, _ in dims.KILL_CHAIN]
    chains = events.groupBy("chain_key").agg(
        F.count("*").alias("event_count"), F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"), F.min("seq").alias("first_seq"), *shown)
    stages = F.array_compact(F.array(*[F.when(F.col(f"_s{ord_}"), stage) for ord_, _, stage in dims.KILL_CHAIN]))
    seconds = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / F.lit(1e6)
    out = chains.withColumn("stages", stages).withColumn("stage_count", F.size("stages"))
    n = F.col("stage_count")
    return out.withColumns({
        "duration_seconds": F.when(F.col("event_count") < 2, 0.0).otherwise(seconds),
        "severity": F.when(n >= 4, "critical").when(n >= 2, "high").when(n >= 1, "medium").otherwise("low"),
    }).drop(*[f"_s{ord_}" for ord_, _, _ in dims.KILL_CHAIN])


def chain_events(events: DataFrame, hot=AUTO) -> DataFrame:
    """Every event with its 1-based place in the time order of its chain."""
    return scan_in_order(events, "chain_key", ["timestamp", "seq"], sums={"event_no": F.lit(1)}, hot=hot)


def first_events(events: DataFrame, keep: int = 10,
                 fields: Sequence[str] = ("timestamp", "seq", "threat_id", "threat_class", "severity", "risk_score")) -> DataFrame:
    """(chain_key, events): the first ``keep`` events of each chain, in order."""
    in_chain = Window.partitionBy("chain_key").orderBy("timestamp", "seq")
    head = events.withColumn("_no", F.row_number().over(in_chain)).where(F.col("_no") <= keep)
    return head.groupBy("chain_key").agg(
        F.array_sort(F.collect_list(F.struct("_no", *fields))).alias("events"))


def chain_ranking(events: DataFrame, limit: int = 10, keep: int = 10, pick: str = "top") -> DataFrame:
    """The chains with most stages, then most events, each with its first events.

    ``pick="first_seen"`` ranks only the ``limit`` chains that appeared first.
    """
    chains = attack_chains(events)
    if pick == "first_seen":
        chains = chains.orderBy("first_seq").limit(limit)
    ranked = chains.orderBy(F.col("stage_count").desc(), F.col("event_count").desc(), "chain_key").limit(limit)
    # ``limit`` rows, so it can be broadcast; only their events are looked at
    ranked = F.broadcast(ranked)
    theirs = first_events(events.join(ranked.select("chain_key"), "chain_key", "left_semi"), keep)
    return ranked.join(theirs, "chain_key").orderBy(
        F.col("stage_count").desc(), F.col("event_count").desc(), "chain_key")
