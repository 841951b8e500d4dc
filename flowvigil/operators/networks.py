"""Longest-prefix match of addresses against tables of IPv4 networks of any size.

Every network is a key (prefix length, first address), so a match is an equi-join and
never a comparison of ranges. Distinct addresses are matched, not rows:

* networks of at most 16 bits are fewer than 2**17 whatever the table, and are broadcast;
* a longer one covers fewer than 2**16 addresses, so no key of that join can be hot.

Rows then find their address's match through ``attach_by_key``, which spreads hot addresses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowvigil.functions.ip import ipv4_number
from flowvigil.operators.policies import INDICATOR_LEVELS
from flowvigil.operators.skew import attach_by_key
from flowvigil.session import materialise

WIDE_BITS = 16


def first_address(number: Column, bits: Column) -> Column:
    """The address with all bits after the first ``bits`` set to 0."""
    host = F.lit(32) - bits
    return F.call_function("shiftleft", F.call_function("shiftright", number, host), host)


def parsed(networks: DataFrame, column: str = "network") -> DataFrame:
    """Adds _bits and _base; ``a.b.c.d`` is one address. Other texts are left out, host bits are ignored."""
    parts = F.split(column, "/")
    bits = F.when(F.size(parts) == 1, F.lit(32)).when(
        (F.size(parts) == 2) & F.get(parts, F.lit(1)).rlike("^([0-9]|[12][0-9]|3[0-2])$"), F.get(parts, F.lit(1)).cast("int"))
    with_bits = networks.withColumns({"_bits": bits, "_number": ipv4_number(F.get(parts, F.lit(0)))})
    return with_bits.withColumn("_base", first_address(F.col("_number"), F.col("_bits"))).where(
        F.col("_base").isNotNull()).drop("_number")


@dataclass
class NetworkTable:
    """Parsed networks, written once: ``rows`` are (_bits, _base, _value), one per network."""

    rows: DataFrame
    lengths: list[int]


def network_table(networks: DataFrame, network: str = "network", rank: Column | None = None, keep_network: bool = False) -> NetworkTable:
    """The table that ``attach_longest`` reads, with the other columns of ``networks`` as values.

    Of equal networks the row with the greatest ``rank`` counts, of equal ranks the greatest row.
    """
    values = F.struct(*[c for c in networks.columns if c != network or keep_network])
    order = F.struct(values) if rank is None else F.struct(rank, values)
    rows = materialise(parsed(networks, network).groupBy("_bits", "_base").agg(F.max_by(values, order).alias("_value")))
    return NetworkTable(rows, sorted(r[0] for r in rows.select("_bits").distinct().collect()))  # 33 lengths at most


def attach_longest(rows: DataFrame, column: str, table: NetworkTable, row_id: str, prefix: str = "") -> DataFrame:
    """``rows`` and, named with ``prefix``, the values of the longest network that covers ``column``; else nulls.

    ``row_id`` only spreads the rows of a hot address. A new column must not be one of ``rows``.
    """
    names = {f.name: prefix + f.name for f in table.rows.schema["_value"].dataType}
    clash = set(names.values()) & set(rows.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    numbered = rows.withColumn("_number", ipv4_number(F.col(column)))
    addresses = numbered.where(F.col("_number").isNotNull()).select("_number").distinct()

    def matches(wanted: list[int], networks: DataFrame) -> DataFrame:
        keys = addresses.withColumn("_bits", F.explode(F.array(*[F.lit(b) for b in wanted]).cast("array<int>"))).withColumn(
            "_base", first_address(F.col("_number"), F.col("_bits")))
        return keys.join(networks, ["_bits", "_base"]).select("_number", "_bits", "_value")

    wide = [b for b in table.lengths if b <= WIDE_BITS]
    narrow = [b for b in table.lengths if b > WIDE_BITS]
    found = matches(wide, F.broadcast(table.rows.where(F.col("_bits") <= WIDE_BITS)))  # fewer than 2**17 rows
    if narrow:
        found = found.unionByName(matches(narrow, table.rows.where(F.col("_bits") > WIDE_BITS)))
    best = found.groupBy("_number").agg(F.max_by("_value", "_bits").alias("_value"))
    best = best.select("_number", *[F.col(f"_value.{c}").alias(name) for c, name in names.items()])
    return attach_by_key(numbered, best, "_number", row_id).drop("_number")


def longest_prefix(rows: DataFrame, column: str, networks: DataFrame, row_id: str, network: str = "network",
                   rank: Column | None = None) -> DataFrame:
    """``rows`` and the columns of ``networks`` for each row's address; the longest prefix decides."""
    return attach_longest(rows, column, network_table(networks, network, rank), row_id)


def match_networks(flows: DataFrame, feed: DataFrame, row_id: str = "flow_id") -> DataFrame:
    """Flows whose source or destination lies in a listed network or is a listed address, with network and level.

    ``feed`` has (network, level) rows. The longest prefix decides; of several rows for one network the worst level.
    """
    worst = F.array_position(F.array(*map(F.lit, INDICATOR_LEVELS)), F.col("level"))
    table = network_table(feed.select("network", "level"), rank=worst, keep_network=True)
    out = flows
    for side in ("src", "dst"):
        out = attach_longest(out, f"{side}_ip", table, row_id, f"{side}_")
    return out.where(F.col("src_network").isNotNull() | F.col("dst_network").isNotNull())
