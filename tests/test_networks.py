"""Longest-prefix match against the standard library's networks, and the shape of its plan."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from flowvigil.operators import networks


def brute(address, table):
    try:
        ip = ipaddress.IPv4Address(address)
    except ValueError:
        return None
    best = None
    for text, label in table:
        try:
            net = ipaddress.IPv4Network(text, strict=False)
        except ValueError:
            continue
        if ip in net and (best is None or (net.prefixlen, label) > best):
            best = (net.prefixlen, label)
    return best and best[1]


def test_equals_the_standard_library(spark):
    rng = random.Random(5)
    base = [f"{rng.choice([10, 10, 172, 255])}.{rng.randrange(3)}.{rng.randrange(3)}.{rng.randrange(256)}" for _ in range(300)]
    table = [(f"{a}/{rng.choice([0, 1, 7, 8, 15, 16, 17, 23, 24, 28, 31, 32])}" if rng.random() < .9 else a, i) for i, a in enumerate(base[:150])]
    table += [(table[3][0], 900), ("10.0.0.0/33", 901), ("10.0.0", 902), ("10.0.0.256/8", 903), ("::1/64", 904), ("", 905), (None, 906), ("10.0.0.0/8/8", 907)]
    rows = list(enumerate(base + base[:20] + [None, "", "10.0.0.300", "::1", "255.255.255.255", "0.0.0.0"]))
    out = networks.longest_prefix(spark.createDataFrame(rows, "id long, ip string"), "ip",
                                  spark.createDataFrame(table, "network string, label long"), "id")
    got = {r["id"]: r["label"] for r in out.collect()}
    usable = [(n, v) for n, v in table if n]
    assert got == {i: brute(a, usable) for i, a in rows}


@pytest.mark.parametrize("table", [[], [("no network", 1)]])
def test_tables_without_a_network(spark, table):
    rows = spark.createDataFrame([(1, "10.0.0.1"), (2, None)], "id long, ip string")
    out = networks.longest_prefix(rows, "ip", spark.createDataFrame(table, "network string, label long"), "id")
    assert sorted(map(tuple, out.collect())) == [(1, "10.0.0.1", None), (2, None, None)]


def test_empty_rows_and_clashing_names(spark):
    rows = spark.createDataFrame([], "id long, ip string")
    table = spark.createDataFrame([("10.0.0.0/8", 1)], "network string, label long")
    assert networks.longest_prefix(rows, "ip", table, "id").collect() == []
    with pytest.raises(ValueError):
        networks.longest_prefix(rows.withColumn("label", F.lit(1)), "ip", table, "id")


def test_joins_by_key_only(spark):
    rows = spark.range(1000).select("id", F.concat(F.lit("10.0.0."), F.col("id") % 250).alias("ip"))
    feed = spark.range(40).select(F.concat(F.lit("10.0.0."), F.col("id"), F.lit("/"), 8 + F.col("id") % 24).alias("network"), F.lit("low").alias("level"))
    flows = rows.select(F.col("id").alias("flow_id"), F.col("ip").alias("src_ip"), F.col("ip").alias("dst_ip"))
    plan = networks.match_networks(flows, feed)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
