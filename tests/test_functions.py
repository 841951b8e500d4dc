"""Column functions on hand-made values, including the published edge cases."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from flowvigil.functions import scoring, timeparts
from flowvigil.functions.ip import ip_location, ip_type
from flowvigil.functions.stats import entropy_from_counts


def values(spark, kind, items, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


IPS = {
    "127.0.0.1": "loopback", "10.1.2.3": "private", "172.16.0.1": "private", "172.32.0.1": "public",
    "192.168.0.9": "private", "169.254.1.1": "private", "198.18.0.5": "private", "198.20.0.5": "public",
    "224.0.0.1": "multicast", "240.0.0.1": "private", "255.255.255.255": "private", "8.8.8.8": "public",
    "100.64.0.1": "public", "192.0.0.9": "public", "192.0.0.10": "public", "192.0.0.11": "private",
    "192.0.0.90": "private", "203.0.113.7": "private", "1.2.3": "invalid", "01.2.3.4": "invalid", "300.1.1.1": "invalid",
    "abc": "invalid", "": "invalid", "::1": "loopback", "fe80::1": "private", "fc00::5": "private",
    "2001:db8::1": "private", "2606:4700::1111": "public", "ff02::1": "multicast", "4000::1": "reserved",
    "1:2:3": "invalid", "::ffff:10.0.0.1": "private", "2606:4700:0:0:0:0:0:1": "public", "12345::1": "invalid",
}


def test_ip_types(spark):
    assert dict(zip(IPS, values(spark, "string", list(IPS), ip_type))) == IPS


def test_ipv4_types_match_the_standard_library(spark):
    import random
    rng = random.Random(3)
    ips = [".".join(str(rng.choice([0, 10, 127, 169, 172, 192, 198, 203, 224, 240, rng.randrange(256)]) if i == 0
                        else rng.choice([0, 2, 18, 51, 113, 168, 254, rng.randrange(256)])) for i in range(4))
           for _ in range(2000)]

    def want(ip):
        a = ipaddress.ip_address(ip)
        return ("loopback" if a.is_loopback else "private" if a.is_private else
                "multicast" if a.is_multicast else "reserved" if a.is_reserved else "public")
    assert values(spark, "string", ips, ip_type) == [want(ip) for ip in ips]


def test_locations(spark):
    got = values(spark, "string", ["loopback", "private", "public", "invalid"], ip_location)
    assert got == ["Local Machine", "Local Network", "Internet", "Internet"]


def test_severity_and_action_edges(spark):
    risks = [0.0, 40.0, 40.5, 41.0, 59.999, 60.0, 60.5, 80.0, 80.5, 81.0, 100.0]
    assert values(spark, "double", risks, scoring.severity_of) == [
        "low", "medium", "medium", "medium", "medium", "high", "high", "critical", "critical", "critical", "critical"]
    assert values(spark, "double", risks, scoring.action_of) == [
        "monitor", "monitor", "monitor", "alert", "alert", "alert", "monitor", "isolate", "monitor", "block", "block"]


def test_published_risk_example(spark):
    row = spark.range(1).select(
        scoring.base_severity(F.lit("ransomware")).alias("base"), scoring.base_severity(F.lit("other")).alias("other"))
    row = row.withColumn("risk", scoring.risk_score(F.col("base"), F.lit(0.95), F.lit(0.9), F.lit(9.0), F.lit(3.0)))
    got = row.first()
    assert (got["base"], got["other"]) == (100.0, 50.0) and got["risk"] == pytest.approx(93.0)


def test_risk_is_clamped(spark):
    row = spark.range(1).select(
        scoring.risk_score(F.lit(100.0), F.lit(5.0), F.lit(5.0)).alias("hi"),
        scoring.risk_score(F.lit(-100.0), F.lit(-5.0), F.lit(0.0)).alias("lo")).first()
    assert (row["hi"], row["lo"]) == (100.0, 0.0)


def test_duration_labels(spark):
    got = values(spark, "double", [0.4, 59.4, 59.6, 60.0, 89.0, 90.0, 3599.0, 3600.0, 5400.0], timeparts.duration_label)
    assert got == ["0s", "59s", "60s", "1m", "1m", "2m", "60m", "1h", "2h"]


def test_hours(spark):
    stamps = ["2024-01-05 08:59:59", "2024-01-05 09:00:00", "2024-01-05 17:30:00", "2024-01-06 18:00:00"]
    def flags(c):
        ts = c.cast("timestamp")
        return F.array(timeparts.is_business_hours(ts), timeparts.is_off_hours(ts), timeparts.is_weekend(ts))
    assert values(spark, "string", stamps, flags) == [
        [False, True, False], [True, False, False], [True, True, False], [False, True, True]]


def test_entropy_of_one_value_is_plain_zero(spark):
    df = spark.createDataFrame([(5,)], "n bigint")
    assert repr(df.agg(entropy_from_counts(F.col("n")).alias("h")).first()["h"]) == "0.0"
