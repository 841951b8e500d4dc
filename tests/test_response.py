"""Routing, history, chains, policies on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from flowvigil.operators import chains, enrich, history, policies, risk, rules

SCHEMA = "seq long, ts string, src_ip string, dst_ip string, dst_port int, anomaly_score double, confidence double, threat_class string, source string"


def detections(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture(scope="module")
def sample(spark):
    return detections(spark, [
        (1, "2024-01-01 03:00:00", "1.1.1.1", "9.9.9.9", 22, 0.0, 0.0, "normal", "realtime"),
        (2, "2024-01-01 10:00:00", "1.1.1.1", "9.9.9.9", 0, 0.5, 0.5, "port_scan", "simulation"),
        (3, "2024-01-01 10:05:00", "1.1.1.1", None, 443, 1.0, 1.0, "ransomware", "realtime"),
        (4, "2024-01-06 10:05:00", None, "9.9.9.9", None, 0.4, 0.4, "brute_force", "simulation")])


def test_pending_rows_stay_out_of_history(sample):
    assert sorted(r["seq"] for r in risk.action_history(sample).collect()) == [1, 2, 4]
    assert risk.action_history(sample, include_pending=True).count() == 4
    assert [r["seq"] for r in risk.approval_queue(risk.score_detections(sample)).collect()] == [3]


def test_automation_off_and_forced_approval(sample):
    scored = risk.choose_action(risk.assess_risk(sample))
    assert {r["status"] for r in risk.route(scored, automation=False).collect()} == {"dry_run"}
    forced = risk.route(scored, require_approval=F.col("seq") == 1)
    assert sorted(r["seq"] for r in forced.where("status = 'pending_approval'").collect()) == [1, 3]


def test_alert_text_has_defaults(sample):
    text = {r["seq"]: r["description"] for r in risk.alert_record(risk.score_detections(sample)).collect()}
    assert text[3].startswith("Detected ransomware attack from 1.1.1.1 targeting unknown.")
    assert text[4].startswith("Detected brute_force attack from unknown")


def test_limit_comes_before_the_severity_filter(sample):
    log = risk.action_history(sample, include_pending=True)
    assert [r["seq"] for r in history.recent_history(log, 2, "low").collect()] == []
    assert [r["seq"] for r in history.recent_of_source(log, 1, "realtime").collect()] == [3]


def test_top_counts_skip_missing_values(sample):
    log = risk.action_history(sample, include_pending=True)
    assert {r["port"]: r["count"] for r in history.top_counts(log, "dst_port", "port").collect()} == {22: 1, 443: 1}
    assert [tuple(r) for r in history.top_counts(log, "src_ip", "ip").collect()] == [("1.1.1.1", 3)]


def test_detail_defaults(sample):
    rows = {r["seq"]: r for r in history.detailed_history(risk.action_history(sample), None).collect()}
    assert (rows[4]["src_ip"], rows[4]["dst_port"], rows[4]["service"]) == ("N/A", "N/A", "")
    assert (rows[1]["service"], rows[1]["src_port"], rows[1]["process"]) == ("SSH", "N/A", "unknown")


def test_empty_history_reports(sample):
    empty = risk.action_history(sample).where("seq < 0")
    assert history.hourly(empty).agg(F.sum("count")).first()[0] == 0
    assert history.heatmap(empty).where("level = 0").count() == 168
    assert tuple(history.stats(empty).first()) == (0, 0, 0, 0)
    assert tuple(history.peaks(empty).first()) == (0, "Mon")
    assert tuple(history.severity_distribution(empty).first()) == (0, 0, 0, 0)


def test_chains(sample):
    rows = chains.chain_input(risk.action_history(sample, include_pending=True))
    out = {r["chain_key"]: r for r in chains.attack_chains(rows).collect()}
    assert out["1.1.1.1"]["stages"] == ["reconnaissance"] and out["1.1.1.1"]["severity"] == "medium"
    assert out["1.1.1.1"]["duration_seconds"] == 7 * 3600 + 300
    assert out["unknown"]["duration_seconds"] == 0.0 and out["unknown"]["stages"] == ["initial_access"]
    first = chains.first_events(rows, keep=2).where("chain_key = '1.1.1.1'").first()["events"]
    assert [e["seq"] for e in first] == [1, 2]


def test_blocklist_fold(spark):
    rows = [(i, f"2024-01-01 0{i}:00:00", ip, "9.9.9.9", 80, 1.0, 1.0, "ransomware", "x")
            for i, ip in [(1, "a"), (2, "b"), (3, "a"), (4, "b")]]
    log = risk.action_history(detections(spark, rows), include_pending=True)
    unblocks = spark.createDataFrame([("a", 2), ("b", 9)], "ip string, seq long")
    assert {r["ip"] for r in history.blocklist(log).collect()} == {"a", "b"}
    kept = history.blocklist(log, unblocks).collect()
    assert [(r["ip"], r["threat_id"]) for r in kept] == [("a", "THR-20240101-000003")]


def test_unknown_port(spark):
    out = enrich.port_service(spark.createDataFrame([(9999,), (None,), (23,)], "dst_port int")).collect()
    assert {r["dst_port"]: (r["service"], r["port_risk"]) for r in out} == {
        9999: ("UNKNOWN", "unknown"), None: ("UNKNOWN", "unknown"), 23: ("TELNET", "critical")}


def test_sessions_at_the_gap(spark):
    rows = [(i, f"2024-01-01 10:{m:02d}:{s:02d}", "a", 1.0 * i) for i, (m, s) in enumerate([(0, 0), (5, 0), (10, 1), (30, 0)])]
    df = spark.createDataFrame(rows, "seq long, ts string, src_ip string, risk_score double").withColumn("ts", F.col("ts").cast("timestamp"))
    out = policies.correlate_alerts(df).collect()
    assert [(r["alerts"], r["max_risk_score"]) for r in out] == [(2, 1.0)]


def test_maintenance_window_ends_are_included(spark):
    alerts = spark.createDataFrame([(1, "h", "2024-01-01 09:59:59", .9), (2, "h", "2024-01-01 10:00:00", .9), (3, "h", "2024-01-01 13:00:00", .9),
                                    (4, "h", "2024-01-01 13:00:01", .9), (5, "g", "2024-01-01 11:00:00", .9), (6, "g", "2024-01-01 11:00:00", .5)],
                                   "seq long, dst_ip string, ts string, confidence double").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = spark.createDataFrame([("h", "2024-01-01 10:00:00", "2024-01-01 13:00:00")], "dst_ip string, start string, end string").selectExpr(
        "dst_ip", "cast(start as timestamp) start", "cast(end as timestamp) end")
    assert sorted(r["seq"] for r in policies.suppress_in_maintenance(alerts, windows).collect()) == [1, 4, 5]


def test_rules_on_signatures(spark):
    def flow(i, src, dst, port, packets, size, seconds):
        return (i, src, dst, port, packets, size, seconds, "2024-01-01 10:01:00")
    rows = [flow(i, "9.9.9.9", "10.0.0.1", 100 + i, 1, 44, 0.001) for i in range(30)]
    rows += [flow(100 + i, "8.8.8.8", "10.0.0.2", 22, 80, 9000, 0.5) for i in range(25)]
    rows += [flow(200 + i, f"7.7.{i}.1", "10.0.0.3", 80, 10 ** 6, 10 ** 9, 0.1) for i in range(60)]
    rows += [flow(300, "10.0.0.9", "6.6.6.6", 443, 10 ** 5, 10 ** 9, 60.0), flow(301, "10.0.0.9", "6.6.6.6", 4444, 9, 9, 1.0),
             flow(302, "5.5.5.5", "10.0.0.4", 445, 10 ** 6, 10 ** 8, 0.01)]
    df = spark.createDataFrame(rows, "flow_id long, src_ip string, dst_ip string, dst_port int, packets long, bytes long, flow_duration double, ts string"
                               ).withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r["src_ip"], r["ports"]) for r in rules.port_scan(df).collect()] == [("9.9.9.9", 30)]
    assert [(r["src_ip"], r["attempts"]) for r in rules.brute_force(df).collect()] == [("8.8.8.8", 25)]
    assert [r["dst_ip"] for r in rules.ddos(df).collect()] == ["10.0.0.3"]
    assert [r["src_ip"] for r in rules.exfiltration(df).collect()] == ["10.0.0.9"]
    assert [r["flow_id"] for r in rules.c2_ports(df).collect()] == [301]
    assert [r["flow_id"] for r in rules.exploit_burst(df).collect()] == [302]


def test_maintenance_of_any_length(spark):
    times = ["2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-02-29 12:00:00", "2124-06-01 00:30:00", "9000-01-01 00:00:00"]
    alerts = spark.createDataFrame([(i, h, t, 0.9) for i, t in enumerate(times) for h in ("a", "b", "c", "d", "e")],
                                   "seq int, dst_ip string, t string, confidence double").withColumn("ts", F.col("t").cast("timestamp"))
    rows = [("a", "2024-01-01 00:00:00", None), ("b", "2024-01-01 00:00:00", "9999-12-31 00:00:00"), ("c", "2024-01-01 00:00:01", "2124-06-01 00:29:59"),
            ("d", None, "2124-06-01 00:00:00"), ("d", "2124-06-02 00:00:00", "2024-01-01 00:00:00"), ("e", "2024-02-29 12:00:00", "2024-02-29 12:00:00")]
    windows = spark.createDataFrame(rows, "dst_ip string, s string, e string").select(
        "dst_ip", F.col("s").cast("timestamp").alias("start"), F.col("e").cast("timestamp").alias("end"))
    left = {h: sorted(r.seq for r in policies.suppress_in_maintenance(alerts, windows).where(F.col("dst_ip") == h).collect()) for h in "abcde"}
    assert left == {"a": [0], "b": [0], "c": [0, 1, 3, 4], "d": [0, 1, 2, 3, 4], "e": [0, 1, 3, 4]}


def test_matrix_of_too_many_classes_raises(spark):
    import pytest

    from flowvigil.operators import evaluate
    rows = spark.range(30).select(F.col("id").cast("string").alias("actual"), F.lit("1").alias("predicted"))
    with pytest.raises(ValueError, match="more than 20"):
        evaluate.confusion_matrix(rows, max_classes=20)
    assert evaluate.confusion_matrix(rows, max_classes=30).count() == 900
