"""Cleaning, sources, sinks and evaluation on small rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowvigil.operators import clean, evaluate
from flowvigil.session import scratch_path
from flowvigil.sources import files, sinks


def test_column_map():
    assert clean.parse_column_map("a=b, c = d,junk") == {"a": "b", "c": "d"}


def test_required_columns(spark):
    out = clean.fill_required(spark.createDataFrame([(9,)], "packets int")).first()
    assert (out["packets"], out["protocol"], out["src_ip"], out["flow_duration"]) == (9, 6, "0.0.0.0", 0.0)


def test_label_column_and_headers(spark):
    df = clean.trim_headers(spark.createDataFrame([(1, "x")], "` a ` int, ` My Label ` string"))
    assert df.columns == ["a", "My Label"] and clean.label_column(df) == "My Label"
    assert clean.label_column(df.select("a")) is None


def test_infinite_sparse_and_impute(spark):
    df = spark.createDataFrame([(1.0, math.inf, None), (3.0, -math.inf, None), (None, None, None), (5.0, 2.0, None)],
                               "x double, y double, z string")
    cleaned = clean.clear_infinite(df)
    assert [r["y"] for r in cleaned.collect()] == [None, None, None, 2.0]
    assert clean.drop_sparse_rows(cleaned).count() == 1
    assert {tuple(r) for r in clean.impute(cleaned).collect()} == {
        (1.0, 2.0, "unknown"), (3.0, 2.0, "unknown"), (5.0, 2.0, "unknown")}


@pytest.mark.parametrize("options, want", [
    ({}, [0, 0, 1, 1]), ({"trim": False}, [0, 1, 1, 1]), ({"ignore_case": False, "trim": False}, [0, 1, 1, 1]),
    ({"benign": ["benign", "normal"]}, [0, 0, 0, 1])])
def test_binary_labels(spark, options, want):
    df = spark.createDataFrame([(0, "BENIGN"), (1, " benign "), (2, "normal"), (3, "DDoS")], "i int, l string")
    assert [r[0] for r in df.orderBy("i").select(clean.binary_label(F.col("l"), **options)).collect()] == want


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "x int, y string")
    assert tuple(clean.duplicates_removed(df).first()) == (3, 2, 1)


def test_bootstrap_is_repeatable_and_noisy(spark):
    df = spark.range(4000).select("id", F.lit(5.0).alias("x"))
    a, b = (clean.bootstrap_with_noise(df, ["x"]).toPandas() for _ in range(2))
    assert a.equals(b) and 3700 < len(a) < 4300 and a.id.duplicated().any()
    assert abs(a.x.mean() - 5) < 0.02 and abs(a.x.std() - 0.1) < 0.02


def test_arff(spark):
    path = scratch_path(spark, "arff")
    text = ["% c", "@RELATION r", "@ATTRIBUTE duration REAL", "@attribute 'proto type' {'tcp','udp'}", "@data", "1.5,'tcp'", "2,udp"]
    spark.createDataFrame([(line,) for line in text], "value string").coalesce(1).write.text(path)
    df = files.read_arff(spark, path)
    assert df.columns == ["duration", "proto type"]
    assert {tuple(r) for r in df.collect()} == {(1.5, "tcp"), (2.0, "udp")}


def test_json_events(spark):
    good = '{"timestamp":"2024-01-01T10:00:00","src_ip":"1.1.1.1","dst_ip":"2.2.2.2","src_port":1,"dst_port":2,"protocol":6,"packets":1,"bytes":9,"flow_duration":0.5,"flags":"S"}'
    lines = [good, "{broken", good.replace('"bytes":9', '"bytes":"many"'), good.replace('"dst_ip":"2.2.2.2",', ""), None]
    parsed = files.parse_json_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r["flags"] for r in files.accepted(parsed.where("src_ip is not null")).collect()] == ["S"]
    assert files.rejected(parsed).count() == 3


def test_results_nan_becomes_null(spark):
    path = scratch_path(spark, "csv")
    sinks.write_results(spark.createDataFrame([("m", float("nan")), ("n", 0.5)], "model string, f1 double"), path)
    assert {tuple(r) for r in sinks.read_results(spark, path, "model string, f1 double").collect()} == {("m", None), ("n", 0.5)}


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    assert tuple(evaluate.binary_metrics(df).first()) == (1.0, 0.0, 0.0, 0.0, 2)


def test_votes(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.5, 0.5, 0.0], 2, 1, 1), ([0.1, 0.2, 0.7], [0.1, 0.8, 0.1], 3, 1, 2)],
                               "p array<double>, q array<double>, a int, b int, c int")
    name, confidence = evaluate.soft_vote(["p", "q"], ["x", "y", "z"])
    rows = df.select(name, confidence, evaluate.hard_vote(["a", "b", "c"])).collect()
    assert [(r[0], pytest.approx(r[1])) for r in rows] == [("x", 0.5), ("y", 0.5)]
    assert [r[2] for r in rows] == [1, 1]


def test_class_report_averages(spark):
    rng = np.random.default_rng(0)
    pairs = [(str(a), str(b)) for a, b in zip(rng.integers(0, 3, 90), rng.integers(0, 4, 90))]
    rows = {r["label"]: r for r in evaluate.class_report(spark.createDataFrame(pairs, "actual string, predicted string")).collect()}
    hits = sum(a == b for a, b in pairs)
    assert rows["accuracy"]["f1_score"] == pytest.approx(hits / 90) and rows["3"]["support"] == 0
    assert rows["macro avg"]["recall"] == pytest.approx(np.mean([rows[c]["recall"] for c in "0123"]))
    assert rows["weighted avg"]["recall"] == pytest.approx(hits / 90)


def test_best_model_takes_first_name_on_ties(spark):
    rows = [("b", 0.5, 0.5, 0.5, 0.7, 1.0, 9), ("a", 0.6, 0.5, 0.5, 0.7, 3.0, 9)]
    table = spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1_score double, latency double, samples long")
    out = evaluate.benchmark_summary(table).first()
    assert (out["best_model"], out["worst_model"], out["quality"], out["avg_latency"]) == ("a", "a", "Good", 2.0)
