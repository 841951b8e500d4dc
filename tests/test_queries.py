"""Every registered query with a check runs on the smallest data set and equals its SQL."""

import os

import pytest

import __spark_entry__ as entry
import check
from flowvigil.operators import context, policies, skew, temporal, throttle
from flowvigil.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
QUERIES, ORACLES = catalog.all_queries(), catalog.all_oracles()

# walks in time order need Python; everything else with a check is built-in expressions
PYTHON = {"r7_notify_throttle", "r7_notify_throttle_day", "st6_throttle_state"}


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_sql(spark, duck, key):
    _, _, verdict = check.compare(spark, duck, key, QUERIES[key], ORACLES[key], SF)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("key", [
    "t7_counter_deltas", "t9_sequence_windows", "u4_unusual_time", "a1_feature_join", "f1_custom_feature", "r7_notify_throttle_day",
    "r8_threat_ids", "q15_blocklist_unblocked", "q16_chain_events", "x1_alert_correlation", "x9_ioc_match"])
def test_equals_sql_when_every_busy_key_is_split(spark, duck, key, monkeypatch):
    """The same results when keys with more than a few rows take the hot path."""
    few = key.startswith("q1")  # many small keys
    monkeypatch.setattr(skew, "CUTS", 16)
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 1 if few else 15)
    monkeypatch.setattr(skew, "HOT_SHARE", 0.0015 if few else 0.015)
    found = []
    real = skew.find_hot

    def recording(*args, **kwargs):
        found.append(real(*args, **kwargs))
        return found[-1]

    for module in (skew, context, policies, temporal, throttle):
        monkeypatch.setattr(module, "find_hot", recording)
    _, _, verdict = check.compare(spark, duck, key, QUERIES[key], ORACLES[key], SF)
    assert verdict.startswith("ok"), verdict
    assert any(hot is not None for hot in found)


@pytest.mark.parametrize("key", ["n8_network_features", "a1_feature_join", "t6_temporal_features", "u8_user_features",
                                 "i2_ip_type", "r4_approval_routing", "q16_attack_chains", "x1_alert_correlation", "d10_ensemble_score"])
def test_plans_stay_in_the_jvm(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key, filters", [("s1_parquet_scan", ["EqualTo(event_type,error)", "GreaterThan(value,50.0)"]),
                                          ("s5_recent_range_scan", ["GreaterThanOrEqual(ts,", "LessThanOrEqual(ts,"]),
                                          ("x4_retention", ["GreaterThanOrEqual(ts,"])])
def test_filters_and_columns_reach_the_scan(spark, key, filters):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert all(f in pushed for f in filters)
    assert "props" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names(spark):
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
