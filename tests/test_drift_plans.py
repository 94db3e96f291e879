"""No drift step puts the whole history of one rule into one task (F5 to F12)."""

import re

from logloom.functions.extract import SEEDS
from logloom.operators import drift as W
from logloom.operators.normalize import normalize
from logloom.plans.lines import derived_events
from pyspark.sql import functions as F


def test_no_join_by_the_rule_alone(spark):
    view = normalize(derived_events(spark, "/root/testdata/sf0.001"), SEEDS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only what is marked is broadcast
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        closed = plan(W.windows(view, 100, 864_000))
        assert not re.search(r"Join \[fingerprint_id#\d+, rule_version#\d+\]", closed.replace("BroadcastHashJoin", "")) and closed.count("BroadcastHashJoin") >= 2
        rows = spark.createDataFrame([], "fingerprint_id string, rule_version int, field string, window_start timestamp, window_end timestamp, events_count bigint, null_rate double, match_rate double, violation_rate double, shape_dist map<string,bigint>, severity string")
        assert "SortMergeJoin" not in plan(W.findings(rows.repartition(2), W.baseline(rows.repartition(3), 3), SEEDS))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_enforcement_sorts_no_windows(spark):
    """A task of the scan holds no more than a row a field, severity and action (F7)."""
    rows = [("f", 1, "a", f"2024-05-01 00:00:{k:02d}", s, act) for k, (s, act) in enumerate([("minor", "alert"), ("moderate", "field_quarantined"), ("moderate", "alert"), ("none", None), ("moderate", "field_quarantined")])]
    found = spark.createDataFrame(rows, "fingerprint_id string, rule_version int, field string, window_start string, severity string, action_taken string").withColumn("window_start", F.col("window_start").cast("timestamp"))
    plan = W.enforcement_plan(found)
    scan = plan._jdf.queryExecution().executedPlan().toString().splitlines()[-6:]
    assert any("HashAggregate" in x for x in scan) and not any("Sort" in x for x in scan)
    assert [(r.field, str(r.window_start), r.severity, r.action) for r in plan.collect()] == [("a", "2024-05-01 00:00:01", "moderate", "field_quarantined")]
