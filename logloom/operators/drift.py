"""Drift: count-or-time windows over the current view, field statistics, baselines, findings, enforcement."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import drift as D
from ..functions.extract import Rule
from ..storage import small

KEY = ("fingerprint_id", "rule_version")
RULE_FIELD, UNMAPPED = "__rule__", "unmapped."
#: Rows with documents that a task sorts or groups: about 1 KB each.
TASK_ROWS = 100_000


def dealt(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """rows by hash in as many parts as hold TASK_ROWS of n, and no fewer than there are cores: parts don't grow with the table."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *by)


def windows(view: DataFrame, count_window: int = 1000, time_window_s: int = 600) -> DataFrame:
    """view with wid, the number of the closed window of each row; rows of an open window are left out.

    A window closes when it holds count_window rows, or when its first row is older than the
    newest row less time_window_s. So each row older than that is a window of its own, and the
    others are cut into windows of count_window: no state, only sums and numbers within a second.
    """
    rows = view.where(F.col("rule_version").isNotNull()).withColumn("second", F.date_trunc("second", "parsed_at"))
    counts = rows.groupBy(*KEY, "second").agg(F.count("*").alias("n"), F.max("parsed_at").alias("last"))
    # Numbers of the rows before each second, from sums over seconds of an hour and over hours: no task orders a whole history.
    counts = counts.withColumn("hour", F.date_trunc("hour", "second"))
    earlier = lambda of, by: F.coalesce(F.sum("n").over(Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = counts.groupBy(*KEY, "hour").agg(F.sum("n").alias("n"), F.max("last").alias("last")).withColumn("hours_before", earlier(KEY, "hour"))
    # One row a rule version: broadcast, as a shuffle by a handful of keys would give each task the whole history of one.
    ends = hours.groupBy(*KEY).agg(F.sum("n").alias("total"), (F.max("last") - F.make_interval(secs=F.lit(time_window_s))).alias("horizon"))
    before = counts.withColumn("seconds_before", earlier((*KEY, "hour"), "second")).join(hours.select(*KEY, "hour", "hours_before"), [*KEY, "hour"])
    before = before.select(*KEY, "second", (F.col("hours_before") + F.col("seconds_before")).alias("before"))
    nth = F.row_number().over(Window.partitionBy(*KEY, "second").orderBy("parsed_at", "event_id")) - 1
    known = F.broadcast(ends)
    n = rows.count()
    parts = dealt(rows, [*KEY, "second"], n)
    out = parts.withColumn("nth", nth).join(before, [*KEY, "second"]).withColumn("rn", F.col("before") + F.col("nth")).join(known, list(KEY)).withColumn("old", F.col("parsed_at") < F.col("horizon"))
    old = rows.select(*KEY, "parsed_at").join(known, list(KEY)).where(F.col("parsed_at") < F.col("horizon")).groupBy(*KEY).agg(F.count("*").alias("some_old"))
    out = out.join(F.broadcast(old), list(KEY), "left").withColumn("n_old", F.coalesce("some_old", F.lit(0)))
    full = F.col("n_old") + F.floor((F.col("total") - F.col("n_old")) / count_window) * count_window
    wid = F.when(F.col("old"), F.col("rn")).otherwise(F.col("n_old") + F.floor((F.col("rn") - F.col("n_old")) / count_window)).cast("long")
    closed = out.withColumn("wid", wid).where(F.col("old") | (F.col("rn") < full)).select(*view.columns, "wid")
    return dealt(closed, [*KEY, "wid"], n)  # bounds, fields and their join all go by window


def window_bounds(closed: DataFrame) -> DataFrame:
    """One row a closed window: start, end, rows, parsed, parse errors and match rate."""
    out = closed.groupBy(*KEY, "wid").agg(F.min("parsed_at").alias("window_start"), F.max("parsed_at").alias("window_end"), F.count("*").alias("events_count"), F.count_if(F.col("status") == "parsed").alias("parsed"), F.count_if(F.col("status") == "parse_error").alias("parse_errors"))
    return out.withColumn("match_rate", F.when(F.col("parsed") + F.col("parse_errors") > 0, F.col("parsed") / (F.col("parsed") + F.col("parse_errors"))))


def field_values(closed: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """One row a parsed document and mapped target of its rule, or unmapped key: value as text and violation."""
    doc, entries = F.col("ocsf"), []
    for target in sorted({t for r in rules for _, t in r.mappings}):
        owners = [F.struct(F.lit(r.fingerprint_id), F.lit(r.version)) for r in rules if target in {t for _, t in r.mappings}]
        entry = F.struct(F.lit(target).alias("field"), D.target_text(target, doc).alias("value"), D.tier1_violation(target, doc).alias("violation"))
        entries.append(F.when(F.struct(F.col("fingerprint_id"), F.col("rule_version")).isin(owners), entry))
    mapped = F.filter(F.array(*entries), lambda e: e.isNotNull())
    unmapped = F.transform(F.map_entries(doc["unmapped"]), lambda e: F.struct(F.concat(F.lit(UNMAPPED), e["key"]).alias("field"), e["value"].alias("value"), F.lit(False).alias("violation")))
    return closed.where("status = 'parsed' AND ocsf IS NOT NULL").select(*KEY, "wid", F.explode(F.concat(mapped, unmapped)).alias("f")).select(*KEY, "wid", "f.*")


def field_stats(closed: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Nulls, violations and counts of value classes by window and field; all partial aggregates."""
    kind = D.classify_value(F.col("value"))
    counts = [F.count_if(kind == c).alias(c) for c in ("ipv4", "timestamp", "int", "free_text")]
    out = field_values(closed, rules).groupBy(*KEY, "wid", "field").agg(F.count_if(F.col("value").isNull()).alias("nulls"), F.count_if("violation").alias("violations"), *counts)
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("ipv4", "timestamp", "int", "free_text")])
    return out.withColumn("shape_dist", F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0)))


def window_rows(view: DataFrame, rules: Iterable[Rule], count_window: int = 1000, time_window_s: int = 600) -> DataFrame:
    """Rows of drift_windows: one a window and field, and __rule__ for the window itself.

    Null rates are over the parsed documents. Where timestamps tie, windows may share their
    start: the first of them is kept.
    """
    rules, n = list(rules), view.where(F.col("rule_version").isNotNull()).count()
    closed = windows(view, count_window, time_window_s)
    bounds = dealt(window_bounds(closed), [*KEY, "window_start"], n)
    first = bounds.withColumn("n", F.row_number().over(Window.partitionBy(*KEY, "window_start").orderBy("wid"))).where("n = 1").drop("n")
    fields = field_stats(closed, rules).join(first, [*KEY, "wid"])
    hidden = F.col("field").startswith(UNMAPPED)
    violation = F.when(~hidden, F.col("violations") / F.col("parsed"))
    fields = fields.select(*KEY, "field", "wid", "window_start", "window_end", "events_count", (F.col("nulls") / F.col("parsed")).alias("null_rate"), F.lit(None).cast("double").alias("match_rate"), violation.alias("violation_rate"), "shape_dist", F.coalesce(D.tier1_severity(violation), F.lit("none")).alias("severity"))
    whole = first.select(*KEY, F.lit(RULE_FIELD).alias("field"), "wid", "window_start", "window_end", "events_count", F.lit(None).cast("double").alias("null_rate"), "match_rate", F.lit(None).cast("double").alias("violation_rate"), F.lit(None).cast("map<string,bigint>").alias("shape_dist"), F.lit("none").alias("severity"))
    return fields.unionByName(whole)


def baseline(rows: DataFrame, n_windows: int = 10) -> DataFrame:
    """Profiles from the first n_windows windows of a rule version; none while there are fewer.

    Mean null and match rate, least and most events, and value classes summed and then scaled to
    shares; unmapped keys have no profile.
    """
    # The first n_windows hours that have windows hold the first n_windows of them: the others needn't be ordered.
    hours = rows.select(*KEY, F.date_trunc("hour", "window_start").alias("hour")).distinct()
    early = hours.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("hour"))).where(F.col("nth") <= n_windows).groupBy(*KEY).agg(F.max("hour").alias("until"))
    rows = rows.join(F.broadcast(early), list(KEY)).where(F.date_trunc("hour", "window_start") <= F.col("until")).drop("until")
    ranked = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("window_start"))).where(F.col("nth") <= n_windows)
    enough = ranked.groupBy(*KEY).agg(F.max("nth").alias("seen")).where(F.col("seen") >= n_windows)
    used = ranked.where(~F.col("field").startswith(UNMAPPED)).join(F.broadcast(enough), list(KEY))
    count = lambda c: F.coalesce(F.sum(F.coalesce(F.try_element_at("shape_dist", F.lit(c)), F.lit(0))), F.lit(0))
    classes = ("ipv4", "timestamp", "int", "free_text")
    rule = F.col("field") == RULE_FIELD
    out = used.groupBy(*KEY, "field").agg(F.avg("null_rate").alias("base_null"), F.avg("match_rate").alias("base_match"), F.min("events_count").alias("low"), F.max("events_count").alias("high"), F.max("seen").cast("int").alias("windows_seen"), *[count(c).alias(c) for c in classes])
    total = sum((F.col(c) for c in classes), F.lit(0))
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), (F.col(c) / F.when(total > 0, total)).alias("value")) for c in classes])
    shape = F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"] > 0, F.lit(False))))
    return out.select(*KEY, "field", "base_null", "base_match", F.when(rule, F.col("low")).alias("base_low"), F.when(rule, F.col("high")).alias("base_high"), F.when(~rule, shape).alias("base_shape"), "windows_seen")


def first_unmapped(rows: DataFrame) -> DataFrame:
    """The unmapped keys of the earliest window of each rule version."""
    first = rows.groupBy(*KEY).agg(F.min("window_start").alias("window_start"))
    return rows.where(F.col("field").startswith(UNMAPPED)).join(F.broadcast(first), [*KEY, "window_start"]).select(*KEY, "field").distinct()


def findings(rows: DataFrame, profiles: DataFrame, rules: Iterable[Rule] = ()) -> DataFrame:
    """rows with decided severity and action.

    Invariants always count; null rate and shape where a profile exists; match rate and volume
    for the rule itself, which alerts where a field would be quarantined. A new unmapped key
    alerts. A field that is quarantined already isn't again.
    """
    known = small(first_unmapped(rows).withColumn("known", F.lit(True)), 256)
    has_base = profiles.select(*KEY).distinct().withColumn("has_base", F.lit(True))
    # Profiles are a row a rule and target: broadcast, so that the rows of a field don't meet in one task.
    out = rows.join(F.broadcast(profiles), [*KEY, "field"], "left").join(known, [*KEY, "field"], "left").join(F.broadcast(has_base), list(KEY), "left")
    hist, rule, hidden = F.col("shape_dist"), F.col("field") == RULE_FIELD, F.col("field").startswith(UNMAPPED)
    total = F.aggregate(F.map_values(hist), F.lit(0.0), lambda s, x: s + x)
    scaled = F.transform_values("base_shape", lambda _, share: share * total)
    comparable = (F.size(hist) > 0) & (F.size("base_shape") > 0)
    divergence = F.when(comparable, D.js_divergence(hist, scaled))
    targets = [t for r in rules for t in [t for _, t in r.mappings]]
    new = hidden & F.coalesce("has_base", F.lit(False)) & F.col("known").isNull() & (~F.substring_index("field", UNMAPPED, -1).isin(targets) if targets else F.lit(True))
    field_severity = D.worst(D.tier1_severity(F.col("violation_rate")), D.null_rate_severity(F.col("null_rate"), F.col("base_null")), D.shape_severity(divergence))
    rule_severity = D.worst(D.match_rate_severity(F.col("match_rate"), F.col("base_match")), D.volume_severity(F.col("events_count"), F.col("base_low"), F.col("base_high")))
    severity = F.when(hidden, F.when(new, "minor").otherwise("none")).when(rule, rule_severity).otherwise(field_severity)
    quarantined = [F.struct(F.lit(r.fingerprint_id), F.lit(r.version), F.lit(t)) for r in rules for t in r.quarantined]
    action = D.decide_action(F.col("severity"))
    action = F.when(rule & (action == "field_quarantined"), "alert").otherwise(action)
    if quarantined:
        action = F.when((action == "field_quarantined") & F.struct("fingerprint_id", "rule_version", "field").isin(quarantined), None).otherwise(action)
    out = out.withColumn("divergence", divergence).withColumn("severity", severity)
    return out.withColumn("action_taken", action).drop("base_null", "base_match", "base_low", "base_high", "base_shape", "windows_seen", "known", "has_base")


def merge_findings(found: DataFrame) -> DataFrame:
    """The worst severity of each field over all windows."""
    return found.groupBy(*KEY, "field").agg(D.severity_of(F.max(D.rank(F.col("severity")))).alias("severity"))


def enforcement_plan(found: DataFrame) -> DataFrame:
    """What to do, worst first: one deactivation of a rule at most and then nothing else for it; else one action a field."""
    # A minimum of structs sorts what it reads: first the earliest time of each severity and action, by hash, which leaves a few rows a field.
    few = found.where(F.col("action_taken").isNotNull()).groupBy(*KEY, "field", "severity", "action_taken").agg(F.min("window_start").alias("window_start"))
    first = F.min(F.struct((-D.rank(F.col("severity"))).alias("order"), "window_start", "severity", "action_taken")).alias("f")  # the worst, of equals the earliest
    worst = few.groupBy(*KEY, "field").agg(first).select(*KEY, "field", "f.*")
    gone = F.max(F.col("action_taken") == "rule_deactivated").over(Window.partitionBy(*KEY))
    lead = F.row_number().over(Window.partitionBy(*KEY).orderBy(D.rank(F.col("severity")).desc(), "window_start", "field"))
    return worst.withColumn("gone", gone).withColumn("lead", lead).where(~F.col("gone") | (F.col("lead") == 1)).select(*KEY, "field", "window_start", "severity", F.col("action_taken").alias("action"))
