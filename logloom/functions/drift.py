"""Drift arithmetic as columns: value classes, divergence, severity ladders, actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("none", "minor", "moderate", "severe")
#: The ladders.
MATCH_BANDS, SHAPE_BANDS, VIOLATION_BANDS = (0.10, 0.25, 0.50), (0.15, 0.35, 0.60), (0.05, 0.20, 0.50)
IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def classify_value(value: Column) -> Column:
    """ipv4, timestamp, int or free_text; null for a null."""
    return F.when(value.isNull(), None).when(value.rlike(IPV4), "ipv4").when(value.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}"), "timestamp").when(value.rlike(r"^\d+$"), "int").otherwise("free_text")


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence (natural log) of two histograms, one added to each class that either has; 0 for two empty ones."""
    keys = F.array_union(F.map_keys(p), F.map_keys(q))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k).cast("double"), F.lit(0.0)) + 1
    total = lambda m: F.aggregate(keys, F.lit(0.0), lambda s, k: s + at(m, k))
    all_p, all_q = total(p), total(q)

    def term(s: Column, k: Column) -> Column:
        a, b = at(p, k) / all_p, at(q, k) / all_q
        m = (a + b) / 2
        return s + 0.5 * a * F.log(a / m) + 0.5 * b * F.log(b / m)

    return F.aggregate(keys, F.lit(0.0), term)


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def severity_of(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (level + 1).cast("int"))


def worst(*severities: Column) -> Column:
    """The worst of several severities; nulls don't count; none without any."""
    return severity_of(F.greatest(F.lit(0), *[F.coalesce(rank(s), F.lit(0)) for s in severities]))


def band(value: Column, bands: tuple[float, float, float]) -> Column:
    a, b, c = bands
    return F.when(value < a, "none").when(value < b, "minor").when(value < c, "moderate").when(value.isNotNull(), "severe")


def match_rate_severity(current: Column, baseline: Column) -> Column:
    return band(F.round(baseline - current, 6), MATCH_BANDS)


def shape_severity(divergence: Column) -> Column:
    return band(divergence, SHAPE_BANDS)


def tier1_severity(rate: Column) -> Column:
    return band(rate, VIOLATION_BANDS)


def null_rate_severity(current: Column, baseline: Column) -> Column:
    """By how many times the null rate grew, if by at least 0.05; from 0 it grows without bound."""
    now, base = F.round(current, 6), F.round(baseline, 6)
    ratio = F.when(base > 0, now / base).when(now > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
    change = F.round(now - base, 6)
    return F.when(now.isNull() | base.isNull(), None).when((ratio < 3) | (change < 0.05), "none").when(ratio < 10, "minor").when(ratio < 40, "moderate").otherwise("severe")


def volume_severity(count: Column, low: Column, high: Column) -> Column:
    return F.when(count == 0, "severe").when(low.isNull() | high.isNull(), None).when((count >= low) & (count <= high), "none").otherwise("minor")


def decide_action(severity: Column) -> Column:
    return F.when(severity == "minor", "alert").when(severity == "moderate", "field_quarantined").when(severity == "severe", "rule_deactivated")


def iso_time(value: Column) -> Column:
    """Opens with a full date and can be read as a timestamp."""
    return value.rlike(r"^\d{4}-\d{2}-\d{2}") & value.try_cast("timestamp").isNotNull()


def tier1_violation(field: str, doc: Column) -> Column:
    """Does the value of a mapped target break its invariant? Nulls don't."""
    if field in ("src_endpoint.ip", "dst_endpoint.ip"):
        return F.coalesce(~target_text(field, doc).rlike(IPV4), F.lit(False))
    if field in ("src_endpoint.port", "dst_endpoint.port"):
        side = doc[field.split(".")[0]]
        return F.coalesce(side["port_raw"].isNotNull() | ~side["port"].between(0, 65_535), F.lit(False))
    if field == "severity_id":
        return F.coalesce(~doc["severity_id"].between(0, 6), F.lit(False))
    if field == "time":
        return F.coalesce(~iso_time(doc["time"]), F.lit(False))
    return F.lit(False)


def target_text(field: str, doc: Column) -> Column:
    """The value of a target as text, null if missing; a port that is no integer as it came."""
    parts = field.split(".")
    if parts[-1] == "port":
        return F.coalesce(doc[parts[0]]["port"].cast("string"), doc[parts[0]]["port_raw"])
    value = doc
    for p in parts:
        value = value[p]
    return value.cast("string")
