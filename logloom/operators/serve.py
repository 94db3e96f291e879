"""Read queries: statistics, browsing, traces, rules, audit, samples, drift, alerts, exports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .normalize import current_view

STATUSES = ("parsed", "unparsed", "quarantined", "parse_error")
LIST_CAP, LIST_DEFAULT, EXPORT_CAP = 500, 50, 50_000
#: The closed vocabulary of audit actions, and those that are alerts.
AUDIT_ACTIONS = ("samples_split", "candidate_created", "candidate_failed", "rule_approved", "rule_rejected", "rule_deactivated", "rule_reactivated", "field_quarantined", "field_unquarantined", "reparse_complete")
ALERT_ACTIONS = ("rule_deactivated", "field_quarantined", "field_unquarantined")


def clamp(limit: int | None, cap: int = LIST_CAP, default: int = LIST_DEFAULT) -> int:
    return max(1, min(cap, default if limit is None else limit))


def stats_by_status(view: DataFrame) -> DataFrame:
    """Counts of the four statuses, also of those without events; an unknown status is an error."""
    known = view.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    checked = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("null")))))
    counts = view.groupBy("status").agg(F.count("*").alias("events")).withColumn("status", checked)
    return known.join(F.broadcast(counts), "status", "left").select("status", F.coalesce("events", F.lit(0)).alias("events"))  # four rows at most


def stats_by_fingerprint(view: DataFrame, limit: int = LIST_CAP) -> DataFrame:
    """Events and parsed events of each fingerprint, the largest first; truncated tells whether there were more."""
    found = view.groupBy("fingerprint_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "parsed").alias("parsed"))
    top = found.orderBy(F.desc("total"), "fingerprint_id").limit(limit + 1)
    order = Window.orderBy(F.desc("total"), "fingerprint_id")  # over limit + 1 rows
    return top.withColumn("n", F.row_number().over(order)).withColumn("truncated", F.max("n").over(Window.partitionBy()) > limit).where(F.col("n") <= limit).drop("n")


def parsed_percentage(view: DataFrame) -> DataFrame:
    return view.agg(F.round(100 * F.count_if(F.col("status") == "parsed") / F.greatest(F.count("*"), F.lit(1)), 1).alias("parsed_pct"), F.count("*").alias("events"))


def events_last_minute(view: DataFrame, asof: datetime | Column) -> DataFrame:
    at = asof if isinstance(asof, Column) else F.lit(asof)
    return view.where((F.col("parsed_at") >= at - F.expr("INTERVAL 1 MINUTE")) & (F.col("parsed_at") <= at)).agg(F.count("*").alias("events"))


def events_page(view: DataFrame, status: str | None = None, fingerprint: str | None = None, before: tuple[datetime, str] | datetime | None = None, limit: int | None = None) -> DataFrame:
    """Newest first. before is a time, or a time and event id, which loses no rows where times tie."""
    if status is not None:
        view = view.where(F.col("status") == status)
    if fingerprint is not None:
        view = view.where(F.col("fingerprint_id") == fingerprint)
    if isinstance(before, tuple):
        view = view.where((F.col("parsed_at") < F.lit(before[0])) | ((F.col("parsed_at") == F.lit(before[0])) & (F.col("event_id") < before[1])))
    elif before is not None:
        view = view.where(F.col("parsed_at") < F.lit(before))
    return view.orderBy(F.desc("parsed_at"), F.desc("event_id")).limit(clamp(limit))


def newest_page(view: DataFrame, status: str | None = None, fingerprint: str | None = None, before: tuple[datetime, str] | datetime | None = None, limit: int | None = None) -> DataFrame:
    """events_page of a table partitioned by day of parsed_at, without reading all of it: days are opened from the newest on, twice as many each time, until a page is full."""
    first = (before[0] if isinstance(before, tuple) else before).date() if before is not None else view.agg(F.max("day")).first()[0]
    if first is None:
        return events_page(view, status, fingerprint, before, limit)
    days = 1
    while days < 1 << 14:
        page = events_page(view.where(F.col("day").between(first - timedelta(days - 1), first)), status, fingerprint, before, limit)
        if page.count() == clamp(limit):
            return page
        days *= 2
    return events_page(view, status, fingerprint, before, limit)


def trace(view: DataFrame, raw: DataFrame) -> DataFrame:
    """Each event with the raw line it came from; both keys of the join prune day partitions."""
    r = raw.select("raw_id", F.col("received_at").alias("raw_received_at"), "source_id", "content_hash", "raw_text")
    return view.join(r, ["raw_id", "raw_received_at"])


def browse(view: DataFrame) -> DataFrame:
    """Display columns of the event browser: ip:port of both ends."""
    end = lambda side: F.concat_ws(":", F.col(f"ocsf.{side}.ip"), F.coalesce(F.col(f"ocsf.{side}.port").cast("string"), F.col(f"ocsf.{side}.port_raw")))
    return view.where("status = 'parsed'").select("event_id", "fingerprint_id", F.col("ocsf.time").alias("time"), end("src_endpoint").alias("source"), end("dst_endpoint").alias("target"), F.col("ocsf.action").alias("action"))


def rules_list(rules: DataFrame, status: str | None = None) -> DataFrame:
    rules = rules if status is None else rules.where(F.col("status") == status)
    return rules.orderBy("fingerprint_id", F.desc("version"))


def rules_latest(rules: DataFrame) -> DataFrame:
    """Of each fingerprint the rule of the highest version."""
    return rules.groupBy("fingerprint_id").agg(F.max_by(F.struct("version", "status", "provenance"), "version").alias("r")).select("fingerprint_id", "r.*")


def quarantined_fields(rules: DataFrame) -> DataFrame:
    return rules.where("status = 'active'").select("fingerprint_id", F.explode("quarantined_fields").alias("field")).distinct()


def audit_page(audit: DataFrame, entity: str | None = None, limit: int | None = 200) -> DataFrame:
    audit = audit if entity is None else audit.where(F.col("entity") == entity)
    return audit.orderBy(F.desc("id")).limit(clamp(limit))


def samples_by_role(samples: DataFrame) -> DataFrame:
    """Counts of samples by role and the last capture; samples has role, as split_roles gives it."""
    count = lambda role: F.count_if(F.col("role") == role).alias(role)
    return samples.groupBy("fingerprint_id").agg(*map(count, ("prompt", "held_out", "unused")), F.count("*").alias("total"), F.max("captured_at").alias("last_captured_at"))


def drift_latest(rows: DataFrame) -> DataFrame:
    """The latest window of each fingerprint and field."""
    order = Window.partitionBy("fingerprint_id", "field").orderBy(F.desc("window_start"), F.desc("rule_version"))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def alerts(rows: DataFrame, audit: DataFrame, limit: int | None = None) -> DataFrame:
    """Windows that aren't none and three audit actions, the latest first."""
    drift = rows.where("severity <> 'none'").select(F.lit("drift").alias("kind"), F.col("window_start").alias("ts"), "fingerprint_id", "field", "severity", F.col("action_taken").alias("action"))
    acted = audit.where(F.col("action").isin(*ALERT_ACTIONS)).select(F.lit("audit").alias("kind"), "ts", F.col("entity").alias("fingerprint_id"), "action")
    return drift.unionByName(acted, allowMissingColumns=True).orderBy(F.desc("ts"), "kind", "fingerprint_id", "field").limit(clamp(limit))


def unmapped_opportunities(rows: DataFrame) -> DataFrame:
    """Unmapped keys seen in windows, with how often: candidates for a mapping."""
    return rows.where(F.col("field").startswith("unmapped.")).groupBy("fingerprint_id", "field").agg(F.count("*").alias("windows"), F.sum("events_count").alias("events"))


def export_rows(normalized: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Parsed current events, newest first; another status as well finds nothing."""
    view = current_view(normalized).where("status = 'parsed'")
    view = view if status is None else view.where(F.col("status") == status)
    return view.orderBy(F.desc("parsed_at"), F.desc("event_id")).limit(clamp(limit, EXPORT_CAP, EXPORT_CAP))


def export_jsonl(rows: DataFrame, path: str) -> None:
    """One document a line; nulls are written."""
    rows.select(F.to_json("ocsf", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def flat(rows: DataFrame) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return rows.select("event_id", "raw_id", "fingerprint_id", "rule_version", "status", iso("parsed_at").alias("parsed_at"), F.to_json("ocsf", {"ignoreNullFields": "false"}).alias("ocsf"))


def export_parquet(rows: DataFrame, path: str) -> None:
    flat(rows).write.mode("overwrite").option("compression", "snappy").parquet(path)


def tail(view: DataFrame, cursor: tuple[datetime, str] | None = None, snapshot: int = 100) -> DataFrame:
    """A snapshot of the newest events, the oldest of them first; after a cursor, all that came later."""
    if cursor is None:
        return view.orderBy(F.desc("parsed_at"), F.desc("event_id")).limit(snapshot).orderBy("parsed_at", "event_id")
    at, event = cursor
    return view.where((F.col("parsed_at") > F.lit(at)) | ((F.col("parsed_at") == F.lit(at)) & (F.col("event_id") > event))).orderBy("parsed_at", "event_id")
