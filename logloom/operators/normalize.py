"""Normalise: raw events joined to the active rule of their fingerprint and parsed into event documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.drift import iso_time
from ..functions.extract import Rule, document, parse_error, parsed_document
from ..functions.fingerprint import bound
from ..functions.ids import event_id
from ..functions.json_schema import compile_schema
from ..schemas import DOCUMENT_RULE
from ..storage import small

#: Samples are captured for a fingerprint without an active rule up to this many.
SAMPLE_CAP = 200


def active(rules: Iterable[Rule]) -> list[Rule]:
    """The active rules; two for one fingerprint are an error."""
    found = [r for r in rules if r.status == "active"]
    if len({r.fingerprint_id for r in found}) < len(found):
        raise ValueError("a fingerprint has two active rules")
    return found


def normalize(events: DataFrame, rules: Iterable[Rule], parsed_at: Column | None = None, ignore_quarantine: bool = False) -> DataFrame:
    """A normalized event for each raw event: status parsed, unparsed (no rule) or parse_error.

    The rules are compiled into the plan: one expression for each distinct pattern and mapping,
    chosen by fingerprint, so that parsing needs no join and no Python. Missing
    times are filled with the time of receipt.
    """
    rules = active(rules)
    if ignore_quarantine:
        rules = [Rule(r.fingerprint_id, r.version, r.pattern, r.mappings, r.provenance, r.status) for r in rules]
    by_body: dict[tuple, list[Rule]] = {}
    for r in rules:
        by_body.setdefault((r.pattern, r.effective().mappings), []).append(r)
    fingerprint, raw = F.col("fingerprint_id"), F.col("raw_text")
    version, error, doc = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit("")), F.when(F.lit(False), document({}, F.create_map().cast("map<string,string>")))
    for r in rules:
        version = version.when(fingerprint == r.fingerprint_id, r.version)
    for body in by_body.values():
        chosen = fingerprint.isin([r.fingerprint_id for r in body])
        error, doc = error.when(chosen, parse_error(raw, body[0])), doc.when(chosen, parsed_document(raw, body[0]))
    at = F.col("received_at") if parsed_at is None else parsed_at
    # Three steps: what has no rule or doesn't match is known before a document is built, and without one if none is asked for.
    out = events.withColumn("rule_version", version.cast("int")).withColumn("error", error)
    out = out.withColumn("status", F.when(F.col("rule_version").isNull(), "unparsed").when(F.col("error").isNull(), "parsed").otherwise("parse_error"))
    out = out.withColumn("doc", F.when(F.col("status") == "parsed", doc))
    filled = F.col("doc").withField("time", F.coalesce("doc.time", F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))
    return out.select(
        event_id(F.col("raw_id"), F.coalesce("rule_version", F.lit(0))).alias("event_id"), "raw_id", F.col("received_at").alias("raw_received_at"), at.alias("parsed_at"), "fingerprint_id", "rule_version", "status",
        F.when(F.col("doc").isNotNull(), filled).alias("ocsf"), "error", F.to_date(at).alias("day"),
    )


def envelopes(normalized: DataFrame) -> DataFrame:
    """Key and value of the topic of normalized events; every status is sent."""
    return normalized.select(F.col("fingerprint_id").alias("key"), F.to_json(F.struct("event_id", "raw_id", "fingerprint_id", F.coalesce("rule_version", F.lit(0)).alias("rule_version"), "status", "ocsf")).alias("value"))


def dead_letters(normalized: DataFrame) -> DataFrame:
    return normalized.where("status = 'parse_error'").select(F.to_json(F.struct("raw_id", "fingerprint_id", "error")).alias("value"))


def capture_samples(events: DataFrame, rules: Iterable[Rule], existing: DataFrame | None = None, cap: int = SAMPLE_CAP) -> DataFrame:
    """Samples of fingerprints without an active rule, the earliest first, with those there already up to the cap."""
    covered = [r.fingerprint_id for r in active(rules)]
    open_ = events.where(~F.col("fingerprint_id").isin(covered)) if covered else events
    if existing is not None:
        open_ = open_.join(existing.select("raw_id"), "raw_id", "left_anti").join(existing.groupBy("fingerprint_id").agg(F.count("*").alias("have")), "fingerprint_id", "left")
    else:
        open_ = open_.withColumn("have", F.lit(0))
    order = Window.partitionBy("fingerprint_id").orderBy("received_at", "raw_id")
    taken = open_.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap).where(F.col("rn") <= cap - F.coalesce("have", F.lit(0)))
    return taken.select("fingerprint_id", "raw_id", "raw_text", F.col("received_at").alias("captured_at"))


def superseded(normalized: DataFrame) -> DataFrame:
    """(day, event_id, superseded_by_event_id) of the events that are not current: of each raw event the row of the highest rule version is.

    Only ids, versions and days are read and shuffled; documents stay where they are.
    """
    ids = normalized.select("raw_id", "event_id", "day", F.coalesce("rule_version", F.lit(0)).alias("version"))
    top = ids.groupBy("raw_id").agg(F.max(F.struct("version", "event_id")).alias("top"), F.count("*").alias("n")).where("n > 1")
    return ids.join(top, "raw_id").where("event_id <> top.event_id").select("day", "event_id", F.col("top.event_id").alias("superseded_by_event_id"))


def current_view(normalized: DataFrame, delta: DataFrame | None = None) -> DataFrame:
    """What has not been superseded: the events without those of a delta (day, event_id), found from the events where none is given.

    A delta holds only what later rules have replaced; up to 16 MB of it go to all executors, so
    that documents are not shuffled. A larger one is joined by day and event.
    """
    delta = superseded(normalized) if delta is None else delta
    return normalized.join(small(delta.select("day", "event_id"), 96), ["day", "event_id"], "left_anti").select(normalized.columns)


def replaced_by(new: DataFrame, view: DataFrame) -> DataFrame:
    """The delta of new events: the current events of the same raw events, of lower versions."""
    by = new.select("raw_id", F.col("event_id").alias("superseded_by_event_id"), F.coalesce("rule_version", F.lit(0)).alias("to"))
    old = view.select("raw_id", "event_id", "day", F.coalesce("rule_version", F.lit(0)).alias("version"))
    return old.join(small(by, 160), "raw_id").where("version < to").select("day", "event_id", "superseded_by_event_id")


def supersession(normalized: DataFrame) -> DataFrame:
    """normalized with superseded_by_event_id: the current event of the same raw event, null for that one itself."""
    return normalized.join(small(superseded(normalized), 160), ["day", "event_id"], "left").select(*normalized.columns, "superseded_by_event_id")


def document_variant(doc: Column) -> Column:
    """A document as a VARIANT of its JSON: all keys but those that an endpoint lacks, and a port that is no integer as text."""

    def built(d: Column) -> Column:
        port = lambda e: F.coalesce(e["port"].cast("variant"), e["port_raw"].cast("variant"))
        side = lambda e: F.when(e.isNotNull(), F.parse_json(F.to_json(F.struct(e["ip"].alias("ip"), port(e).alias("port")))))
        fields = ("class_uid", "class_name", "activity_id", "severity_id", "time", "action", "message", "metadata", "unmapped")
        return F.parse_json(F.to_json(F.struct(*[d[f].alias(f) for f in fields], *[side(d[f]).alias(f) for f in ("src_endpoint", "dst_endpoint")]), {"ignoreNullFields": "false"}))

    return F.when(doc.isNotNull(), bound(doc, built))


def document_errors(doc: Column, rule: dict = DOCUMENT_RULE) -> Column:
    """What is wrong with a document by its schema, as an array of texts."""
    return bound(document_variant(doc), compile_schema(rule))


def canary(normalized: DataFrame, every: int = 100, rule: dict = DOCUMENT_RULE) -> DataFrame:
    """Checked and failed counts of the documents of about one event in so many, chosen by the last digits of their id."""
    chosen = normalized.where("status = 'parsed'").where(F.conv(F.substring("event_id", -8, 8), 16, 10).cast("long") % every == 0)
    return chosen.agg(F.count("*").alias("checked"), F.count_if(F.size(document_errors(F.col("ocsf"), rule)) > 0).alias("failed"))


def readable_time(doc: Column) -> Column:
    return F.coalesce(iso_time(doc["time"]), F.lit(False))
