"""The predecessor's variants, where they differ."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import drift as D
from ..functions.extract import Rule, document, parse, parse_error, parsed_document
from ..functions.fingerprint import PRIORITY, SYSLOG, bound, is_json_object, strip, vendor
from ..storage import materialise
from . import lifecycle

RESPONSES = {"none": "No action needed.", "minor": "Alert raised for review.", "moderate": "Field quarantined; the rule stays live.", "severe": "Rule deactivated; lines stay raw."}


def fingerprint(line: Column) -> Column:
    """CEF, LEEF, JSON and syslog; anything else is unknown."""
    found = lambda text: F.when(text.startswith("CEF:"), vendor(text, "cef")).when(text.startswith("LEEF:"), vendor(text, "leef")).when(is_json_object(text), "json").when(text.rlike(SYSLOG) | text.rlike(PRIORITY), "syslog").otherwise("unknown")
    return bound(strip(line), found)


def apply_rule(rows: DataFrame, rule: Rule, raw_col: str = "raw", ingest_col: str = "received_at") -> DataFrame:
    """Flat event columns of a line; a line without a match is an error; a missing time is the time of ingest."""
    p = parse(F.col(raw_col), rule)
    doc = F.when(p["error"].isNotNull(), F.raise_error(p["error"])).otherwise(p["doc"])
    return rows.withColumn("d", doc).withColumn("time", F.coalesce("d.time", F.date_format(ingest_col, "yyyy-MM-dd'T'HH:mm:ss"))).withColumn("unmapped_fields", F.map_keys("d.unmapped"))


def key_value_map(text: Column) -> Column:
    """Pairs parted by blanks, as the review screen reads them."""
    return F.str_to_map(text, F.lit(" "), F.lit("="))


def null_rate(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.avg(F.col(column).isNull().cast("int")).alias("null_rate"), F.count("*").alias("events"))


def check_drift(rates: DataFrame, base: float = 0.01) -> DataFrame:
    """rates (null_rate) with severity against a baseline, and the response to it."""
    answer = F.create_map(*[F.lit(x) for pair in RESPONSES.items() for x in pair])
    return rates.withColumn("severity", D.null_rate_severity(F.col("null_rate"), F.lit(base))).withColumn("response", answer[F.col("severity")])


def check_sequence(rows: DataFrame) -> DataFrame:
    """Stated severities against the ladder: rows with null_rate, baseline_null_rate, severity."""
    return rows.withColumn("found", D.null_rate_severity(F.col("null_rate"), F.col("baseline_null_rate"))).withColumn("agrees", F.col("found") == F.col("severity"))


def simulated_windows(rows: DataFrame, order_col: str, column: str, fractions: list[float], seed: int = 0) -> DataFrame:
    """Equal windows by order; in window k the share fractions[k] of the values of column is lost."""
    n = F.ntile(len(fractions)).over(Window.orderBy(order_col))  # a demo over a few rows: one order over all
    share = F.element_at(F.array(*map(F.lit, fractions)), F.col("window"))
    lost = F.pmod(F.xxhash64(F.lit(seed), F.col(order_col)), F.lit(1000)) / 1000 < share
    return rows.withColumn("window", n).withColumn(column, F.when(~lost, F.col(column)))


def validate_rule(rule: Rule, samples: DataFrame, raw_col: str = "raw") -> dict:
    """Four checks; without samples it fails."""
    doc = parse(F.col(raw_col), rule)["doc"]
    ends = ("src_endpoint", "dst_endpoint")
    bad_ip = [~F.coalesce(doc[e]["ip"].rlike(D.IPV4), F.lit(True)) for e in ends]
    bad_port = [D.tier1_violation(f"{e}.port", doc) for e in ends]
    row = samples.agg(F.count("*").alias("n"), F.count_if(doc.isNull()).alias("failed"), F.count_if(bad_ip[0] | bad_ip[1]).alias("ip"), F.count_if(bad_port[0] | bad_port[1]).alias("port")).first()
    checks = {"has_samples": row.n > 0, "all_match": row.n > 0 and not row.failed, "ips_valid": not row.ip, "ports_valid": not row.port}
    return {"passed": all(checks.values()), "checks": checks}


def fragmentation(lines: DataFrame, fingerprint_col: str = "fingerprint_id", shape_col: str = "shape_hash") -> DataFrame:
    """Distinct shapes of each fingerprint; more than one is a fragmented group."""
    return lines.groupBy(fingerprint_col).agg(F.count("*").alias("lines"), F.count_distinct(shape_col).alias("shapes")).withColumn("fragmented", F.col("shapes") > 1)


def generate_rule(fingerprint_id: str, samples: DataFrame, client: Callable[[str, float], str] | None = None, attempts: int = 3) -> tuple[Rule, float]:
    """A rule for a format and the share of all samples it reads whole. JSON goes by the names of its keys; if no reply passes, the last rule that could be read counts."""
    if fingerprint_id == "json":
        rule = lifecycle.json_rule(samples, fingerprint_id)
        return rule, lifecycle.confidence(samples, rule)
    if client is None:
        raise ValueError("no language model is given")
    rule, error, lines = None, None, [r.raw_text for r in lifecycle.first_samples(samples).select("raw_text").limit(lifecycle.PROMPT).collect()]
    for attempt in range(attempts):
        try:
            found = json.loads(lifecycle.outer_object(client(lifecycle.build_prompt(fingerprint_id, lines, error), 0.1 + 0.2 * attempt)))
            rule = Rule(fingerprint_id, 1, found["pattern"], tuple((m["source_field"], m["ocsf_path"]) for m in found["mappings"]), "slm")
        except (KeyError, TypeError, ValueError) as e:
            error = f"{type(e).__name__}: {e}"
            continue
        checks = validate_rule(rule, samples, "raw_text")
        if checks["passed"]:
            break
        error = str(checks["checks"])
    if rule is None:
        raise ValueError(f"no reply for {fingerprint_id} could be read: {error}")
    return rule, lifecycle.confidence(samples, rule)


class RuleStore:
    """Rules in one JSON file, by fingerprint; the last one saved counts."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def all(self) -> dict[str, Rule]:
        if not self.path.exists():
            return {}
        return {k: Rule(k, r["version"], r["pattern"], tuple(map(tuple, r["mappings"])), r["provenance"]) for k, r in json.loads(self.path.read_text()).items()}

    def get(self, fingerprint_id: str) -> Rule | None:
        return self.all().get(fingerprint_id)

    def save(self, rule: Rule) -> None:
        rules = {**self.all(), rule.fingerprint_id: rule}
        text = json.dumps({k: {"version": r.version, "pattern": r.pattern, "mappings": r.mappings, "provenance": r.provenance} for k, r in rules.items()}, indent=1)
        part = self.path.with_name(self.path.name + ".part")
        part.write_text(text)
        part.replace(self.path)  # readers see the old rules or the new ones


def ingest_lines(lines: DataFrame, root: str) -> DataFrame:
    """Append lines (raw, source_id) under random raw_ ids; returns them as stored."""
    rows = lines.select(F.concat(F.lit("raw_"), F.replace(F.uuid(), F.lit("-"), F.lit(""))).alias("raw_id"), "raw", "source_id", F.current_timestamp().alias("received_at"))
    path = f"{root}/legacy_raw_{uuid.uuid4().hex}"
    rows.write.parquet(path)  # ids are drawn once, when written
    return lines.sparkSession.read.schema(rows.schema).parquet(path)


def raw_event(stored: DataFrame, raw_id: str) -> DataFrame:
    """The stored line of an id; no row for an unknown one."""
    return stored.where(F.col("raw_id") == raw_id)


def onboard_new_format(store: RuleStore, fingerprint_id: str, samples: DataFrame, client: Callable[[str, float], str] | None = None) -> Rule | None:
    """The stored rule of a format, or a new one, saved; null where none can be made. Samples are looked for once, and only for a new rule."""
    if rule := store.get(fingerprint_id):
        return rule
    samples = materialise(samples, "samples")
    try:
        rule, _ = generate_rule(fingerprint_id, samples, client)
    except ValueError:
        return None
    store.save(rule)
    return rule


def process_lines(lines: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """lines (raw, fingerprint_id) with status (ok, failed, or unknown without a rule) and the document."""
    fp, raw = F.col("fingerprint_id"), F.col("raw")
    error, doc = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), document({}, F.create_map().cast("map<string,string>")))
    for name, rule in rules.items():
        error, doc = error.when(fp == name, parse_error(raw, rule)), doc.when(fp == name, parsed_document(raw, rule))
    out = lines.withColumn("status", F.when(~fp.isin(list(rules)), "unknown").when(error.isNull(), "ok").otherwise("failed"))
    return out.withColumn("doc", F.when(F.col("status") == "ok", doc))


def three_passes(lines: DataFrame, store: RuleStore, client: Callable[[str, float], str] | None = None, base: float = 0.01) -> DataFrame:
    """Fingerprint all lines (raw), onboard each format once, process all; by format: lines, ok, null rate of the source address, severity and response."""
    marked = materialise(lines.select("raw", fingerprint(F.col("raw")).alias("fingerprint_id")), "marked")  # each pass reads it
    rules = {}
    for r in marked.select("fingerprint_id").distinct().orderBy("fingerprint_id").collect():  # formats
        name = r.fingerprint_id
        samples = marked.where(F.col("fingerprint_id") == name).select("fingerprint_id", F.col("raw").alias("raw_text")).orderBy("raw_text").limit(lifecycle.READY)
        if name != "unknown" and (rule := onboard_new_format(store, name, samples, client)):
            rules[name] = rule
    done = process_lines(marked, rules).groupBy("fingerprint_id").agg(F.count("*").alias("lines"), F.count_if(F.col("status") == "ok").alias("ok"), F.avg(F.when(F.col("status") == "ok", F.col("doc.src_endpoint.ip").isNull().cast("int"))).alias("null_rate"))
    return check_drift(done, base)
