"""Cold-path jobs over the tables: candidates, the backlog, drift; one pass each, and a loop that repeats them."""

from __future__ import annotations

import logging
import os
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Batch, filter_of
from .functions.extract import Rule
from .operators import drift as W
from .operators import lifecycle as L
from .operators.normalize import replaced_by
from .rulebook import RuleBook
from .schemas import append_new, new_rows, read, read_current, schema
from .storage import materialise

log = logging.getLogger("logloom.jobs")


@dataclass(frozen=True)
class Settings:
    """What the jobs go by. Each may be set as LOGLOOM_ and its name in capitals."""

    window_count: int = 1000
    window_time_s: int = 600
    baseline_windows: int = 10
    drift_poll_s: float = 5.0
    ready_samples: int = L.READY
    prompt_size: int = L.PROMPT
    held_out_size: int = L.HELD_OUT
    fresh_samples: int = L.FRESH
    onboarding_poll_s: float = 5.0
    reparse_poll_s: float = 2.0

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        return cls(**{f.name: type(f.default)(env[key]) for f in fields(cls) if (key := f"LOGLOOM_{f.name.upper()}") in env})


# --- candidates -----------------------------------------------------------------------------


def record_failure(spark: SparkSession, root: str, book: RuleBook, fingerprint: str, error: str) -> None:
    """An attempt with the number of all samples there are by now, so that the next waits for new ones, and its audit entry."""
    seen = read(spark, root, "onboarding_samples").where(F.col("fingerprint_id") == fingerprint).count()
    row = spark.range(1).select(F.lit(fingerprint).alias("fingerprint_id"), F.lit(seen).cast("int").alias("samples_seen"), F.current_timestamp().alias("attempted_at"), F.lit(error).alias("error"))
    row.write.mode("append").parquet(f"{root}/onboarding_attempts")
    book.write(lambda ledger: ledger.note("engine", "candidate_failed", fingerprint))


def process_fingerprint(spark: SparkSession, root: str, fingerprint: str, client: Callable[[str, float], str] | None = None, settings: Settings | None = None) -> bool:
    """One candidate cycle of one fingerprint; whether a candidate was stored.

    Lines that are all JSON give a rule by the names of their keys, others one by the client (a
    function of prompt and temperature). A failure is recorded, never raised.
    """
    settings, book = settings or Settings(), RuleBook(spark, root)
    if any(r.fingerprint_id == fingerprint and r.status in ("active", "pending_review") for r in book.ledger().rules):
        return False
    found = read(spark, root, "onboarding_samples").where(F.col("fingerprint_id") == fingerprint)
    samples = L.split_roles(found, settings.prompt_size, settings.held_out_size).where("role <> 'unused'")
    if samples.count() < settings.prompt_size + settings.held_out_size:
        return False
    book.write(lambda ledger: ledger.note("engine", "samples_split", fingerprint))
    try:
        if not samples.where("role = 'prompt'").where(~L.is_json(F.col("raw_text"))).limit(1).count():
            rule = L.json_rule(samples, fingerprint)
        elif client is None:
            raise ValueError("no language model is given")
        else:
            rule = L.generate_candidate(fingerprint, samples, client)
        if rule is None:
            raise ValueError("no reply of the language model passes the gate")
        report = L.validate_candidate(rule, samples)
        if not report["passed"]:
            raise ValueError("; ".join(report["notes"][:3]) or "the gate refuses it")
        book.write(lambda ledger: ledger.propose(rule))
    except Exception as e:  # fails closed: the fingerprint waits for more samples
        log.exception("no candidate for %s", fingerprint)
        record_failure(spark, root, book, fingerprint, f"{type(e).__name__}: {e}")
        return False
    return True


def candidate_job(spark: SparkSession, root: str, client: Callable[[str, float], str] | None = None, settings: Settings | None = None) -> dict[str, bool]:
    """A candidate cycle of every fingerprint that is ready; fingerprints to whether one was stored."""
    settings = settings or Settings()
    ready = L.ready_fingerprints(read(spark, root, "onboarding_samples"), RuleBook(spark, root).frame(), read(spark, root, "onboarding_attempts"), settings.ready_samples, settings.fresh_samples)
    names = [r.fingerprint_id for r in ready.orderBy("fingerprint_id").collect()]  # formats, not lines
    return {name: process_fingerprint(spark, root, name, client, settings) for name in names}


# --- backlog --------------------------------------------------------------------------------


def reparse_job(spark: SparkSession, root: str) -> dict[str, int]:
    """Parse the backlog of every active rule that has one, append what is new, and audit it once; fingerprints to rows.

    All rules go in one job. Parsing time is the time of receipt, so a second run finds nothing to do.
    """
    book = RuleBook(spark, root)
    view = read_current(spark, root)
    behind = [r.fingerprint_id for r in L.stale(view, book.frame()).collect()]
    if not behind:
        return {}
    live = [r for r in book.ledger().rules if r.status == "active" and r.fingerprint_id in behind]
    done = L.reparse(view, read(spark, root, "raw_events"), live, F.col("received_at")).persist()
    try:
        counts = {r.fingerprint_id: r["count"] for r in done.groupBy("fingerprint_id").count().collect()}
        batch = Batch(spark, root, f"reparse-{uuid.uuid4().hex}")
        fresh = batch.add("normalized_events", new_rows(done, root, "normalized_events", ["event_id"]))
        batch.add("key_filters_normalized_events", filter_of(fresh, ["event_id"]))
        batch.add("superseded", replaced_by(fresh, view))
        batch.commit()  # the new events and what they replace are seen together
    finally:
        done.unpersist()
    for name in sorted(counts):
        book.write(lambda ledger, name=name: ledger.note("engine", "reparse_complete", name))
    return counts


# --- drift ----------------------------------------------------------------------------------


def establish_baselines(spark: SparkSession, root: str, windows: int) -> DataFrame:
    """Profiles of the rule versions that have enough windows and none yet: written once, never again."""
    known = read(spark, root, "baseline_profiles").select(*W.KEY).distinct()
    new = W.baseline(read(spark, root, "drift_windows"), windows).join(known, list(W.KEY), "left_anti")
    return append_new(new.select(*[f.name for f in schema("baseline_profiles")]), root, "baseline_profiles", [*W.KEY, "field"])


def drift_job(spark: SparkSession, root: str, settings: Settings | None = None) -> dict[str, int]:
    """Scan all active rules: record the new windows with what was decided, then baselines, then act on the findings.

    Findings are against the profiles that were there before the scan. Windows that are recorded
    already keep what was decided then; actions on all findings are repeated, as one that was
    carried out changes nothing. Returns how many windows and actions were new.
    """
    settings, book = settings or Settings(), RuleBook(spark, root)
    live = [r for r in book.ledger().rules if r.status == "active"]
    if not live:
        return {"windows": 0, "actions": 0}
    view = read_current(spark, root)
    keys = spark.createDataFrame([(r.fingerprint_id, r.version) for r in live], "fingerprint_id string, rule_version int")
    view = view.join(F.broadcast(keys), list(W.KEY), "left_semi")  # one row a rule
    rows = W.window_rows(view, live, settings.window_count, settings.window_time_s)
    found = W.findings(rows, read(spark, root, "baseline_profiles"), live)
    found = materialise(found.select(*[f.name for f in schema("drift_windows")]), "drift-scan")
    new = append_new(found, root, "drift_windows", [*W.KEY, "field", "window_start"]).where(F.col("field") == W.RULE_FIELD).count()
    establish_baselines(spark, root, settings.baseline_windows)
    plan = W.enforcement_plan(found).orderBy("fingerprint_id", "window_start", "field").collect()  # fields of rules
    before = len(book.ledger().audit)
    after = book.write(lambda ledger: ledger.enforce(plan))
    return {"windows": new, "actions": len(after.audit) - before}


def repeat(job: Callable[[], object], seconds: float, stop: threading.Event) -> int:
    """Run a job again and again until stop is set; an error is logged and the next run tries anew. Returns the runs."""
    runs = 0
    while not stop.is_set():
        try:
            job()
        except Exception:
            log.exception("a run failed; the next one starts in %s s", seconds)
        runs += 1
        stop.wait(seconds)
    return runs


def manual_candidate(book: RuleBook, rule: Rule, samples: DataFrame, actor: str) -> Rule:
    """A hand-written rule through the gate of all candidates, pending review; a refused one is a TransitionError and writes nothing."""
    L.gate(rule, samples)
    after = book.write(lambda ledger: ledger.propose(replace(rule, provenance="human"), actor))
    return max((r for r in after.rules if r.fingerprint_id == rule.fingerprint_id), key=lambda r: r.version)


def approve(book: RuleBook, fingerprint: str, version: int, actor: str, samples: DataFrame | None = None, mappings: tuple[tuple[str, str], ...] | None = None, override: tuple[str, tuple[tuple[str, str], ...]] | None = None) -> Rule:
    """Activate a candidate as it is, with other mappings (slm-edited) or with a pattern and mappings of its own (human).

    Changed content passes the gate on the samples before anything is written.
    """
    edited = None
    if mappings is not None or override is not None:
        draft = book.ledger().find(fingerprint, version)
        pattern, maps, source = (*override, "human") if override else (draft.pattern, mappings, "slm-edited")
        edited = Rule(fingerprint, version, pattern, tuple(maps), source)
        L.gate(edited, samples)
    return book.write(lambda ledger: ledger.approve(fingerprint, version, actor, edited)).active(fingerprint)

