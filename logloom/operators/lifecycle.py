"""The life of rules: samples, readiness, candidates, the gate, transitions, and parsing the backlog again."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import drift as D
from ..functions.extract import JSON_RULE, MOST_CHARS, MOST_DEPTH, MOST_GROUPS, TARGETS, Rule, flatten_json, json_path, matches, parse, rule_errors, translate
from ..functions.mutate import mutate
from .normalize import document_errors, normalize
from .serve import AUDIT_ACTIONS

PROMPT, HELD_OUT, READY, FRESH, PROBES, PREVIEWS = 5, 15, 20, 10, 20, 5
#: Names of keys that stand for a target, in lower case.
ALIASES = {
    "src_endpoint.ip": ("src_ip", "source_ip", "srcip"),
    "src_endpoint.port": ("src_port", "source_port", "srcport"),
    "dst_endpoint.ip": ("dest_ip", "dst_ip", "destination_ip", "dstip"),
    "dst_endpoint.port": ("dest_port", "dst_port", "destination_port", "dstport"),
    "time": ("timestamp", "time"),
    "severity_id": ("severity", "sev"),
    "action": ("action", "event_type"),
    "message": ("message", "msg", "signature"),
}
#: Literals in the order in which they claim text: times, addresses, host names; then numbers of three digits or more.
LITERALS = (r"\d{4}-\d{2}-\d{2}[T ][0-9:.]+Z?", r"\d{1,3}(?:\.\d{1,3}){3}", r"\b[a-z][a-z0-9-]*\d{1,4}\b")


def split_roles(samples: DataFrame, prompt: int = PROMPT, held_out: int = HELD_OUT) -> DataFrame:
    """samples with role: of each fingerprint the first are prompt, the next held_out, the rest unused."""
    n = F.row_number().over(Window.partitionBy("fingerprint_id").orderBy("captured_at", "raw_id"))
    return samples.withColumn("n", n).withColumn("role", F.when(F.col("n") <= prompt, "prompt").when(F.col("n") <= prompt + held_out, "held_out").otherwise("unused")).drop("n")


def ready_fingerprints(samples: DataFrame, rules: DataFrame, attempts: DataFrame, minimum: int = READY, fresh: int = FRESH) -> DataFrame:
    """Fingerprints with enough samples, no active or pending rule, and never tried or with enough new samples since."""
    counts = samples.groupBy("fingerprint_id").agg(F.count("*").alias("samples")).where(F.col("samples") >= minimum)
    taken = rules.where(F.col("status").isin("active", "pending_review")).select("fingerprint_id")
    last = attempts.groupBy("fingerprint_id").agg(F.max_by("samples_seen", "attempted_at").alias("samples_seen"))
    out = counts.join(taken, "fingerprint_id", "left_anti").join(last, "fingerprint_id", "left")
    return out.where(F.col("samples_seen").isNull() | (F.col("samples") - F.col("samples_seen") >= fresh)).select("fingerprint_id", "samples", "samples_seen")


def literals(line: Column) -> Column:
    """Distinct literals of a line; a number inside another literal doesn't count."""
    found, rest = [], line
    for pattern in LITERALS:
        found.append(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)))
        rest = F.regexp_replace(rest, pattern, "\x00")
    return F.array_distinct(F.concat(*found, F.regexp_extract_all(rest, F.lit(r"\d{3,}"), F.lit(0))))


def hardcoded_literals(lines: DataFrame, pattern: str, line_col: str = "raw_text") -> DataFrame:
    """Literals in the pattern that not all lines share, sorted; with one line nothing is shared."""
    rows = lines.select(F.monotonically_increasing_id().alias("line"), F.explode(literals(F.col(line_col))).alias("literal")).where(F.instr(F.lit(pattern), F.col("literal")) > 0)
    n = lines.count()
    return rows.groupBy("literal").agg(F.count_distinct("line").alias("lines")).where((F.col("lines") < n) | F.lit(n < 2)).select("literal").orderBy("literal")


def sanity(doc: Column) -> dict[str, Column]:
    ends = ("src_endpoint", "dst_endpoint")
    ip = lambda side: F.coalesce(doc[side]["ip"].rlike(D.IPV4), F.lit(True))
    port = lambda side: ~D.tier1_violation(f"{side}.port", doc)
    return {"ip_fields_valid": ip(ends[0]) & ip(ends[1]), "port_fields_valid": port(ends[0]) & port(ends[1]), "severity_valid": ~D.tier1_violation("severity_id", doc)}


def validate_candidate(rule: Rule, samples: DataFrame, seed: int = 20260919, probes: int = PROBES) -> dict:
    """The report of the eight checks of a candidate on its samples (raw_text, role prompt or held_out).

    Without samples only caps, compilation and targets are checked, and a note says so. The match
    rate is over held-out lines alone.
    """
    base = rule_errors(rule)
    names = ("caps_and_allowlist", "samples_parse", "held_out_match_all", "ip_fields_valid", "port_fields_valid", "no_orphan_mappings", "adversarial_probe", "no_hardcoded_literals")
    checks, notes = dict.fromkeys(names, True), list(base)
    checks["caps_and_allowlist"] = not base
    if base:
        checks.update({k: False for k in names[1:5]})
        return report(checks, 0.0, notes, [], 0, 0)
    used = samples.where(F.col("role").isin("prompt", "held_out")).select("raw_text", "role", parse(F.col("raw_text"), rule).alias("p"))
    doc = F.col("p.doc")
    ok = sanity(doc)
    held = F.col("role") == "held_out"
    resolved = {t: F.coalesce(F.bool_or(D.target_text(t, doc).isNotNull()), F.lit(False)) for _, t in rule.mappings}
    orphan = [F.coalesce(F.bool_or(F.map_contains_key(doc["unmapped"], F.lit(s))), F.lit(False)).alias(f"u{i}") for i, (s, _) in enumerate(rule.mappings)]
    row = used.agg(
        F.count_if(~held).alias("prompt"), F.count_if(held).alias("held"), F.count_if(held & doc.isNotNull()).alias("matched"), F.count_if(doc.isNull()).alias("failed"),
        *[F.count_if(doc.isNotNull() & ~c).alias(k) for k, c in ok.items()], F.count_if(F.size(document_errors(doc)) > 0).alias("schema"), *[c.alias(f"t{i}") for i, c in enumerate(resolved.values())], *orphan,
    ).first()
    if not row.prompt + row.held:
        notes.append("no samples provided; sample-dependent checks were skipped")
        return report(checks, 1.0, notes, [], 0, 0)
    checks["caps_and_allowlist"] = not row.schema
    checks["samples_parse"] = not row.failed and not row.severity_valid
    checks["held_out_match_all"] = row.matched == row.held
    checks["ip_fields_valid"], checks["port_fields_valid"] = not row.ip_fields_valid, not row.port_fields_valid
    groups = set() if rule.pattern == JSON_RULE else set(translate(rule.pattern).groups)
    seen = {t: row[f"t{i}"] for i, t in enumerate(resolved)}
    orphans = [s for i, (s, t) in enumerate(rule.mappings) if s not in groups and not seen[t] and not row[f"u{i}"]]
    checks["no_orphan_mappings"] = not orphans
    prompts = used.where(~held)
    broken = prompts.select(F.explode(F.sequence(F.lit(1), F.lit(probes))).alias("n"), "raw_text").select(mutate(F.col("raw_text"), F.col("n") + seed).alias("line")).where(parse(F.col("line"), rule)["error"].isNotNull()).count()
    checks["adversarial_probe"] = not broken
    hard = [r.literal for r in hardcoded_literals(prompts, rule.pattern).collect()]  # parts of one pattern
    checks["no_hardcoded_literals"] = not hard
    notes += [f"{row.failed} sample lines failed to parse"] * bool(row.failed) + [f"mappings of fields that no sample has: {orphans}"] * bool(orphans) + [f"{broken} mutants failed to parse"] * bool(broken) + [f"values written into the pattern that differ from line to line: {hard}"] * bool(hard)
    previews = [{"line": r.raw_text, "status": "error" if r.ocsf is None else "parsed", "ocsf": json.loads(r.ocsf) if r.ocsf else None} for r in used.where(held).select("raw_text", F.to_json("p.doc").alias("ocsf")).limit(PREVIEWS).collect()]
    return report(checks, row.matched / row.held if row.held else 1.0, notes, previews, row.prompt, row.held)


def report(checks: dict[str, bool], rate: float, notes: list[str], previews: list[dict], prompt: int, held: int) -> dict:
    return {"passed": all(checks.values()), "checks": checks, "held_out_match_rate": rate, "notes": notes, "previews": previews, "prompt_count": prompt, "held_out_count": held}


def gate(rule: Rule, samples: DataFrame | None) -> dict:
    """The report of a rule that passes on the samples of its fingerprint; one that doesn't is a TransitionError. Without samples only the rule itself is checked."""
    if samples is None:
        wrong = rule_errors(rule)
        found = {"passed": not wrong, "notes": wrong}
    else:
        found = validate_candidate(rule, samples)
    if not found["passed"]:
        raise TransitionError("; ".join(found["notes"]) or str(found["checks"]))
    return found


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, t) for t, names in ALIASES.items() for a in names], "alias string, ocsf_path string")


def json_mappings(samples: DataFrame, line_col: str = "raw_text") -> DataFrame:
    """(fingerprint_id, ocsf_path, source_field): of the keys whose leaf is an alias of a target the first in order, one a target."""
    keys = samples.select("fingerprint_id", F.explode(F.map_keys(flatten_json(F.col(line_col)))).alias("source_field")).distinct()
    leaf = F.lower(F.substring_index("source_field", ".", -1))
    found = keys.withColumn("alias", leaf).join(F.broadcast(alias_table(samples.sparkSession)), "alias")  # the table is fixed and small
    return found.groupBy("fingerprint_id", "ocsf_path").agg(F.min("source_field").alias("source_field"))


def json_rule(samples: DataFrame, fingerprint: str, version: int = 1) -> Rule:
    """A JSON rule from the keys of the samples of a fingerprint; without any mapping it is refused."""
    found = json_mappings(samples.where(F.col("fingerprint_id") == fingerprint)).orderBy("source_field").collect()
    if not found:
        raise ValueError(f"no key of {fingerprint} is an alias of a target")
    return Rule(fingerprint, version, JSON_RULE, tuple((r.source_field, r.ocsf_path) for r in found), "slm", "pending_review")


def confidence(samples: DataFrame, rule: Rule, line_col: str = "raw_text") -> float:
    """Share of the samples that a rule reads whole, to two decimals; 0 without samples.

    A JSON rule reads a line whole if every mapped path has a value that isn't null.
    """
    line = F.col(line_col)
    good = matches(line, rule)
    if rule.pattern == JSON_RULE:
        for source, _ in rule.mappings:
            good = good & json_path(line, source).isNotNull()
    row = samples.agg(F.avg(F.coalesce(good, F.lit(False)).cast("int")).alias("a")).first()
    return round(row.a or 0.0, 2)


def is_json(line: Column) -> Column:
    """Whether a line is JSON, of any kind."""
    return F.try_parse_json(line).isNotNull()


def outer_object(text: str) -> str:
    """As extract_json, for one text; an error where there are no braces."""
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        raise ValueError("the reply holds no JSON object")
    return text[start : end + 1]


def extract_json(text: Column) -> Column:
    """The outermost braces of a reply, fences left out."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


# --- transitions ----------------------------------------------------------------------------


class TransitionError(ValueError):
    """The rule isn't in the state that the transition starts from (conflict), or isn't there."""


@dataclass(frozen=True)
class Ledger:
    """The rules and their audit trail. Transitions give a new ledger and leave this one alone."""

    rules: tuple[Rule, ...] = ()
    audit: tuple[tuple[str, str, str], ...] = ()  # (actor, action, entity)

    def find(self, fingerprint: str, version: int) -> Rule:
        for r in self.rules:
            if (r.fingerprint_id, r.version) == (fingerprint, version):
                return r
        raise TransitionError(f"no rule {fingerprint} version {version}")

    def active(self, fingerprint: str) -> Rule | None:
        return next((r for r in self.rules if r.fingerprint_id == fingerprint and r.status == "active"), None)

    def next_version(self, fingerprint: str) -> int:
        return max((r.version for r in self.rules if r.fingerprint_id == fingerprint), default=0) + 1

    def put(self, *changed: Rule, note: tuple[str, str, str] | None = None) -> Ledger:
        if note and note[1] not in AUDIT_ACTIONS:
            raise ValueError(f"{note[1]!r} is no audit action")
        keys = {(r.fingerprint_id, r.version) for r in changed}
        kept = tuple(r for r in self.rules if (r.fingerprint_id, r.version) not in keys)
        return Ledger(kept + changed, self.audit + ((note,) if note else ()))

    def note(self, actor: str, action: str, entity: str) -> Ledger:
        """An audit entry alone."""
        return self.put(note=(actor, action, entity))

    def expect(self, fingerprint: str, version: int, *states: str) -> Rule:
        rule = self.find(fingerprint, version)
        if rule.status not in states:
            raise TransitionError(f"rule {fingerprint} version {version} is {rule.status}")
        return rule

    def propose(self, rule: Rule, actor: str = "engine") -> Ledger:
        """A new candidate with the next version, pending review; one a fingerprint."""
        if any(r.fingerprint_id == rule.fingerprint_id and r.status == "pending_review" for r in self.rules):
            raise TransitionError(f"{rule.fingerprint_id} has a pending rule")
        new = replace(rule, version=self.next_version(rule.fingerprint_id), status="pending_review")
        return self.put(new, note=(actor, "candidate_created", rule.fingerprint_id))

    def approve(self, fingerprint: str, version: int, actor: str, edited: Rule | None = None) -> Ledger:
        """Activate a candidate in place of the active rule; an edited one becomes a version of its own and the draft is rejected."""
        draft, old = self.expect(fingerprint, version, "pending_review"), self.active(fingerprint)
        changed = [replace(old, status="superseded")] if old else []
        if edited is None:
            changed.append(replace(draft, status="active"))
        else:
            if wrong := rule_errors(edited):
                raise TransitionError("; ".join(wrong))
            changed += [replace(draft, status="rejected"), replace(edited, fingerprint_id=fingerprint, version=self.next_version(fingerprint), status="active")]
        return self.put(*changed, note=(actor, "rule_approved", fingerprint))

    def reject(self, fingerprint: str, version: int, actor: str) -> Ledger:
        return self.put(replace(self.expect(fingerprint, version, "pending_review"), status="rejected"), note=(actor, "rule_rejected", fingerprint))

    def deactivate(self, fingerprint: str, version: int, actor: str) -> Ledger:
        return self.put(replace(self.expect(fingerprint, version, "active"), status="deactivated"), note=(actor, "rule_deactivated", fingerprint))

    def reactivate(self, fingerprint: str, version: int, actor: str) -> Ledger:
        rule = self.expect(fingerprint, version, "deactivated", "superseded")
        if self.active(fingerprint):
            raise TransitionError(f"{fingerprint} has an active rule")
        return self.put(replace(rule, status="active"), note=(actor, "rule_reactivated", fingerprint))

    def quarantine(self, fingerprint: str, field: str, actor: str = "drift") -> Ledger:
        """Quarantine a field of the active rule; again, it changes nothing."""
        rule = self.active(fingerprint)
        if rule is None or field in rule.quarantined:
            return self
        return self.put(replace(rule, quarantined=(*rule.quarantined, field)), note=(actor, "field_quarantined", fingerprint))

    def unquarantine(self, fingerprint: str, field: str, actor: str) -> Ledger:
        rule = self.active(fingerprint)
        if rule is None:
            raise TransitionError(f"{fingerprint} has no active rule")
        if field not in rule.quarantined:
            raise TransitionError(f"{field} is not quarantined")
        return self.put(replace(rule, quarantined=tuple(f for f in rule.quarantined if f != field)), note=(actor, "field_unquarantined", fingerprint))

    def enforce(self, plan: Iterable) -> Ledger:
        """Carry out an enforcement plan (rows of fingerprint_id, field, action), worst first; repeated runs change nothing."""
        out = self
        for step in plan:
            rule = out.active(step.fingerprint_id)
            if step.action == "rule_deactivated" and rule:
                out = out.deactivate(rule.fingerprint_id, rule.version, "drift")
            elif step.action == "field_quarantined":
                out = out.quarantine(step.fingerprint_id, step.field)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r.fingerprint_id, r.version, r.pattern, [{"source_field": s, "ocsf_path": t} for s, t in r.mappings], r.provenance, None, r.status, list(r.quarantined)) for r in self.rules]
        from ..schemas import schema

        return spark.createDataFrame(rows, schema("rules"))


def fold_states(log: DataFrame) -> DataFrame:
    """The present status of each rule from an append-only log (seq, fingerprint_id, version, status)."""
    return log.groupBy("fingerprint_id", "version").agg(F.max_by("status", "seq").alias("status"))


# --- backlog --------------------------------------------------------------------------------


def stale(normalized: DataFrame, rules: DataFrame) -> DataFrame:
    """Active rules with current events of a lower version, or of none."""
    live = rules.where("status = 'active'").select("fingerprint_id", "version")
    seen = normalized.groupBy("fingerprint_id").agg(F.min(F.coalesce("rule_version", F.lit(0))).alias("low"))
    return live.join(seen, (live.fingerprint_id == seen.fingerprint_id) & (seen.low < live.version), "left_semi")


def reparse(view: DataFrame, raw: DataFrame, rules: Iterable[Rule], parsed_at: Column) -> DataFrame:
    """New events for the stale current ones, parsed under the active rules; quarantine doesn't count here."""
    live = [r for r in rules if r.status == "active"]
    newer = F.lit(False)
    for r in live:
        newer = newer | ((F.col("fingerprint_id") == r.fingerprint_id) & (F.coalesce("rule_version", F.lit(0)) < r.version))
    behind = view.where(newer).select("raw_id", F.col("raw_received_at").alias("received_at"))
    return normalize(raw.join(behind, ["raw_id", "received_at"]), live, parsed_at, ignore_quarantine=True)


def supersede_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("fingerprint_id").agg(F.count_if(F.col("superseded_by_event_id").isNotNull()).alias("superseded"), F.count_if(F.col("superseded_by_event_id").isNull()).alias("current"))


#: Two formats and the replies wanted for them: columns parted by tabs, and named parts in brackets.
EXAMPLES = (
    (
        "2031-05-06T07:08:09Z\trefuse\t10.1.2.3\t4242\t10.9.8.7\t22\tno such account",
        r"^(?P<at>[^\t]+)\t(?P<verdict>[^\t]+)\t(?P<peer>[^\t]+)\t(?P<peer_port>\d+)\t(?P<host>[^\t]+)\t(?P<host_port>\d+)\t(?P<text>.*)$",
        {"at": "time", "verdict": "action", "peer": "src_endpoint.ip", "peer_port": "src_endpoint.port", "host": "dst_endpoint.ip", "host_port": "dst_endpoint.port", "text": "message"},
    ),
    ("[level: 3] [caller: 10.4.4.4] [what: door opened]", r"^\[level: (?P<level>\d+)\] \[caller: (?P<caller>[^\]]+)\] \[what: (?P<what>[^\]]*)\]$", {"level": "severity_id", "caller": "src_endpoint.ip", "what": "message"}),
)


def build_prompt(fingerprint: str, lines: list[str], error: str | None = None) -> str:
    """The request to a language model for one rule: the task, what this engine does with a rule, two examples, the lines and what was wrong before."""
    reply = lambda pattern, targets: json.dumps({"pattern": pattern, "mappings": [{"source_field": s, "ocsf_path": t} for s, t in targets.items()]})
    parts = [
        f"Write one Python regular expression that reads every line of the log format {fingerprint}, of which some lines follow.",
        "A mapping may name a group of the pattern. A group called extension is read further, as key=value pairs, and a mapping may name their keys too. What no mapping names is kept as it is.",
        f"A pattern may have {MOST_CHARS} characters and {MOST_GROUPS} groups, {MOST_DEPTH} deep. One whose cost can grow faster than with the square of a line's length is refused: let each repeat end at a character that it can't take itself.",
        "The pattern must also read lines with other hosts, times and numbers: it is tried on such.",
        f"A mapping leads to one of {', '.join(TARGETS)}; name only fields that mean just that.",
        'The reply is a JSON object alone: {"pattern": ..., "mappings": [{"source_field": ..., "ocsf_path": ...}]}.',
        *(f"For the line\n{line}\nthe reply is\n{reply(pattern, targets)}" for line, pattern, targets in EXAMPLES),
        "Lines:\n" + "\n".join(lines),
    ]
    return "\n\n".join(parts + ([f"Your last reply was wrong: {error}"] if error else []))


def first_samples(samples: DataFrame) -> DataFrame:
    """Samples in the order of their capture, so that the same are taken each time."""
    return samples.orderBy(*[c for c in ("captured_at", "raw_id", "raw_text") if c in samples.columns])


def generate_candidate(fingerprint: str, samples: DataFrame, client, attempts: int = 3) -> Rule | None:
    """A candidate from a client (a function of prompt and temperature), tried with feedback; null if none passes the gate."""
    error, lines = None, [r.raw_text for r in first_samples(samples.where("role = 'prompt'")).limit(PROMPT).collect()]
    for attempt in range(attempts):
        reply = client(build_prompt(fingerprint, lines, error), 0.1 + 0.2 * attempt)
        try:
            found = json.loads(outer_object(reply))
            rule = Rule(fingerprint, 0, found["pattern"], tuple((m["source_field"], m["ocsf_path"]) for m in found["mappings"]), "slm", "pending_review")
        except (TypeError, ValueError, KeyError) as e:
            error = f"{type(e).__name__}: {e}"
            continue
        result = validate_candidate(rule, samples)
        if result["passed"]:
            return rule
        error = "; ".join(result["notes"]) or str(result["checks"])
    return None


def evaluation(runs: DataFrame) -> DataFrame:
    """Tallies of model runs (valid_json, compiles, match_rate, attempts, seconds, stored)."""
    share = lambda c: F.round(100 * F.avg(F.col(c).cast("int")), 1).alias(f"{c}_pct")
    return runs.agg(F.count("*").alias("runs"), share("valid_json"), share("compiles"), share("stored"), F.avg("match_rate").alias("match_rate"), F.avg("attempts").alias("attempts"), F.try_divide(F.sum("seconds"), F.count_if("stored")).alias("seconds_per_rule"))


