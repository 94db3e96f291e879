"""The rule book and the cold-path jobs on small tables."""

import json
import threading
from datetime import datetime, timedelta

import pytest

from logloom import jobs
from logloom.functions.extract import SEEDS, Rule
from logloom.operators import lifecycle as L
from logloom.operators.ingest import raw_events
from logloom.operators.normalize import capture_samples, current_view, normalize
from logloom.rulebook import RuleBook
from logloom.schemas import append_new, bootstrap, read

T0 = datetime(2024, 1, 1)
ANY = Rule("f", 0, "^(?P<x>.*)$", (("x", "message"),))


def ingest(spark, root, lines, rules, second=0):
    rows = [("raw.logs", 0, second + i, "s", "udp", T0 + timedelta(seconds=second + i), None, line) for i, line in enumerate(lines)]
    events = raw_events(spark.createDataFrame(rows, "topic string, partition int, offset long, source_id string, transport string, received_at timestamp, format_hint string, raw string"))
    append_new(events, root, "raw_events", ["raw_id"])
    append_new(normalize(events, rules), root, "normalized_events", ["event_id"])
    capture_samples(events, rules).write.mode("append").parquet(f"{root}/onboarding_samples")


def iptables(i, source=True):
    return f"Jan 12 01:02:03 fw{i % 3} kernel: IPTABLES-DROP: " + (f"SRC=10.0.0.{i % 250} " if source else "") + f"DST=1.2.3.4 SPT={i} DPT=22"


def test_book_guards_its_writers(spark, tmp_path):
    book, other = RuleBook(spark, str(tmp_path)), RuleBook(spark, str(tmp_path))
    book.write(lambda ledger: ledger.propose(ANY))
    with pytest.raises(L.TransitionError):
        other.write(lambda ledger: ledger.propose(ANY))

    def late(ledger):  # another writer comes between reading and writing
        if not other.ledger().active("f"):
            other.write(lambda again: again.approve("f", 1, "bob"))
        return ledger.reject("f", 1, "ada")

    with pytest.raises(L.TransitionError):
        book.write(late)
    assert book.ledger().active("f").version == 1
    assert [r.action for r in book.audit().orderBy("id").collect()] == ["candidate_created", "rule_approved"]
    rules, audit = book.history("f")
    assert rules.count() == 1 and [r.actor for r in audit.collect()] == ["bob", "engine"]
    (tmp_path / "rule_commits" / f"{2:012d}.json").write_text('{"rules": [')  # a writer that was lost
    book.write(lambda ledger: ledger.deactivate("f", 1, "ada"))
    assert RuleBook(spark, str(tmp_path)).ledger().find("f", 1).status == "deactivated"
    with pytest.raises(ValueError):
        book.write(lambda ledger: ledger.note("ada", "made_coffee", "f"))


def test_edits_pass_the_gate(spark, tmp_path):
    book = RuleBook(spark, str(tmp_path))
    samples = spark.createDataFrame([(f"a={i} b=10.0.0.{i}", "prompt" if i < 5 else "held_out") for i in range(20)], "raw_text string, role string")
    with pytest.raises(L.TransitionError):
        jobs.manual_candidate(book, Rule("f", 0, "^nothing$", ()), samples, "ada")
    new = jobs.manual_candidate(book, Rule("f", 0, "^(?P<extension>.*)$", (("b", "src_endpoint.ip"),)), samples, "ada")
    assert (new.version, new.status, new.provenance) == (1, "pending_review", "human")
    with pytest.raises(L.TransitionError):
        jobs.approve(book, "f", 1, "ada", samples, mappings=(("a", "src_endpoint.ip"),))
    assert book.ledger().active("f") is None
    done = jobs.approve(book, "f", 1, "ada", samples, override=("^(?P<extension>.*)$", (("b", "dst_endpoint.ip"),)))
    assert (done.version, done.provenance) == (2, "human") and book.ledger().find("f", 1).status == "rejected"


def test_candidates_and_backlog(spark, tmp_path):
    root = str(tmp_path)
    bootstrap(spark, root)
    book = RuleBook(spark, root)
    js = [json.dumps({"src_ip": f"10.0.0.{i}", "event_type": "drop", "n": i}) for i in range(25)]
    text = [f"APP login user{i} from 10.1.1.{i} ok" for i in range(25)]
    ingest(spark, root, js + text, ())
    names = {r.fingerprint_id for r in read(spark, root, "raw_events").select("fingerprint_id").distinct().collect()}
    (other,) = names - {"json"}
    assert jobs.candidate_job(spark, root) == {"json": True, other: False}
    failed = read(spark, root, "onboarding_attempts").collect()
    assert [(r.fingerprint_id, r.samples_seen) for r in failed] == [(other, 25)]
    assert jobs.candidate_job(spark, root) == {}  # one is pending, the other waits for ten new samples
    assert {r.action for r in book.audit().collect()} == {"samples_split", "candidate_created", "candidate_failed"}

    jobs.approve(book, "json", 1, "ada")
    assert jobs.reparse_job(spark, root) == {"json": 25} and jobs.reparse_job(spark, root) == {}
    view = current_view(read(spark, root, "normalized_events"))
    assert {(r.fingerprint_id, r.status): r["count"] for r in view.groupBy("fingerprint_id", "status").count().collect()} == {("json", "parsed"): 25, (other, "unparsed"): 25}
    assert [r.entity for r in book.audit().where("action = 'reparse_complete'").collect()] == ["json"]


def test_generated_candidate(spark, tmp_path):
    lines = [f"APP login user{i} from 10.1.1.{i} ok" for i in range(20)]
    samples = spark.createDataFrame([(x, "prompt" if i < 5 else "held_out") for i, x in enumerate(lines)], "raw_text string, role string")
    asked = []

    def client(prompt, temperature):
        asked.append((prompt, temperature))
        if len(asked) == 1:
            return "no rule today"
        good = {"pattern": r"^APP login (?P<who>\S+) from (?P<ip>\S+)", "mappings": [{"source_field": "ip", "ocsf_path": "src_endpoint.ip"}]}
        return f"```json\n{json.dumps(good)}\n```"

    rule = L.generate_candidate("app", samples, client)
    assert rule.mappings == (("ip", "src_endpoint.ip"),) and [round(t, 1) for _, t in asked] == [0.1, 0.3]
    assert "ValueError" in asked[1][0] and all(t in asked[0][0] for t in ("src_endpoint.port", "severity_id", "time")) and lines[0] in asked[0][0]
    assert L.generate_candidate("app", samples, lambda *_: "{}") is None
    assert L.confidence(samples, rule) == 1.0


def test_drift_job(spark, tmp_path):
    root = str(tmp_path)
    bootstrap(spark, root)
    book = RuleBook(spark, root)
    syslog = next(r for r in SEEDS if r.fingerprint_id == "syslog")
    book.write(lambda ledger: ledger.propose(syslog).approve("syslog", 1, "ada"))
    settings = jobs.Settings(window_count=10, window_time_s=10_000, baseline_windows=3)
    ingest(spark, root, [iptables(i) for i in range(35)], [syslog])
    assert jobs.drift_job(spark, root, settings) == {"windows": 3, "actions": 0}
    base = read(spark, root, "baseline_profiles")
    assert {r.field for r in base.collect()} >= {"src_endpoint.ip", "__rule__"}
    assert jobs.drift_job(spark, root, settings) == {"windows": 0, "actions": 0}
    ingest(spark, root, [iptables(i, source=i % 3 == 0) for i in range(35, 60)], [syslog], second=35)
    found = jobs.drift_job(spark, root, settings)
    assert found["windows"] == 3 and found["actions"] == 1 and read(spark, root, "baseline_profiles").count() == base.count()
    assert book.ledger().active("syslog") is None  # a lost source is severe
    rows = read(spark, root, "drift_windows").where("field = 'src_endpoint.ip'").orderBy("window_start").collect()
    assert [r.severity for r in rows][:3] == ["none"] * 3 and rows[-1].action_taken == "rule_deactivated"
    assert jobs.drift_job(spark, root, settings) == {"windows": 0, "actions": 0}


def test_settings_and_loop():
    got = jobs.Settings.from_env({"LOGLOOM_WINDOW_COUNT": "7", "LOGLOOM_DRIFT_POLL_S": "0.5", "OTHER": "x"})
    assert (got.window_count, got.drift_poll_s, got.baseline_windows) == (7, 0.5, 10)
    stop, seen = threading.Event(), []

    def job():
        seen.append(1)
        if len(seen) == 3:
            stop.set()
        raise ValueError("a run that fails")

    assert jobs.repeat(job, 0.01, stop) == 3




def test_predecessor_store_and_generator(spark, tmp_path):
    from logloom.operators import legacy

    store = legacy.RuleStore(str(tmp_path / "rules.json"))
    assert store.get("f") is None
    store.save(Rule("f", 1, "a", (("x", "message"),)))
    store.save(Rule("f", 2, "b", ()))
    assert store.get("f").pattern == "b" and list(store.all()) == ["f"]
    stored = legacy.ingest_lines(spark.createDataFrame([("a line", "s"), ("a line", "s")], "raw string, source_id string"), str(tmp_path))
    ids = [r.raw_id for r in stored.collect()]
    assert len(set(ids)) == 2 and all(i.startswith("raw_") for i in ids) and ids == [r.raw_id for r in stored.collect()]
    assert legacy.raw_event(stored, ids[0]).first().raw == "a line" and legacy.raw_event(stored, "raw_x").count() == 0
    samples = spark.createDataFrame([("app", f"user{i} in") for i in range(4)], "fingerprint_id string, raw_text string")
    wrong = json.dumps({"pattern": "^nobody$", "mappings": []})
    rule, share = legacy.generate_rule("app", samples, lambda *_: wrong)
    assert (rule.pattern, share) == ("^nobody$", 0.0)  # the last one counts though none passes
    good = json.dumps({"pattern": r"^(?P<who>\w+) in", "mappings": [{"source_field": "who", "ocsf_path": "message"}]})
    assert legacy.onboard_new_format(store, "app", samples, lambda *_: good).mappings == (("who", "message"),) and store.get("app")
    assert legacy.onboard_new_format(store, "other", samples) is None


def test_a_commit_that_is_still_being_written_is_waited_for(spark, tmp_path):
    """Half a file isn't an empty commit while its writer lives; once it is lost, it is."""
    import os
    import threading
    import time

    book = RuleBook(spark, str(tmp_path))
    book.write(lambda ledger: ledger.note("engine", "reparse_complete", "a"))
    path = tmp_path / "rule_commits" / "000000000001.json"
    whole = (tmp_path / "rule_commits" / "000000000000.json").read_text()
    path.write_text(whole[:10])
    writer = threading.Timer(1.5, lambda: path.write_text(whole))
    writer.start()
    assert len(book.ledger().audit) == 2
    writer.join()
    lost = tmp_path / "rule_commits" / "000000000002.json"
    lost.write_text("{")
    old = time.time() - 60
    os.utime(lost, (old, old))
    assert len(book.ledger().audit) == 2 and len(book.write(lambda ledger: ledger.note("engine", "reparse_complete", "b")).audit) == 3
