"""Windows, baselines, enforcement, chains, lifecycle, tables and the stream."""

import json
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from logloom.functions.extract import SEEDS, Rule
from logloom.operators import drift as W
from logloom.operators import ingest, lifecycle, serve
from logloom.operators.normalize import capture_samples, current_view, normalize
from logloom.schemas import read
from logloom.sources.readers import accept_request, read_lines, read_rules
from logloom.streaming.pipeline import start

T0 = datetime(2024, 1, 1)


def view(spark, seconds, fingerprint="syslog"):
    rows = [(f"e{i:05d}", fingerprint, 1, "parsed", T0 + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "event_id string, fingerprint_id string, rule_version int, status string, parsed_at timestamp")


def window_list(rows, n, t):
    """The stated rule as a loop."""
    out, current = [], []
    for s in sorted(rows):
        current.append(s)
        if len(current) >= n or current[0] < max(rows) - t:
            out.append(len(current))
            current = []
    return out


@pytest.mark.parametrize("seconds,n,t", [([i / 1000 for i in range(1001)], 1000, 600), ([0, 700, 800], 1000, 600), ([0, 5, 5, 5, 900, 901, 902, 903, 904], 2, 600), (list(range(50)), 7, 10), ([3], 1, 1)])
def test_windows_follow_the_rule(spark, seconds, n, t):
    closed = W.windows(view(spark, seconds), n, t)
    assert [r.events_count for r in W.window_bounds(closed.withColumn("x", F.lit(1))).orderBy("wid").collect()] == window_list(seconds, n, t)


def test_baseline_profile(spark):
    schema = "fingerprint_id string, rule_version int, field string, window_start timestamp, events_count bigint, null_rate double, match_rate double, shape_dist map<string,bigint>"
    rows = [("a", 1, "f", T0 + timedelta(i), 10 + 2 * i, r, None, {"ipv4": 6, "free_text": 4}) for i, r in enumerate((0.1, 0.2, 0.3))] + [("a", 1, "__rule__", T0 + timedelta(i), 10 + 2 * i, None, r, None) for i, r in enumerate((1.0, 0.9, 0.8))]
    table = spark.createDataFrame(rows, schema)
    got = {r.field: r for r in W.baseline(table, 3).collect()}
    assert got["f"].base_null == pytest.approx(0.2) and got["f"].base_shape == pytest.approx({"ipv4": 0.6, "free_text": 0.4})
    assert got["__rule__"].base_match == pytest.approx(0.9) and (got["__rule__"].base_low, got["__rule__"].base_high) == (10, 14)
    assert W.baseline(table, 4).count() == 0


def test_chain_verification_finds_tampering(spark):
    events = spark.range(7).select(F.lit(0).alias("partition"), F.col("id").alias("offset"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    chain = ingest.batches(events, 3)
    assert ingest.verify_chain(chain).where("NOT ok").count() == 0 and chain.count() == 3
    broken = chain.withColumn("merkle_root", F.when(F.col("batch_seq") == 2, F.repeat(F.lit("ab"), 32)).otherwise(F.col("merkle_root")))
    assert [r.batch_seq for r in ingest.verify_chain(broken).where("NOT ok").orderBy("batch_seq").collect()] == [2, 3]
    assert ingest.extend_chain(chain, chain).agg(F.max("batch_seq")).first()[0] == 6


def test_ledger_transitions():
    ledger = lifecycle.Ledger(SEEDS)
    second = Rule("syslog", 0, "x", ())
    ledger = ledger.propose(second)
    with pytest.raises(lifecycle.TransitionError):
        ledger.propose(second)
    approved = ledger.approve("syslog", 2, "ada")
    assert approved.active("syslog").version == 2 and approved.find("syslog", 1).status == "superseded"
    edited = ledger.approve("syslog", 2, "ada", edited=Rule("syslog", 0, "y", ()))
    assert edited.active("syslog").version == 3 and edited.find("syslog", 2).status == "rejected"
    with pytest.raises(lifecycle.TransitionError):
        approved.reject("syslog", 2, "ada")
    down = approved.deactivate("syslog", 2, "ada")
    assert down.active("syslog") is None and down.reactivate("syslog", 1, "ada").active("syslog").version == 1
    held = approved.quarantine("json", "action")
    assert held.quarantine("json", "action") == held and held.unquarantine("json", "action", "ada").active("json").quarantined == ()
    plan = [SimpleNamespace(fingerprint_id="json", field="__rule__", action="rule_deactivated"), SimpleNamespace(fingerprint_id="syslog", field="action", action="field_quarantined")]
    done = approved.enforce(plan)
    assert done.active("json") is None and done.active("syslog").quarantined == ("action",) and done.enforce(plan) == done


def test_candidate_gate(spark):
    lines = [f"Jan {d:02d} 01:02:03 fw01 kernel: IPTABLES-DROP: SRC=10.0.0.{d} DST=10.0.1.{d} SPT={1000 + d} DPT=80" for d in range(1, 21)]
    rows = spark.createDataFrame([("syslog", f"r{i:02d}", x, T0 + timedelta(i)) for i, x in enumerate(lines)], "fingerprint_id string, raw_id string, raw_text string, captured_at timestamp")
    samples = lifecycle.split_roles(rows)
    good = lifecycle.validate_candidate(next(r for r in SEEDS if r.fingerprint_id == "syslog"), samples)
    assert good["passed"] and good["held_out_match_rate"] == 1 and (good["prompt_count"], good["held_out_count"]) == (5, 15)
    bad = lifecycle.validate_candidate(Rule("syslog", 1, r"^Jan 0[1-5].*SRC=10.0.0.1 (?P<extension>.*)$", (("NOPE", "message"),)), samples)
    assert not bad["passed"] and not bad["checks"]["held_out_match_all"] and not bad["checks"]["no_orphan_mappings"] and not bad["checks"]["no_hardcoded_literals"]
    assert lifecycle.validate_candidate(SEEDS[0], samples.limit(0))["passed"]


def messages(spark, lines, first=0):
    rows = [("raw.logs", i % 2, i // 2 + first, json.dumps({"source_id": "s", "transport": "udp", "received_at": f"2024-01-01T00:00:{i % 60:02d}Z", "raw": x})) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows + [("raw.logs", 0, 900 + first, "{broken"), ("raw.logs", 0, 901 + first, '{"source_id":"s","transport":"u","received_at":"never","raw":"x"}')], "topic string, partition int, offset bigint, value string")


def test_stream_and_replay(spark, tmp_path):
    lines = ["CEF:0|Palo Alto|Fw|1|9|x|5|src=1.2.3.4 act=drop", "unknown|x|1", '{"src_ip":"1.1.1.1"}', "Jan 12 01:02:03 host app: hello"]
    messages(spark, lines).write.parquet(str(tmp_path / "in"))
    sent = []
    for run in ("one", "two"):
        stream = spark.readStream.schema("topic string, partition int, offset bigint, value string").parquet(str(tmp_path / "in"))
        start(stream, str(tmp_path / "db"), str(tmp_path / run), lambda: SEEDS, lambda ok, bad: sent.append((ok.count(), bad.count()))).awaitTermination()
        raw, done = read(spark, str(tmp_path / "db"), "raw_events"), read(spark, str(tmp_path / "db"), "normalized_events")
        assert raw.count() == 4 and {r.status: r["count"] for r in done.groupBy("status").count().collect()} == {"parsed": 2, "unparsed": 1, "parse_error": 1}
    assert sent and sent[0][1] <= 1 and read(spark, str(tmp_path / "db"), "onboarding_samples").count() == 1
    chain = read(spark, str(tmp_path / "db"), "raw_batches")
    assert ingest.verify_chain(chain).where("NOT ok").count() == 0 and chain.groupBy("partition_id").count().count() == 2
    assert serve.trace(done, raw).count() == 4


def test_current_view_and_samples(spark):
    events = ingest.raw_events(ingest.decode(messages(spark, ["Jan 12 01:02:03 h k: IPTABLES-DROP: SRC=1.1.1.1", "odd|1"])), xml=False)
    first = normalize(events, SEEDS)
    ledger = lifecycle.Ledger(SEEDS).propose(Rule("syslog", 0, r"IPTABLES-(?P<v>\w+)", (("v", "action"),))).approve("syslog", 2, "ada")
    second = lifecycle.reparse(first, events, ledger.rules, F.current_timestamp())
    both = first.unionByName(second)
    assert {(r.fingerprint_id[:4], r.rule_version) for r in current_view(both).collect()} == {("sysl", 2), ("auto", None)}
    assert capture_samples(events, SEEDS).count() == 1
    with pytest.raises(Exception, match="unknown status"):
        serve.stats_by_status(spark.createDataFrame([("odd",)], "status string")).collect()


def test_exports_and_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  two  \n")
    assert sorted(r.raw for r in read_lines(spark, str(tmp_path / "a.txt")).collect()) == ["one", "two"]
    (tmp_path / "r.json").write_text(json.dumps({"fingerprint_id": "z", "pattern": "x", "mappings": [{"source_field": "a", "ocsf_path": "action"}]}))
    assert read_rules(spark, str(tmp_path / "r.json"))[0].mappings == (("a", "action"),)
    requests = spark.createDataFrame([("s", ["x"], None), ("s", ["x", ""], None), ("s", ["y" * 65_537], None)], "source_id string, lines array<string>, format_hint string")
    assert [r.accepted for r in accept_request(requests).collect()] == [True, False, False]
    events = ingest.raw_events(ingest.decode(messages(spark, ['{"src_ip":"1.1.1.1"}'])), xml=False)
    rows = serve.export_rows(normalize(events, SEEDS))
    serve.export_jsonl(rows, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["severity_id"] is None
    assert serve.export_rows(normalize(events, SEEDS), status="unparsed").count() == 0
