"""Registered queries on lines made to show one behaviour each: poison, long lines, optional groups, replays, transitions."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.extract import SEEDS, Rule, flatten_json, parse
from ..functions.fingerprint import fingerprint_id
from ..functions.mutate import drift_phase, escalation_span
from ..functions.registry import register
from ..jobs import establish_baselines
from ..operators import drift as W
from ..operators import ingest, legacy, lifecycle, serve
from ..operators.normalize import capture_samples, normalize
from ..rulebook import RuleBook
from ..schemas import append_new, bootstrap, read, schema
from ..sources.readers import read_messages, replay, request_messages, route, stream_messages
from ..storage import shared_dir
from ..streaming.pipeline import start
from .lines import lines
from .queries import ACTIVE, BASE, BASE_WINDOWS, FP, SAMPLES, SHAPES, WITH, L, normalized, query, rows, samples, stored_events


def fresh_root(spark) -> str:
    """An empty set of tables in the shared folder."""
    root = f"{shared_dir(spark)}/logloom/case-{uuid.uuid4().hex}"
    bootstrap(spark, root)
    return root


# --- ingest ---------------------------------------------------------------------------------


def messages(spark, sf_dir):
    """The lines as messages; of eleven, four can't be used."""
    good = ingest.envelope(F.col("raw"), F.concat(F.lit("src-"), F.col("user_id").cast("string")), "udp", F.col("received_at"))
    poison = F.when(F.col("eid") % 11 == 0, F.lit("no JSON")).when(F.col("eid") % 11 == 1, F.lit('{"source_id":"s"}')).when(F.col("eid") % 11 == 2, F.regexp_replace(good, '"received_at":"[^"]*"', '"received_at":"yesterday"'))
    value = poison.when(F.col("eid") % 11 == 3, ingest.envelope(F.lit(""), F.lit("s"), "udp", F.col("received_at"))).otherwise(good)
    return lines(spark, sf_dir).select("eid", F.lit("raw.logs").alias("topic"), F.col("partition_id").alias("partition"), F.col("pos").alias("offset"), value.alias("value"))


@query(f"WITH {L} SELECT partition_id, pos, 'src-' || CAST(user_id AS VARCHAR) AS source_id, 'udp' AS transport, raw, received_at FROM l WHERE eid % 11 > 3")
def decoded_envelopes(spark, sf_dir):
    return ingest.decode(messages(spark, sf_dir)).select(F.col("partition").alias("partition_id"), F.col("offset").alias("pos"), "source_id", "transport", "raw", "received_at")


@query(f"WITH {L} SELECT 'r' || CAST(eid // 50 AS VARCHAR) AS source_id, count(*) AS lines FROM l WHERE (eid // 50) % 7 > 2 GROUP BY eid // 50")
def accepted_requests(spark, sf_dir):
    found = lines(spark, sf_dir).select(F.floor(F.col("eid") / 50).alias("r"), "raw").groupBy("r").agg(F.collect_list("raw").alias("lines"))  # 50 lines a request
    bad = F.when(F.col("r") % 7 == 0, F.array_append("lines", F.repeat(F.lit("x"), 70_000))).when(F.col("r") % 7 == 1, F.array_repeat(F.lit("x"), 1001)).otherwise(F.col("lines"))
    requests = found.select(F.concat(F.lit("r"), F.col("r").cast("string")).alias("source_id"), bad.alias("lines"), F.when(F.col("r") % 7 == 2, F.repeat(F.lit("h"), 65)).alias("format_hint"))
    return request_messages(requests).groupBy(F.get_json_object("value", "$.source_id").alias("source_id")).agg(F.count("*").alias("lines"))


@query(WITH + "SELECT CAST(CAST(received_at AS DATE) AS VARCHAR) AS day, count(*) AS events, count(DISTINCT raw_id) AS ids FROM n GROUP BY 1")
def appended_twice(spark, sf_dir):
    root, found = fresh_root(spark), stored_events(spark, sf_dir).select(*[f.name for f in schema("raw_events")])
    append_new(found.where(F.col("raw_id") < "8"), root, "raw_events", ["raw_id"])
    append_new(found.unionByName(found), root, "raw_events", ["raw_id"])
    return read(spark, root, "raw_events").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("events"), F.count_distinct("raw_id").alias("ids"))


def streamed(spark, root, rules, part=None):
    """Write a lot of messages and stream all its files as one micro-batch; without one, stream what is still waiting."""
    if part is not None:
        part.drop("eid").write.mode("append").parquet(f"{root}/messages")
    files = len(read_messages(spark, f"{root}/messages").inputFiles())
    start(stream_messages(spark, f"{root}/messages", max(files, 1)), root, f"{root}/checkpoint", rules).awaitTermination()


@query(WITH + f"""SELECT 'normalized_events' AS name, status, count(*) AS n FROM n WHERE eid % 11 > 3 GROUP BY status UNION ALL SELECT 'raw_events', NULL, count(*) FROM n WHERE eid % 11 > 3
UNION ALL SELECT 'onboarding_samples', NULL, sum(least(c, 200)) FROM (SELECT count(*) AS c FROM n WHERE eid % 11 > 3 AND fp NOT IN {ACTIVE} GROUP BY fp)""")
def streamed_tables(spark, sf_dir):
    """Two lots of messages that overlap, one micro-batch each, to tables."""
    root, found = fresh_root(spark), messages(spark, sf_dir)
    for part in (found.where("eid % 3 <> 0"), found.where("eid % 3 <> 1")):
        streamed(spark, root, lambda: SEEDS, part)
    none = F.lit(None).cast("string").alias("status")
    count = lambda name, by: read(spark, root, name).groupBy(by).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "status", "n")
    return count("normalized_events", "status").unionByName(count("raw_events", none)).unionByName(count("onboarding_samples", none))


@query(f"WITH {L} SELECT CASE eid % 6 WHEN 0 THEN 'cef' WHEN 1 THEN 'syslog' WHEN 2 THEN 'acmegw' WHEN 3 THEN 'newapp' WHEN 4 THEN 'json' ELSE 'other' END AS corpus, CASE WHEN eid % 6 < 4 THEN 'udp' WHEN eid % 6 = 4 THEN 'http' END AS transport, 2 * count(*) AS messages FROM l GROUP BY ALL")
def replayed_corpora(spark, sf_dir):
    corpus = F.element_at(F.array(*map(F.lit, ("cef", "syslog", "acmegw", "newapp", "json", "other"))), (F.col("eid") % 6 + 1).cast("int"))
    sent = replay(lines(spark, sf_dir).select(corpus.alias("corpus"), "raw"), 2).dropDuplicates(["partition", "offset"])
    sent = sent.select(F.regexp_replace(F.get_json_object("value", "$.source_id"), "^sim-", "").alias("corpus"))
    return sent.groupBy("corpus").agg(F.count("*").alias("messages")).select("corpus", route(F.col("corpus")).alias("transport"), "messages")


# --- fingerprints and parsing ---------------------------------------------------------------


@query(f"WITH {L} SELECT eid, eid % 6 IN (0, 2, 3, 5) AS is_xml FROM l")
def xml_lines(spark, sf_dir):
    n, k = F.col("eid").cast("string"), F.col("eid") % 6
    text = F.when(k == 0, F.concat(F.lit('<event id="'), n, F.lit('"><a>x</a></event>'))).when(k == 1, F.concat(F.lit("<event><a>"), n, F.lit("</event>"))).when(k == 2, F.concat(F.lit("  <e/> then "), n))
    text = text.when(k == 3, F.concat(F.lit("<!DOCTYPE r><r>"), n, F.lit(" &amp; 2</r>"))).when(k == 4, F.concat(F.lit("<r>a &nosuch; "), n, F.lit("</r>"))).otherwise(F.concat(F.lit('<?xml version="1.0"?><r a="'), n, F.lit('"/><')))
    return lines(spark, sf_dir).select("eid", F.coalesce(fingerprint_id(text) == "xml", F.lit(False)).alias("is_xml"))


@query(WITH + """SELECT event_id, CASE WHEN eid % 50 IN (0, 3) THEN 'parse_error' ELSE status END AS status,
CASE WHEN eid % 50 IN (0, 3) THEN 'line exceeds 65536 characters' WHEN status = 'parse_error' THEN 'rule pattern did not match line' END AS error FROM n""")
def long_lines(spark, sf_dir):
    longer = lines(spark, sf_dir).where("eid % 50 IN (0, 3)").select(F.col("partition_id").alias("partition"), F.col("pos").alias("offset"), F.lit(True).alias("long"))
    found = stored_events(spark, sf_dir).join(longer, ["partition", "offset"], "left").withColumn("raw_text", F.when(F.col("long"), F.concat("raw_text", F.repeat(F.lit(" "), 65_536))).otherwise(F.col("raw_text")))
    return normalize(found, SEEDS).select("event_id", "status", "error")


@query(WITH + "SELECT event_id, CAST(NULL AS VARCHAR) AS message, json_extract_string(raw, '$.alert.signature') AS kept FROM n WHERE fp = 'json'")
def quarantined_mapping(spark, sf_dir):
    rules = [replace(r, quarantined=("message",)) if r.fingerprint_id == "json" else r for r in SEEDS]
    found = normalize(stored_events(spark, sf_dir).where("fingerprint_id = 'json'"), rules)
    return found.select("event_id", F.col("ocsf.message").alias("message"), F.col("ocsf.unmapped")["alert.signature"].alias("kept"))


OPTIONAL = Rule("pipes", 1, r"^ACMEX\|(?P<ver>\w+)\|(?P<at>[^|]+)\|type:(?P<type>\w+)\|source=(?P<ip>[\d.]+)(?::(?P<port>1\d+))?.*?(?:\|proto=(?P<proto>udp))?(?:\|sev=(?P<sev>[34]))?$", (("ip", "src_endpoint.ip"), ("port", "src_endpoint.port"), ("type", "action")))


@query(f"""WITH {L} SELECT eid, regexp_extract(raw, 'source=([\\d.]+)', 1) AS src_ip, CASE WHEN regexp_matches(raw, 'source=[\\d.]+:1') THEN CAST(regexp_extract(raw, 'source=[\\d.]+:(\\d+)', 1) AS BIGINT) END AS src_port,
regexp_extract(raw, 'type:(\\w+)', 1) AS action, CASE WHEN eid % 5 >= 3 THEN CAST(eid % 5 AS VARCHAR) END AS sev, CASE WHEN eid % 5 >= 3 THEN 3 ELSE 2 END AS unmapped FROM l WHERE starts_with(raw, 'ACMEX')""")
def optional_groups(spark, sf_dir):
    doc = parse(F.col("raw"), OPTIONAL)["doc"]
    found = lines(spark, sf_dir).where(F.col("raw").startswith("ACMEX")).select("eid", doc.alias("d"))
    return found.select("eid", F.col("d.src_endpoint.ip").alias("src_ip"), F.col("d.src_endpoint.port").alias("src_port"), "d.action", F.col("d.unmapped")["sev"].alias("sev"), F.size("d.unmapped").alias("unmapped"))


@query(f"WITH {L} SELECT eid, unnest(['a.b.c.d.e.f.g', 'a.s', 'n', 'x']) AS key, unnest([CAST(eid AS VARCHAR), 'v {{', NULL, '[1,{{\"y\":2}}]']) AS value FROM l")
def nested_json(spark, sf_dir):
    text = F.concat(F.lit('{"a":{"s":"v {","b":{"c":{"d":{"e":{"f":{"g":'), F.col("eid").cast("string"), F.lit('}}}}}},"x":[1,{"y":2}],"n":null}'))
    return lines(spark, sf_dir).select("eid", F.explode(flatten_json(text)).alias("key", "value"))


@query(WITH + "SELECT round(avg(CAST(eid % 17 <> 0 AS INT)), 2) AS json_share, (SELECT round(avg(CAST(status = 'parsed' AS INT)), 2) FROM n WHERE fp = 'syslog') AS syslog_share FROM n WHERE fp = 'json'")
def rule_confidence(spark, sf_dir):
    found = stored_events(spark, sf_dir)
    share = lambda name: lifecycle.confidence(found.where(F.col("fingerprint_id") == name), next(r for r in SEEDS if r.fingerprint_id == name))
    return spark.range(1).select(F.lit(share("json")).alias("json_share"), F.lit(share("syslog")).alias("syslog_share"))


@query(f"WITH {L} SELECT eid, CASE eid % 3 WHEN 0 THEN '{{\"k\": {{\"n\": 1}}}}' WHEN 1 THEN '{{\"a\": ' || CAST(eid AS VARCHAR) || '}}' END AS found FROM l")
def replies(spark, sf_dir):
    k = F.col("eid") % 3
    text = F.when(k == 0, F.lit('Here:\n```json\n{"k": {"n": 1}}\n```')).when(k == 1, F.concat(F.lit('so {"a": '), F.col("eid").cast("string"), F.lit("}."))).otherwise(F.lit("nothing"))
    return lines(spark, sf_dir).select("eid", lifecycle.extract_json(text).alias("found"))


@query(f"WITH {L} SELECT eid, least(greatest((eid % 100 - 20) / greatest(eid % 90 - 20.0, 1.0), 0.0), 1.0) AS phase FROM l")
def drift_phases(spark, sf_dir):
    span = escalation_span(F.col("eid") % 90, F.lit(20))
    return lines(spark, sf_dir).select("eid", drift_phase(F.col("eid") % 100 - 20, span).alias("phase"))


@query(f"WITH {L}{SHAPES}{FP} SELECT CASE WHEN fp LIKE 'cef%' THEN fp ELSE 'none' END AS fingerprint_id, count(*) AS lines, count_if(contains(raw, 'src=')) AS with_source, CASE WHEN round(avg(CAST(NOT contains(raw, 'src=') AS INT)), 6) < 0.06 THEN 'none' ELSE 'found' END AS drift FROM f WHERE fp LIKE 'cef%' GROUP BY fp")
def legacy_drift(spark, sf_dir):
    found = stored_events(spark, sf_dir).where(F.col("fingerprint_id").startswith("cef"))
    flat = legacy.apply_rule(found, SEEDS[0], raw_col="raw_text").select("fingerprint_id", F.col("d.src_endpoint.ip").alias("src"))
    rates = flat.groupBy("fingerprint_id").agg(F.count("*").alias("lines"), F.count("src").alias("with_source"), F.avg(F.col("src").isNull().cast("int")).alias("null_rate"))
    return legacy.check_drift(rates).select("fingerprint_id", "lines", "with_source", F.when(F.col("severity") == "none", "none").otherwise("found").alias("drift"))


@query(f"WITH {L}{SHAPES}{FP} SELECT eid, fp AS fingerprint_id, substr(sha256(shape), 1, 8) AS shape_hash, sha256(raw) AS content_hash, 'severe' AS severity FROM f")
def sql_functions(spark, sf_dir):
    """The functions by name, as a user of SQL calls them."""
    register(spark)
    return spark.sql("SELECT eid, log_fingerprint(raw) AS fingerprint_id, log_shape_hash(raw) AS shape_hash, log_content_hash(raw) AS content_hash, log_null_rate_severity(0.6D, 0.01D) AS severity FROM {lines}", lines=lines(spark, sf_dir))


@query(WITH + """, g AS (SELECT *, CASE WHEN fp LIKE 'auto%' THEN 'unknown' ELSE fp END AS f FROM n)
SELECT f AS fingerprint_id, count(*) AS lines, count_if(status = 'parsed') AS ok, round(avg(CASE WHEN status = 'parsed' THEN CAST(src_ip IS NULL AS INT) END), 9) AS null_rate FROM g GROUP BY f""")
def legacy_three_passes(spark, sf_dir):
    """Formats with seed rules are stored, JSON is onboarded by its keys, the others have no model to ask."""
    with tempfile.TemporaryDirectory() as folder:  # the store is a file of the driver
        store = legacy.RuleStore(f"{folder}/rules.json")
        for rule in SEEDS:
            if rule.fingerprint_id != "json":
                store.save(rule)
        found = legacy.three_passes(lines(spark, sf_dir), store)
    return found.select("fingerprint_id", "lines", "ok", F.round("null_rate", 9).alias("null_rate"))


# --- chain ----------------------------------------------------------------------------------


@query(f"""WITH {L}, b AS (SELECT partition_id, CAST(floor(pos / 50.0) AS BIGINT) AS block, count(*) AS count FROM l GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY block) AS seq FROM b),
k AS (SELECT * FROM s WHERE seq % 7 <> 6 OR seq = 6) SELECT partition_id, seq AS batch_seq, seq <> 1 OR partition_id <> 2 AS genesis_ok, NOT (seq > 7 AND seq % 7 = 0) AS gap_ok,
NOT (seq > 7 AND seq % 7 = 0) AND seq % 7 <> 4 AS link_ok, seq % 7 <> 5 AS count_ok, seq % 7 NOT IN (3, 5) AS root_ok FROM k""")
def tampered_chain(spark, sf_dir):
    """Batches with a changed root (every 3rd of 7), with a row less (5th) and left out (6th, but the first), and a wrong start in one partition."""
    chain, k = ingest.batches(stored_events(spark, sf_dir), 50), F.col("batch_seq") % 7
    chain = chain.withColumn("merkle_root", F.when(k == 3, F.sha2("merkle_root", 256)).otherwise(F.col("merkle_root")))
    chain = chain.withColumn("row_hashes", F.when(k == 5, F.slice("row_hashes", 2, 10**6)).otherwise(F.col("row_hashes")))
    chain = chain.withColumn("prev_hash", F.when((F.col("batch_seq") == 1) & (F.col("partition_id") == 2), F.sha2(F.lit("x"), 256)).otherwise(F.col("prev_hash")))
    return ingest.verify_chain(chain.where((k != 6) | (F.col("batch_seq") == 6))).drop("count", "ok")


# --- rules ----------------------------------------------------------------------------------


@query(f"""WITH {L}{SHAPES}{FP}, r AS (SELECT DISTINCT fp FROM f), v AS (SELECT fp, unnest(CASE WHEN fp LIKE 'cef%' THEN [1, 2] ELSE [1] END) AS version FROM r)
SELECT fp AS fingerprint_id, version, CASE WHEN fp LIKE 'cef%' THEN CASE version WHEN 1 THEN 'superseded' ELSE 'active' END WHEN fp LIKE 'leef%' THEN 'rejected' WHEN fp = 'syslog' THEN 'deactivated' WHEN fp LIKE 'auto%' THEN 'pending_review' ELSE 'active' END AS status,
CASE WHEN fp = 'json' THEN 1 ELSE 0 END AS quarantined, CASE WHEN fp LIKE 'cef%' THEN 4 WHEN fp LIKE 'leef%' THEN 2 WHEN fp LIKE 'auto%' THEN 1 WHEN fp = 'syslog' THEN 5 ELSE 5 END AS entries FROM v""")
def guarded_transitions(spark, sf_dir):
    """Every fingerprint's rule proposed and taken on its own way through the book; refused changes leave no trace."""
    book = RuleBook(spark, fresh_root(spark))
    names = [r.fingerprint_id for r in stored_events(spark, sf_dir).select("fingerprint_id").distinct().orderBy("fingerprint_id").collect()]

    def refused(change):
        try:
            book.write(change)
        except lifecycle.TransitionError:
            return
        raise AssertionError("a change from the wrong state was written")

    for name in names:
        new = lambda ledger, name=name: ledger.propose(Rule(name, 0, "^(?P<x>.*)$", (("x", "message"),)))
        book.write(new)
        refused(new)  # one pending rule a fingerprint
        if name.startswith("leef"):
            book.write(lambda ledger, name=name: ledger.reject(name, 1, "ada"))
            refused(lambda ledger, name=name: ledger.approve(name, 1, "ada"))
        elif not name.startswith("auto"):
            book.write(lambda ledger, name=name: ledger.approve(name, 1, "ada"))
        if name.startswith("cef"):
            book.write(new)
            book.write(lambda ledger, name=name: ledger.approve(name, 2, "ada"))
            refused(lambda ledger, name=name: ledger.reactivate(name, 1, "ada"))
        if name == "syslog":
            for change in ("deactivate", "reactivate", "deactivate"):
                book.write(lambda ledger, change=change: getattr(ledger, change)("syslog", 1, "ada"))
            refused(lambda ledger: ledger.deactivate("syslog", 1, "ada"))
        if name == "json":
            for field in ("message", "action", "message"):  # the third changes nothing
                book.write(lambda ledger, field=field: ledger.quarantine("json", field))
            book.write(lambda ledger: ledger.unquarantine("json", "action", "ada"))
            refused(lambda ledger: ledger.unquarantine("json", "action", "ada"))
    entries = book.audit().groupBy(F.col("entity").alias("fingerprint_id")).agg(F.count("*").alias("entries"))
    return book.frame().join(entries, "fingerprint_id").select("fingerprint_id", "version", "status", F.size("quarantined_fields").alias("quarantined"), "entries")


@query(f"WITH {L} SELECT 'f' || CAST(eid % 40 AS VARCHAR) AS fingerprint_id, CAST(eid // 40 + 1 AS INT) AS version FROM l WHERE eid % 7 = 2")
def pending_rules(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("active", "superseded", "pending_review", "rejected", "deactivated", "superseded", "rejected"))), (F.col("eid") % 7 + 1).cast("int"))
    rules = lines(spark, sf_dir).select(F.concat(F.lit("f"), (F.col("eid") % 40).cast("string")).alias("fingerprint_id"), (F.floor(F.col("eid") / 40) + 1).cast("int").alias("version"), status.alias("status"))
    return serve.rules_list(rules, "pending_review").select("fingerprint_id", "version")


@query(WITH + "SELECT eid AS id, received_at AS ts, 'rule_approved' AS action FROM n WHERE fp = 'json' ORDER BY eid DESC LIMIT 200")
def audit_page(spark, sf_dir):
    audit = lines(spark, sf_dir).join(stored_events(spark, sf_dir).select(F.col("partition").alias("partition_id"), F.col("offset").alias("pos"), F.col("fingerprint_id").alias("entity")), ["partition_id", "pos"])
    return serve.audit_page(audit.select(F.col("eid").alias("id"), F.col("received_at").alias("ts"), F.lit("rule_approved").alias("action"), "entity"), "json").select("id", "ts", "action")


@query(WITH + "SELECT v.asked, least(greatest(coalesce(v.asked, 50), 1), 500, (SELECT count(*) FROM n)) AS found FROM (VALUES (-5), (0), (1), (NULL), (500), (9999)) v(asked)")
def page_limits(spark, sf_dir):
    view = normalized(spark, sf_dir)
    out = None
    for asked in (-5, 0, 1, None, 500, 9999):
        one = serve.events_page(view, limit=asked).agg(F.count("*").alias("found")).select(F.lit(asked).cast("int").alias("asked"), "found")
        out = one if out is None else out.unionByName(one)
    return out


@query(SAMPLES + ", a AS (SELECT fp, count(*) AS c FROM p GROUP BY fp) SELECT fp AS fingerprint_id, c AS samples, c - CASE WHEN starts_with(fp, 'leef') THEN 9 ELSE 10 END AS samples_seen FROM a WHERE c >= 20 AND NOT starts_with(fp, 'leef')")
def ready_after_attempts(spark, sf_dir):
    """The last attempt saw nine samples less of one format and ten less of the others: ten new ones are wanted."""
    found = samples(spark, sf_dir)
    less = F.when(F.col("fingerprint_id").startswith("leef"), 9).otherwise(10)
    seen = found.groupBy("fingerprint_id").agg(F.count("*").alias("c"))
    tries = F.explode(F.array(F.struct(F.lit(1).alias("seen"), F.lit(1).alias("t")), F.struct((F.col("c") - less).cast("int").alias("seen"), F.lit(2).alias("t"))))
    attempts = seen.select("fingerprint_id", tries.alias("a")).select("fingerprint_id", F.col("a.seen").alias("samples_seen"), F.timestamp_seconds(F.col("a.t")).alias("attempted_at"))
    return lifecycle.ready_fingerprints(found, lifecycle.Ledger(SEEDS).frame(spark), attempts).withColumn("samples_seen", F.col("samples_seen").cast("long"))


@query(SAMPLES + ", q AS (SELECT fp, raw_id, row_number() OVER (PARTITION BY fp ORDER BY received_at, raw_id) AS k FROM n WHERE fp NOT IN " + ACTIVE + "), have AS (SELECT * FROM q WHERE k % 2 = 0 AND k <= 100) SELECT fp AS fingerprint_id, raw_id FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY k) AS r, (SELECT count(*) FROM have h WHERE h.fp = q.fp) AS had FROM q WHERE NOT (k % 2 = 0 AND k <= 100)) WHERE r <= 200 - had")
def samples_beside_others(spark, sf_dir):
    first = samples(spark, sf_dir).withColumn("k", F.row_number().over(W.Window.partitionBy("fingerprint_id").orderBy("captured_at", "raw_id"))).where("k % 2 = 0 AND k <= 100").drop("k")
    return capture_samples(stored_events(spark, sf_dir), SEEDS, first).select("fingerprint_id", "raw_id")


@query(f"WITH {L} SELECT user_id, count(*) AS runs, round(100 * avg(CAST(eid % 2 = 0 AS INT)), 1) AS valid_json_pct, round(100 * avg(CAST(eid % 3 = 0 AS INT)), 1) AS stored_pct, avg(eid % 4) AS attempts FROM l WHERE user_id = 7 GROUP BY user_id")
def model_tallies(spark, sf_dir):
    runs = lines(spark, sf_dir).where("user_id = 7").selectExpr("eid % 2 = 0 AS valid_json", "eid % 2 = 0 AS compiles", "eid % 3 = 0 AS stored", "1.0D AS match_rate", "eid % 4 AS attempts", "2.0D AS seconds")
    return lifecycle.evaluation(runs).select(F.lit(7).cast("long").alias("user_id"), "runs", "valid_json_pct", "stored_pct", "attempts")


# --- serving and drift ----------------------------------------------------------------------


@query(WITH + ", c AS (SELECT received_at, event_id FROM n ORDER BY received_at DESC, event_id DESC LIMIT 1 OFFSET 300) SELECT n.event_id, n.status FROM n, c WHERE n.received_at > c.received_at OR (n.received_at = c.received_at AND n.event_id > c.event_id)")
def tail_after(spark, sf_dir):
    view = normalized(spark, sf_dir)
    at = view.orderBy(F.desc("parsed_at"), F.desc("event_id")).offset(300).select("parsed_at", "event_id").first()
    return serve.tail(view, tuple(at) if at else None).select("event_id", "status")


@query(BASE + "SELECT fp AS fingerprint_id, field, round(base_null, 9) AS base_null FROM base")
def baseline_once(spark, sf_dir):
    """Profiles written, written again and written after later windows came: the first ones stay."""
    root, found = fresh_root(spark), rows(spark, sf_dir).withColumn("action_taken", F.lit(None).cast("string")).select(*[f.name for f in schema("drift_windows")])
    found.write.mode("append").parquet(f"{root}/drift_windows")
    establish_baselines(spark, root, BASE_WINDOWS)
    establish_baselines(spark, root, BASE_WINDOWS)
    found.withColumn("window_start", F.col("window_start") - F.expr("INTERVAL 1 YEAR")).withColumn("null_rate", F.lit(1.0)).write.mode("append").parquet(f"{root}/drift_windows")
    establish_baselines(spark, root, BASE_WINDOWS)
    return read(spark, root, "baseline_profiles").select("fingerprint_id", "field", F.round("base_null", 9).alias("base_null"))

