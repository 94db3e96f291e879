"""Registered queries of JSON flattening, pattern costs, schema checks and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..commits import Batch
from ..functions.extract import Rule, flatten_json, pairs_of, parse
from ..functions.json_schema import compile_schema
from ..functions.registry import register
from ..operators import serve
from ..operators.normalize import dead_letters, envelopes, replaced_by
from ..schemas import DOCUMENT_RULE, append_new, read, read_current
from ..streaming.outbox import LETTERS, NORMALIZED, to_outbox
from .cases import fresh_root, messages, streamed
from .lines import lines
from .queries import ACTIVE, SEEDS, WITH, L, normalized, query, sql_uuid, with_second_parse

# --- flattening -----------------------------------------------------------------------------

#: Leaves of a JSON text: what isn't an object and lies in no list.
LEAVES = "replace(substr(fullkey, 3), '\"', '') AS key, CASE type WHEN 'NULL' THEN NULL ELSE t.value ->> '$' END AS value FROM {}, json_tree({}) t WHERE type <> 'OBJECT' AND NOT contains(fullkey, '[')"


@query("WITH c AS (SELECT click_id, props FROM clicks WHERE json_valid(props)) SELECT click_id, " + LEAVES.format("c", "c.props"))
def flatten_props(spark, sf_dir):
    """The JSON of each click: nested objects, lists, broken and missing texts."""
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    return pairs_of(["click_id"], flatten_json(F.col("props")), clicks)


DEPTH = 20
OPEN, CLOSE = "".join(f'{{"n{k}":' for k in range(DEPTH)), "}" * DEPTH
#: Strings with braces and JSON in them, escaped quotes, empty objects, nulls, lists of objects, and DEPTH levels.
ODD = f"""concat('{{"note":"{{not json}}","text":"{{', chr(92), '"x', chr(92), '":', CAST(eid AS STRING), '}}","none":{{}},"gone":null,"deep":{OPEN}', CAST(eid % 97 AS STRING),
  '{CLOSE},"list":[{{"a":1}},"{{"],"some":{{"b":"}}","c":{{}},"d":{{"e":true}}}}}}')"""


@query(f"WITH {L}, o AS (SELECT eid, {ODD} AS js FROM l) SELECT eid, true AS same, " + LEAVES.format("o", "o.js"))
def flatten_deep(spark, sf_dir):
    """By the function and by its name in SQL; same: whether both agree."""
    register(spark)
    text = lines(spark, sf_dir).select("eid", F.expr(ODD).alias("js"))
    both = text.select("eid", flatten_json(F.col("js")).alias("m"), F.expr("log_flatten(js)").alias("s"))
    return pairs_of(["eid", "same"], F.col("m"), both.withColumn("same", F.map_entries("m") == F.map_entries("s")))


# --- pattern costs --------------------------------------------------------------------------

#: Each start may read to the end of a run without blanks: quadratic. Words in words: exponential.
SQUARE = Rule("syslog", 1, r"SRC=(?P<s>\S+) DST=(?P<d>\S+)", (("s", "src_endpoint.ip"), ("d", "dst_endpoint.ip")))
ENDLESS = Rule("syslog", 1, r"^(?P<s>(?:\w+[ :=.-]*)+)$", (("s", "message"),))
PADDED = "CASE WHEN eid % 7 = 3 THEN concat(raw, repeat(' pad', 1024)) ELSE raw END"


@query(f"""WITH {L}, p AS (SELECT eid, {PADDED} AS raw FROM l), m AS (SELECT *, regexp_extract(raw, 'SRC=(\\S+) DST=(\\S+)', ['s', 'd']) AS g, regexp_matches(raw, 'SRC=\\S+ DST=\\S+') AS ok, length(raw) > 4096 AS long FROM p)
SELECT eid, CASE WHEN long THEN 'line exceeds 4096 characters for a pattern of quadratic cost' WHEN NOT ok THEN 'rule pattern did not match line' END AS error, CASE WHEN ok AND NOT long THEN g.s END AS src, CASE WHEN ok AND NOT long THEN g.d END AS dst, 'pattern may take exponential time' AS endless FROM m""")
def costly_patterns(spark, sf_dir):
    """A rule of quadratic cost on short and long lines, and one of exponential cost, which is never tried."""
    raw = F.expr(PADDED)
    both = lines(spark, sf_dir).select("eid", parse(raw, SQUARE).alias("p"), parse(raw, ENDLESS)["error"].alias("endless"))
    return both.select("eid", F.col("p.error").alias("error"), F.col("p.doc.src_endpoint.ip").alias("src"), F.col("p.doc.dst_endpoint.ip").alias("dst"), "endless")


# --- schema ---------------------------------------------------------------------------------

#: Documents of which each of eleven has another fault, by eid: the right one is the first.
PARTS = {
    1: '"severity_id":150', 2: '"severity_id":-1', 3: '"severity_id":"high"', 4: '"src_endpoint":{"ip":7,"port":true}', 5: '"action":3,"message":{}', 6: '"more":1,"also":null', 7: '"src_endpoint":{"ip":"10.0.0.1","port":70000}', 8: '"severity_id":7.0', 9: '"dst_endpoint":{"port":"http","why":[]}',
}
FAULTY = "CASE eid % 13 WHEN 10 THEN '{\"class_uid\":4002,\"class_name\":null,\"activity_id\":99.5,\"unmapped\":[]}' WHEN 11 THEN '[]' WHEN 12 THEN 'no JSON' ELSE concat('{\"class_uid\":4001,\"class_name\":\"Network Activity\",\"activity_id\":99,\"time\":null,\"metadata\":{\"product\":\"logloom\",\"version\":2},\"unmapped\":{\"eid\":', CAST(eid AS STRING), '}', CASE eid % 13 " + " ".join(f"WHEN {k} THEN ',{v}'" for k, v in PARTS.items()) + " ELSE '' END, '}') END"


@query(f"""WITH {L} SELECT eid, unnest(CASE eid % 13 WHEN 1 THEN ['$.severity_id is greater than 99'] WHEN 2 THEN ['$.severity_id is less than 0'] WHEN 3 THEN ['$.severity_id is not of type integer or null']
 WHEN 4 THEN ['$.src_endpoint.ip is not of type string', '$.src_endpoint.port is not of type integer or string'] WHEN 5 THEN ['$.action is not of type string or null', '$.message is not of type string or null'] WHEN 6 THEN ['$.also is not allowed', '$.more is not allowed']
 WHEN 10 THEN ['$.time is missing', '$.metadata is missing', '$.class_uid is not 4001', '$.class_name is not "Network Activity"', '$.activity_id is not of type integer', '$.activity_id is greater than 99', '$.unmapped is not of type object']
 WHEN 11 THEN ['$ is not of type object'] WHEN 12 THEN ['$ is no JSON'] END) AS problem FROM l""")
def schema_faults(spark, sf_dir):
    """What the compiled schema finds in documents with known faults; severity 7 and port 70,000 are none."""
    rule = compile_schema(DOCUMENT_RULE)
    return lines(spark, sf_dir).select("eid", F.explode(rule(F.try_parse_json(F.expr(FAULTY)))).alias("problem"))


# --- commits --------------------------------------------------------------------------------

USED = "eid % 11 > 3"


@query("SELECT name, CAST(n AS BIGINT) AS n, CAST(ids AS BIGINT) AS ids FROM (" + WITH + f"""SELECT 'raw_events' AS name, count(*) AS n, count(DISTINCT raw_id) AS ids FROM n WHERE {USED} UNION ALL SELECT 'normalized_events', count(*), count(DISTINCT event_id) FROM n WHERE {USED}
UNION ALL SELECT 'onboarding_samples', sum(least(c, 200)), sum(least(c, 200)) FROM (SELECT count(*) AS c FROM n WHERE {USED} AND fp NOT IN {ACTIVE} GROUP BY fp)
UNION ALL SELECT 'raw_batches', sum(b), sum(b) FROM (SELECT count(DISTINCT pos // 500) AS b FROM n WHERE {USED} AND eid % 2 = 0 GROUP BY partition_id UNION ALL SELECT count(DISTINCT pos // 500) FROM n WHERE {USED} AND eid % 2 = 1 GROUP BY partition_id)
UNION ALL SELECT 'chain_heads', count(DISTINCT partition_id), count(DISTINCT partition_id) FROM n WHERE {USED})""")
def failed_batch(spark, sf_dir):
    """Two micro-batches of which the second dies after its raw events and chain are written, and runs again: each row once."""
    root, found = fresh_root(spark), messages(spark, sf_dir)
    calls = []

    def rules():
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("dies between two tables")
        return SEEDS

    streamed(spark, root, rules, found.where("eid % 2 = 0"))
    try:
        streamed(spark, root, rules, found.where("eid % 2 = 1"))
    except Exception:
        if len(calls) != 2:
            raise
    streamed(spark, root, rules)
    ids = {"raw_events": "raw_id", "normalized_events": "event_id", "onboarding_samples": "raw_id", "raw_batches": "struct(partition_id, batch_seq)", "chain_heads": "partition_id"}
    parts = [read(spark, root, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct(F.expr(key)).alias("ids")) for name, key in ids.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- serving from stored tables -------------------------------------------------------------


@query(WITH + "SELECT event_id, fp AS fingerprint_id, status FROM n WHERE fp <> 'json' ORDER BY received_at DESC, event_id DESC LIMIT 120")
def newest_days(spark, sf_dir):
    """The newest page of a table by days: most days are never opened."""
    root = fresh_root(spark)
    normalized(spark, sf_dir).where("fingerprint_id <> 'json'").write.mode("append").partitionBy("day").parquet(f"{root}/normalized_events")
    return serve.newest_page(read(spark, root, "normalized_events"), limit=120).select("event_id", "fingerprint_id", "status")


@query(WITH + "SELECT raw_id, fp AS fingerprint_id, CASE WHEN fp = 'syslog' THEN 2 ELSE version END AS rule_version, status, CASE WHEN fp = 'syslog' AND status = 'parsed' THEN 'DROP' ELSE action END AS action FROM n")
def current_from_delta(spark, sf_dir):
    """Stored events parsed again under a second rule; the view is read with the delta that the second parse has left."""
    root, first = fresh_root(spark), normalized(spark, sf_dir)
    append_new(first, root, "normalized_events", ["event_id"])
    again = with_second_parse(spark, sf_dir).where("rule_version = 2")
    batch = Batch(spark, root, "second")
    batch.add("superseded", replaced_by(batch.add("normalized_events", again), read_current(spark, root)))
    batch.commit()
    return read_current(spark, root).select("raw_id", "fingerprint_id", "rule_version", "status", F.col("ocsf.action").alias("action"))


@query(WITH + "SELECT topic, key, CAST(count(*) AS BIGINT) AS messages, CAST(count(DISTINCT id) AS BIGINT) AS ids FROM (SELECT 'normalized.events' AS topic, fp AS key, event_id AS id FROM n UNION ALL SELECT 'pipeline.dlq', NULL, raw_id FROM n WHERE status = 'parse_error') GROUP BY ALL")
def outbox_once(spark, sf_dir):
    """Messages of two batches of which one comes again: each is in the outbox once."""
    root, done = fresh_root(spark), normalized(spark, sf_dir)
    for half in (0, 1, 0):
        part = done.where(F.pmod(F.xxhash64("raw_id"), F.lit(2)) == half)
        to_outbox(envelopes(part), root, NORMALIZED, f"events-{half}")
        to_outbox(dead_letters(part), root, LETTERS, f"letters-{half}")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    found = read(spark, root, "outbox").withColumn("id", F.when(F.col("topic") == NORMALIZED, field("event_id")).otherwise(field("raw_id")))
    return found.groupBy("topic", "key").agg(F.count("*").alias("messages"), F.count_distinct("id").alias("ids"))


# --- the functions by name ------------------------------------------------------------------

#: Rates and counts that follow from a line's number; every 23rd has no baseline.
RATES = "SELECT eid, raw, partition_id, pos, (eid % 101) / 100.0 AS now, CASE WHEN eid % 23 = 0 THEN NULL WHEN eid % 7 = 0 THEN 0.0 ELSE (eid % 13) / 100.0 END AS base, eid % 40 AS n"
LADDER = lambda x, a, b, c: f"CASE WHEN {x} < {a} THEN 'none' WHEN {x} < {b} THEN 'minor' WHEN {x} < {c} THEN 'moderate' WHEN {x} IS NOT NULL THEN 'severe' END"


@query(f"""WITH {L}, r AS ({RATES} FROM l), q AS (SELECT *, round(base - now, 6) AS lost, round(now - base, 6) AS grown FROM r), s AS (SELECT *,
 CASE WHEN base IS NULL THEN NULL WHEN grown < 0.05 OR (base > 0 AND now / base < 3) THEN 'none' WHEN base > 0 AND now / base < 10 THEN 'minor' WHEN base > 0 AND now / base < 40 THEN 'moderate' ELSE 'severe' END AS null_rate,
 {LADDER('lost', 0.10, 0.25, 0.50)} AS match_rate, {LADDER('now', 0.15, 0.35, 0.60)} AS shape, {LADDER('now', 0.05, 0.20, 0.50)} AS tier1,
 CASE WHEN n = 0 THEN 'severe' WHEN base IS NULL THEN NULL WHEN n BETWEEN 10 AND 30 THEN 'none' ELSE 'minor' END AS volume, {sql_uuid("'raw.logs:' || CAST(partition_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR)")} AS raw_id FROM q)
SELECT eid, null_rate, match_rate, shape, tier1, volume, CASE tier1 WHEN 'minor' THEN 'alert' WHEN 'moderate' THEN 'field_quarantined' WHEN 'severe' THEN 'rule_deactivated' END AS action, raw_id, {sql_uuid("raw_id || ':' || CAST(partition_id AS VARCHAR)")} AS event_id,
 CASE WHEN regexp_matches(raw, '^\\d+$') THEN 'int' WHEN regexp_matches(raw, '^\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}') THEN 'timestamp' ELSE 'free_text' END AS value_class,
 sha256(unhex(sha256(raw)) || unhex(sha256('x'))) AS root, (SELECT count(*) FROM unnest(regexp_extract_all(raw, '(?:^|[^\\w])\\w+=')) t(x)) > 0 AS has_pairs FROM s""")
def functions_by_name(spark, sf_dir):
    """The ladders, ids, roots and classes as a user of SQL calls them, on values of each line."""
    register(spark)
    text = f"""SELECT eid, log_null_rate_severity(now, base) AS null_rate, log_match_rate_severity(now, base) AS match_rate, log_shape_severity(now) AS shape, log_tier1_severity(now) AS tier1,
      log_volume_severity(n, CASE WHEN base IS NOT NULL THEN 10L END, CASE WHEN base IS NOT NULL THEN 30L END) AS volume, log_decide_action(log_tier1_severity(now)) AS action, log_raw_id('raw.logs', partition_id, pos) AS raw_id,
      log_event_id(log_raw_id('raw.logs', partition_id, pos), partition_id) AS event_id, log_value_class(raw) AS value_class, log_merkle_root(array(log_content_hash(raw), log_content_hash('x'))) AS root, size(log_key_values(raw)) > 0 AS has_pairs
      FROM ({RATES.replace("/ 100.0", "/ 100.0D").replace("THEN 0.0", "THEN 0.0D")} FROM {{lines}})"""
    return spark.sql(text, lines=lines(spark, sf_dir))
