"""The registered queries on derived log lines, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import drift as D
from ..functions.extract import SEEDS, Rule, key_values
from ..functions.fingerprint import fingerprint_id, shape_hash, shape_sequence
from ..functions.mutate import corrupt_syslog, mutate
from ..operators import drift as W
from ..operators import ingest, legacy, lifecycle, serve
from ..operators.normalize import canary, capture_samples, current_view, document_errors, normalize, supersession
from ..schemas import NETWORK_RULE
from ..storage import materialise, spread
from .lines import LINES, derived_events, lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COUNT_WINDOW, TIME_WINDOW, BASE_WINDOWS = 100, 10 * 86_400, 3
#: A second version of the syslog rule that maps the action too, and the first one for the parse of the backlog.
SECOND = Rule("syslog", 2, r"^.*?IPTABLES-(?P<verdict>\w+):\s*(?P<extension>.*)$", (("SRC", "src_endpoint.ip"), ("SPT", "src_endpoint.port"), ("DST", "dst_endpoint.ip"), ("DPT", "dst_endpoint.port"), ("verdict", "action")))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- common parts of the checking SQL -------------------------------------------------------

UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 AS INT) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
NS = "unhex('7308095f97735212acefa4c9f422b66c')"


def sql_uuid(name: str) -> str:
    return UUID.replace("h,", f"sha1({NS} || encode({name})),")


REST = "regexp_extract(t, '[^=]*$')"
KIND = f"""repeat('KV:', CAST(length(t) - length(replace(t, '=', '')) AS INT)) || CASE
 WHEN regexp_matches({REST}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}:\\d+$') THEN 'IPPORT' WHEN regexp_matches({REST}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') THEN 'IP'
 WHEN regexp_matches({REST}, '^[0-9a-fA-F:]{{6,}}$') THEN 'HEXISH' WHEN regexp_matches({REST}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ].+') THEN 'ISOTS'
 WHEN regexp_matches({REST}, '^\\d+$') THEN 'N' ELSE 'W' END"""
L = f"l AS ({LINES})"
SHAPES = f""", s0 AS (SELECT *, list_transform(CASE WHEN contains(raw, ' ') THEN string_split_regex(raw, '\\s+') ELSE string_split_regex(raw, '[|;,]') END, lambda t: {KIND}) AS cl FROM l),
s AS (SELECT *, array_to_string(list_filter(cl, lambda c, i: NOT (c = 'W' AND i > 1 AND cl[i - 1] = 'W')), '|') AS shape FROM s0)"""
FP = """, f AS (SELECT *, CASE WHEN starts_with(raw, 'CEF:') THEN 'cef_' || regexp_replace(lower(split_part(raw, '|', 2)), '[^a-z0-9]', '', 'g')
 WHEN starts_with(raw, 'LEEF:') THEN 'leef_' || lower(split_part(raw, '|', 2)) WHEN json_valid(raw) THEN 'json'
 WHEN regexp_matches(raw, '^[A-Z][a-z]{2} \\d\\d ') THEN 'syslog' ELSE 'auto_' || substr(sha256(shape), 1, 8) END AS fp FROM s)"""
PORT = "TRY_CAST({0} AS BIGINT)"
KV = lambda k: f"CASE WHEN regexp_matches(raw, '(^|[ |]){k}=[^ ]') THEN regexp_extract(raw, '(?:^|[ |]){k}=([^ ]+)', 1) END"
JS = lambda k: f"json_extract_string(raw, '$.{k}')"


def by_format(cef: str, js: str, syslog: str) -> str:
    return f"CASE WHEN status <> 'parsed' THEN NULL WHEN fp LIKE 'cef%' THEN {cef} WHEN fp = 'json' THEN CASE WHEN json_valid(raw) THEN {js} END ELSE {syslog} END"


ISO_UTC = "strftime(received_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"
NORM = f""", n0 AS (SELECT *, CASE WHEN fp = 'syslog' AND NOT regexp_matches(raw, 'IPTABLES-\\w+:') THEN 'parse_error' WHEN fp LIKE 'cef%' OR fp IN ('json', 'syslog') THEN 'parsed' ELSE 'unparsed' END AS status,
 CASE WHEN fp LIKE 'cef%' OR fp IN ('json', 'syslog') THEN 1 END AS version, {sql_uuid("'raw.logs:' || CAST(partition_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR)")} AS raw_id FROM f),
n AS (SELECT *, {sql_uuid("raw_id || ':' || CAST(coalesce(version, 0) AS VARCHAR)")} AS event_id,
 {by_format(KV('src'), JS('src_ip'), KV('SRC'))} AS src_ip, {by_format(KV('dst'), JS('dest_ip'), KV('DST'))} AS dst_ip,
 {by_format(KV('spt'), JS('src_port'), KV('SPT'))} AS src_port, {by_format(KV('dpt'), JS('dest_port'), KV('DPT'))} AS dst_port,
 {by_format(KV('act'), JS('event_type'), 'NULL')} AS action, {by_format("regexp_extract(raw, 'msg=(.*)$', 1)", "json_extract_string(raw, '$.alert.signature')", 'NULL')} AS message,
 {by_format('NULL', "CAST(json_extract_string(raw, '$.alert.severity') AS BIGINT)", 'NULL')} AS severity,
 {by_format('NULL', JS('timestamp'), 'NULL')} AS time FROM n0)"""
WITH = f"WITH {L}{SHAPES}{FP}{NORM}"
ACTIVE = "('cef_paloalto', 'cef_ciscoasa', 'cef_fortigate', 'json', 'syslog')"


# --- the same in Spark ----------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_events(spark, sf_dir)


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that ingest has written: queries that serve read tables, as users do. Written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = materialise(build(), f"tables/{name}")
    return _TABLES[key]


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "raw_events", lambda: events(spark, sf_dir))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "normalized_events", lambda: normalize(stored_events(spark, sf_dir), SEEDS))


def parsed(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    rows = normalize(stored_events(spark, sf_dir), SEEDS).where(F.col("fingerprint_id").startswith(prefix) & (F.col("status") == "parsed"))
    port = lambda side: F.coalesce(F.col(f"ocsf.{side}.port").cast("string"), F.col(f"ocsf.{side}.port_raw"))
    return rows.select("event_id", F.col("ocsf.src_endpoint.ip").alias("src_ip"), port("src_endpoint").alias("src_port"), F.col("ocsf.dst_endpoint.ip").alias("dst_ip"), port("dst_endpoint").alias("dst_port"), F.col("ocsf.severity_id").alias("severity"), F.col("ocsf.action").alias("action"), F.col("ocsf.message").alias("message"))


PARSED = WITH + "SELECT event_id, src_ip, src_port, dst_ip, dst_port, severity, action, message FROM n WHERE status = 'parsed' AND fp LIKE '{}%'"


# --- ids, fingerprints, extraction ----------------------------------------------------------


@query(WITH + "SELECT raw_id, sha256(raw) AS content_hash, fp AS fingerprint_id FROM n")
def raw_ids(spark, sf_dir):
    return events(spark, sf_dir).select("raw_id", "content_hash", "fingerprint_id")


@query(WITH + "SELECT fp AS fingerprint_id, count(*) AS lines FROM n GROUP BY fp")
def fingerprint_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy("fingerprint_id").agg(F.count("*").alias("lines"))


@query(f"WITH {L}{SHAPES} SELECT eid, shape, substr(sha256(shape), 1, 8) AS shape_hash FROM s")
def shapes(spark, sf_dir):
    return lines(spark, sf_dir).select("eid", F.array_join(shape_sequence(F.col("raw")), "|").alias("shape"), shape_hash(F.col("raw")).alias("shape_hash"))


@query(f"WITH {L}{SHAPES}{FP} SELECT fp AS fingerprint_id, count(*) AS lines, count(DISTINCT shape) AS shapes, count(DISTINCT shape) > 1 AS fragmented FROM f GROUP BY fp")
def fragmentation(spark, sf_dir):
    return legacy.fragmentation(events(spark, sf_dir).select("fingerprint_id", shape_hash(F.col("raw_text")).alias("shape_hash")))


@query(f"""WITH d AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS raw FROM documents), l AS (SELECT * FROM d){SHAPES}
SELECT doc_id, CASE WHEN raw LIKE '{{%}}' AND json_valid(raw) THEN 'json' WHEN length(raw) - length(replace(raw, ',', '')) >= 2 AND NOT regexp_matches(regexp_replace(raw, '"[^"]*("|$)', '', 'g'), '\\s') THEN 'csv'
 WHEN regexp_matches(raw, '(?i)^<?\\d*>?\\s*(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+\\d{{1,2}}\\s+\\d{{2}}:\\d{{2}}:\\d{{2}}') THEN 'syslog' ELSE 'auto_' || substr(sha256(shape), 1, 8) END AS fingerprint_id FROM s""")
def fingerprint_documents(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", fingerprint_id(F.col("text")).alias("fingerprint_id"))


@query()
def fingerprint_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", fingerprint_id(F.col("html")).alias("fingerprint_id"))


@query(PARSED.replace("{}", "cef"))
def parse_cef(spark, sf_dir):
    return parsed(spark, sf_dir, "cef")


@query(PARSED.replace("{}", "json"))
def parse_json(spark, sf_dir):
    return parsed(spark, sf_dir, "json")


@query(PARSED.replace("{}", "syslog"))
def parse_syslog(spark, sf_dir):
    return parsed(spark, sf_dir, "syslog")


@query(f"""WITH {L}, p AS (SELECT eid, list_filter(string_split(regexp_replace(raw, '(\\w+=)', chr(1) || '\\1', 'g'), chr(1)), lambda x, i: i > 1) AS ps FROM l),
q AS (SELECT eid, ps[i] AS p, i = len(ps) AS last FROM p, unnest(range(1, len(ps) + 1)) AS r(i)), v AS (SELECT eid, split_part(p, '=', 1) AS key, substr(p, instr(p, '=') + 1) AS v, last FROM q)
SELECT eid, key, trim(v) AS value FROM v WHERE trim(v) <> '' AND (last OR v LIKE '% ')""")
def kv_scan(spark, sf_dir):
    rows = lines(spark, sf_dir).select("eid", F.explode(key_values(F.col("raw"))).alias("p"))
    return rows.select("eid", "p.key", "p.value")


@query(WITH + """SELECT event_id, 'cat' AS key, 'web' AS value FROM n WHERE fp LIKE 'cef%' AND contains(raw, ' cat=web') UNION ALL SELECT event_id, 'zone', 'dmz' FROM n WHERE fp LIKE 'cef%' AND contains(raw, ' zone=dmz')
UNION ALL SELECT event_id, 'flow_id', json_extract_string(raw, '$.flow_id') FROM n WHERE fp = 'json'
UNION ALL SELECT event_id, k, CASE k WHEN 'IN' THEN 'eth0' WHEN 'PROTO' THEN 'TCP' ELSE regexp_extract(raw, 'LEN=(\\d+)', 1) END FROM n, (VALUES ('IN'), ('LEN'), ('PROTO')) v(k) WHERE fp = 'syslog' AND status = 'parsed'""")
def unmapped_values(spark, sf_dir):
    return normalized(spark, sf_dir).where("status = 'parsed'").select("event_id", F.explode("ocsf.unmapped").alias("key", "value"))


@query(WITH + "SELECT event_id, coalesce(time, " + ISO_UTC + ") AS time FROM n WHERE status = 'parsed'")
def time_fill(spark, sf_dir):
    return normalized(spark, sf_dir).where("status = 'parsed'").select("event_id", F.col("ocsf.time").alias("time"))


BEYOND = ("coalesce(severity NOT BETWEEN 0 AND 6, false)", *(f"coalesce(TRY_CAST({c} AS BIGINT) NOT BETWEEN 0 AND 65535, false)" for c in ("src_port", "dst_port")))


@query(WITH + "SELECT event_id, " + " + ".join(f"CAST({x} AS BIGINT)" for x in BEYOND) + " AS problems FROM n WHERE status = 'parsed'")
def schema_errors(spark, sf_dir):
    """Every parsed document against the schema with the limits of network events: severities up to 6, ports up to 65,535."""
    return normalized(spark, sf_dir).where("status = 'parsed'").select("event_id", F.size(document_errors(F.col("ocsf"), NETWORK_RULE)).cast("long").alias("problems"))


@query(WITH + f"SELECT count(*) AS checked, CAST(count_if({' OR '.join(BEYOND)}) AS BIGINT) AS failed FROM n WHERE status = 'parsed' AND CAST('0x' || right(event_id, 8) AS BIGINT) % 100 = 0")
def schema_canary(spark, sf_dir):
    return canary(normalized(spark, sf_dir), rule=NETWORK_RULE)


@query(WITH + "SELECT event_id, coalesce(regexp_full_match(src_ip, '(\\d{1,3}\\.){3}\\d{1,3}'), true) AND coalesce(regexp_full_match(dst_ip, '(\\d{1,3}\\.){3}\\d{1,3}'), true) AS ip_fields_valid, coalesce(TRY_CAST(src_port AS BIGINT) BETWEEN 0 AND 65535, src_port IS NULL) AND coalesce(TRY_CAST(dst_port AS BIGINT) BETWEEN 0 AND 65535, dst_port IS NULL) AS port_fields_valid, coalesce(severity BETWEEN 0 AND 6, true) AS severity_valid FROM n WHERE status = 'parsed'")
def value_sanity(spark, sf_dir):
    """Values that the schema allows and a network event can't have."""
    found = lifecycle.sanity(F.col("ocsf"))
    return normalized(spark, sf_dir).where("status = 'parsed'").select("event_id", *[c.alias(k) for k, c in found.items()])


# --- serving --------------------------------------------------------------------------------


@query(WITH + "SELECT event_id, raw_id, fp AS fingerprint_id, version AS rule_version, status FROM n")
def normalized_status(spark, sf_dir):
    return normalize(stored_events(spark, sf_dir), SEEDS).select("event_id", "raw_id", "fingerprint_id", "rule_version", "status")


@query(WITH + "SELECT s AS status, count(n.status) AS events FROM (VALUES ('parsed'), ('unparsed'), ('quarantined'), ('parse_error')) v(s) LEFT JOIN n ON n.status = s GROUP BY s")
def stats_by_status(spark, sf_dir):
    return serve.stats_by_status(normalized(spark, sf_dir))


@query(WITH + "SELECT fp AS fingerprint_id, count(*) AS total, count_if(status = 'parsed') AS parsed, false AS truncated FROM n GROUP BY fp ORDER BY total DESC, fp LIMIT 500")
def stats_by_fingerprint(spark, sf_dir):
    return serve.stats_by_fingerprint(normalized(spark, sf_dir))


@query(WITH + "SELECT round(100.0 * count_if(status = 'parsed') / count(*), 1) AS parsed_pct, count(*) AS events FROM n")
def parsed_percentage(spark, sf_dir):
    return serve.parsed_percentage(normalized(spark, sf_dir))


AS_OF = datetime(2024, 1, 15, 12, 0)


@query(f"WITH {L} SELECT count(*) AS events FROM l WHERE received_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 1 MINUTE AND TIMESTAMP '{AS_OF}'")
def events_last_minute(spark, sf_dir):
    return serve.events_last_minute(normalized(spark, sf_dir), F.lit(f"{AS_OF}").cast("timestamp"))


@query(WITH + "SELECT event_id, fp AS fingerprint_id, status FROM n WHERE status = 'parsed' ORDER BY received_at DESC, event_id DESC LIMIT 50")
def events_page(spark, sf_dir):
    return serve.events_page(normalized(spark, sf_dir), status="parsed").select("event_id", "fingerprint_id", "status")


@query(WITH + f"SELECT event_id, status FROM n WHERE fp = 'syslog' AND received_at < TIMESTAMP '{AS_OF}' ORDER BY received_at DESC, event_id DESC LIMIT 100")
def events_before(spark, sf_dir):
    return serve.events_page(normalized(spark, sf_dir), fingerprint="syslog", before=AS_OF, limit=100).select("event_id", "status")


@query(WITH + "SELECT event_id, raw_id, sha256(raw) AS content_hash, length(raw) AS chars FROM n")
def trace_join(spark, sf_dir):
    return serve.trace(normalized(spark, sf_dir), stored_events(spark, sf_dir)).select("event_id", "raw_id", "content_hash", F.length("raw_text").cast("long").alias("chars"))


@query(WITH + "SELECT event_id, concat_ws(':', src_ip, src_port) AS source, concat_ws(':', dst_ip, dst_port) AS target, action FROM n WHERE status = 'parsed'")
def event_browser(spark, sf_dir):
    return serve.browse(normalized(spark, sf_dir)).select("event_id", "source", "target", "action")


@query(WITH + "SELECT event_id, raw_id, fp AS fingerprint_id, version AS rule_version, status, " + ISO_UTC + " AS parsed_at FROM n WHERE status = 'parsed' ORDER BY received_at DESC, event_id DESC LIMIT 50000")
def export_parquet_rows(spark, sf_dir):
    return serve.flat(serve.export_rows(normalized(spark, sf_dir))).drop("ocsf")


@query(WITH + """SELECT event_id, '{"class_uid":4001,"class_name":"Network Activity","activity_id":99,"severity_id":' || coalesce(CAST(severity AS VARCHAR), 'null') || ',' AS head FROM n WHERE status = 'parsed' ORDER BY received_at DESC, event_id DESC LIMIT 1000""")
def export_jsonl(spark, sf_dir):
    rows = serve.export_rows(normalized(spark, sf_dir), limit=1000)
    return rows.select("event_id", F.substring_index(F.to_json("ocsf", {"ignoreNullFields": "false"}), '"time"', 1).alias("head"))


@query(WITH + "SELECT event_id, status FROM (SELECT * FROM n ORDER BY received_at DESC, event_id DESC LIMIT 100)")
def tail_snapshot(spark, sf_dir):
    return serve.tail(normalized(spark, sf_dir)).select("event_id", "status")


# --- chain ----------------------------------------------------------------------------------

CHAIN = f"""WITH {L}, b AS (SELECT partition_id, CAST(floor(pos / 2.0) AS BIGINT) AS block, min(pos) AS first_offset, max(pos) AS last_offset, count(*) AS count, list(sha256(raw) ORDER BY pos) AS h FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY block) AS batch_seq, CASE WHEN count = 1 THEN h[1] ELSE sha256(unhex(h[1]) || unhex(h[2])) END AS merkle_root FROM b) """


@query(CHAIN + "SELECT partition_id, batch_seq, coalesce(lag(merkle_root) OVER (PARTITION BY partition_id ORDER BY batch_seq), repeat('0', 64)) AS prev_hash, merkle_root, count, first_offset, last_offset FROM r")
def merkle_batches(spark, sf_dir):
    return ingest.batches(events(spark, sf_dir), 2).drop("row_hashes")


@query(CHAIN + "SELECT partition_id, max(batch_seq) AS batch_seq, arg_max(merkle_root, batch_seq) AS merkle_root, arg_max(count, batch_seq) AS count, max(last_offset) AS last_offset FROM r GROUP BY partition_id")
def chain_heads(spark, sf_dir):
    return serve_heads(spark, sf_dir)


def serve_heads(spark, sf_dir):
    return ingest.chain_heads(ingest.batches(events(spark, sf_dir), 2))


@query(f"WITH {L} SELECT partition_id, row_number() OVER (PARTITION BY partition_id ORDER BY floor(pos / 500.0)) AS batch_seq, count(*) AS count, true AS genesis_ok, true AS gap_ok, true AS link_ok, true AS count_ok, true AS root_ok, true AS ok FROM l GROUP BY partition_id, floor(pos / 500.0)")
def chain_verify(spark, sf_dir):
    return ingest.verify_chain(ingest.batches(events(spark, sf_dir)))


@query(f"""WITH RECURSIVE {L}, t(partition, k, hash, n) AS (SELECT partition_id, row_number() OVER (PARTITION BY partition_id ORDER BY pos) - 1, sha256(raw), count(*) OVER (PARTITION BY partition_id) FROM l
UNION ALL SELECT a.partition, a.k // 2, sha256(unhex(a.hash) || unhex(coalesce(b.hash, a.hash))), (a.n + 1) // 2 FROM t a LEFT JOIN t b ON a.partition = b.partition AND b.k = a.k + 1 WHERE a.n > 1 AND a.k % 2 = 0) SELECT partition, hash AS root FROM t WHERE n = 1""")
def merkle_whole_partitions(spark, sf_dir):
    return ingest.partition_roots(events(spark, sf_dir))


# --- samples and rules ----------------------------------------------------------------------

SAMPLES = WITH + f", c AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY received_at, raw_id) AS rn FROM n WHERE fp NOT IN {ACTIVE}), p AS (SELECT *, CASE WHEN rn <= 5 THEN 'prompt' WHEN rn <= 20 THEN 'held_out' ELSE 'unused' END AS role FROM c WHERE rn <= 200) "


def samples(spark, sf_dir):
    return capture_samples(stored_events(spark, sf_dir), SEEDS)


@query(SAMPLES + "SELECT fp AS fingerprint_id, raw_id FROM p")
def samples_capture(spark, sf_dir):
    return samples(spark, sf_dir).select("fingerprint_id", "raw_id")


@query(SAMPLES + "SELECT fp AS fingerprint_id, raw_id, role FROM p")
def samples_split(spark, sf_dir):
    return lifecycle.split_roles(samples(spark, sf_dir)).select("fingerprint_id", "raw_id", "role")


@query(SAMPLES + "SELECT fp AS fingerprint_id, count_if(role = 'prompt') AS prompt, count_if(role = 'held_out') AS held_out, count_if(role = 'unused') AS unused, count(*) AS total FROM p GROUP BY fp")
def samples_status(spark, sf_dir):
    return serve.samples_by_role(lifecycle.split_roles(samples(spark, sf_dir))).drop("last_captured_at")


@query(SAMPLES + "SELECT fp AS fingerprint_id, count(*) AS samples FROM p GROUP BY fp HAVING count(*) >= 20")
def ready_fingerprints(spark, sf_dir):
    ledger = lifecycle.Ledger(SEEDS)
    attempts = spark.createDataFrame([], "fingerprint_id string, samples_seen int, attempted_at timestamp")
    return lifecycle.ready_fingerprints(samples(spark, sf_dir), ledger.frame(spark), attempts).drop("samples_seen")


@query("SELECT * FROM (VALUES ('json', 'src_endpoint.ip', 'src_ip'), ('json', 'src_endpoint.port', 'src_port'), ('json', 'dst_endpoint.ip', 'dest_ip'), ('json', 'dst_endpoint.port', 'dest_port'), ('json', 'time', 'timestamp'), ('json', 'severity_id', 'alert.severity'), ('json', 'action', 'event_type'), ('json', 'message', 'alert.signature')) v(fingerprint_id, ocsf_path, source_field)")
def json_alias_rule(spark, sf_dir):
    rows = stored_events(spark, sf_dir).where("fingerprint_id = 'json'").select("fingerprint_id", "raw_text")
    return lifecycle.json_mappings(rows)


@query("SELECT * FROM (VALUES ('cef_ciscoasa', 1, 'active'), ('cef_fortigate', 1, 'active'), ('cef_paloalto', 1, 'active'), ('json', 1, 'active'), ('syslog', 2, 'active')) v(fingerprint_id, version, status)")
def rules_latest(spark, sf_dir):
    return serve.rules_latest(upgraded().frame(spark)).select("fingerprint_id", "version", "status")


def upgraded() -> lifecycle.Ledger:
    """The seed rules after a second syslog rule was proposed and approved, and one field quarantined."""
    return lifecycle.Ledger(SEEDS).propose(SECOND, "ada").approve("syslog", 2, "ada").quarantine("json", "severity_id")


@query("SELECT 'json' AS fingerprint_id, 'severity_id' AS field")
def quarantined_fields(spark, sf_dir):
    return serve.quarantined_fields(upgraded().frame(spark))


@query("SELECT 'syslog' AS fingerprint_id, 2 AS version")
def reparse_stale(spark, sf_dir):
    return lifecycle.stale(current_view(normalized(spark, sf_dir)), upgraded().frame(spark))


def with_second_parse(spark, sf_dir):
    first = normalized(spark, sf_dir)
    return first.unionByName(lifecycle.reparse(first, stored_events(spark, sf_dir), upgraded().rules, F.col("received_at") + F.expr("INTERVAL 1 DAY")))


@query(WITH + "SELECT raw_id, fp AS fingerprint_id, CASE WHEN fp = 'syslog' THEN 2 ELSE version END AS rule_version, status, CASE WHEN fp = 'syslog' AND status = 'parsed' THEN 'DROP' ELSE action END AS action FROM n")
def current_events(spark, sf_dir):
    return current_view(with_second_parse(spark, sf_dir)).select("raw_id", "fingerprint_id", "rule_version", "status", F.col("ocsf.action").alias("action"))


@query(WITH + "SELECT fp AS fingerprint_id, count_if(fp = 'syslog') AS superseded, count(*) AS current FROM n GROUP BY fp")
def supersede_counts(spark, sf_dir):
    return lifecycle.supersede_counts(supersession(with_second_parse(spark, sf_dir)))


@query(f"""WITH {L}, x AS (SELECT * FROM l WHERE eid % 5 = 3), c AS (SELECT 'host3' AS literal, count_if(regexp_matches(raw, '\\bhost3\\b')) AS n, count(*) AS lines FROM x
UNION ALL SELECT '192.168.3.1', count_if(regexp_matches(raw, '\\b192\\.168\\.3\\.1\\b')), count(*) FROM x
UNION ALL SELECT v, count_if(regexp_matches(raw, '=' || v || '( |$)')), count(*) FROM x, (VALUES ('168'), ('192')) o(v) GROUP BY v) SELECT literal FROM c WHERE n > 0 AND (n < lines OR lines < 2)""")
def hardcoded_literals(spark, sf_dir):
    rows = stored_events(spark, sf_dir).where("fingerprint_id = 'syslog'")
    return lifecycle.hardcoded_literals(rows, "host3 DST=192.168.3.1 LEN")


VALID = lambda c, low, high: f"count_if({c} IS NOT NULL AND NOT coalesce(TRY_CAST({c} AS BIGINT) BETWEEN {low} AND {high}, false)) = 0"
DOTTED = lambda c: f"count_if({c} IS NOT NULL AND NOT regexp_full_match({c}, '(\\d{{1,3}}\\.){{3}}\\d{{1,3}}')) = 0"
CHECKS = {
    "caps_and_allowlist": VALID("severity", 0, 99), "samples_parse": "count_if(status <> 'parsed') = 0 AND " + VALID("severity", 0, 6), "held_out_match_all": f"count_if(k > {lifecycle.PROMPT} AND status <> 'parsed') = 0",
    "ip_fields_valid": f"{DOTTED('src_ip')} AND {DOTTED('dst_ip')}", "port_fields_valid": f"{VALID('src_port', 0, 65535)} AND {VALID('dst_port', 0, 65535)}",
    "no_orphan_mappings": " AND ".join(f"count({c}) > 0" for c in ("src_ip", "dst_ip", "src_port", "dst_port", "time", "severity", "action", "message")), "adversarial_probe": "count_if(NOT json_valid(raw)) = 0", "no_hardcoded_literals": "count_if(contains(raw, '__JSON__')) = 0",
}


@query(WITH + f", u AS (SELECT *, row_number() OVER (ORDER BY received_at, raw_id) AS k FROM n WHERE fp = 'json'), kept AS (SELECT * FROM u WHERE k <= {lifecycle.PROMPT + lifecycle.HELD_OUT}) " + " UNION ALL ".join(f"SELECT '{k}' AS check_key, {v} AS passed FROM kept" for k, v in CHECKS.items()))
def candidate_report(spark, sf_dir):
    """The eight checks of the rule that aliases give JSON lines, on the lines that its fingerprint keeps as samples."""
    rows = stored_events(spark, sf_dir).where("fingerprint_id = 'json'")
    split = lifecycle.split_roles(rows.select("fingerprint_id", "raw_id", "raw_text", F.col("received_at").alias("captured_at")))
    rule = lifecycle.json_rule(rows, "json")
    found = lifecycle.validate_candidate(rule, split)
    return spark.createDataFrame([(k, v) for k, v in found["checks"].items()], "check_key string, passed boolean")


@query(f"WITH {L}{SHAPES}{FP} SELECT fp AS fingerprint_id, 1.0 AS stability, 3 * count(*) AS mutants FROM f GROUP BY fp")
def mutation_stability(spark, sf_dir):
    rows = events(spark, sf_dir).select("fingerprint_id", "raw_text", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seed"))
    same = rows.select("fingerprint_id", (fingerprint_id(mutate(F.col("raw_text"), F.col("seed")), xml=False) == F.col("fingerprint_id")).alias("same"))
    return same.groupBy("fingerprint_id").agg(F.avg(F.col("same").cast("int")).alias("stability"), F.count("*").alias("mutants"))


@query(f"""WITH {L} SELECT eid, CASE WHEN (eid * 2654435761 % 1000) / 1000.0 < 0.4 AND eid % 3 = 0 THEN regexp_replace(raw, '\\bSRC=', 'SRCADDR=')
 WHEN (eid * 2654435761 % 1000) / 1000.0 < 0.4 THEN regexp_replace(raw, '\\bSRC=\\S*', 'SRC=uplink-trust-0x4f') ELSE raw END AS raw FROM l WHERE eid % 5 = 3""")
def corrupted_syslog(spark, sf_dir):
    return lines(spark, sf_dir).where("eid % 5 = 3").select("eid", corrupt_syslog(F.col("raw"), F.col("eid"), F.lit(0.4)).alias("raw"))


@query(f"WITH {L}{SHAPES}{FP} SELECT CASE WHEN fp LIKE 'auto%' THEN 'unknown' ELSE fp END AS fingerprint_id, count(*) AS lines FROM f GROUP BY 1")
def legacy_fingerprints(spark, sf_dir):
    return lines(spark, sf_dir).select(legacy.fingerprint(F.col("raw")).alias("fingerprint_id")).groupBy("fingerprint_id").agg(F.count("*").alias("lines"))


@query(WITH + "SELECT fp AS fingerprint_id, avg(CAST(src_ip IS NULL AS INT)) AS null_rate, count(*) AS events FROM n WHERE status = 'parsed' GROUP BY fp")
def legacy_null_rates(spark, sf_dir):
    rows = normalized(spark, sf_dir).where("status = 'parsed'")
    return rows.groupBy("fingerprint_id").agg(F.avg(F.col("ocsf.src_endpoint.ip").isNull().cast("int")).alias("null_rate"), F.count("*").alias("events"))


# --- drift ----------------------------------------------------------------------------------

CLOSED = WITH + f""", w0 AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY received_at, event_id) - 1 AS rn, received_at < max(received_at) OVER (PARTITION BY fp) - INTERVAL {TIME_WINDOW} SECOND AS old FROM n WHERE version IS NOT NULL),
w1 AS (SELECT *, count_if(old) OVER (PARTITION BY fp) AS n_old FROM w0), w2 AS (SELECT *, CASE WHEN old THEN rn ELSE n_old + (rn - n_old) // {COUNT_WINDOW} END AS wid FROM w1),
w AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY fp, wid) AS size FROM w2) WHERE old OR size = {COUNT_WINDOW}),
b AS (SELECT fp, wid, min(received_at) AS window_start, max(received_at) AS window_end, count(*) AS events_count, count_if(status = 'parsed') AS parsed, count_if(status = 'parse_error') AS errors FROM w GROUP BY fp, wid)"""
VALUES = """, v AS (SELECT fp, wid, unnest([{'f': 'src_endpoint.ip', 'v': src_ip}, {'f': 'dst_endpoint.ip', 'v': dst_ip}, {'f': 'src_endpoint.port', 'v': src_port}, {'f': 'dst_endpoint.port', 'v': dst_port},
 {'f': 'action', 'v': action}, {'f': 'message', 'v': message}, {'f': 'severity_id', 'v': CAST(severity AS VARCHAR)}, {'f': 'time', 'v': time}], recursive := true) FROM w WHERE status = 'parsed'),
um AS (SELECT fp, wid, 'unmapped.cat' AS f, 'web' AS v FROM w WHERE fp LIKE 'cef%' AND contains(raw, ' cat=web') UNION ALL SELECT fp, wid, 'unmapped.zone', 'dmz' FROM w WHERE fp LIKE 'cef%' AND contains(raw, ' zone=dmz')
 UNION ALL SELECT fp, wid, 'unmapped.flow_id', json_extract_string(raw, '$.flow_id') FROM w WHERE fp = 'json'
 UNION ALL SELECT fp, wid, 'unmapped.' || x, regexp_extract(raw, x || '=(\\S+)', 1) FROM w, (VALUES ('IN'), ('LEN'), ('PROTO')) o(x) WHERE fp = 'syslog' AND status = 'parsed'),
u AS (SELECT * FROM v WHERE fp = 'json' OR (f NOT IN ('severity_id', 'time') AND (fp LIKE 'cef%' OR f NOT IN ('action', 'message'))) UNION ALL SELECT fp, wid, f, v FROM um),
k AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN regexp_matches(v, '^\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}$') THEN 'ipv4' WHEN regexp_matches(v, '^\\d{4}[-/]\\d{2}[-/]\\d{2}') THEN 'timestamp' WHEN regexp_matches(v, '^\\d+$') THEN 'int' ELSE 'free_text' END AS c,
 coalesce(CASE WHEN f LIKE '%.port' THEN TRY_CAST(v AS BIGINT) IS NULL AND v IS NOT NULL WHEN f = 'severity_id' THEN CAST(v AS INT) > 6 END, false) AS bad FROM u),
fs AS (SELECT fp, wid, f AS field, count_if(v IS NULL) AS nulls, count_if(bad) AS violations, count_if(coalesce(c, '') = 'ipv4') AS ipv4, count_if(coalesce(c, '') = 'timestamp') AS ts_values, count_if(coalesce(c, '') = 'int') AS int_values, count_if(coalesce(c, '') = 'free_text') AS free_text FROM k GROUP BY ALL)"""
BAND = lambda x, a, b, c: f"CASE WHEN {x} < {a} THEN 'none' WHEN {x} < {b} THEN 'minor' WHEN {x} < {c} THEN 'moderate' WHEN {x} IS NOT NULL THEN 'severe' END"
ROWS = CLOSED + VALUES + f""", r AS (SELECT fs.fp, field, window_start, window_end, events_count, nulls / parsed AS null_rate, CAST(NULL AS DOUBLE) AS match_rate, CASE WHEN field NOT LIKE 'unmapped.%' THEN violations / parsed END AS violation_rate, ipv4, ts_values, int_values, free_text, coalesce(CASE WHEN field NOT LIKE 'unmapped.%' THEN {BAND('violations / parsed', 0.05, 0.2, 0.5)} END, 'none') AS severity FROM fs JOIN b USING (fp, wid)
 UNION ALL SELECT fp, '__rule__', window_start, window_end, events_count, NULL, CASE WHEN parsed + errors > 0 THEN parsed / (parsed + errors) END, NULL, NULL, NULL, NULL, NULL, 'none' FROM b)"""
BASE = ROWS + f""", nth AS (SELECT *, dense_rank() OVER (PARTITION BY fp ORDER BY window_start) AS nth FROM r),
base AS (SELECT fp, field, avg(null_rate) AS base_null, avg(match_rate) AS base_match, CASE WHEN field = '__rule__' THEN min(events_count) END AS base_low, CASE WHEN field = '__rule__' THEN max(events_count) END AS base_high,
 sum(ipv4) AS b_ipv4, sum(ts_values) AS b_ts, sum(int_values) AS b_int, sum(free_text) AS b_text, sum(ipv4) + sum(ts_values) + sum(int_values) + sum(free_text) AS b_all FROM nth WHERE field NOT LIKE 'unmapped.%' AND nth <= {BASE_WINDOWS} AND fp IN (SELECT fp FROM nth WHERE nth = {BASE_WINDOWS}) GROUP BY fp, field)"""


def rows(spark, sf_dir):
    return stored(spark, sf_dir, "drift_windows", lambda: W.window_rows(normalized(spark, sf_dir), SEEDS, COUNT_WINDOW, TIME_WINDOW))


@query(CLOSED + "SELECT fp AS fingerprint_id, wid, window_start, window_end, events_count, parsed, errors AS parse_errors FROM b")
def drift_windows(spark, sf_dir):
    return W.window_bounds(W.windows(normalized(spark, sf_dir), COUNT_WINDOW, TIME_WINDOW)).drop("match_rate", "rule_version")


@query(CLOSED + VALUES + "SELECT fp AS fingerprint_id, wid, field, nulls, violations, ipv4, ts_values, int_values, free_text FROM fs")
def drift_field_stats(spark, sf_dir):
    out = W.field_stats(W.windows(normalized(spark, sf_dir), COUNT_WINDOW, TIME_WINDOW), SEEDS)
    return out.select("fingerprint_id", "wid", "field", "nulls", "violations", "ipv4", F.col("timestamp").alias("ts_values"), F.col("int").alias("int_values"), "free_text")


@query(ROWS + "SELECT fp AS fingerprint_id, field, window_start, events_count, round(null_rate, 9) AS null_rate, round(match_rate, 9) AS match_rate, round(violation_rate, 9) AS violation_rate, severity FROM r")
def drift_rows(spark, sf_dir):
    out = rows(spark, sf_dir)
    return out.select("fingerprint_id", "field", "window_start", "events_count", *[F.round(c, 9).alias(c) for c in ("null_rate", "match_rate", "violation_rate")], "severity")


@query(BASE + "SELECT fp AS fingerprint_id, field, round(base_null, 9) AS base_null, round(base_match, 9) AS base_match, base_low, base_high, round(CASE WHEN field <> '__rule__' AND b_all > 0 AND b_ipv4 > 0 THEN b_ipv4 / b_all END, 9) AS ipv4_share FROM base")
def baseline_profiles(spark, sf_dir):
    out = W.baseline(rows(spark, sf_dir), BASE_WINDOWS)
    return out.select("fingerprint_id", "field", F.round("base_null", 9).alias("base_null"), F.round("base_match", 9).alias("base_match"), "base_low", "base_high", F.round(F.try_element_at("base_shape", F.lit("ipv4")), 9).alias("ipv4_share"))


def js_sql() -> str:
    """Divergence of the counts from the scaled shares, over the classes that either has."""
    pairs = (("ipv4", "b_ipv4"), ("ts_values", "b_ts"), ("int_values", "b_int"), ("free_text", "b_text"))
    total = "(ipv4 + ts_values + int_values + free_text)"
    has = lambda p, b: f"({p} > 0 OR {b} > 0)"
    q = lambda b: f"({b} / b_all * {total} + 1)"
    sp = " + ".join(f"CASE WHEN {has(p, b)} THEN {p} + 1.0 ELSE 0 END" for p, b in pairs)
    sq = " + ".join(f"CASE WHEN {has(p, b)} THEN {q(b)} ELSE 0 END" for p, b in pairs)
    term = lambda p, b: f"CASE WHEN {has(p, b)} THEN 0.5 * (({p} + 1.0) / sp) * ln((({p} + 1.0) / sp) / ((({p} + 1.0) / sp + {q(b)} / sq) / 2)) + 0.5 * ({q(b)} / sq) * ln(({q(b)} / sq) / ((({p} + 1.0) / sp + {q(b)} / sq) / 2)) ELSE 0 END"
    return f", j0 AS (SELECT r.*, base_null, base_match, base_low, base_high, b_ipv4, b_ts, b_int, b_text, b_all, {sp} AS sp, {sq} AS sq FROM r LEFT JOIN base USING (fp, field)), j AS (SELECT *, CASE WHEN field <> '__rule__' AND {total} > 0 AND b_all > 0 THEN {' + '.join(term(p, b) for p, b in pairs)} END AS div FROM j0)"


NULLS = "CASE WHEN null_rate IS NULL OR base_null IS NULL THEN NULL WHEN (CASE WHEN round(base_null, 6) > 0 THEN round(null_rate, 6) / round(base_null, 6) WHEN round(null_rate, 6) > 0 THEN 1e300 ELSE 1 END) < 3 OR round(round(null_rate, 6) - round(base_null, 6), 6) < 0.05 THEN 'none' WHEN round(base_null, 6) > 0 AND round(null_rate, 6) / round(base_null, 6) < 10 THEN 'minor' WHEN round(base_null, 6) > 0 AND round(null_rate, 6) / round(base_null, 6) < 40 THEN 'moderate' ELSE 'severe' END"
RANK = lambda x: f"coalesce(list_position(['none', 'minor', 'moderate', 'severe'], {x}), 1)"
FINDINGS = BASE + js_sql() + f""", first AS (SELECT fp, field FROM r WHERE (fp, window_start) IN (SELECT (fp, min(window_start)) FROM r GROUP BY fp)),
d AS (SELECT *, CASE WHEN field LIKE 'unmapped.%' THEN CASE WHEN fp IN (SELECT fp FROM base) AND (fp, field) NOT IN (SELECT (fp, field) FROM first) THEN 'minor' ELSE 'none' END WHEN field = '__rule__' THEN ['none', 'minor', 'moderate', 'severe'][greatest({RANK(BAND('round(base_match - match_rate, 6)', 0.1, 0.25, 0.5))}, {RANK("CASE WHEN base_low IS NULL THEN NULL WHEN events_count BETWEEN base_low AND base_high THEN 'none' ELSE 'minor' END")})]
 ELSE ['none', 'minor', 'moderate', 'severe'][greatest({RANK(BAND('violation_rate', 0.05, 0.2, 0.5))}, {RANK(NULLS)}, {RANK(BAND('div', 0.15, 0.35, 0.6))})] END AS decided FROM j),
a AS (SELECT *, CASE decided WHEN 'minor' THEN 'alert' WHEN 'moderate' THEN CASE WHEN field = '__rule__' THEN 'alert' ELSE 'field_quarantined' END WHEN 'severe' THEN 'rule_deactivated' END AS action FROM d)"""


def found(spark, sf_dir):
    all_rows = rows(spark, sf_dir)
    return W.findings(all_rows, W.baseline(all_rows, BASE_WINDOWS), SEEDS)


@query(FINDINGS + "SELECT fp AS fingerprint_id, field, window_start, round(div, 9) AS divergence, decided AS severity, action AS action_taken FROM a")
def drift_findings(spark, sf_dir):
    out = found(spark, sf_dir)
    return out.select("fingerprint_id", "field", "window_start", F.round("divergence", 9).alias("divergence"), "severity", "action_taken")


@query(FINDINGS + f"SELECT fp AS fingerprint_id, field, ['none', 'minor', 'moderate', 'severe'][max({RANK('decided')})] AS severity FROM a GROUP BY fp, field")
def drift_severity(spark, sf_dir):
    return W.merge_findings(found(spark, sf_dir)).drop("rule_version")


@query(ROWS + "SELECT fp AS fingerprint_id, field, window_start, severity FROM (SELECT *, row_number() OVER (PARTITION BY fp, field ORDER BY window_start DESC) AS q FROM r) WHERE q = 1")
def drift_metrics_latest(spark, sf_dir):
    return serve.drift_latest(rows(spark, sf_dir)).select("fingerprint_id", "field", "window_start", "severity")


@query(FINDINGS + ", z AS (SELECT 'drift' AS kind, window_start AS ts, fp AS fingerprint_id, field, decided AS severity FROM a WHERE decided <> 'none' UNION ALL SELECT 'audit', TIMESTAMP '2024-01-20', 'json', NULL, NULL) SELECT * FROM z ORDER BY ts DESC, kind, fingerprint_id, field NULLS FIRST LIMIT 500")
def drift_alerts(spark, sf_dir):
    audit = spark.sql("SELECT 1L AS id, TIMESTAMP '2024-01-20' AS ts, 'drift' AS actor, 'field_quarantined' AS action, 'json' AS entity UNION ALL SELECT 2L, TIMESTAMP '2024-01-21', 'ada', 'rule_approved', 'syslog'")
    return serve.alerts(found(spark, sf_dir), audit, 500).drop("action")


@query(FINDINGS + f", y AS (SELECT *, row_number() OVER (PARTITION BY fp, field ORDER BY {RANK('decided')} DESC, window_start) AS q FROM a WHERE action IS NOT NULL), x AS (SELECT *, bool_or(action = 'rule_deactivated') OVER (PARTITION BY fp) AS gone, row_number() OVER (PARTITION BY fp ORDER BY {RANK('decided')} DESC, window_start, field) AS lead FROM y WHERE q = 1) SELECT fp AS fingerprint_id, field, window_start, decided AS severity, action FROM x WHERE NOT gone OR lead = 1")
def enforcement_plan(spark, sf_dir):
    return W.enforcement_plan(found(spark, sf_dir)).drop("rule_version")


@query(FINDINGS + "SELECT DISTINCT fp AS fingerprint_id, field FROM a WHERE field LIKE 'unmapped.%' AND decided = 'minor'")
def unmapped_new_keys(spark, sf_dir):
    return found(spark, sf_dir).where(F.col("field").startswith(W.UNMAPPED) & (F.col("severity") == "minor")).select("fingerprint_id", "field").distinct()


@query(ROWS + "SELECT fp AS fingerprint_id, field, count(*) AS windows, sum(events_count) AS events FROM r WHERE field LIKE 'unmapped.%' GROUP BY fp, field")
def unmapped_opportunities(spark, sf_dir):
    return serve.unmapped_opportunities(rows(spark, sf_dir))


@query("SELECT * FROM (VALUES (0.02, 0.01, 'none'), (0.08, 0.01, 'minor'), (0.2, 0.01, 'moderate'), (0.6, 0.01, 'severe'), (0.06, 0.0, 'severe')) v(null_rate, baseline_null_rate, found)")
def severity_ladder(spark, sf_dir):
    table = spark.createDataFrame([(0.02, 0.01), (0.08, 0.01), (0.2, 0.01), (0.6, 0.01), (0.06, 0.0)], "null_rate double, baseline_null_rate double")
    return table.withColumn("found", D.null_rate_severity(F.col("null_rate"), F.col("baseline_null_rate")))
