"""Fingerprints, extraction, ids and drift arithmetic against hand-made facts."""

import hashlib
import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from logloom.functions import drift as D
from logloom.functions.extract import SEEDS, Rule, flatten_json, key_values, last_values, load_rules, parse, pattern_errors, rule_errors, translate
from logloom.functions.fingerprint import fingerprint_id, shape_sequence
from logloom.functions.ids import NAMESPACE, merkle_root, raw_id
from logloom.functions.mutate import corrupt_syslog, drift_phase, mutate


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(*columns).first()


LINES = {
    "CEF:0|Palo Alto|Fw|1|9|x|5|src=1.2.3.4": "cef_paloalto",
    "CEF:0": "cef",
    "CEF:0||x": "cef",
    "LEEF:1.0|Acme-7|x|": "leef_acme7",
    ' {"a": 1} ': "json",
    "{not json}": None,
    "Jan 12 01:02:03 host app: hello": "syslog",
    "<13>anything": "syslog",
    "a,b,c,1,2,3": "csv",
    '"x y",b,c': "csv",
    "a,b c,d": None,
    "<event><src>1.2.3.4</src></event>": "xml",
    "<a>1,2</a><b>3,4</b>": "xml",
    "": None,
}


def test_formats(spark):
    rows = spark.createDataFrame([(k,) for k in LINES], "raw string").select("raw", fingerprint_id(F.col("raw")).alias("f")).collect()
    for r in rows:
        assert r.f == LINES[r.raw] if LINES[r.raw] else r.f.startswith("auto_"), r


def test_hostile_lines_do_not_crash(spark):
    hostile = ["<a>" * 20_000, "a=" * 1200, '{"a":' * 2000 + "1" + "}" * 2000, "a" * 32_000 + "="]
    rows = spark.createDataFrame([(k,) for k in hostile], "raw string").select(fingerprint_id(F.col("raw")).alias("f"), parse(F.col("raw"), SEEDS[0])["error"].alias("e")).collect()
    assert all(r.f for r in rows)


def shape(spark, line):
    return one(spark, shape_sequence(F.col("raw")).alias("s"), raw=line).s


def test_shapes(spark):
    assert shape(spark, "10.0.0.1:80 10.0.0.1 facade 12 hello there 2024-01-02T03 k= a=b=7") == ["IPPORT", "IP", "HEXISH", "N", "W", "ISOTS", "KV:W", "KV:KV:N"]
    assert shape(spark, "x|y|12;3,z") == ["W", "N", "N", "W"]
    text = "|".join(shape(spark, "x|12"))
    assert one(spark, fingerprint_id(F.col("raw")).alias("f"), raw="x|12").f == "auto_" + hashlib.sha256(text.encode()).hexdigest()[:8]


def test_ids_are_version_five(spark):
    got = one(spark, raw_id(F.lit("raw.logs"), F.lit(3), F.lit(7)).alias("i")).i
    assert got == str(uuid.uuid5(uuid.UUID(NAMESPACE), "raw.logs:3:7"))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 33])
def test_merkle(spark, n):
    level = leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    while len(level) > 1:
        level = [hashlib.sha256(bytes.fromhex(level[i]) + bytes.fromhex(level[min(i + 1, len(level) - 1)])).hexdigest() for i in range(0, len(level), 2)]
    assert spark.createDataFrame([(leaves,)], "l array<string>").select(merkle_root(F.col("l")).alias("r")).first().r == level[0]


def test_key_values(spark):
    got = one(spark, last_values(key_values(F.col("t"))).alias("m"), t='src=1.2.3.4 msg="a b" act=drop it now cat= x=1 x=2').m
    assert got == {"src": "1.2.3.4", "msg": "a b", "act": "drop it now", "x": "2"}


def test_parse_rules(spark):
    line = "CEF:0|V|P|1|9|n|5|src=10.1.2.3 dst=10.0.0.9 spt=51422 dpt=443 act=block cat=spyware msg=Suspicious DNS Query"
    doc = one(spark, parse(F.col("raw"), SEEDS[0]).alias("p"), raw=line).p.doc
    assert (doc.src_endpoint.port, doc.dst_endpoint.port, doc.action, doc.message, doc.unmapped) == (51422, 443, "block", "Suspicious DNS Query", {"cat": "spyware"})
    js = next(r for r in SEEDS if r.fingerprint_id == "json")
    doc = one(spark, parse(F.col("raw"), js).alias("p"), raw=json.dumps({"src_ip": "1.1.1.1", "src_port": {"oops": 1}, "alert": {"severity": "high", "extra": {"k": [1]}}, "nul": None})).p.doc
    assert doc.src_endpoint.port is None and doc.src_endpoint.port_raw is None and doc.severity_id is None and doc.dst_endpoint is None
    assert doc.unmapped == {"alert.extra.k": "[1]", "nul": None, "src_port.oops": "1"}
    assert one(spark, parse(F.col("raw"), js).alias("p"), raw="[1]").p.error
    quarantined = Rule("x", 1, SEEDS[0].pattern, SEEDS[0].mappings, quarantined=("action",))
    doc = one(spark, parse(F.col("raw"), quarantined).alias("p"), raw=line).p.doc
    assert doc.action is None and doc.unmapped["act"] == "block"
    assert one(spark, flatten_json(F.col("t")).alias("m"), t='{"a":{"b":{"c":1}},"d":null}').m == {"a.b.c": "1", "d": None}


def test_caps_and_translation():
    assert pattern_errors("(" * 33 + ")" * 33) and pattern_errors("x" * 1001) and not pattern_errors(r"\((a)")
    assert rule_errors(Rule("x", 1, "(", ())) and rule_errors(Rule("x", 1, "a", (("a", "metadata.product"),)))
    assert translate(r"(?P<a>x)(y)(?P=a)").pattern.endswith(r"(x)(y)(?:\1)") and list(translate(r"(?P<a>x)?").witnesses) == ["a"]
    with pytest.raises(ValueError):
        load_rules(json.dumps([{"fingerprint_id": "a", "pattern": "x", "mappings": []}] * 2))


def test_ladders(spark):
    f = lambda c: one(spark, c.alias("x")).x
    lit = F.lit
    cases = [(0.02, 0.01, "none"), (0.08, 0.01, "minor"), (0.2, 0.01, "moderate"), (0.6, 0.01, "severe"), (0.06, 0.0, "severe"), (0.04, 0.0, "none"), (0.0, 0.0, "none")]
    for now, base, want in cases:
        assert f(D.null_rate_severity(lit(now), lit(base))) == want
    assert [f(D.match_rate_severity(lit(x), lit(1.0))) for x in (0.91, 0.9, 0.75, 0.5)] == ["none", "minor", "moderate", "severe"]
    assert [f(D.shape_severity(lit(x))) for x in (0.149, 0.15, 0.35, 0.6)] == ["none", "minor", "moderate", "severe"]
    assert [f(D.tier1_severity(lit(x))) for x in (0.049, 0.05, 0.2, 0.5)] == ["none", "minor", "moderate", "severe"]
    assert [f(D.volume_severity(lit(n), lit(10), lit(14))) for n in (0, 9, 10, 14, 15)] == ["severe", "minor", "none", "none", "minor"]
    m = lambda d: F.create_map(*[lit(x) for p in d.items() for x in p])
    assert f(D.js_divergence(m({"a": 5.0}), m({"a": 5.0}))) == 0
    assert f(D.js_divergence(m({"a": 20.0}), m({"b": 20.0}))) == pytest.approx(math.log(2) + 21 / 22 * math.log(21 / 22) + 1 / 22 * math.log(1 / 22))
    assert [f(D.classify_value(lit(x))) for x in ("1.2.3.4", "2024-01-02T0", "77", "x")] == ["ipv4", "timestamp", "int", "free_text"]


def test_mutants_keep_the_shape(spark):
    lines = ["Jan 12 01:02:03 fw01 kernel: IPTABLES-DROP: SRC=1.2.3.4 SPT=55", "ACMEX|v3|2024-01-02T03:04:05Z|source=1.2.3.4:80"]
    rows = spark.createDataFrame([(x, i) for x in lines for i in range(20)], "raw string, seed int")
    assert rows.where(fingerprint_id(F.col("raw"), False) != fingerprint_id(mutate(F.col("raw"), F.col("seed")), False)).count() == 0


def test_corruption(spark):
    rows = spark.range(1000).select("id", corrupt_syslog(F.lit("a SRC=1.2.3.4 b"), F.col("id"), F.lit(0.25)).alias("x"))
    assert rows.where("x <> 'a SRC=1.2.3.4 b'").count() == 250
    assert rows.where("x LIKE '%SRCADDR=1.2.3.4%'").where("id % 3 <> 0").count() == 0
    assert one(spark, drift_phase(F.lit(5.0), F.lit(10.0)).alias("p")).p == 0.5
