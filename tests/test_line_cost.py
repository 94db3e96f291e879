"""What a line costs: steps that are done once for it, and that they find the same."""

import re

from logloom.functions.extract import JSON_RULE, Rule, key_values, parse
from logloom.functions.fingerprint import BLANKS, SPACES, strip
from logloom.functions.mutate import VARIABLE
from logloom.operators import legacy
from logloom.plans.lines import LINES, lines
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_lines_compile_to_short_methods(spark):
    """The JVM never compiles a method of over 8,000 bytes (F16, F17, F19, F21 to F23); the lines are those of the SQL."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan isn't settled yet
    found = lines(spark, SF)
    plan = found._jdf.queryExecution().executedPlan()
    parts = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) < 8_000
    plain = spark.sql(LINES.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{SF}/events.parquet"))
    assert found.columns == plain.columns and found.count() == plain.count() and not found.exceptAll(plain).count()


def test_blanks_are_those_of_the_pattern(spark):
    rows = spark.createDataFrame([(chr(c),) for c in range(0x10000) if not 0xD800 <= c < 0xE000], "c string")
    wide = {r.c for r in rows.where(F.col("c").rlike(r"(?U)^\s\z")).collect()}
    assert wide == set(SPACES) and set(BLANKS) == wide | set("\x1c\x1d\x1e\x1f")
    texts = spark.createDataFrame([("\u3000\x1f a\u00a0b \r\n",), ("a",), ("é ",), ("\t",), ("",), (None,)], "t string")
    assert [r.s for r in texts.select(strip(F.col("t")).alias("s")).collect()] == ["a\u00a0b", "a", "é", "", "", None]


def test_pairs_are_searched_once(spark):
    rows = spark.createDataFrame([('a="x = y" b= " z" c="open d="" e=" s "  f=" g=1=2 h=\u00a0v\u2003',)], "t string")
    found = rows.select(key_values(F.col("t")).alias("p"))
    part = lambda k: F.regexp_extract_all("t", F.lit(r'(\w+)=("[^"]*"|[^= ]*)'), F.lit(k))
    got = {p.key: p.value for p in found.first().p}
    assert got["a"] == "x = y" and got["b"] == '" z"' and got["h"] == "v" and len(rows.select(part(1).alias("k")).first().k) > 5
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_members_of_objects(spark):
    """Paths are looked up in the members, also where a key has an apostrophe; what get_json_object writes anew is asked of it."""
    rule = Rule("j", 1, JSON_RULE, (("o.it's", "message"), ("o.n", "severity_id"), ("p.n", "action"), ("x", "src_endpoint.ip"), ("l", "time")))
    rows = spark.createDataFrame([(1, '{"o":{"it\'s":"a","n":3},"p":{"n":1.50},"x":"1.50","l":[1, 2]}'), (2, '{"o":"{\\"n\\":3}","p":[{"n":1}],"x":null}')], "i int, t string")
    docs = {r.i: r.d for r in rows.select("i", parse(F.col("t"), rule)["doc"].alias("d")).collect()}
    first, second = docs[1], docs[2]
    wanted = rows.where("i = 1").select(F.get_json_object("t", "$.p.n").alias("n"), F.get_json_object("t", "$.l").alias("l")).first()
    assert (first.message, first.severity_id, first.action, first.time, first.unmapped) == ("a", 3, wanted.n, wanted.l, {})
    assert second.severity_id is None and second.action is None and second.src_endpoint is None and second.unmapped == {"o": '{"n":3}', "p": '[{"n":1}]', "x": None}


def test_most_characters_meet_no_class():
    """classes are tried only where their first character fits."""
    assert re.search(r"\(\?=\\d\)\(\?:", VARIABLE.pattern) and [m.lastgroup for m in VARIABLE.finditer('Jan  2 03:04:05 host3 a=7 10.1.2.3:80 2024-01-02T03:04:05Z ":5 Ab1')] == ["gap", "name", "count", "address", "port", "zone", "count"]


def test_passes_read_marked_lines(spark, tmp_path):
    """lines are fingerprinted once; the passes read what was found."""
    store = legacy.RuleStore(str(tmp_path / "rules.json"))
    rows = spark.createDataFrame([('{"src_ip":"10.0.0.1"}',), ("nothing",)], "raw string")
    found = legacy.three_passes(rows, store)
    assert any("/marked-" in f for f in found.inputFiles())
    assert {r.fingerprint_id: (r.lines, r.ok) for r in found.collect()} == {"json": (1, 1), "unknown": (1, 0)}
