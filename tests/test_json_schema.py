"""The schema compiler on documents with one fault each, and what it refuses to compile."""

import json

import pytest
from logloom.functions.json_schema import compile_schema
from logloom.operators.normalize import document_errors
from logloom.operators.normalize import canary
from logloom.schemas import DOCUMENT_RULE, DOCUMENT, NETWORK_RULE
from pyspark.sql import functions as F


def found(spark, schema, *values):
    rows = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in enumerate(values)], "k int, t string")
    return [r.e for r in rows.select("k", compile_schema(schema)(F.try_parse_json("t")).alias("e")).orderBy("k").collect()]


def test_types(spark):
    values = [{}, [], "\"x\"", 1, 1.5, 2.0, True, None]
    fits = {"object": [0], "array": [1], "string": [2], "integer": [3, 5], "number": [3, 4, 5], "boolean": [6], "null": [7]}
    for name, good in fits.items():
        assert [not e for e in found(spark, {"type": name}, *values)] == [k in good for k in range(len(values))], name
    assert [not e for e in found(spark, {"type": ["string", "null"]}, *values)] == [k in (2, 7) for k in range(len(values))]


def test_keywords(spark):
    schema = {"properties": {"a": {"const": 1}, "b": {"enum": ["x", None, 2]}, "c": {"minimum": 0, "maximum": 9.5}, "d": {"minLength": 2, "maxLength": 3, "pattern": "^a"}, "e": {"items": {"type": "integer"}}}, "required": ["a"], "additionalProperties": {"type": "boolean"}}
    good = {"a": 1.0, "b": None, "c": 9.5, "d": "abc", "e": [1, 2], "other": True}
    bad = {"b": "y", "c": 10, "d": "b", "e": [1, "x"], "other": 3}
    assert found(spark, schema, good, {"a": 1, "c": "text", "d": 5, "e": {}}, bad) == [[], [], ["$.a is missing", '$.b is none of ["x", null, 2]', "$.c is greater than 9.5", "$.d is shorter than 2", "$.d does not match ^a", "$.e[1] is not of type integer", "$.other is not of type boolean"]]
    assert found(spark, {"const": {"b": [1], "a": None}}, {"a": None, "b": [1]}, {"a": 1}) == [[], ['$ is not {"b": [1], "a": null}']]
    assert found(spark, {"properties": {"x": False}}, {"x": 1}, "no JSON") == [["$.x is not allowed"], ["$ is no JSON"]]
    assert found(spark, {"const": True}, True, 1, "true") == [[], ["$ is not true"], []] and found(spark, {"const": 1}, True) == [["$ is not 1"]]


@pytest.mark.parametrize("schema", [{"oneOf": []}, {"type": "text"}, {"properties": {"a": {"$ref": "#"}}}])
def test_what_is_not_known_is_refused(schema):
    with pytest.raises(ValueError):
        compile_schema(schema)


def test_documents_of_the_engine(spark):
    side = {"ip": "1.2.3.4", "port": 70_000, "port_raw": None}
    doc = {"class_uid": 4001, "class_name": "Network Activity", "activity_id": 99, "severity_id": 7, "time": None, "src_endpoint": side, "dst_endpoint": {"ip": None, "port": None, "port_raw": "http"}, "action": None, "message": "m", "metadata": {"product": "logloom"}, "unmapped": {"k": None}}
    wrong = {**doc, "severity_id": 150, "class_uid": 1, "unmapped": None, "metadata": None}
    got = [r.e for r in spark.createDataFrame([(doc,), (wrong,)], f"d {DOCUMENT}").select(document_errors(F.col("d"), DOCUMENT_RULE).alias("e")).collect()]
    assert got == [[], ["$.class_uid is not 4001", "$.severity_id is greater than 99", "$.metadata is not of type object", "$.unmapped is not of type object"]]


def test_limits_of_network_events(spark):
    """Severity 7 and port 70,000 pass the schema and break the limits; a port that is a name breaks none (F3, F4)."""
    side = {"ip": "1.2.3.4", "port": 70_000, "port_raw": None}
    doc = {"class_uid": 4001, "class_name": "Network Activity", "activity_id": 99, "severity_id": 7, "time": None, "src_endpoint": side, "dst_endpoint": {"ip": None, "port": None, "port_raw": "http"}, "action": None, "message": "m", "metadata": {"product": "logloom"}, "unmapped": {"k": None}}
    rows = spark.createDataFrame([("00", "parsed", doc), ("64", "parsed", {**doc, "severity_id": 6, "src_endpoint": None})], f"event_id string, status string, ocsf {DOCUMENT}")
    got = [r.e for r in rows.orderBy("event_id").select(document_errors(F.col("ocsf"), NETWORK_RULE).alias("e")).collect()]
    assert got == [["$.severity_id is greater than 6", "$.src_endpoint.port is greater than 65535"], []]
    assert canary(rows, rule=NETWORK_RULE).first()[:] == (2, 1) and canary(rows).first()[:] == (2, 0)
