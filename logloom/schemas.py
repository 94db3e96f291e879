"""Schemas of the tables and their bootstrap."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise

ENDPOINT = "struct<ip:string,port:bigint,port_raw:string>"
DOCUMENT = f"struct<class_uid:int,class_name:string,activity_id:int,severity_id:bigint,time:string,src_endpoint:{ENDPOINT},dst_endpoint:{ENDPOINT},action:string,message:string,metadata:struct<product:string>,unmapped:map<string,string>>"
ENVELOPE = "source_id string, transport string, received_at string, raw string, format_hint string"
TABLES = {
    "raw_events": "raw_id string, received_at timestamp, source_id string, transport string, format_hint string, fingerprint_id string, content_hash string, raw_text string, day date",
    "raw_batches": "partition_id int, batch_seq bigint, prev_hash string, merkle_root string, row_hashes array<string>, count bigint, first_offset bigint, last_offset bigint",
    "normalized_events": f"event_id string, raw_id string, raw_received_at timestamp, parsed_at timestamp, fingerprint_id string, rule_version int, status string, ocsf {DOCUMENT}, error string, day date",
    "commits": "batch string, name string, path string, days array<date>, dropped boolean",
    "chain_heads": "partition_id int, batch_seq bigint, merkle_root string",
    "key_filters_raw_events": "day date, block bigint, bits binary",
    "key_filters_normalized_events": "day date, block bigint, bits binary",
    "superseded": "day date, event_id string, superseded_by_event_id string",
    "outbox": "topic string, key string, value string, batch string",
    "emit_log": "batch string, error string",
    "rules": "fingerprint_id string, version int, pattern string, mappings array<struct<source_field:string,ocsf_path:string>>, provenance string, confidence double, status string, quarantined_fields array<string>",
    "rule_log": "seq bigint, ts timestamp, fingerprint_id string, version int, status string, actor string, action string",
    "audit_log": "id bigint, ts timestamp, actor string, action string, entity string, detail string",
    "onboarding_samples": "fingerprint_id string, raw_id string, raw_text string, captured_at timestamp",
    "onboarding_attempts": "fingerprint_id string, samples_seen int, attempted_at timestamp, error string",
    "drift_windows": "fingerprint_id string, rule_version int, field string, window_start timestamp, window_end timestamp, events_count bigint, null_rate double, match_rate double, violation_rate double, shape_dist map<string,bigint>, severity string, action_taken string",
    "baseline_profiles": "fingerprint_id string, rule_version int, field string, base_null double, base_match double, base_low bigint, base_high bigint, base_shape map<string,double>, windows_seen int",
}
#: What a document must be, as JSON Schema.
_ENDPOINT_RULE = {"type": ["object", "null"], "properties": {"ip": {"type": "string"}, "port": {"type": ["integer", "string"]}}}
DOCUMENT_RULE = {
    "type": "object", "additionalProperties": False, "required": ["class_uid", "activity_id", "time", "metadata", "unmapped"],
    "properties": {
        "class_uid": {"const": 4001}, "class_name": {"const": "Network Activity"}, "activity_id": {"type": "integer", "minimum": 0, "maximum": 99}, "severity_id": {"type": ["integer", "null"], "minimum": 0, "maximum": 99},
        "time": {"type": ["string", "null"]}, "action": {"type": ["string", "null"]}, "message": {"type": ["string", "null"]}, "src_endpoint": _ENDPOINT_RULE, "dst_endpoint": _ENDPOINT_RULE,
        "metadata": {"type": "object", "properties": {"product": {"const": "logloom"}}, "required": ["product"]}, "unmapped": {"type": "object", "additionalProperties": True},
    },
}
_NETWORK_ENDPOINT = {**_ENDPOINT_RULE, "properties": {**_ENDPOINT_RULE["properties"], "port": {**_ENDPOINT_RULE["properties"]["port"], "minimum": 0, "maximum": 65_535}}}
#: The same with the limits that values of a network event have: severities up to 6, numbers of ports up to 65,535.
NETWORK_RULE = {**DOCUMENT_RULE, "properties": {**DOCUMENT_RULE["properties"], "severity_id": {"type": ["integer", "null"], "minimum": 0, "maximum": 6}, "src_endpoint": _NETWORK_ENDPOINT, "dst_endpoint": _NETWORK_ENDPOINT}}
#: Tables partitioned by day: readers with a predicate on it open those days alone.
DAILY = ("raw_events", "normalized_events", "superseded", "key_filters_raw_events", "key_filters_normalized_events")


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(TABLES[table])


def bootstrap(spark: SparkSession, root: str) -> None:
    """Create each table that isn't there yet, empty; running it again changes nothing."""
    for name in TABLES:
        try:
            spark.read.schema(schema(name)).parquet(f"{root}/{name}").schema  # noqa: B018
            continue
        except Exception as e:  # only a path that doesn't exist is created
            if "PATH_NOT_FOUND" not in str(e):
                raise
        empty = spark.createDataFrame([], schema(name))
        writer = empty.write.partitionBy("day") if name in DAILY else empty.write
        writer.parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str, days: list[date] | None = None) -> DataFrame:
    """A table: the rows appended to it and those of committed batches. days: of a daily table only parts with rows of these days are opened."""
    from .commits import read_parts

    found = spark.read.schema(schema(name)).parquet(f"{root}/{name}")
    if name == "commits":
        return found
    parts = read_parts(spark, root, name, days)
    found = found if parts is None else found.unionByName(parts)
    return found if days is None else found.where(F.col("day").isin(days))


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The normalized events that no later one has superseded, by the delta that is kept with them."""
    from .operators.normalize import current_view

    return current_view(read(spark, root, "normalized_events"), read(spark, root, "superseded"))


def new_rows(df: DataFrame, root: str, name: str, key: list[str]) -> DataFrame:
    """The rows of df whose key isn't in the table; repeated keys of df count once.

    In a table partitioned by day the key is looked for in the days of df alone, as ids follow
    from a message, whose time of receipt doesn't change; and there only if the filters of these
    days may hold it.
    """
    from .commits import split_known

    spark = df.sparkSession
    if name not in DAILY:
        return df.dropDuplicates(key).join(read(spark, root, name).select(*key), key, "left_anti")
    days = [r.day for r in df.select("day").distinct().collect()]
    return split_known(df, key, read(spark, root, f"key_filters_{name}", days), read(spark, root, name, days))


def append_new(df: DataFrame, root: str, name: str, key: list[str]) -> DataFrame:
    """Append the rows of df whose key isn't in the table; returns them. They are found once and kept beside the table for both writes.

    The filters come first: a filter may hold keys that the table lacks, never the other way round.
    """
    from .commits import filter_of

    fresh = materialise(new_rows(df, root, name, key).select(*[f.name for f in schema(name)]), f"fresh/{name}")
    if name in DAILY:
        filter_of(fresh, key).write.mode("append").option("compression", "zstd").partitionBy("day").parquet(f"{root}/key_filters_{name}")
    writer = fresh.write.mode("append").partitionBy("day") if name in DAILY else fresh.write.mode("append")
    writer.parquet(f"{root}/{name}")
    return fresh
