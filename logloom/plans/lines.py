"""Log lines derived from the events table, by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import raw_events
from ..storage import spread


def _two(part: str) -> str:
    return f"lpad(CAST({part} AS STRING), 2, '0')"


CLOCK = f"{_two('hour(ts)')}, ':', {_two('minute(ts)')}, ':', {_two('second(ts)')}"
ISO = f"CAST(year(ts) AS STRING), '-', {_two('month(ts)')}, '-', {_two('day(ts)')}, 'T', {CLOCK}, 'Z'"
SRC = "'10.', CAST(user_id % 200 AS STRING), '.', CAST(event_id % 250 AS STRING), '.', CAST(event_id % 99 AS STRING)"
DST = "'192.168.', CAST(event_id % 16 AS STRING), '.', CAST(user_id % 254 AS STRING)"
DPT = "CASE WHEN event_id % 13 = 0 THEN 'http' ELSE CAST(event_id % 1024 AS STRING) END"
SPT = "CAST(1024 + event_id % 50000 AS STRING)"
VENDOR = "CASE event_id % 15 WHEN 0 THEN 'Palo Alto' WHEN 5 THEN 'Cisco ASA' ELSE 'Fortigate' END"
CEF = f"""concat('CEF:0|', {VENDOR}, '|Wall|1.0|', CAST(100 + event_id % 9 AS STRING), '|traffic|', CAST(event_id % 10 AS STRING), '|',
  CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('src=', {SRC}, ' ') END, 'dst=', {DST}, ' spt=', {SPT}, ' dpt=', {DPT},
  ' act=', event_type, CASE WHEN event_id % 4 = 0 THEN ' cat=web' ELSE '' END, CASE WHEN day(ts) > 20 AND event_id % 3 = 0 THEN ' zone=dmz' ELSE '' END, ' msg=session closed by peer')"""
LEEF = f"concat('LEEF:1.0|Acme|Guard|2|', event_type, '|usrName=u', CAST(user_id AS STRING), ' src=', {SRC})"
JSON = f"""concat('{{"timestamp":"', {ISO}, '","event_type":"', event_type, '",', CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('"src_ip":"', {SRC}, '",') END,
  '"src_port":', {SPT}, ',"dest_ip":"', {DST}, '","dest_port":', CASE WHEN event_id % 13 = 0 THEN '"http"' ELSE CAST(event_id % 1024 AS STRING) END,
  ',"flow_id":', CAST(event_id % 7 AS STRING), ',"alert":{{"signature":"sig ', CAST(event_id % 30 AS STRING), '","severity":', CAST(event_id % 9 AS STRING), '}}}}')"""
SYSLOG = f"""concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(ts) * 3 - 2 AS INT), 3), ' ', {_two('day(ts)')}, ' ', {CLOCK}, ' host', CAST(user_id % 5 AS STRING),
  CASE WHEN event_id % 19 = 0 THEN ' sshd: session opened' ELSE concat(' kernel: IPTABLES-DROP: IN=eth0 OUT= ', CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('SRC=', {SRC}, ' ') END,
  'DST=', {DST}, ' LEN=', CAST(40 + event_id % 1400 AS STRING), ' PROTO=TCP SPT=', {SPT}, ' DPT=', {DPT}) END)"""
PIPES = f"concat('ACMEX|v3|', {ISO}, '|type:', event_type, '|source=', {SRC}, ':', {SPT}, '|proto=tcp|sev=', CAST(event_id % 5 AS STRING))"
#: event_id % 5 chooses the format; every 17th row omits its source, every 13th has a port that is no number, every 19th matches no pattern (syslog).
LINES = f"""SELECT event_id AS eid, CAST(event_id % 6 AS INT) AS partition_id, CAST(floor(event_id / 6.0) AS BIGINT) AS pos, ts AS received_at, user_id,
CASE event_id % 5 WHEN 0 THEN {CEF} WHEN 1 THEN {LEEF} WHEN 2 THEN {JSON} WHEN 3 THEN {SYSLOG} ELSE {PIPES} END AS raw FROM events"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(eid, partition_id, pos, received_at, user_id, raw); only the four columns used are read."""
    return spark.sql(shared_parts(LINES).replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=spread(spark.read.parquet(f"{sf_dir}/events.parquet")))


def shared_parts(sql: str) -> str:
    """sql with the parts that several formats share worked out once a row: else the generated method is longer than what the JVM compiles (8,000 bytes)."""
    parts = {"iso_text": ISO, "clock_text": CLOCK, "src_text": SRC, "dst_text": DST, "spt_text": SPT}
    made = ", ".join(f"concat({part}) AS {name}" for name, part in parts.items())
    for name, part in parts.items():
        sql = sql.replace(part, name)
    return sql.replace("FROM events", f"FROM (SELECT *, {made} FROM events)")


def derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as raw events. No line opens with <, so XML isn't probed and the plan stays native."""
    messages = lines(spark, sf_dir).select(F.lit("raw.logs").alias("topic"), F.col("partition_id").alias("partition"), F.col("pos").alias("offset"), F.concat_ws("-", F.lit("src"), F.col("user_id").cast("string")).alias("source_id"), F.lit("udp").alias("transport"), "received_at", F.lit(None).cast("string").alias("format_hint"), "raw")
    return raw_events(messages, xml=False)
