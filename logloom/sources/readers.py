"""Sources: corpora of lines, messages in files, Kafka and sockets, seed rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.extract import Rule, load_rules
from ..functions.fingerprint import strip
from ..operators.ingest import envelope
from ..storage import materialise

MESSAGE = "topic string, partition int, offset bigint, value string"
#: Which corpora come by datagram and which by request.
ROUTES = {"cef": "udp", "syslog": "udp", "acmegw": "udp", "newapp": "udp", "json": "http"}
REQUEST_LINES, LINE_CHARS, HINT_CHARS = 1000, 65_536, 64
#: Lines that a task of a replay orders.
REPLAY_ROWS = 200_000


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, raw): lines of UTF-8 text, stripped, blank ones left out."""
    found = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), strip(F.col("value")).alias("raw"))
    return found.where("raw <> ''")


def route(corpus: Column) -> Column:
    """udp or http for a corpus key; null for one that isn't known."""
    out = F.when(F.lit(False), F.lit(""))
    for key, transport in ROUTES.items():
        out = out.when(corpus == key, transport)
    return out


def accept_request(requests: DataFrame) -> DataFrame:
    """requests (source_id, lines, format_hint) with accepted: all lines of 1 to 65,536 characters, 1,000 at most, a short hint."""
    good = F.size("lines").between(1, REQUEST_LINES) & F.forall("lines", lambda x: F.length(x).between(1, LINE_CHARS)) & (F.coalesce(F.length("format_hint"), F.lit(0)) <= HINT_CHARS)
    return requests.withColumn("accepted", F.coalesce(good, F.lit(False)))


def request_messages(requests: DataFrame) -> DataFrame:
    """Key and envelope of each line of the accepted requests."""
    rows = accept_request(requests).where("accepted").select("source_id", F.explode("lines").alias("raw"))
    return rows.select(F.col("source_id").alias("key"), envelope(F.col("raw"), F.col("source_id"), "http").alias("value"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages that lie in files, as the topic has them."""
    return spark.read.schema(MESSAGE).parquet(path)


def stream_messages(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str = "raw.logs", per_batch: int = 500) -> DataFrame:
    """Messages from Kafka, from the earliest on; offsets live in the checkpoint. Needs the connector on the class path."""
    found = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_batch).load()
    return found.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"))


def stream_socket(spark: SparkSession, host: str, port: int, transport: str = "tcp") -> DataFrame:
    """Envelopes of lines from a socket; trailing line ends go, lines that are empty or too long too."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load().select(F.regexp_replace("value", r"[\r\n]+$", "").alias("raw"))
    good = lines.where(F.length("raw").between(1, LINE_CHARS))
    return good.select(envelope(F.col("raw"), F.lit(f"{transport}-{host}"), transport).alias("value"))


def replay(corpora: DataFrame, copies: int = 1, rows_a_part: int = REPLAY_ROWS) -> DataFrame:
    """Corpus lines as messages of a simulator, in turn: topic, partition, offset and envelope.

    An offset is a line's place among those of its partition, by copy, corpus and text. Lines are
    numbered once, in ranges of the order of about rows_a_part, also where very many are alike;
    what lies before a range is a sum of counts. So no task orders a whole partition.
    """
    rows = corpora.select("corpus", "raw", F.pmod(F.xxhash64("corpus"), F.lit(6)).cast("int").alias("partition")).withColumn("nth", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("partition", "corpus", "raw", "nth")]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-corpora.count() // rows_a_part))
    placed = materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("partition", "corpus", "raw", F.monotonically_increasing_id().alias("at")), "replayed")
    ranges = placed.groupBy("partition", F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("partition")  # one row a range
    before = F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = ranges.select("partition", "range", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    numbered = placed.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(known), ["partition", "range"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    offset = F.col("copy") * F.col("size") + F.col("at") + F.col("shift")
    return numbered.select(F.lit("raw.logs").alias("topic"), "partition", offset.cast("long").alias("offset"), envelope(F.col("raw"), F.concat(F.lit("sim-"), F.col("corpus")), "udp").alias("value"))


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Seed rules from JSON files, read by Spark so that any store will do; all of them are good, or an error."""
    texts: Iterable = spark.read.text(path, wholetext=True).collect()  # a few rules, each within the pattern caps
    rules = [r for t in texts for r in load_rules(t.value)]
    if len({(r.fingerprint_id, r.version) for r in rules}) < len(rules):
        raise ValueError("seed rules name a fingerprint and version twice")
    return rules
