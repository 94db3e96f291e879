"""The hot path as a stream: micro-batches of messages to tables, at least once and without doubles."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..commits import Batch, filter_of
from ..functions.extract import Rule
from ..operators.ingest import batches, chain_heads, decode, extend_chain, raw_events
from ..operators.normalize import capture_samples, dead_letters, envelopes, normalize, replaced_by
from ..schemas import bootstrap, new_rows, read, read_current, schema
from ..storage import spread
from .outbox import LETTERS, NORMALIZED
from .outbox import messages as messages_of


def process(messages: DataFrame, root: str, rules: Callable[[], Iterable[Rule]], emit: Callable[[DataFrame, DataFrame], None] | None = None, batch_rows: int = 500, key: str | None = None, outbox: bool = False) -> None:
    """One micro-batch: raw events and their chain, then normalized events and samples, in one commit.

    A batch whose key is committed already adds nothing. Ids follow from topic, partition and
    offset, and tables take only keys they don't have, so messages that come again in another
    batch add no raw or normalized rows; the chain does grow, as a record of the replay. It
    goes on from the heads that the last commit left, whatever its length. Rules are read when
    lines are parsed. A failed emit doesn't fail the batch; it leaves a row in emit_log. With
    outbox, what goes to the topics is committed with the tables, for a relay to hand on.
    """
    spark, batch = messages.sparkSession, Batch(messages.sparkSession, root, key or uuid.uuid4().hex)
    if key and batch.done():
        return
    events = raw_events(decode(spread(messages))).persist()  # a batch may come in one file
    try:
        fresh = batch.add("raw_events", new_rows(events, root, "raw_events", ["raw_id"]))
        batch.add("key_filters_raw_events", filter_of(fresh, ["raw_id"]))
        heads = read(spark, root, "chain_heads")
        chain = batch.add("raw_batches", extend_chain(batches(events, batch_rows), heads))
        batch.replace("chain_heads", chain_heads(chain.select("partition_id", "batch_seq", "merkle_root", "count", "last_offset").unionByName(heads, allowMissingColumns=True)))
        found = list(rules())
        done = normalize(events, found)
        again = done.join(fresh.select("raw_id"), "raw_id", "left_anti")
        late = bool(again.limit(1).count())
        fresh = batch.add("normalized_events", new_rows(done, root, "normalized_events", ["event_id"]))
        batch.add("key_filters_normalized_events", filter_of(fresh, ["event_id"]))
        if late:  # messages that came before, maybe under another rule: older versions give way
            batch.add("superseded", replaced_by(fresh, read_current(spark, root)))
        batch.add("onboarding_samples", capture_samples(events, found, read(spark, root, "onboarding_samples")))
        if outbox:
            sent = messages_of(envelopes(done), NORMALIZED).unionByName(messages_of(dead_letters(done), LETTERS))
            batch.add("outbox", sent.withColumn("batch", F.lit(batch.key)))
        batch.commit()
        if emit:
            try:
                emit(envelopes(done), dead_letters(done))
            except Exception as e:  # sinks are best effort: the tables are the record
                note = Batch(spark, root, f"{batch.key}-emit")
                note.add("emit_log", spark.createDataFrame([(batch.key, f"{type(e).__name__}: {e}"[:1000])], schema("emit_log")))
                note.commit()
    finally:
        events.unpersist()


def start(messages: DataFrame, root: str, checkpoint: str, rules: Callable[[], Iterable[Rule]], emit: Callable[[DataFrame, DataFrame], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Run process on each micro-batch; rules are read anew for each. Offsets live in the checkpoint, whose name tells the batches of streams apart."""
    bootstrap(messages.sparkSession, root)
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    writer = messages.writeStream.foreachBatch(lambda batch, n: process(batch, root, rules, emit, key=f"{stream}-{n}")).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def kafka_emit(servers: str) -> Callable[[DataFrame, DataFrame], None]:
    """An emit that writes to the topics of normalized events and dead letters."""

    def emit(events: DataFrame, letters: DataFrame) -> None:
        for frame, topic in ((events, "normalized.events"), (letters, "pipeline.dlq")):
            frame.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return emit


def stream_tail(spark: SparkSession, root: str, sink: str) -> StreamingQuery:
    """New normalized events into a memory table, as they are appended."""
    found = spark.readStream.schema(schema("normalized_events")).parquet(f"{root}/normalized_events")
    return found.select("event_id", "parsed_at", "fingerprint_id", "status", F.to_json("ocsf").alias("ocsf")).writeStream.format("memory").queryName(sink).outputMode("append").start()
