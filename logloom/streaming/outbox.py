"""An outbox: messages for topics, committed with the tables they follow from, handed on by a relay.

What a batch says to the outside stands in the same commit as its rows, so neither can be seen
without the other, and a batch that comes again says nothing new. A relay hands on what has
been committed and notes how far it came; a broker that fails leaves a row in emit_log, and the
relay goes on from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..commits import Batch, commit_log, opened
from ..schemas import bootstrap, schema

NORMALIZED, LETTERS, RAW = "normalized.events", "pipeline.dlq", "raw.logs"
PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.NullType)


def check_wire(kind: T.DataType, name: str = "value") -> None:
    """A TypeError for a type that has no agreed form in JSON."""
    if isinstance(kind, T.StructType):
        for f in kind:
            check_wire(f.dataType, f"{name}.{f.name}")
    elif isinstance(kind, T.ArrayType):
        check_wire(kind.elementType, f"{name}[]")
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError(f"{name} has keys of type {kind.keyType.simpleString()}")
        check_wire(kind.valueType, f"{name}{{}}")
    elif not isinstance(kind, PLAIN):
        raise TypeError(f"{name} of type {kind.simpleString()} has no form in JSON")


def wire(df: DataFrame, *columns: str) -> Column:
    """The columns of df as JSON text, nulls written; a type without an agreed form is a TypeError before anything runs."""
    for f in df.select(*columns).schema:
        check_wire(f.dataType, f.name)
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def messages(frame: DataFrame, topic: str) -> DataFrame:
    """(topic, key, value) of a frame with value and maybe key."""
    key = F.col("key") if "key" in frame.columns else F.lit(None)
    return frame.select(F.lit(topic).alias("topic"), key.cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def to_outbox(frame: DataFrame, root: str, topic: str, key: str) -> bool:
    """Commit the messages of a batch of its own; one with a key that is known already adds nothing. Returns whether it was new."""
    batch = Batch(frame.sparkSession, root, key)
    if batch.done():
        return False
    batch.add("outbox", messages(frame, topic).withColumn("batch", F.lit(key)))
    batch.commit()
    return True


def sink(stream: DataFrame, root: str, topic: str, checkpoint: str) -> StreamingQuery:
    """A stream of (key, value) into the outbox, a commit a micro-batch."""
    bootstrap(stream.sparkSession, root)
    name = f"{topic}-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"
    return stream.writeStream.foreachBatch(lambda batch, n: None if to_outbox(batch, root, topic, f"{name}-{n}") else None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def relay(spark: SparkSession, root: str, send: Callable[[DataFrame], None]) -> int:
    """Hand each committed part of the outbox to send, one at a time; returns how many went.

    A part that went is noted, so it isn't sent twice unless the relay dies between the two: at
    least once. One that fails is recorded and ends the run, as messages keep their order.
    """
    sent = {r.batch for r in commit_log(spark, root).where("name = 'relayed'").select("batch").collect()}
    parts = commit_log(spark, root).where("name = 'outbox' AND NOT dropped").orderBy("batch", "path").collect()  # one row a part
    done = 0
    for part in parts:
        key = f"relay-{part.path.rsplit('=', 1)[-1]}"
        if key in sent:
            continue
        note = Batch(spark, root, key)
        try:
            send(opened(spark, root, "outbox", [f"{root}/{part.path}"]))
        except Exception as e:
            failed = Batch(spark, root, f"{key}-failed")
            failed.add("emit_log", spark.createDataFrame([(part.batch, f"{type(e).__name__}: {e}"[:1000])], schema("emit_log")))
            failed.commit()
            return done
        note.rows.append((key, "relayed", part.path, None, False))
        note.commit()
        done += 1
    return done

