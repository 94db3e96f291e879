"""Ingest: envelopes to raw events, ids and hashes, hash-chained batches and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import LINE_CAP
from ..functions.fingerprint import fingerprint_id
from ..functions.ids import GENESIS, content_hash, merkle_root, merkle_subtree, raw_id
from ..schemas import ENVELOPE


def envelope(raw: Column, source: Column, transport: str, received_at: Column | None = None) -> Column:
    """An envelope as JSON text, as collectors send it."""
    at = F.current_timestamp() if received_at is None else received_at
    return F.to_json(F.struct(source.alias("source_id"), F.lit(transport).alias("transport"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("received_at"), raw.alias("raw")))


def decode(messages: DataFrame) -> DataFrame:
    """Messages (topic, partition, offset, value) with usable envelopes, decoded; poison rows are left out.

    Usable: JSON, all required keys, a raw of 1 to 65,536 characters, a readable received_at.
    """
    found = messages.select("topic", "partition", "offset", F.from_json("value", ENVELOPE).alias("e")).select("topic", "partition", "offset", "e.*")
    found = found.withColumn("received_at", F.col("received_at").try_cast("timestamp"))
    return found.where(F.col("source_id").isNotNull() & F.col("transport").isNotNull() & F.col("received_at").isNotNull() & F.length("raw").between(1, LINE_CAP) & (F.coalesce(F.length("format_hint"), F.lit(0)) <= 64))


def raw_events(decoded: DataFrame, xml: bool = True) -> DataFrame:
    """Ids, content hash and fingerprint of decoded messages, in the schema of raw_events and with partition and offset."""
    return decoded.select(
        raw_id(F.col("topic"), F.col("partition"), F.col("offset")).alias("raw_id"), "received_at", "source_id", "transport", "format_hint",
        fingerprint_id(F.col("raw"), xml).alias("fingerprint_id"), content_hash(F.col("raw")).alias("content_hash"), F.col("raw").alias("raw_text"), F.to_date("received_at").alias("day"), "partition", "offset",
    )


def batches(events: DataFrame, size: int = 500) -> DataFrame:
    """One row a partition and batch of size offsets: ordered hashes, Merkle root, previous root, sequence.

    A batch holds size rows at most, so the list that one task gathers is bounded. Chains are one
    a partition, as the partitions of the topic are.
    """
    rows = events.select(F.col("partition").alias("partition_id"), F.floor(F.col("offset") / size).alias("block"), "offset", "content_hash")
    found = rows.groupBy("partition_id", "block").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("offset", "content_hash"))).alias("h"))
    found = found.withColumn("row_hashes", F.transform("h", lambda x: x["content_hash"])).withColumn("merkle_root", merkle_root(F.col("row_hashes")))
    order = Window.partitionBy("partition_id").orderBy("block")
    return found.select("partition_id", F.row_number().over(order).cast("long").alias("batch_seq"), F.coalesce(F.lag("merkle_root").over(order), F.lit(GENESIS)).alias("prev_hash"), "merkle_root", "row_hashes", "count", "first_offset", "last_offset")


def extend_chain(new: DataFrame, old: DataFrame) -> DataFrame:
    """Batches of a new run put behind the heads of the old ones."""
    head = old.groupBy("partition_id").agg(F.max(F.struct("batch_seq", "merkle_root")).alias("head"))
    order = Window.partitionBy("partition_id").orderBy("batch_seq")
    joined = new.join(head, "partition_id", "left").withColumn("first", F.row_number().over(order) == 1)
    columns = {"prev_hash": F.when(F.col("first"), F.coalesce("head.merkle_root", F.lit(GENESIS))).otherwise(F.col("prev_hash")), "batch_seq": F.col("batch_seq") + F.coalesce("head.batch_seq", F.lit(0))}
    return joined.withColumns(columns).drop("head", "first")


def chain_heads(chain: DataFrame) -> DataFrame:
    """The last batch of each partition."""
    return chain.groupBy("partition_id").agg(F.max_by(F.struct("batch_seq", "merkle_root", "count", "last_offset"), "batch_seq").alias("h")).select("partition_id", "h.*")


def verify_chain(chain: DataFrame) -> DataFrame:
    """Each batch with what is wrong with it: genesis, gap, link, count and root; ok if nothing is."""
    order = Window.partitionBy("partition_id").orderBy("batch_seq")
    before, root = F.lag("batch_seq").over(order), F.lag("merkle_root").over(order)
    checks = {
        "genesis_ok": before.isNotNull() | (F.col("prev_hash") == GENESIS),
        "gap_ok": F.coalesce(F.col("batch_seq") == before + 1, F.lit(True)),
        "link_ok": F.coalesce(F.col("prev_hash") == root, F.lit(True)),
        "count_ok": F.size("row_hashes") == F.col("count"),
        "root_ok": F.coalesce(merkle_root(F.col("row_hashes")) == F.col("merkle_root"), F.lit(False)),
    }
    out = chain.withColumns(checks)
    return out.select("partition_id", "batch_seq", "count", *checks, (F.col("genesis_ok") & F.col("gap_ok") & F.col("link_ok") & F.col("count_ok") & F.col("root_ok")).alias("ok"))


def partition_roots(events: DataFrame, height: int = 10) -> DataFrame:
    """(partition, root): the Merkle root over all rows of each partition in the order of their offsets.

    Rows are numbered by counts of offset ranges, and sub-trees of 2^height nodes, aligned to that
    size, are hashed a level of blocks at a time: no task gathers or orders a whole partition.
    """
    block = 1 << height
    rows = events.select("partition", "offset", "content_hash", F.floor(F.col("offset") / block).alias("range"))
    before = Window.partitionBy("partition").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("partition", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("size", F.sum("n").over(Window.partitionBy("partition")))
    inside = Window.partitionBy("partition", "range").orderBy("offset", "content_hash")
    nodes = rows.withColumn("nth", F.row_number().over(inside) - 1).join(ranges, ["partition", "range"]).select("partition", (F.col("before") + F.col("nth")).alias("at"), F.col("content_hash").alias("hash"), "size")
    most = ranges.agg(F.max("size")).first()[0] or 0
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"])
    while most > block:
        parts = nodes.groupBy("partition", F.floor(F.col("at") / block).alias("at")).agg(gathered.alias("h"), F.max("size").alias("size"))
        # The only block of a partition ends in its root; a block among others always rises by height levels.
        up = F.when(F.col("size") <= block, merkle_root(F.col("h"))).otherwise(merkle_subtree(F.col("h"), height))
        nodes = parts.select("partition", "at", up.alias("hash"), F.ceil(F.col("size") / block).alias("size"))
        most = -(-most // block)
    return nodes.groupBy("partition").agg(merkle_root(gathered).alias("root"))
