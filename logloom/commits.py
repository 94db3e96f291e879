"""Commits: one small file says which parts of all tables a micro-batch has added, so that all or none of them are seen.

Parts are written under parts/, where no reader looks, and become visible by the one row file of
commits/ that names them; a writer that dies before leaves parts that nobody reads. A batch is
known by its stream and number, so one that comes again after its commit changes nothing. Keys
of daily tables have a blocked Bloom filter for each day, committed with the rows they belong
to: only keys that it may hold are looked for in the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import DAILY, schema
from .storage import materialise, small

#: A day's filter has this many blocks of 32,768 bits (64 MB, or 33 million keys at 16 bits); a key sets so many bits of one block.
BLOCKS, BLOCK_BITS, BITS = 1 << 14, 32_768, 4
FILTERS = "key_filters"


def commit_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schema("commits")).parquet(f"{root}/commits")


def live_parts(spark: SparkSession, root: str, name: str, days: Iterable[date] | None = None) -> list[str]:
    """Paths of a table's committed parts that no later commit has dropped; of a daily table those with rows of the days."""
    rows = commit_log(spark, root).where(F.col("name") == name)
    if days is not None:
        rows = rows.where(F.col("dropped") | F.col("days").isNull() | F.arrays_overlap("days", F.array(*map(F.lit, days)) if days else F.array().cast("array<date>")))
    found = rows.groupBy("path").agg(F.bool_or("dropped").alias("dropped")).where("NOT dropped").collect()  # one row a part; compact() keeps them few
    return sorted(f"{root}/{r.path}" for r in found)


def read_parts(spark: SparkSession, root: str, name: str, days: Iterable[date] | None = None) -> DataFrame | None:
    paths = live_parts(spark, root, name, days)
    return opened(spark, root, name, paths) if paths else None


def opened(spark: SparkSession, root: str, name: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema(name)).option("basePath", f"{root}/parts/{name}").parquet(*paths).select(*[f.name for f in schema(name)])


class Batch:
    """What one micro-batch adds and drops; nothing of it is seen before commit()."""

    def __init__(self, spark: SparkSession, root: str, key: str) -> None:
        self.spark, self.root, self.key = spark, root, key
        self.rows: list[tuple] = []

    def done(self) -> bool:
        return commit_log(self.spark, self.root).where(F.col("batch") == self.key).limit(1).count() > 0

    def add(self, name: str, df: DataFrame) -> DataFrame:
        """Write df as a part of a table; returns it as written, so that it isn't computed again."""
        path = f"parts/{name}/part={self.key}-{uuid.uuid4().hex}"
        columns = [f.name for f in schema(name)]
        daily = "day" in columns
        writer = df.select(*columns).write
        (writer.partitionBy("day") if daily else writer).parquet(f"{self.root}/{path}")
        written = opened(self.spark, self.root, name, [f"{self.root}/{path}"])
        days = [r.day for r in written.select("day").distinct().collect()] if daily else None
        self.rows.append((self.key, name, path, days, False))
        return written

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """df in place of all that the table has now."""
        self.drop(live_parts(self.spark, self.root, name), name)
        return self.add(name, df)

    def drop(self, paths: Iterable[str], name: str) -> None:
        self.rows += [(self.key, name, p.removeprefix(f"{self.root}/"), None, True) for p in paths]

    def commit(self) -> None:
        """One file, moved into place as a whole: readers see all rows of the batch or none."""
        self.spark.createDataFrame(self.rows, schema("commits")).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")


def compact(spark: SparkSession, root: str, name: str, files: int = 1) -> int:
    """Write the parts of a table together as one and drop them in the same commit; returns how many there were. Filters of a day become one."""
    paths = live_parts(spark, root, name)
    if len(paths) > 1:
        batch = Batch(spark, root, f"compact-{uuid.uuid4().hex}")
        found = opened(spark, root, name, paths)
        found = merged(found) if name.startswith(FILTERS) else found
        batch.drop(paths, name)
        batch.add(name, found.repartition(files, "day") if name in DAILY else found.coalesce(files))
        batch.commit()
    return len(paths)


# --- filters of keys ------------------------------------------------------------------------


def places(key: list[str]) -> tuple[Column, list[Column]]:
    """The block of a key, and its bits in it."""
    bits = F.xxhash64(F.lit("bits"), *map(F.col, key))
    return F.pmod(F.xxhash64(*map(F.col, key)), F.lit(BLOCKS)), [F.pmod(F.shiftrightunsigned(bits, 15 * k), F.lit(BLOCK_BITS)) for k in range(BITS)]


def filter_of(keys: DataFrame, key: list[str]) -> DataFrame:
    """(day, block, bits): the filter of the keys of some rows."""
    block, bits = places(key)
    return keys.select("day", block.alias("block"), F.explode(F.array(*bits)).alias("bit")).groupBy("day", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged(filters: DataFrame) -> DataFrame:
    return filters.groupBy("day", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def with_suspicion(rows: DataFrame, filters: DataFrame, key: list[str]) -> DataFrame:
    """rows with suspect: whether the filter of their day may hold their key. It never says no to one that it holds."""
    block, bits = places(key)
    has = F.lit(True)
    for bit in bits:
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        has = has & (F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1)
    return rows.withColumn("block", block).join(merged(filters), ["day", "block"], "left").withColumn("suspect", F.coalesce(has, F.lit(False))).drop("block", "bits")


def split_known(df: DataFrame, key: list[str], filters: DataFrame | None, known: DataFrame) -> DataFrame:
    """The rows of df, one a key, whose key the table (known) doesn't hold; the table is opened only if the filter suspects a key of df.

    Keys alone meet the filters and the table, once; whole rows are shuffled once, when the result is written.
    """
    rows = df.dropDuplicates(key)
    if filters is None:
        return rows
    keys = ["day", *key]
    suspects = materialise(with_suspicion(df.select(*keys).distinct(), filters, key).where("suspect").select(*keys), "suspects")
    if not suspects.limit(1).count():
        return rows
    held = materialise(known.select(*keys).join(suspects, keys, "left_semi").distinct(), "held")
    return rows.join(small(held, 48 + 48 * len(key)), keys, "left_anti").select(*df.columns)
