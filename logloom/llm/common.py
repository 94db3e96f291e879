"""What the training-data operators share: table access, materialising, Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise, materialise_parts, shared_dir, shuffles_dropped  # noqa: F401

#: Arrow batches hold at most this many bytes, so that long texts do not pile up in a worker.
ARROW_BATCH_BYTES = 4 * 1024 * 1024

#: A table is broadcast if it takes at most this many bytes.
BROADCAST_BYTES = 16 * 1024 * 1024
#: A key that more than one in so many rows have is hot.
HOT_SHARE = 2_000
#: Keys met so often in one of SAMPLE rows are dealt apart, at most HOT_KEYS of them; which these are changes no result.
SAMPLE, HOT_TIMES, HOT_KEYS = 32, 64, 10_000

#: The ASCII white space that separates words in every contract: space and \x09-\x0D.
WHITE = " \t\n\r\x0b\x0c"


def tune(spark: SparkSession) -> SparkSession:
    """Bound the bytes of the Arrow batches that Python operators receive."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def width(kind: T.DataType, column: Column) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 24
    if isinstance(kind, T.StructType):
        return sum((width(f.dataType, column[f.name]) for f in kind), F.lit(8))
    if isinstance(kind, T.ArrayType | T.MapType):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 24
    return F.lit(8)


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its values, measured, take at most limit bytes; else joins shuffle it."""
    size = df.agg(F.sum(sum((width(f.dataType, F.col(f.name)) for f in df.schema), F.lit(32)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def joined_by(left: DataFrame, right: DataFrame, key: str, times: str, how: str = "left", keep: bool = False) -> DataFrame:
    """left with the columns of right, which has key once, where there is a match; times says how many rows of left it matches (kept if keep).

    A small right side is broadcast whole. Else keys that more than one in HOT_SHARE rows have,
    of which there are fewer than HOT_SHARE, are broadcast, so that no task holds all rows of one;
    rows without a key are not shuffled at all.
    """
    gone = [] if keep else [times]
    small = bounded(right)
    if small is not right:
        return left.join(small, key, how).drop(*gone)
    total = left.count()
    hot = F.broadcast(right.where(F.col(times) * HOT_SHARE > total))
    seldom = right.where(F.col(times) * HOT_SHARE <= total)
    filled = left.where(F.col(key).isNotNull())
    out = filled.join(hot, key).unionByName(filled.join(hot.select(key), key, "left_anti").join(seldom, key, how))
    return (out.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out).drop(*gone)


def in_sample(*row: str) -> Column:
    """One of SAMPLE rows, by a hash of what tells them apart."""
    return F.pmod(F.xxhash64(F.lit("sample"), *map(F.col, row)), F.lit(SAMPLE)) == 0


def one_of(column: str, numbers: list[int]) -> Column:
    """Whether a number column is one of so many; the least long has no literal and is none of them."""
    found = [k for k in numbers if k > -(2**63)]
    return F.expr(f"{column} IN ({', '.join(f'{k}L' for k in found)})") if found else F.lit(False)


def hot_keys(sample: DataFrame) -> Column:
    """Whether the number key is met HOT_TIMES times or more in a sample (key), among the most frequent HOT_KEYS of it; others are dealt by hash."""
    times = sample.groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") >= HOT_TIMES)
    found = [r.key for r in times.orderBy(F.desc("times"), "key").limit(HOT_KEYS).collect()]  # at most HOT_KEYS numbers
    return one_of("key", found)


def fold(id_column: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets; a null id counts as the empty text."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % buckets


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def give_back() -> None:
    """Return what a task has freed to the system: a worker lives on and other tasks need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its memory back when a task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow batch by batch with per-task set-up: make() runs once a task and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(tidy(run), schema)
