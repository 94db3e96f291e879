"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark drops the shuffle files of a query when it ends; else they stay until the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is not set, a temporary folder serves a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/logloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def materialise_parts(parts: list[DataFrame], name: str) -> DataFrame:
    """Like materialise() of the union of parts, which are written one after the other."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = f"{shared_dir(spark)}/logloom/{name}-{uuid.uuid4().hex}"
    for k, part in enumerate(parts):
        part.write.parquet(f"{path}/{k}")
    return spark.read.schema(schema).parquet(*[f"{path}/{k}" for k in range(len(parts))])


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile leaves no shuffle files; what is only defined meanwhile and runs later is not concerned."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes from fewer files than there are cores; many files are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def small(df: DataFrame, row_bytes: int, limit: int = 16 * 1024 * 1024) -> DataFrame:
    """df, whose rows take at most about row_bytes, marked for broadcast if all of them, counted, take at most limit bytes; else joins shuffle it."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
