"""What op10 leaves on disk while it runs (F1)."""

import random

import pytest
from logloom import storage
from logloom.llm import common, suffix_dedup
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    line = lambda: " ".join(rng.choice(words) for _ in range(40))
    shared = [line() for _ in range(20)]
    rows = [(k, f"{line()} {rng.choice(shared)} {line()} {rng.choice(shared)}") for k in range(120)]
    return [*rows, (500, rows[3][1]), (None, rows[3][1]), (501, None), (502, "short")]


def shuffles_on_disk(spark):
    """How many shuffles have blocks on this machine, whose executor is the driver."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b.name().split("_")[1] for b in (blocks.apply(k) for k in range(blocks.size())) if b.name().startswith("shuffle_")}


def test_no_step_leaves_its_shuffles(spark, monkeypatch):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    seen, before = [], shuffles_on_disk(spark)
    write = DataFrameWriter.parquet

    def watched(self, path, *args, **kwargs):
        seen.append(shuffles_on_disk(spark) - before)
        write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    conf = spark.conf.get(storage.DROP_SHUFFLES, None)
    suffix_dedup.suffix_dedup(docs)
    assert len(seen) > 5 and not any(seen), seen
    assert spark.conf.get(storage.DROP_SHUFFLES, None) == conf


@pytest.mark.parametrize("broadcast", [True, False])
def test_slices_give_what_the_whole_gives(spark, monkeypatch, broadcast):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    whole = sorted(map(str, suffix_dedup.suffix_dedup(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "SLICE_ROWS", 10)
    if not broadcast:
        monkeypatch.setattr(suffix_dedup, "bounded", lambda df: common.bounded(df, -1))
    assert sorted(map(str, suffix_dedup.suffix_dedup(docs).collect())) == whole and any("n_removed=0" not in x for x in whole)


@pytest.mark.parametrize("least,most", [(1 << 30, 1), (1, 4)])
def test_texts_meet_one_shuffle(spark, monkeypatch, least, most):
    """Where the names of the texts can't be broadcast, texts are not dealt for a semi-join first."""
    monkeypatch.setattr(suffix_dedup, "bounded", lambda df: common.bounded(df, -1))
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", least)
    docs = spark.createDataFrame(texts(), "id long, text string").withColumn("node", F.xxhash64("text"))
    found = docs.where("id < 60").select("node", "id", F.lit(1).alias("found"))
    parts = suffix_dedup.with_texts(docs, docs.select("node", F.octet_length("text").cast("long").alias("n_bytes")), found.select("node"), found, 100)
    assert len(parts) == most and all("LeftSemi" not in p._jdf.queryExecution().optimizedPlan().toString() for p in parts)
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(60))
