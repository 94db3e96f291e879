"""Steps that held a whole partition, one file or every repetition in a task (F13 to F15, F18)."""

from datetime import date

from logloom.commits import filter_of, split_known
from logloom.functions.extract import SEEDS
from logloom.sources.readers import replay
from logloom.streaming import pipeline
from pyspark.sql import Window
from pyspark.sql import functions as F


def test_replay_orders_ranges_not_partitions(spark):
    """Many equal lines, short ones and nulls, in ranges of seven rows."""
    rows = spark.range(90).select(F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("corpus"), F.when(F.col("id") % 3 == 0, F.lit("same")).when(F.col("id") != 1, F.col("id").cast("string")).alias("raw"))
    sent = replay(rows, 2, rows_a_part=7)
    assert "raw#" not in "".join(x for x in sent._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in x or "Sort" in x)
    place = F.row_number().over(Window.partitionBy("partition").orderBy("copy", "corpus", "raw")) - 1
    plain = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("partition", F.pmod(F.xxhash64("corpus"), F.lit(6)).cast("int")).select("partition", place.cast("long").alias("offset"), F.concat(F.lit("sim-"), F.col("corpus")).alias("source_id"), "raw")
    got = sent.select("partition", "offset", F.get_json_object("value", "$.source_id").alias("source_id"), F.get_json_object("value", "$.raw").alias("raw"))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_a_batch_of_one_file_is_spread(spark, tmp_path, monkeypatch):
    text = '{{"source_id":"s","transport":"udp","received_at":"2024-05-01T00:00:00Z","raw":"line {}"}}'
    spark.createDataFrame([("raw.logs", 0, k, text.format(k)) for k in range(9)], "topic string, partition int, offset long, value string").coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    whole = pipeline.decode
    monkeypatch.setattr(pipeline, "decode", lambda messages: seen.append(messages.rdd.getNumPartitions()) or whole(messages))
    pipeline.bootstrap(spark, f"{tmp_path}/db")
    pipeline.process(spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/db", lambda: SEEDS)
    assert seen == [4] and pipeline.read(spark, f"{tmp_path}/db", "raw_events").count() == 9


def test_only_keys_meet_the_filters(spark):
    day = date(2024, 5, 1)
    rows = lambda ids: spark.createDataFrame([(i, f"text {i}", day) for i in ids], "raw_id string, raw_text string, day date")
    found = split_known(rows("aabc"), ["raw_id"], filter_of(rows("ax"), ["raw_id"]), rows("ax"))
    assert sorted(r.raw_id for r in found.collect()) == ["b", "c"]
    assert "bitmap" not in found._jdf.queryExecution().optimizedPlan().toString()
