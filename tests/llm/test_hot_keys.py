"""Very frequent keys: their occurrences meet no join, and each row is counted once."""

from collections import Counter

import numpy as np
import pytest
from logloom.llm import common, jaccard_join, suffix_dedup
from logloom.llm.token_files import planes, ranked
from pyspark.sql import functions as F


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(common, "HOT_TIMES", 5)


def test_counts_of_frequent_tokens_need_no_join(spark, few):
    """Keys below 3 are frequent; of key 0 all rows are of one node, so that no other node has it."""
    rows = [(k, 0 if k == 0 else node) for k in range(3) for node in range(40) for _ in range(2)] + [(k, node) for k in range(3, 60) for node in range(k % 4)]
    pairs = spark.createDataFrame(rows, "key long, node long").repartition(3)
    met = jaccard_join.shared_keys(pairs, pairs)
    assert "Join" not in met._jdf.queryExecution().executedPlan().toString()
    df = Counter(k for k, _ in set(rows))
    assert sorted(map(tuple, met.collect())) == sorted((k, n, df[k]) for k, n in set(rows) if df[k] > 1)


def test_frequent_anchors_need_no_join(spark, few):
    line = "the same passage of well over a hundred bytes that stands in each of the texts, whatever is said before or after it "
    docs = spark.createDataFrame([(k, f"{k} {k * 7919} opens " + line * 2 + f"ends {k * 104729}") for k in range(200)], "id long, text string").withColumn("node", F.xxhash64("text"))
    met = suffix_dedup.meeting_anchors(docs, 100, 24)
    assert "Join" not in met._jdf.queryExecution().executedPlan().toString()
    every = [(int(k), r.node, int(p)) for r in docs.collect() for k, p in zip(*(x.view(np.int64) for x in suffix_dedup.anchors(r.text.encode())), strict=True)]
    places = Counter(k for k, _, _ in set(every))
    assert sorted(map(tuple, met.distinct().collect())) == sorted(x for x in set(every) if places[x[0]] > 1)


def test_ranked_is_unique():
    code = np.array([7, 3, 3, 9, 0, 7], np.int32)
    used, place = ranked(code, 10)
    assert used.tolist() == [0, 3, 7, 9] and place.tolist() == [2, 1, 1, 3, 0, 2]
    assert [len(x) for x in planes(code, 4)[:2]] == [4, 4]
