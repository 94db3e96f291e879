"""Merkle roots of whole partitions against a plain walk over all levels."""

import hashlib
import os

import pytest

from logloom.plans.queries import QUERIES, events

TABLES = "/root/testdata/sf0.01"


def root_of(level):
    while len(level) > 1:
        level = [hashlib.sha256(bytes.fromhex(level[k]) + bytes.fromhex(level[min(k + 1, len(level) - 1)])).hexdigest() for k in range(0, len(level), 2)]
    return level[0]


def by_partition(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.partition, r.offset)):
        out.setdefault(r.partition, []).append(r.content_hash)
    return {p: root_of(h) for p, h in out.items()}


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_merkle_roots_cover_whole_partitions(spark):
    rows = events(spark, TABLES).select("partition", "offset", "content_hash").collect()
    assert {r.partition: r.root for r in QUERIES["merkle_whole_partitions"](spark, TABLES).collect()} == by_partition(rows)


def test_merkle_roots_of_any_length(spark):
    from logloom.operators.ingest import partition_roots

    rows = [(p, 3 * k + k // 5 * 7, hashlib.sha256(f"{p} {k}".encode()).hexdigest()) for p, n in enumerate((1, 2, 3, 4, 5, 9, 16, 17, 31, 33, 65)) for k in range(n)]
    table = spark.createDataFrame(rows, "partition int, offset long, content_hash string").repartition(3)
    assert {r.partition: r.root for r in partition_roots(table, 2).collect()} == by_partition(table.collect())
