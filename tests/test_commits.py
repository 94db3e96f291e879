"""Commits of micro-batches, filters of keys, and views read with a delta."""

from datetime import date, datetime, timedelta

import pytest
from logloom import commits
from logloom.commits import Batch, compact, filter_of, live_parts, split_known, with_suspicion
from logloom.functions.extract import SEEDS
from logloom.operators.normalize import current_view, superseded
from logloom.operators.serve import events_page, newest_page
from logloom.schemas import append_new, bootstrap, read, read_current, schema
from logloom.streaming.outbox import relay, wire
from logloom.streaming.pipeline import process
from pyspark.sql import functions as F

D1, D2 = date(2024, 5, 1), date(2024, 5, 2)


def keys(spark, ids, day=D1):
    return spark.createDataFrame([(i, day) for i in ids], "raw_id string, day date")


def test_a_filter_never_misses_and_seldom_errs(spark, monkeypatch):
    monkeypatch.setattr(commits, "BLOCKS", 4)
    held, others = [f"k{i}" for i in range(4000)], [f"o{i}" for i in range(4000)]
    filters = filter_of(keys(spark, held), ["raw_id"]).unionByName(filter_of(keys(spark, held[:5], D2), ["raw_id"]))
    count = lambda ids, day: with_suspicion(keys(spark, ids, day), filters, ["raw_id"]).where("suspect").count()
    assert count(held, D1) == 4000 and count(others, D1) < 40
    assert count(held[:5], D2) == 5 and count(held[5:], D2) < 5 and count(held, date(2024, 6, 1)) == 0


def test_the_table_is_opened_for_suspects_only(spark):
    filters = filter_of(keys(spark, ["a", "b"]), ["raw_id"])
    unread = spark.range(1).select(F.raise_error(F.lit("opened")).cast("string").alias("raw_id"), F.lit(D1).alias("day"))
    assert split_known(keys(spark, ["c", "d", "d"]), ["raw_id"], filters, unread).count() == 2
    assert sorted(r.raw_id for r in split_known(keys(spark, ["a", "c"]), ["raw_id"], filters, keys(spark, ["a", "b"])).collect()) == ["c"]
    assert sorted(r.raw_id for r in split_known(keys(spark, ["a", "c"]), ["raw_id"], filters, keys(spark, ["b"])).collect()) == ["a", "c"]  # a filter that errs


@pytest.fixture
def root(spark, tmp_path):
    bootstrap(spark, str(tmp_path))
    return str(tmp_path)


def events(spark, n, tag="x", day=D1):
    at = datetime(day.year, day.month, day.day, 1)
    rows = [(f"{tag}{k}", at + timedelta(minutes=k), "s", "udp", None, "f", "h", "line", day) for k in range(n)]
    return spark.createDataFrame(rows, schema("raw_events"))


def test_nothing_is_seen_before_the_commit(spark, root):
    append_new(events(spark, 3, "old"), root, "raw_events", ["raw_id"])
    batch = Batch(spark, root, "one")
    batch.add("raw_events", events(spark, 4))
    batch.add("chain_heads", spark.createDataFrame([(0, 7, "m")], schema("chain_heads")))
    assert read(spark, root, "raw_events").count() == 3 and read(spark, root, "chain_heads").count() == 0 and not batch.done()
    batch.commit()
    assert read(spark, root, "raw_events").count() == 7 and read(spark, root, "chain_heads").count() == 1 and Batch(spark, root, "one").done()
    again = Batch(spark, root, "two")
    again.replace("chain_heads", spark.createDataFrame([(0, 8, "n"), (1, 1, "m")], schema("chain_heads")))
    again.add("raw_events", events(spark, 2, "later", D2))
    again.commit()
    assert {(r.partition_id, r.batch_seq) for r in read(spark, root, "chain_heads").collect()} == {(0, 8), (1, 1)}
    assert read(spark, root, "raw_events", [D2]).count() == 2 and len(live_parts(spark, root, "raw_events", [D2])) == 1
    assert compact(spark, root, "raw_events") == 2
    assert len(live_parts(spark, root, "raw_events")) == 1 and read(spark, root, "raw_events").count() == 9


def message(spark, rows):
    text = '{{"source_id":"s","transport":"udp","received_at":"2024-05-01T0{}:00:00Z","raw":"{}"}}'
    return spark.createDataFrame([("raw.logs", 0, k, text.format(k % 9, line)) for k, line in rows], "topic string, partition int, offset long, value string")


def test_batches_that_come_again_and_sinks_that_fail(spark, root):
    line = "Mar 03 04:05:06 gate7 kernel: IPTABLES-DROP: SRC=10.0.0.1 DST=10.0.0.2"
    first = message(spark, [(k, line) for k in range(6)])
    sent = []
    for _ in range(2):
        process(first, root, lambda: SEEDS, lambda ok, bad: sent.append(ok.count()), batch_rows=4, key="s-0")

    def broken(ok, bad):
        raise OSError("no broker")

    process(message(spark, [(k, line) for k in range(3, 9)]), root, lambda: SEEDS, broken, batch_rows=4, key="s-1")
    assert sent == [6] and read(spark, root, "raw_events").count() == 9 == read(spark, root, "normalized_events").count()
    chain = read(spark, root, "raw_batches")
    assert sorted(r.batch_seq for r in chain.collect()) == [1, 2, 3, 4, 5]
    assert [(r.batch_seq, r.merkle_root) for r in read(spark, root, "chain_heads").collect()] == [(5, r.merkle_root) for r in chain.where("batch_seq = 5").collect()]
    assert [(r.batch, r.error) for r in read(spark, root, "emit_log").collect()] == [("s-1", "OSError: no broker")]
    assert read(spark, root, "superseded").count() == 0


def test_replay_under_a_new_rule_supersedes(spark, root):
    from dataclasses import replace

    line = "Mar 03 04:05:06 gate7 kernel: IPTABLES-DROP: SRC=10.0.0.1 DST=10.0.0.2"
    process(message(spark, [(k, line) for k in range(4)]), root, lambda: SEEDS, key="a-0")
    newer = [replace(r, version=2) if r.fingerprint_id == "syslog" else r for r in SEEDS]
    process(message(spark, [(k, line) for k in range(2, 6)]), root, lambda: newer, key="b-0")
    found = read(spark, root, "normalized_events")
    assert found.count() == 8 and sorted(r.rule_version for r in read_current(spark, root).collect()) == [1, 1, 2, 2, 2, 2]
    assert {r.event_id for r in read_current(spark, root).collect()} == {r.event_id for r in current_view(found).collect()}
    assert superseded(found).count() == 2
    plan = read_current(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_pages_by_day(spark, tmp_path):
    rows = [(f"e{k:03d}", D1 + timedelta(days=(k * k) % 40)) for k in range(90)]
    view = spark.createDataFrame([(e, datetime(d.year, d.month, d.day, k % 24), "f", "parsed", d) for k, (e, d) in enumerate(rows)], "event_id string, parsed_at timestamp, fingerprint_id string, status string, day date")
    view.write.partitionBy("day").parquet(str(tmp_path / "v"))
    stored = spark.read.schema(view.schema).parquet(str(tmp_path / "v"))
    ids = lambda page: [r.event_id for r in page.collect()]
    for how in ({"limit": 3}, {"limit": 50}, {"limit": 200}, {"before": datetime(2024, 5, 20, 7), "limit": 9}, {"before": (datetime(2024, 5, 20, 7), "e050"), "limit": 9}, {"status": "unparsed"}, {"before": datetime(2023, 1, 1)}):
        assert ids(newest_page(stored, **how)) == ids(events_page(stored, **how))
    assert ids(newest_page(stored.where("1 = 0"))) == []
    plan = newest_page(stored, limit=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "2024-06-06" in plan and "2024-05" not in plan  # the newest days alone




def test_outbox_and_relay(spark, root):
    line = "Mar 03 04:05:06 gate7 kernel: IPTABLES-DROP: SRC=10.0.0.1 DST=10.0.0.2"
    for n in (0, 1, 0):
        process(message(spark, [(3 * n + k, line if k else "Mar 03 04:05:06 gate7 sshd: x") for k in range(3)]), root, lambda: SEEDS, key=f"s-{n}", outbox=True)
    box = read(spark, root, "outbox")
    assert sorted((r.topic, r["count"]) for r in box.groupBy("topic").count().collect()) == [("normalized.events", 6), ("pipeline.dlq", 2)]
    got, calls = [], []

    def send(frame):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("no broker")
        got.extend(r.value for r in frame.collect())

    assert relay(spark, root, send) == 1 and [r.error for r in read(spark, root, "emit_log").collect()] == ["OSError: no broker"]
    assert relay(spark, root, send) == 1 and relay(spark, root, send) == 0
    assert sorted(got) == sorted(r.value for r in box.collect())


def test_wire_raises_on_types_without_a_form(spark):
    good = spark.range(1).select("id", F.lit(None).cast("string").alias("s"), F.create_map(F.lit("a"), F.array(F.lit(1.5))).alias("m"), F.lit("2024-05-01 01:02:03").cast("timestamp").alias("t"))
    assert good.select(wire(good, "id", "s", "m", "t").alias("v")).first().v == '{"id":0,"s":null,"m":{"a":[1.5]},"t":"2024-05-01T01:02:03.000000Z"}'
    for bad in ("X'00'", "INTERVAL 1 DAY", "map(1, 2)", "array(named_struct('a', X'00'))", "parse_json('1')"):
        frame = spark.sql(f"SELECT {bad} AS b")
        with pytest.raises(TypeError):
            wire(frame, "b")
