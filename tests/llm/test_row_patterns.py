"""Row pattern matching against a backtracking regular expression over each key's rows."""

import datetime as dt
import hashlib
import math
import random
from collections import defaultdict

import pytest

from logloom.llm.row_patterns import composed, counted, find_pattern, pattern_digest

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id {}, kind string, value double, props string, at long, key string, entry long, cents long"
T0 = dt.datetime(2024, 3, 1)


def brute(rows):
    """Tries every start and every length in the order that a backtracking matcher would."""
    clients = defaultdict(set)
    for r in rows:
        if r[3] is not None and r[1] is not None:
            clients[r[3]].add(r)
    out = []
    for client, found in clients.items():
        rs = sorted(found, key=lambda r: (r[1], r[0]))
        cents = [None if r[5] is None or math.isnan(r[5]) else math.floor(100 * r[5] + 0.5) for r in rs]

        def fits(letter, k, a):
            if cents[k] is None:
                return False
            if letter == "A":
                return True
            if rs[k][1] - rs[k - 1][1] > dt.timedelta(minutes=10):
                return False
            if letter == "P":
                return rs[k][4] == "purchase" and cents[k] >= cents[a]
            return rs[k][4] not in (None, "error") and (cents[k] < cents[k - 1] if letter == "D" else cents[k] > cents[k - 1])

        def tail(k, a, letters):
            while k < len(rs):  # lazy: P first
                if fits("P", k, a):
                    return k, letters + "P"
                letter = next((x for x in "DU" if fits(x, k, a)), None)
                if letter is None:
                    return None
                letters += letter
                k += 1
            return None

        start, no = 0, 0
        while start < len(rs):
            match = tail(start + 1, start, "A") if fits("A", start, start) else None
            if match is None:
                start += 1
                continue
            end, letters = match
            no += 1
            out.append((client, no, rs[start][0], rs[end][0], end - start + 1, sum(cents[start : end + 1]), letters))
            start = end + 1
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


def clicks(seed, n, clients, purchases=0.08, breaks=0.03, spread=60, wide=False):
    rng = random.Random(seed)
    rows, t = [], {c: T0 for c in clients}
    for i in range(n):
        c = clients[0] if rng.random() < 0.6 else rng.choice(clients)
        t[c] += dt.timedelta(seconds=rng.choice([0, 1, 5, 600]) if rng.random() > breaks else 601)
        kind = "purchase" if rng.random() < purchases else rng.choice(["view"] * 20 + ["click"] * 10 + ([None, "error"] if rng.random() < breaks * 5 else []))
        value = None if rng.random() < breaks / 3 else rng.randint(0, spread) / 100 if not wide else i / 10 + rng.randint(0, 30) / 10
        rows.append((i, t[c], T0, c, kind, value, "{}", 1, "k", 2, 3))
    return rows


def check(spark, rows, kind="long", **how):
    frame = spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(3)
    got = [tuple(r) for r in find_pattern(frame, **how).collect()]
    assert sorted(got, key=lambda r: (str(r[0]), r[1])) == brute(rows)
    return got


def test_one_chunk_and_odd_rows(spark):
    rows = clicks(1, 900, [7, 1, 2, 3, 4])
    rows += rows[:40] + [(5000, None, T0, 7, "view", 1.0, "{}", 1, "k", 2, 3), (5001, T0, T0, None, "view", 1.0, "{}", 1, "k", 2, 3), (5002, T0, T0, 7, "view", float("nan"), "{}", 1, "k", 2, 3)]
    assert len(check(spark, rows)) > 20


@pytest.mark.parametrize(("seed", "options"), [(2, {}), (3, {"purchases": 0.02, "breaks": 0.005, "spread": 400}), (4, {"purchases": 0.3, "breaks": 0.0, "wide": True})])
def test_walks_that_span_chunks(spark, seed, options):
    """Chunks of about five rows and groups of three: walks and chains cross chunks, groups and groups of groups."""
    got = check(spark, clicks(seed, 260, [7, 8], **options), chunk_rows=5, fan=3)
    assert max(r[4] for r in got) > 5


def test_text_keys_over_chunks(spark):
    check(spark, clicks(5, 120, ["ä", "b c", '"q"'], breaks=0.01), "string", chunk_rows=9, fan=4)


def test_many_keys_over_many_chunks(spark):
    """Keys shorter than the table: a search must be found in every chunk, however far from the first (F1)."""
    check(spark, clicks(11, 400, list(range(40)), breaks=0.01, purchases=0.15), chunk_rows=6, fan=3)


def test_a_match_over_all_chunks(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), T0, 1, "view", (50 + i % 2) * 1.0, "{}", 1, "k", 2, 3) for i in range(100)] + [(100, T0 + dt.timedelta(seconds=100), T0, 1, "purchase", 90.0, "{}", 1, "k", 2, 3)]
    got = check(spark, rows, chunk_rows=7, fan=3)
    assert [r[4] for r in got] == [101]


def test_empty_and_digest(spark):
    empty = spark.createDataFrame([], SCHEMA.format("long"))
    assert find_pattern(empty).count() == 0
    rows = clicks(6, 60, [1], breaks=0.0, purchases=0.4)
    got = pattern_digest(find_pattern(spark.createDataFrame(rows, SCHEMA.format("long")))).collect()
    assert {r.labels_sha256 for r in got} == {hashlib.sha256(r[6].encode()).hexdigest() for r in brute(rows)}


def test_summaries_compose_whatever_the_bracketing():
    rng = random.Random(7)
    for _ in range(300):
        parts = []
        for at in range(3):
            ends = [[rng.choice([1, 1, 2]), 10 * at * 600_000_000 // 10 + rng.choice([0, 5]), rng.randint(0, 5), rng.choice([7, 5, 4, 6, 3])] for _ in range(2)]
            parts.append({"at": at, "first": ends[0], "last": ends[1], "through": rng.random() < 0.7, "top": rng.choice([None, 1, 4, 9])})
        a, b, c = parts
        assert composed(composed(a, b), c) == composed(a, composed(b, c))
        counts = [{"first": rng.choice("xy"), "last": rng.choice("xy"), "n": rng.randint(0, 3), "one": False} for _ in range(3)]
        for s in counts:
            s["one"] = s["first"] == s["last"] and rng.random() < 0.7
        a, b, c = counts
        assert counted(counted(a, b), c) == counted(a, counted(b, c))
