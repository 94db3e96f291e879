"""Flattening of JSON against a plain walk over parsed objects."""

import json
import random

from logloom.functions.extract import flatten_json, json_depth, pairs_of
from pyspark.sql import functions as F


def plain(value, prefix=""):
    out = {}
    for k, v in value.items():
        name = f"{prefix}.{k}" if prefix else k
        if isinstance(v, dict):
            out.update(plain(v, name))
        else:
            out[name] = v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    return out


def value(rng, depth):
    kind = rng.randint(0, 9 if depth else 6)
    if kind >= 7:
        return {rng.choice("abcdé\"{. '") + str(rng.randint(0, 5)): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return [None, True, rng.randint(-5, 5), "{", '{"x":{"y":1}}', rng.choice(["}", 'a"{', "\\", "\n", "é"]), [1, {"y": "{"}]][kind]


def test_random_objects(spark):
    rng = random.Random(12)
    objects = [{f"k{j}": value(rng, 5) for j in range(4)} for _ in range(300)]
    rows = [(i, json.dumps(o, ensure_ascii=i % 2 == 0)) for i, o in enumerate(objects)]
    got = {r.i: r.m for r in spark.createDataFrame(rows, "i int, t string").select("i", flatten_json(F.col("t")).alias("m")).collect()}
    assert all(got[i] == plain(o) for i, o in enumerate(objects))


def test_many_levels_and_what_is_no_object(spark):
    deep = {"end": 1}
    for k in range(60):
        deep = {f"n{k}": deep, "s": "{"}
    texts = [json.dumps(deep), "{}", "[1]", "x", None, '"{}"', '{"a":1', '{"a":{},"b":{"c":{}}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", flatten_json(F.col("t")).alias("m"), json_depth(F.col("t")).alias("d")).collect()
    got = {r.i: r.m for r in rows}
    assert got[0] == plain(deep) and got[1] == {} and got[7] == {} and all(got[i] is None for i in range(2, 7))
    assert {r.i: r.d for r in rows}[0] == 61


def test_a_map_is_worked_out_once(spark):
    """Rows of pairs: no filter below repeats the flattening, and empty or missing maps give no row (F2)."""
    rows = spark.createDataFrame([(1, '{"a":{"b":null},"c":"{x"}'), (2, "{}"), (3, "no"), (4, None)], "i int, t string")
    found = pairs_of(["i"], flatten_json(F.col("t")), rows)
    assert sorted(map(tuple, found.collect())) == [(1, "a.b", None), (1, "c", "{x")]
    plan = pairs_of(["id"], flatten_json(F.concat(F.lit('{"a":'), F.col("id").cast("string"), F.lit("}"))), spark.range(3))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1 and plan.count() == 3
