"""Texts of few parts are flattened from front to back; what that gives is what opening them level by level gives (F2)."""

import json
import random

from logloom.functions import extract
from logloom.functions.extract import flat_text, flatten_json, opened
from logloom.plans.further import ODD
from pyspark.sql import functions as F

def by_level(text):
    return F.when(F.trim(text).startswith("{") & F.try_parse_json(text).isNotNull(), extract.bound(extract.object_of(text, F.try_variant_get(F.try_parse_json(text), "$", extract.MEMBERS), extract.levels(text)), lambda s: opened(s["rounds"], s["found"])))


RNG = random.Random(99)


def gap():
    return RNG.choice(["", "", "", " ", "\n", "\t ", "\r\n"])


def string():
    signs = ["a", "b", ".", "$", "$1", "{", "}", "[", "]", '"', "\\", ":", ",", " ", "\n", "é", " ", "😀", "/", "null"]
    return json.dumps("".join(RNG.choice(signs) for _ in range(RNG.choice([1, 1, 2, 3, 6, 0]))), ensure_ascii=RNG.random() < 0.5)


def value(depth):
    kind = RNG.random()
    if depth and kind < 0.5:
        return "{" + gap() + (gap() + "," + gap()).join(string() + gap() + ":" + gap() + value(depth - 1) for _ in range(RNG.choice([0, 1, 1, 2, 3]))) + gap() + "}"
    if depth and kind < 0.65:
        return "[" + gap() + (gap() + "," + gap()).join(value(depth - 1) for _ in range(RNG.randint(0, 3))) + gap() + "]"
    return RNG.choice(["null", "true", "0", "-0", "1.50", "1e2", "-1E+400", "9" * 50, "0.1e-7", string(), string(), '"\\u0041\\/"', '"{\\"x\\":{}}"'])


def broken(text):
    at = RNG.randint(0, len(text))
    return RNG.choice([text[:at] + text[at + 1 :], text[:at] + RNG.choice('{}[]",:\\ \n1x') + text[at:], text[:at], RNG.choice("\n [\t") + text, text + RNG.choice(["}", "{", "x", ',"b":1}', "\n", " ", "{}", ',"b":{}}'])])


def both(spark, texts):
    text = F.col("t")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", flatten_json(text).alias("got"), by_level(text).alias("want"), flat_text(text).isNotNull().alias("fast"))
    return rows.withColumn("same", F.map_entries("got").eqNullSafe(F.map_entries("want"))).orderBy("i").collect()


def test_random_texts(spark):
    texts = [f'{{"k":{value(8)},{string()}:{value(6)}}}' for _ in range(3000)]
    found = both(spark, [broken(t) if k % 3 == 2 else t for k, t in enumerate(texts)])
    assert all(r.same for r in found), [r.t for r in found if not r.same][:5]
    assert sum(r.fast and r.want is not None for r in found) > 1000


def test_what_is_left_to_the_other_way(spark):
    deep = lambda n, inner: '{"k":' * n + inner + "}" * n
    wide = "{" + ",".join(f'"k{k}":{{"a":{k}}}' for k in range(300)) + "}"
    other = ['{"":{"a":1}}', '{"":{"":{"":2}}}', '{"x":{"y":1E+400}}', deep(30, "[[[[[[1]]]]]]"), wide, '{"a":{"b":1}}\n', '{"a":1}{"b":2}', '{"a":1},"b":{"c":2}}', '{"a":{}}}', '{"a":{"b":"' + "x" * 60_000 + '"}}']
    same = ['{"x":{"":{"a":1}}}', '{"a.b":1,"a":{"b":2}}', '{"a":{"b":2},"a.b":1}', '{"\\u002e":{"\\"":1}}', deep(300, "1"), "{}", '{"a":{}}', ' {"a":{"b":[[[[1]]]]}} ', '{"t":"' + '\\"{' * 15_000 + '"}', '{"l":[' + ",".join('{"a":"]"}' for _ in range(4000)) + "]}"]
    none = ['{"a":1,"a":2}', '{"a":1,}', '{"a":{,"b":1}}', '{"a":{"b":1}"c":2}', '{"a":01}', "{", "}", "", None, '{"a":NaN}', deep(1100, "1")]
    found = both(spark, other + same + none)
    assert all(r.same for r in found), [r.t for r in found if not r.same][:5]
    assert not any(r.fast for r in found[: len(other)]) and all(r.fast for r in found[len(other) : -len(none)])
    assert all(r.got is None for r in found[-len(none) :])


def test_levels_cost_no_rounds(spark):
    """The texts of flatten_deep, 21 levels deep, have 15 parts."""
    row = spark.range(1).select(F.col("id").alias("eid")).select(F.expr(ODD).alias("t")).select(F.size(F.regexp_extract_all(F.substring("t", 2, 10_000), F.lit(f"({extract.PART})"), F.lit(1))).alias("n"), flat_text(F.col("t")).alias("flat")).first()
    assert row.n == 15 and json.loads(row.flat)["deep." + ".".join(f"n{k}" for k in range(20))] == 0
