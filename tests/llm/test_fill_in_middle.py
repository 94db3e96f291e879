"""The fill-in-the-middle transformation against a plain version, on texts with the signs and markers it uses itself."""

import hashlib
import random
import re

from logloom.llm.fill_in_middle import fill_in_middle, middle_digest, restored
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, n long, form string, marked string, h1 long, low long, id string, output string"


def plain_version(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, z = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b, z, f"<S>{z}<P>{a}<M>{b}"
    return n, "psm", a, b, z, f"<P>{a}<S>{z}<M>{b}"


def texts():
    rng = random.Random(3)
    signs = ["\x1e", "\x1f", "\x1f0", "\x1f1", "\x1e1", "0", "1", "a", "Zz", "ab", " ", "\n", "\r\n", "é", "日本", "😀", "<", ">", "<P", "S>", "$0", "\\", "\t", "\x00"]
    out = ["", None, " ", "a", "word", "\x1e", "\x1f", "\x1f1\x1e0", "<P>", "x<S>y", "x<M>", "<<P", "two words", "x" * 5000, "Ünïcode á b " * 40, "long text, with 1 sign. " * 60_000]
    return out + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(400)]


def test_against_the_plain_version(spark):
    rows = [(k, t, 1, "f", "m", 2, 3, "i", "o") for k, t in enumerate(texts())] + [(None, "no id here", 1, "f", "m", 2, 3, "i", "o"), (3, "a", 1, "f", "m", 2, 3, "i", "o")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, fill_in_middle(frame).withColumn("again", restored(F.col("form"), F.col("output"))).collect()), key=repr)
    assert got == sorted(((r[0], *plain_version(r[0], r[1]), r[1] or "") for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for r in rows:
        n, form, a, b, _, output = plain_version(r[0], r[1])
        expected.append((r[0], n, form, None if a is None else len(a), None if b is None else len(b), sha(output), sha(r[1] or "")))
    assert sorted(map(tuple, middle_digest(fill_in_middle(frame)).collect()), key=repr) == sorted(expected, key=repr)


def test_another_seed_and_no_rows(spark):
    frame = spark.createDataFrame([(k, "some more words here", 1, "f", "m", 2, 3, "i", "o") for k in range(50)], SCHEMA)
    assert sorted(r.output for r in fill_in_middle(frame, seed=9).collect()) == sorted(plain_version(k, "some more words here", 9)[-1] for k in range(50))
    assert middle_digest(fill_in_middle(frame.limit(0))).count() == 0
    plan = fill_in_middle(frame)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
