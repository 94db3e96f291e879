"""The corpus pipeline against a plain-Python version of its five stages, and its edge cases."""

import random
from collections import Counter

import corpus_pipeline
from logloom.llm import pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().lower().split()


def prose(rng, n=70):
    return " ".join("".join(rng.choice("aeioulnrstm") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


def corpus():
    rng = random.Random(31)
    passages = [" ".join(prose(rng, 20).split()) for _ in range(4)]
    texts = [prose(rng) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5].replace(texts[5].split()[8], "changed"), f"{texts[7]} tail"]  # copies
    texts += [f"{prose(rng, 30)} {p} {prose(rng, 30)}" for p in passages]  # contaminated
    texts += [f"{prose(rng, 200)} {passages[0][:40]}", f"{prose(rng)} mail me at ann.lee@example.com or ann (at) example (dot) org"]
    texts += ["short one", "", None, "a b c d e f " * 30]  # rejected by the rules
    rows = [(i, t, "en", f"s{i % 5}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[3], "en", "s1", len(texts[3])), (None, prose(rng), "en", None, 9), rows[0], (2, prose(rng), "en", "s1", 5)]
    return rows, passages


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def plain_filter(rows):
    out = []
    for r in rows:
        w = (r[1] or "").split()
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        if len(w) >= 10 and 100 * len(hit) <= 20 * len(w):
            out.append(r)
    return out


def plain_dedup(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(k)
    return rows, list(groups.values())


def bench_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_decontaminate(rows, passages):
    windows = [tuple(w[k : k + 13]) for p in passages for w in [bench_words(p)] for k in range(len(w) - 12)]
    out = []
    for r in rows:
        w = bench_words(r[1])
        hit = {p + j for k in windows for p in range(len(w) - 12) if tuple(w[p : p + 13]) == k for j in range(13)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def test_pipeline_is_the_plain_one(spark, tmp_path):
    rows, passages = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")  # without labels the rules alone decide
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus_pipeline.table(spark, str(tmp_path), "documents")
    run = lambda k, docs: corpus_pipeline.materialise(corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)), "test-stage")
    found = lambda docs: sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()), key=str)

    docs, want = run(0, docs), plain_filter(rows)
    assert found(docs) == sorted(want, key=str)

    docs = run(1, docs)
    kept, (unique, groups) = [tuple(r) for r in docs.collect()], plain_dedup(want)
    assert len(kept) == len(groups)
    for group in groups:  # one of each group: that with the smallest id
        of = [unique[k] for k in group]
        (one,) = [r for r in kept if r in of]
        ids = [r[0] for r in of if r[0] is not None]
        assert one[0] == (min(ids) if ids else None)

    docs, want = run(2, docs), plain_decontaminate(kept, passages)
    assert found(docs) == sorted(want, key=str) and len(kept) - len(want) == 4

    docs = run(3, docs)
    masked = [(i, new, lang, s, len(new)) for i, t, lang, s, _ in want for new in [pii.mask(t, pii.find(t)[1])]]
    assert found(docs) == sorted(masked, key=str) and any("[EMAIL]" in r[1] for r in masked)

    got = run(4, docs).collect()
    size, source, taken = Counter(), {r[0:2]: r[3] for r in masked}, Counter()
    for r in masked:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, open_, budget = {}, set(order), sum(size.values())
    while open_:
        unit = budget / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > 3 * size[s]]
        for s in full:
            target[s] = 3 * size[s]
            budget -= target[s]
            open_.discard(s)
        if not full:
            target.update({s: weight[s] * unit for s in open_})
            break
    longest = max(len(words(r[1])) for r in masked)
    for r in got:
        n = len(words(r.text))
        assert source[r.doc_id, r.text] == r.source and 1 <= r.repeats <= 3 and r.taken == n * r.repeats
        assert abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(0 <= target[s] - taken[s] < longest for s in order)


def test_pipeline_of_empty_tables_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, prose(rng), "en", "s", 5, 1, 2, "x") for i in range(4)], SCHEMA + ", node long, id long, row_key string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() == 4
