"""Cases of the review: whole results where a bound, a null or a repeated id once cut them."""

import os
import random

import pytest

import corpus_pipeline
from logloom.llm.jaccard_join import jaccard_join
from logloom.llm.mixing import subset
from logloom.llm.quality_rules import quality_rules

TABLES = "/root/testdata/sf0.01"


def words_taken(lengths, counts, budget, limit=65_536):
    take = subset(lengths, counts, budget, limit)
    assert all(0 <= k <= n for k, n in zip(take, counts, strict=True))
    return sum(x * k for x, k in zip(lengths, take, strict=True))


@pytest.mark.parametrize(
    "lengths,counts,budget",
    [([10, 1_000_000], [100_000, 1], 1_000_000), ([10, 1_000_000], [1000, 1], 1_000_000), ([100_000, 150_000, 170_000], [1, 1, 1], 320_000), ([10, 100_000, 250_000], [5000, 1, 1], 270_000)],
)
def test_subset_with_very_long_documents(lengths, counts, budget):
    assert words_taken(lengths, counts, budget) == budget


def best_sum(lengths, counts, budget):
    sums = {0}
    for x, n in zip(lengths, counts, strict=True):
        sums = {a + k * x for a in sums for k in range(n + 1) if a + k * x <= budget}
    return max(sums)


def test_small_subsets_are_the_best():
    rng = random.Random(4)
    for _ in range(1500):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 6)))
        counts = [rng.randint(1, 6) for _ in lengths]
        budget = rng.randint(0, sum(x * n for x, n in zip(lengths, counts, strict=True)))
        assert words_taken(lengths, counts, budget) == best_sum(lengths, counts, budget)
    assert words_taken([5, 32], [5, 3], 100) == 96 and words_taken([311_000, 351_000], [2, 4], 648_577) == 622_000


def test_subsets_of_documents_beyond_the_states_miss_next_to_nothing():
    rng = random.Random(5)
    for k in range(2000):
        lengths = sorted(rng.sample(range(66_000 if k % 2 else 1, 400_000), rng.randint(1, 5)))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(1, sum(x * n for x, n in zip(lengths, counts, strict=True)))
        assert 0 <= best_sum(lengths, counts, budget) - words_taken(lengths, counts, budget) <= budget / 1000


def test_subset_with_few_states_stays_near():
    rng = random.Random(6)
    for _ in range(200):
        lengths = sorted({1, *(rng.randint(1, 400) for _ in range(6))})
        counts = [500, *(rng.randint(1, 5) for _ in lengths[1:])]
        budget = rng.randint(0, sum(x * n for x, n in zip(lengths, counts, strict=True)))
        assert budget - 16 <= words_taken(lengths, counts, budget, 64) <= budget


def test_equal_texts_have_equal_scores(spark):
    """Whatever their labels and folds, also where a text stands in several batches."""
    from logloom.llm.quality_classifier import classify_quality

    rng = random.Random(8)
    words = {q: ["".join(rng.choice("abcdefgh" if q else "lmnopqrs") for _ in range(5)) for _ in range(60)] for q in (0, 1)}
    texts = [" ".join(rng.choice(words[k % 3 > 0]) for _ in range(40)) + "." for k in range(200)]
    rows = [(k, texts[k % 200]) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 200 % 3 > 0)) for k in range(0, 600, 2) if k % 5], "doc_id long, quality int")
    found = {}
    for r in classify_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), labels).collect():
        found.setdefault(r.doc_id % 200, set()).add((r.score, r.held_out))
    assert all(len({s for s, _ in x}) == 1 for x in found.values()) and sum(len(x) > 1 for x in found.values()) > 100


def prose(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(60)) + "."


def test_pipeline_stages_tell_rows_of_one_id_apart(spark, tmp_path):
    passage = " ".join(prose(900).split()[:30])
    near = lambda text: text + " tail"
    rows = [(i, prose(i)) for i in range(20)]
    rows += [(None, prose(100)), (None, prose(101)), (None, "junk"), (None, passage), (None, near(prose(3))), (None, near(prose(101)))]
    rows += [(50, prose(200)), (50, prose(201)), (50, "junk"), (50, passage), (50, near(prose(200))), (7, prose(7)), (60, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(i, 1, 0) for i in (*range(20), 50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def run(stage, docs):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        return out, sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    words = lambda t: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4))
    want = sorted(((i, t) for i, t in rows if len((t or "").split()) >= 10), key=str)
    docs, got = run(corpus_pipeline.filter_quality, docs)
    assert got == want
    parent = list(range(len(want)))
    for a, (_, x) in enumerate(want):
        for b, (_, y) in enumerate(want):
            if 100 * len(words(x) & words(y)) >= 80 * len(words(x) | words(y)):
                parent = [parent[a] if p == parent[b] else p for p in parent]
    docs, got = run(corpus_pipeline.drop_near_copies, docs)
    groups = {p: [want[k] for k in range(len(want)) if parent[k] == p] for p in parent}
    assert len(got) == len(groups)
    for group in groups.values():
        kept = [r for r in got if r in group]
        assert len(kept) == 1 and kept[0][0] == min((i for i, _ in group if i is not None), default=None)
    want = sorted((r for r in got if r[1] != passage), key=str)
    docs, got = run(corpus_pipeline.decontaminated, docs)
    assert got == want and {i for i, _ in got} >= {None, 50}
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    assert all((r.doc_id, r.text) in got for r in mixed)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_rules_reject_all_above_the_calibrated_edge(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    label = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    got = [r for r in quality_rules(docs, labels).where("NOT base_failed").collect() if r.doc_id in label]
    good = sorted(r.anomaly for r in got if label[r.doc_id] == 1)
    edge = good[int(0.997 * len(good))] + 0.001  # a bin's width
    beyond = [r for r in got if label[r.doc_id] == 0 and r.anomaly > edge]
    assert beyond and not any(r.kept for r in beyond)
    assert sum(r.kept for r in got if label[r.doc_id] == 1) >= 0.997 * len(good)


def test_jaccard_chain_through_a_null_id(spark):
    w = [f"w{k}" for k in range(200)]
    chain = [(1, w), (None, w[7:] + [f"x{k}" for k in range(7)]), (3, w[14:] + [f"x{k}" for k in range(14)])]
    rows = [(i, " ".join(x)) for i, x in chain] + [(None, prose(5)), (None, prose(6)), (9, prose(7))]
    got = {(r.doc_id, r.n_links): r.component_id for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=90).collect()}
    assert got == {(1, 1): 1, (None, 2): 1, (3, 1): 1, (None, 0): None, (9, 0): 9}


def test_text_ids_survive_the_archive(spark):
    from logloom.llm.warc import capture_digest, round_trip

    ids = [" a", "a ", "b\r\nc", "x: y", "100%", "a+b", "é/ü", "", "\t", "plain"]
    pages = spark.createDataFrame([(i, "http://h/", "same page " * 20) for i in ids], "page_id string, url string, html string")
    got = {r.page_id: r.refers_to for r in capture_digest(round_trip(pages), pages).collect()}
    assert set(got) == set(ids) and {v for k, v in got.items() if v is not None} == {min(ids)}


def test_long_words_are_scored_in_small_groups():
    from logloom.llm.subword_lm import GROUP_CHARS, Lattice

    words = [b"w" * 300_000] * 3 + [b"ab"] * 50_000
    sizes = [(len(part), codes.shape[1]) for part, codes in Lattice.groups(words)]
    assert sum(n for n, _ in sizes) == len(words) and all(n == 1 or n * width <= GROUP_CHARS for n, width in sizes)


def test_decontamination_by_both_joins(spark, monkeypatch):
    """Windows that fit a broadcast and windows that don't, also of very long words and texts."""
    from logloom.llm import decontamination
    from logloom.llm.decontamination import decontaminate

    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["x" * 100_000]
    items = [(k, " ".join(rng.choice(words[:40]) for _ in range(rng.randint(1, 30)))) for k in range(20)] + [(99, " ".join(["x" * 100_000] * 14))]
    docs = [(k, " ".join([*(rng.choice(words[:40]) for _ in range(30)), rng.choice(items)[1]])) for k in range(30)] + [(200, "w1 " * 400_000), (201, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    first = sorted(map(str, decontaminate(d, b).collect()))
    monkeypatch.setattr(decontamination, "bounded", lambda df: df)
    assert sorted(map(str, decontaminate(d, b).collect())) == first and len(first) == 32
