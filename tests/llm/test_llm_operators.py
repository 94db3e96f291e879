"""Each operator against brute force or a round trip, on rows with nulls, repeats, ties and clashing columns."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.llm import pii, warc
from logloom.llm.decontamination import contamination_digest, decontaminate
from logloom.llm.jaccard_join import jaccard_join
from logloom.llm.mixing import mix, subset, with_targets
from logloom.llm.quality_classifier import classify_quality
from logloom.llm.quality_rules import quality_rules
from logloom.llm.subword_lm import Lattice, read_vocabulary, score_texts
from logloom.llm.suffix_dedup import suffix_dedup
from logloom.llm.text_stats import stats
from logloom.llm.token_counts import count_tokens, split_text

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string, id string, node long, n long, c long, key string, h long"


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(12, 160))) + "." for _ in range(60)]
    for i in range(12):  # near copies
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += texts[:5] + ["", "   ", "one", "two words", "Ünïcode Wörds Ä é 日本 " * 8, "x" * 3000, "a b " * 4000]
    rows = [(i, t, f"s{i % 4}" if i % 9 else None) for i, t in enumerate(texts)]
    return rows + [(900, None, "s1"), (901, None, None), rows[3], rows[3], (None, "null id words here", "s2")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "k", 4) for r in rows], SCHEMA).repartition(3)


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def words_of(text):
    return (text or "").encode().lower().split()


OPERATORS = {
    "tokens": lambda d, labels: count_tokens(d, tokenizers.path("byte_bpe_50k.json")),
    "rules": quality_rules,
    "classifier": classify_quality,
    "pii": lambda d, labels: pii.find_pii(d),
    "jaccard": lambda d, labels: jaccard_join(d),
    "lm": lambda d, labels: score_texts(d, tokenizers.path("piece_bpe_32k.model")),
    "decontaminate": lambda d, labels: decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "mix": lambda d, labels: mix(d),
    "suffix": lambda d, labels: suffix_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    empty = frame(spark, []).where("1 = 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert OPERATORS[name](empty, labels).count() == 0


def test_token_counts(spark, rows):
    from tokenizers import Tokenizer

    rows = [*rows, (950, "a<|endoftext|>b  c <|endoftext|>\n\n  d", "s1"), (951, "it's 12 " * 9000, "s1"), (952, "日本語の文章、続く。かな「引用」１２３。" * 900, "s1"), (953, "ñandú élève² " * 4000 + "é" * 3000, "s1")]
    t = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    got = by_id(count_tokens(frame(spark, rows), tokenizers.path("byte_bpe_50k.json"), piece_chars=500, batch_bytes=3000))
    for i, text, _ in rows:
        n = len(t.encode(text or "", add_special_tokens=False))
        assert all((r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 1024) for r in got[i])
    assert sum(map(len, got.values())) == len(rows)
    assert "".join(split_text("ab cd\nef" * 500, 64)) == "ab cd\nef" * 500


def test_rule_counts_and_verdict(spark, rows):
    bad = [(1000 + i, " ".join(f"w{j}###$$$" for j in range(i, i + 60)), "s0") for i in range(4)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(1000 + i, 0, 0) for i in range(4)] + [(0, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules(frame(spark, rows + bad), labels))
    for i, text, _ in rows:
        w = (text or "").split(None)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        for r in got[i]:
            assert (r.n_words, r.n_repeat_words) == (len(w), len(hit)) and r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
            assert not (r.base_failed and r.kept)
    assert not any(r.kept for i, _, _ in bad for r in got[i]) and all(r.kept for i in range(60) for r in got[i])
    assert stats("a\nb\n\na\n \na #$")["n_dup_lines"] == 1 and stats("a\nb #$")["n_symbols"] == 2


def test_classifier_learns_from_positives(spark):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 90))) + "."
    data = [(i, good() if i % 4 else good().upper().replace(" ", "!! "), "s") for i in range(800)] + [(2000, None, "s"), (2000, None, "s")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(800) if i % 3], "doc_id long, quality int, toxic int")
    got = by_id(classify_quality(frame(spark, data), labels))
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i][0].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(800))
    assert sum(got[i][0].predicted == int(i % 4 > 0) for i in held) / len(held) > 0.95
    assert abs(got[1][0].prior - 0.75) < 0.12 and len(got[2000]) == 2 and all(0 <= r.score <= 1 for x in got.values() for r in x)


def test_pii_base_matches_plain_patterns(spark):
    import re

    rng = random.Random(3)
    pieces = ["a.b@c-d.com", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "@", "é", " ", ".", "-", "99", "+", "a@b.c@d.e", "0" * 30]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        want = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(d)]
        want += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
        assert pii.detect(text) == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2])))


DISGUISED = {
    "write to john at example dot com now": ["john at example dot com"],
    "mail john.doe [at] example [dot] co (dot) uk!": ["john.doe [at] example [dot] co (dot) uk"],
    "call plus one five five five one two three four five six seven ok": ["plus one five five five one two three four five six seven"],
    "jоhn@exаmple.com": ["jоhn@exаmple.com"],
    "４１１１ １１１１ １１１１ １１１１": ["４１１１ １１１１ １１１１ １１１１"],
    "ip one nine two dot one six eight dot one dot nine": ["one nine two dot one six eight dot one dot nine"],
    "look at example.com": [], "one, two, three": [], "he stood at the dot in a row": [], "meet at noon": [],
}


@pytest.mark.parametrize("text", DISGUISED)
def test_pii_disguises(text):
    base, spans = pii.find(text)
    assert [text[a:b] for a, b, _ in spans] == DISGUISED[text] and set(base) <= set(spans)


def planted(rng):
    """(kind, identifier) with a value of each kind."""
    name = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    yield "email", f"{name(6)}.{name(4)}@{name(7)}.{rng.choice(['com', 'org', 'net', 'co.uk'])}"
    yield "ip", ".".join(str(rng.randint(1, 255)) for _ in range(4))
    digits = [rng.randint(1, 9) for _ in range(15)]
    check = next(c for c in range(10) if pii.luhn("".join(map(str, [*digits, c]))))
    card = "".join(map(str, [*digits, check]))
    yield "card", " ".join(card[i : i + 4] for i in range(0, 16, 4))
    yield "phone", f"+{rng.randint(1, 9)} {rng.randint(200, 999)} {rng.randint(200, 999)} {rng.randint(1000, 9999)}"


WORDS = dict(zip("0123456789", "zero one two three four five six seven eight nine".split()))
LOOKS = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р", "x": "х", "i": "і", "1": "１", "2": "２", "3": "٣", "7": "７", "0": "０", "@": "＠"}


def disguises(rng, kind, value):
    """value in other dress: look-alikes, characters without width, spelled digits, at and dot in words or brackets."""
    yield "".join(LOOKS.get(c, c) if rng.random() < 0.6 else c for c in value)
    yield "\u200b".join(value)
    if kind == "email":
        local, domain = value.split("@")
        yield f"{local} at {domain.replace('.', ' dot ')}"
        yield f"{local.replace('.', ' dot ')} [at] {domain.replace('.', ' [dot] ')}"
        yield f"{local}(at){domain.replace('.', '(dot)')}"
    else:
        say = lambda c: WORDS.get(c, {"+": "plus", ".": "dot"}.get(c, c))
        yield " ".join(say(c) for c in value if c != " ")
        if kind != "ip":
            k = value.rindex(value.strip("+")[-1])
            yield f"{value[:k]} {WORDS[value[k]]}" if value[k - 1] == " " else " ".join([*value.split()[:-1], *(WORDS[c] for c in value.split()[-1])])


def test_pii_recall_of_planted_disguises():
    rng = random.Random(12)
    found, all_ = Counter(), Counter()
    wrong = 0
    for _ in range(120):
        for kind, value in planted(rng):
            for dressed in disguises(rng, kind, value):
                text = f"Please note {dressed} , thanks"
                base, spans = pii.find(text)
                at = (text.index(dressed), text.index(dressed) + len(dressed), kind)
                all_[kind] += 1
                found[kind] += any(k == kind and abs(a - at[0]) <= 1 and abs(b - at[1]) <= 1 for a, b, k in spans)
                wrong += any(b <= at[0] or a >= at[1] for a, b, k in spans)
                assert set(base) <= set(spans)
    assert all(found[k] >= 0.9 * all_[k] for k in pii.KINDS), (found, all_)
    assert not wrong


def test_pii_frame(spark, rows):
    got = by_id(pii.pii_digest(pii.find_pii(frame(spark, [*rows, (970, "mail a@b.co and +1 (555) 123-4567", "s")]))))
    assert got[900][0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[900][0].spans == ""
    assert got[970][0].spans == "email:5:11,phone:16:33" and (got[970][0].n_email, got[970][0].n_phone) == (1, 1)
    assert pii.mask("mail a@b.co!", [(5, 11, "email")]) == "mail [EMAIL]!"


@pytest.mark.parametrize("shingle,percent,counted", [(3, 90, True), (5, 80, False), (1, 50, True), (1, 50, False)])
def test_jaccard_join(spark, rows, shingle, percent, counted, monkeypatch):
    monkeypatch.setattr("logloom.llm.jaccard_join.LEAF", 3)  # many leaves to a home
    monkeypatch.setattr("logloom.llm.common.SAMPLE", 1)  # some keys go the way of very frequent ones
    monkeypatch.setattr("logloom.llm.common.HOT_TIMES", 4)
    rng = random.Random(8)
    crowd = [f"c{k}" for k in range(60)]
    rows = [*rows, *((1000 + i, " ".join(w if rng.random() > 0.08 else f"e{rng.randrange(40)}" for w in crowd), "s1") for i in range(60))]
    got = by_id(jaccard_join(frame(spark, rows), shingle=shingle, percent=percent, count_links=counted))
    sets = {}
    for i, text, _ in rows:
        w = words_of(text)
        sets[i] = frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset()
    ids = sorted((i for i in sets if i is not None))
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(set)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
    for i in ids:
        assert all((r.n_shingles, r.component_id, r.n_links) == (len(sets[i]), root(i), len(links[i]) if counted else None) for r in got[i]), i
    assert sum(map(len, got.values())) == len(rows)


def test_lattice_is_the_sum_over_segmentations():
    pieces, logp, byte_ids = read_vocabulary(tokenizers.path("piece_bpe_32k.model"))
    at = {p: i for i, p in enumerate(pieces) if p}
    words = [b"the", b"segmentation", "日x".encode(), "é😀".encode(), b"a" * 40]
    for word, got in zip(words, Lattice(pieces, logp, byte_ids).score(words), strict=True):
        text = "▁" + word.decode()
        sums = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                if text[i:j] in at:
                    sums[j] += sums[i] * math.exp(logp[at[text[i:j]]])
                elif j == i + 1:
                    sums[j] += sums[i] * math.exp(sum(logp[byte_ids[b]] for b in text[i:j].encode()))
        assert got == pytest.approx(math.log10(sums[-1]))


@pytest.mark.parametrize("known", [200_000, 20])
def test_lm_base_score(spark, rows, known, monkeypatch):
    from logloom.llm import subword_lm

    monkeypatch.setattr(subword_lm, "KNOWN_WORDS", known)
    got = by_id(score_texts(frame(spark, rows), tokenizers.path("piece_bpe_32k.model")))
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    counts = Counter(w for i, t, _ in rows if fold(i) for w in [*words_of(t), b""])
    n, v = sum(counts.values()), len(counts)
    for i, text, _ in rows:
        w = [*words_of(text), b""]
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 0, len(w), sum(counts[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) and r.score < 0
    assert sum(map(len, got.values())) == len(rows)


def test_decontamination_both_ways(spark, rows, monkeypatch):
    from logloom.llm import decontamination

    items = [(0, rows[0][1]), (1, " ".join(rows[1][1].split()[3:19])), (2, "two words"), (3, None), (4, ""), (1, rows[2][1]), (None, rows[4][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    plain = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in "".join(c.lower() if c.isascii() else c for c in t or "")).split()
    results = []
    for side in (decontamination.bounded, lambda df: df):  # then nothing is small enough
        monkeypatch.setattr(decontamination, "bounded", side)
        results.append(by_id(contamination_digest(decontaminate(frame(spark, rows), table))))
    for i, text, _ in rows:
        w, hit, found = plain(text), set(), set()
        for item, t in items:
            x = plain(t)
            for k in range(max(1, len(x) - 12) if x else 0):
                win = x[k : k + 13]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found |= {str(item)} if item is not None else set()
        want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
        for got in results:
            assert all(tuple(r)[1:] == want for r in got[i]), i


def test_lm_scores_of_texts_by_brute_force(spark):
    """One round of expectation maximisation over all segmentations of the training words, then the sum over a text's words and its end."""
    from logloom.llm.subword_lm import PIECE_PRIOR

    path = tokenizers.path("piece_bpe_32k.model")
    pieces, logp, byte_ids = read_vocabulary(path)
    at = {p: i for i, p in enumerate(pieces) if p}
    texts = ["the cat sat", "a cat", "the hat the hat", "é日", "", None, "zq the", "hat a sat cat", "Cat"]
    rows = [(i, t, "s") for i, t in enumerate(texts * 4)]

    def paths(text):
        """All segmentations as lists of piece numbers."""
        if not text:
            yield []
        for j in range(1, len(text) + 1):
            own = [at[text[:j]]] if text[:j] in at else [byte_ids[b] for b in text.encode()[: len(text[0].encode())]] if j == 1 else None
            if own is not None:
                yield from (own + rest for rest in paths(text[j:]))

    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    train = Counter(w.decode() for i, t, _ in rows if not held(i) for w in words_of(t))
    ends = sum(not held(i) for i, _, _ in rows)
    counts = [PIECE_PRIOR if math.isfinite(x) else 0.0 for x in logp]
    for word, n in train.items():
        ways = list(paths("\u2581" + word))
        weight = [math.exp(sum(logp[k] for k in way)) for way in ways]
        for way, x in zip(ways, weight):
            for k in way:
                counts[k] += n * x / sum(weight)
    total = sum(counts) + ends
    prob = [c / total for c in counts]
    for r in score_texts(frame(spark, rows), path).collect():
        want = math.log10(1 - sum(prob))
        for w in words_of(texts[r.doc_id % len(texts)]):
            want += math.log10(sum(math.prod(prob[k] for k in way) for way in paths("\u2581" + w.decode())))
        assert r.score == pytest.approx(want, rel=1e-6) and r.held_out == held(r.doc_id)


LONG = ("word{} and{} more " * 60_000).format(*range(120_000))  # a text of 1.5 MB


@pytest.mark.parametrize("name", ["tokens", "rules", "classifier", "pii", "jaccard", "lm", "mix", "suffix"])
def test_a_very_long_text_beside_short_ones(spark, name):
    rows = [(1, LONG, "a"), (2, LONG + "end", "b"), (3, "日" * 400_000, "a"), (4, "short text of a few words", None), (5, "x" * 1_200_000, "b")]
    labels = spark.createDataFrame([(4, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(OPERATORS[name](frame(spark, rows), labels))
    assert sorted(got) == [1, 2, 3, 4, 5]
    if name == "jaccard":
        assert got[2][0].component_id == 1 and got[1][0].n_shingles == 180_000 - 4
    if name == "suffix":
        assert got[2][0].n_removed == len(LONG) and got[5][0].n_removed == 1_200_000 - 1
    if name == "mix":
        assert got[1][0]["size"] == 180_000


def test_targets(spark):
    from logloom.llm.mixing import ranked_sources

    def targets(sizes):
        rows = spark.createDataFrame([(n, s, 1) for n, s in sizes.items()], "source string, size long, n long").repartition(3)
        return {r.source: r.target for r in with_targets(ranked_sources(rows)).collect()}

    assert targets({"a": 100, "b": 100, "c": 100}) == pytest.approx({"a": 50, "b": 100, "c": 150})
    got = targets({"B": 1000, "a": 10, None: 10})
    assert (got["a"], got[None]) == (30.0, 30.0) and sum(got.values()) == pytest.approx(1020)
    assert targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0} and targets({"\U0001F600": 50, "\uFFEE": 50, "z": 50}) == pytest.approx({"z": 25, "\uFFEE": 50, "\U0001F600": 75})


def test_subset_is_the_nearest():
    rng = random.Random(2)
    for _ in range(300):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 6)))
        counts = [rng.randint(1, 5) for _ in lengths]
        budget = rng.randint(0, sum(x * n for x, n in zip(lengths, counts)) + 5)
        take = subset(lengths, counts, budget)
        assert all(0 <= k <= n for k, n in zip(take, counts))
        sums = {0}
        for x, n in zip(lengths, counts):
            sums = {s + x * k for s in sums for k in range(n + 1)}
        best, got = max(s for s in sums if s <= budget), sum(x * k for x, k in zip(lengths, take))
        assert got == best, (lengths, counts, budget)
    assert subset([3, 5], [4, 4], 16) == [2, 2] and subset([7], [3], 20) == [2]


@pytest.mark.parametrize("broadcast", [True, False])
def test_mix_takes_rows_without_ids_and_alike(spark, monkeypatch, broadcast):
    from logloom.llm import common, mixing

    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(common.bounded, "__defaults__", (-1,))
        monkeypatch.setattr(common, "HOT_SHARE", 3)
    text = lambda k: " ".join(f"w{k}" for _ in range(10))
    rows = [(None, text(k), "a") for k in range(40)] + [(1, text(0), "b")] * 100 + [(None, text(k % 3), None) for k in range(60)] + [(5, None, "b"), (6, "", None)]
    got = mix(frame(spark, rows)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"] and (r["size"] or not r.repeats)
    assert len(got) == len(rows) and all(0 <= target[s] - taken[s] < 10 for s in target), (taken, target)


def test_mix(spark, rows, monkeypatch):
    from logloom.llm import mixing

    rows = [r for r in rows if len(words_of(r[1])) < 1000]  # a document longer than a target can't be taken
    first = sorted(map(tuple, mix(frame(spark, rows)).collect()), key=str)
    assert first == sorted(map(tuple, mix(frame(spark, rows[::-1])).collect()), key=str)
    monkeypatch.setattr(mixing, "SLICE_ROWS", 3)
    got = mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= max(60, 0.03 * t) for s, t in target.items()) and sum(target.values()) == pytest.approx(sum(len(words_of(t)) for _, t, _ in rows))


def test_warc_round_trip(spark):
    body = "<p>" + "é" * 100 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>"
    pages = [(5, "http://a/x y", body), (3, "http://b/", body), (7, None, body), (8, "u", None), (9, "u", ""), (10, "u", "tiny"), (11, "u", "tiny"), (3, "http://b/", body), (None, "n", body), (12, "http://c/", "z" * 99)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    captures = warc.round_trip(table, payload=True)
    got = warc.capture_digest(captures, table).collect()
    assert len(got) == len(pages)
    for r in got:
        text = (next(h for i, _, h in pages if i == r.page_id) or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(text), hashlib.sha256(text).hexdigest())
        again = len(text) >= 100 and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if again else ("response", None))
    whole = [r.response.payload for r in captures.collect() if r.response.type == "response"]
    assert body.encode() in [bytes(x) for x in whole]
    assert warc.assemble(spark.createDataFrame([], warc.RECORD)).count() == 0
    assert warc.round_trip(table.where("1 = 0").withColumn("digest", F.lit(1)).withColumn("body", F.lit("x"))).count() == 0
    long = spark.createDataFrame([(1, "u", "é" * 1_500_000), (2, "u", "x" * 70_000), (3, "u", "é" * 1_500_000)], "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("page", F.lit("x"))
    again = {r.page_id: r for r in warc.capture_digest(warc.round_trip(long), long).collect()}
    assert (again[1].payload_bytes, again[2].payload_bytes, again[3].refers_to) == (3_000_000, 70_000, 1)


def brute_suffix(rows):
    seen, out = set(), {}
    for i, text in sorted({(i, t) for i, t, _ in rows if i is not None}, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("crowd,block", [(1000, 1 << 19), (6, 256)])
def test_suffix_dedup(spark, crowd, block, monkeypatch):
    suffix_dedup_module = sys.modules["logloom.llm.suffix_dedup"]
    monkeypatch.setattr(suffix_dedup_module, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup_module, "BLOCK", block)
    rng = random.Random(3)
    base = ["".join(rng.choice("ab ") for _ in range(400)) for _ in range(3)]
    rows = []
    for i in range(70):
        t = rng.choice(base)
        t = t[: rng.randint(0, 399)] + rng.choice(["", "x", "é" * rng.randint(1, 60)]) + t[rng.randint(0, 399) :]
        rows.append((i, "a" * rng.randint(90, 400) if rng.random() < 0.1 else t * rng.randint(1, 2), "s"))
    rows += [(200, "", "s"), (201, None, "s"), (202, rows[5][1], "s"), rows[7]]
    got, want = by_id(suffix_dedup(frame(spark, rows))), brute_suffix(rows)
    for i, w in want.items():
        assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w and r.n_spans == len(r.spans) for r in got[i]), i
    assert len(got[7]) == 2
