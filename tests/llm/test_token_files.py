"""Wavelet matrices against plain arrays, and written and read token ids against the library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import token_files
from logloom.llm.token_files import encoder, occurrences, open_shard, read_tokens, shard_file, token_digest, write_tokens

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, id string, nth long, partition long, at long, start long, shard string"


def library():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def texts(seed=4):
    rng = random.Random(seed)
    signs = ["a", "the", "The", "it's", "don't", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "\u0085", "\x1c", "1", "2024", ",", ".", "...", "é", "Straße", "日本語", "。", "😀", "<|endoftext|>", "<|endof", "'s", "'", "_", "²", "½5", "Ⅷ", "x_", "-_", "\u0301", "word,", "Wort.", "été!?", "​", "\x00"]
    out = [None, "", " ", "\n", "x" * 30_000, "word " * 20_000, "<|endoftext|>", " <|endoftext|> ", "日本語の文章です。" * 500]
    return out + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(500)]


@pytest.mark.parametrize("bits", [1, 5, 16, 17])
def test_wavelet_matrix(bits, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BITS", 64)
    rng = np.random.default_rng(bits)
    ids = (rng.zipf(1.3, 700) % (1 << bits)).astype(np.uint32)
    head, lengths, matrix = open_shard(shard_file(ids, ["a", "b"], [300, 400], bits, {"partition": 3, "nth": 0, "before": 9}) + b"\n")
    assert head["partition"] == 3 and lengths.tolist() == [300, 400]
    assert matrix.all().tolist() == ids.tolist() == [matrix.access(i) for i in range(len(ids))]
    for token in {*ids[:40].tolist(), (1 << bits) - 1, 0, 1 << bits}:
        places = np.flatnonzero(ids == token).tolist()
        assert matrix.count(token) == len(places) and matrix.count(token, 100, 333) == sum(100 <= x < 333 for x in places)
        assert [matrix.locate(token, k) for k in range(len(places))] == places
        with pytest.raises(IndexError):
            matrix.locate(token, len(places))
    assert open_shard(shard_file(ids[:0], [], [], bits, {}))[2].all().tolist() == []


def test_pieces_are_encoded_as_the_library_encodes_whole_texts(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_PIECES", 200)  # forgets most
    encode, _ = encoder(open(PATH, "rb").read())
    known = library()
    for k in range(0, 500, 50):
        part = [x or "" for x in texts(k)]
        assert [x.tolist() for x in encode(pa.array(part))] == [known(x) for x in part]


def expected(rows):
    known, at, out = library(), 0, []
    for doc_id, text in rows:
        ids = np.asarray([*known(text), 0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    return out


def test_written_and_read_back(spark, tmp_path):
    rows = [(10 * k - 300, t) for k, t in enumerate(texts())]
    shuffled = random.Random(1).sample(rows, len(rows))
    frame = spark.createDataFrame([(*r, "i", 1, 2, 3, 4, "s") for r in shuffled], SCHEMA).repartition(5)
    path = str(tmp_path / "tokens")
    write_tokens(frame, PATH, path, shard_tokens=3000)
    want = expected(rows)
    got = sorted(map(tuple, read_tokens(spark, path).collect()))
    assert got == want
    assert len([x for x in (tmp_path / "tokens").iterdir() if x.name.startswith("part") and x.stat().st_size]) > 8
    token = library()(" the")[0] if any(library()(" the")[0] in w[4] for w in want) else library()("the")[0]
    assert sorted(map(tuple, occurrences(spark, path, token).collect())) == sorted((w[0], k) for w in want for k, x in enumerate(w[4]) if x == token)
    assert sorted(map(tuple, token_digest(frame, PATH, str(tmp_path / "again")).collect())) == [w[:4] for w in want]


def test_repeats_nulls_and_no_rows(spark, tmp_path):
    rows = [(5, "same"), (5, "same"), (None, "no id"), (None, None), (7, "last")]
    frame = spark.createDataFrame([(*r, "i", 1, 2, 3, 4, "s") for r in rows], SCHEMA)
    got = sorted(token_digest(frame, PATH, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 5, 5, 7]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert token_digest(frame.limit(0), PATH, str(tmp_path / "b")).count() == 0
    text_ids = spark.createDataFrame([("b", "two words"), ("a", "one")], "doc_id string, text string")
    assert [r.doc_id for r in token_digest(text_ids, PATH, str(tmp_path / "c")).orderBy("start").collect()] == ["a", "b"]
