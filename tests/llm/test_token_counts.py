"""Token counts from remembered pieces against the library on whole texts."""

import random
import re

import pytest
from logloom.llm.token_counts import batch_counter
from logloom.llm.token_files import remembered

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


def test_pieces_are_remembered_and_sum_to_whole_texts():
    rng = random.Random(9)
    signs = ["a", "The", "it's", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "\u0085", "\x1c", "2024", ",", "...", "Straße", "日本語", "。", "😀", "<|endoftext|>", "<|endof", "'s", "½5", "́", "word,", "\x00"]
    texts = ["", " ", "\n", "x" * 3000, " word" * 2000, " <|endoftext|> ", "日本語の文章です。" * 300, "zqxjkremember once"] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    content = open(PATH, "rb").read()
    tokenizer = tokenizers.Tokenizer.from_str(content.decode())
    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    for piece_chars, batch_bytes in ((64, 500), (16_384, 262_144)):
        assert batch_counter(PATH, content, piece_chars, batch_bytes)(texts) == want
    assert any(re.fullmatch(" ?zqxjkremember", x) for x in remembered(content))
