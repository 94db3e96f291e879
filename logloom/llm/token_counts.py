"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_arrow
from .token_files import encoder

#: A piece of a long text has about this many characters.
PIECE_CHARS = 16_384
#: One call of the library gets at most about this many bytes.
BATCH_BYTES = 262_144
#: A space or line feed right after a letter or digit of any script, a full stop or a comma, or a mark of CJK
#: right after a letter or digit: no token of a byte-level vocabulary runs across the start of it, and what follows it is split alike.
SAFE = re.compile(r"(?<=[^\W_]|[.,])[ \n]|(?<=[^\W_])(?=[\u3001\u3002\uff0c\uff1b\uff1a\uff1f\uff01\u300c\u300d\u300e\u300f])")


def split_text(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of text that end at safe boundaries; one piece where there is none."""
    start = 0
    while len(text) - start > piece_chars:
        found = SAFE.search(text, start + piece_chars)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def batch_counter(path: str, content: bytes, piece_chars: int, batch_bytes: int) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts for a .json (tokenizers) or .model (sentencepiece) file."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
        # Pieces of sentencepiece may depend on what stands before a space: texts stay whole.
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    encode, _ = encoder(content)
    made = json.loads(content)
    # Only the byte-level splitter is known to restart at SAFE; others get whole texts.
    whole = (made.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or made.get("normalizer") is not None

    def count(texts: list[str]) -> list[int]:
        counts, pending, owners, size = [0] * len(texts), [], [], 0

        def flush() -> None:
            nonlocal size
            for owner, ids in zip(owners, encode(pa.array(pending, pa.string())), strict=True):
                counts[owner] += len(ids)
            pending.clear()
            owners.clear()
            size = 0

        for i, text in enumerate(texts):
            for piece in [text] if whole else split_text(text, piece_chars):
                if piece:
                    pending.append(piece)
                    owners.append(i)
                    size += len(piece) if piece.isascii() else len(piece.encode())
                    if size >= batch_bytes:
                        flush()
        if pending:
            flush()
        return counts

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The vocabulary file is read once on the driver and travels with the function, so that
    executors need no file. Batches are filled by size, long texts are cut at safe boundaries, each
    distinct piece between white space is encoded once a worker and remembered, and only lengths
    come back. Special strings in a text follow the library's default.
    Nulls and empty texts have 0 bytes and tokens; repeated rows give repeated rows; an empty
    table gives none; other columns of docs are ignored.
    """
    with open(tokenizer_path, "rb") as file:
        content = file.read()

    def make():
        count = batch_counter(tokenizer_path, content, piece_chars, batch_bytes)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(count(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

        return each

    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {id_type(docs, id_col)}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
