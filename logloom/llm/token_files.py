"""Token ids in files: a wavelet matrix per shard, compressed, with access, counting and lookup from the file alone.

A shard file holds, in this order: MAGIC; the length of the head (8 bytes, little-endian); the
head (JSON: where the shard lies in the order of all shards, how many tokens and bits, the
documents' ids, and per block how many bytes it takes and how many ones lie before it); the
documents' lengths; the blocks. Bit-plane k holds bit k (from the highest) of each id, in the
order that sorting by the bits before it, last bit first, leaves; a plane is cut into blocks of
BLOCK_BITS bits, each compressed by itself, so that a rank or select reads one block of a plane.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import sys
import types
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_type, materialise, tidy
from .row_patterns import levels, scanned

MAGIC = b"logloom wavelet 1\n"
#: Bits of a block; a shard holds at most so many tokens, or one document.
BLOCK_BITS, SHARD_TOKENS = 1 << 17, 1 << 22
#: So many pieces of text, of so many characters at most, are remembered with their ids.
KNOWN_PIECES, KNOWN_CHARS = 1 << 20, 64
#: White space after anything else starts a piece: no token of a byte-level vocabulary runs across that.
PIECE, SPACES = re.compile(r"(?<=\S)(?=[ \n\t\r])"), re.compile(r"\s")
#: A line feed, letters with a blank before them, and signs: each begins a token of its own. An apostrophe may stand with the letters after it.
WORD = re.compile(r"(\n)?( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([^\w\s']+)?")
#: Blanks beside other white space or at an end (for RE2, all white space of Unicode): there a single blank doesn't start a piece.
ODD_BLANKS = r"[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}] | [\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]|^ | $"
FAN = 64


class WaveletMatrix:
    """Access, rank and select over ids from compressed bit-planes; blocks are opened as they are asked for."""

    def __init__(self, n: int, bits: int, sizes: list[list[int]], ones: list[list[int]], data: memoryview) -> None:
        self.n, self.bits, self.ones, self.data = n, bits, ones, data
        ends = np.cumsum([x for plane in sizes for x in plane]).tolist()
        at = iter([0, *ends])
        self.places = [[next(at) for _ in plane] for plane in sizes]
        self.ends = iter(ends)
        self.sizes = sizes
        self.zeros = [n - plane[-1] for plane in ones]
        self.opened: dict[tuple[int, int], np.ndarray] = {}

    def block(self, plane: int, k: int) -> np.ndarray:
        """The bits of a block, one a byte."""
        if (plane, k) not in self.opened:
            if len(self.opened) >= 4 * self.bits:
                self.opened.clear()
            at = self.places[plane][k]
            raw = np.frombuffer(zlib.decompress(self.data[at : at + self.sizes[plane][k]]), np.uint8)
            self.opened[plane, k] = np.unpackbits(raw, count=min(BLOCK_BITS, self.n - k * BLOCK_BITS), bitorder="little")
        return self.opened[plane, k]

    def rank(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, BLOCK_BITS)
        return self.ones[plane][k] + (int(np.count_nonzero(self.block(plane, k)[:rest])) if rest else 0)

    def select(self, plane: int, bit: int, nth: int) -> int:
        """Where the nth (from 0) one or zero of a plane is."""
        ones = self.ones[plane]
        before = ones if bit else [min(k * BLOCK_BITS, self.n) - x for k, x in enumerate(ones)]
        k = bisect_right(before, nth) - 1
        return k * BLOCK_BITS + int(np.flatnonzero(self.block(plane, k) == bit)[nth - before[k]])

    def access(self, i: int) -> int:
        out = 0
        for plane in range(self.bits):
            k, rest = divmod(i, BLOCK_BITS)
            bit = int(self.block(plane, k)[rest])
            out = out << 1 | bit
            i = self.zeros[plane] + self.rank(plane, i) if bit else i - self.rank(plane, i)
        return out

    def span(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the token's occurrences in low to high (end exclusive) lie after the last plane."""
        if token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self.rank(plane, low), self.rank(plane, high)
            low, high = (self.zeros[plane] + a, self.zeros[plane] + b) if token >> (self.bits - 1 - plane) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        a, b = self.span(token, low, self.n if high is None else high)
        return b - a

    def locate(self, token: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of a token."""
        a, b = self.span(token, 0, self.n)
        if not 0 <= nth < b - a:
            raise IndexError(nth)
        i = a + nth
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            i = self.select(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def all(self) -> np.ndarray:
        """All ids, plane by plane from the last."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for plane in range(self.bits - 1, -1, -1):
            raw = b"".join(zlib.decompress(self.data[at : at + size]) for at, size in zip(self.places[plane], self.sizes[plane], strict=True))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            earlier = np.empty_like(values)
            earlier[~ones] = values[: self.zeros[plane]]
            earlier[ones] = values[self.zeros[plane] :] | kind(1 << (self.bits - 1 - plane))
            values = earlier
        return values


def squeezed(block: bytes) -> bytes:
    """A block compressed: bits repeat in runs of bytes, so that longer matches aren't looked for."""
    made = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, zlib.DEF_MEM_LEVEL, zlib.Z_RLE)
    return made.compress(block) + made.flush()


def planes(ids: np.ndarray, bits: int) -> tuple[list[list[int]], list[list[int]], list[bytes]]:
    """Sizes and earlier ones of the blocks of each plane (ones: with the total at the end), and the compressed blocks."""
    ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    sizes, before, blocks = [], [], []
    for plane in range(bits):
        ones = (ids & ids.dtype.type(1 << (bits - 1 - plane))) != 0
        packed = np.packbits(ones, bitorder="little").tobytes()
        step = BLOCK_BITS // 8
        parts = [squeezed(packed[k : k + step]) for k in range(0, len(packed), step)]
        sizes.append([len(x) for x in parts])
        before.append([0, *np.cumsum([int(np.count_nonzero(ones[k : k + BLOCK_BITS])) for k in range(0, len(ids), BLOCK_BITS)]).tolist()])
        blocks += parts
        if plane + 1 < bits:
            ids = np.concatenate((ids[~ones], ids[ones]))
    return sizes, before, blocks


def shard_file(ids: np.ndarray, documents: list, lengths: list[int], bits: int, where: dict) -> bytes:
    """A whole shard file; where: partition, nth and before (tokens of the partition before it)."""
    sizes, ones, blocks = planes(ids, bits)
    head = json.dumps({**where, "tokens": len(ids), "bits": bits, "documents": documents, "sizes": sizes, "ones": ones}).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, np.asarray(lengths, "<u8").tobytes(), *blocks])


def open_shard(content: bytes) -> tuple[dict, np.ndarray, WaveletMatrix]:
    """Head, lengths of the documents, and the wavelet matrix of a shard file."""
    view = memoryview(content)
    if bytes(view[: len(MAGIC)]) != MAGIC:
        raise ValueError("not a shard file")
    at = len(MAGIC) + 8
    (size,) = struct.unpack("<Q", view[len(MAGIC) : at])
    head = json.loads(bytes(view[at : at + size]))
    at += size
    lengths = np.frombuffer(view[at : at + 8 * len(head["documents"])], "<u8").astype(np.int64)
    at += 8 * len(head["documents"])
    return head, lengths, WaveletMatrix(head["tokens"], head["bits"], head["sizes"], head["ones"], view[at:])


def ranked(code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers below most among code, and for each of code its place among them: np.unique without a sort."""
    met = np.zeros(most, bool)
    met[code] = True
    return np.flatnonzero(met), (np.cumsum(met, dtype=np.int32) - np.int32(1))[code]


def remembered(content: bytes) -> dict[str, bytes]:
    """Pieces and their ids that this worker process has met with a vocabulary: it serves many tasks."""
    holder = sys.modules.setdefault("_logloom_pieces", types.ModuleType("_logloom_pieces"))
    return holder.__dict__.setdefault(f"v{zlib.crc32(content)}_{len(content)}", {})


def encoder(content: bytes) -> tuple[Callable[[pa.Array], list[np.ndarray]], int]:
    """A function from texts to their ids (32 bits), and the size of the vocabulary.

    Where the library splits texts at white space anyway, each distinct piece of a text is
    encoded by it once and remembered; texts with added tokens, and other vocabularies, go to it whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode("utf-8"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    splitter = tokenizer.pre_tokenizer
    by_piece = type(splitter).__name__ == "ByteLevel" and tokenizer.normalizer is None and splitter.use_regex and not splitter.add_prefix_space
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    known = remembered(content)

    def asked(texts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(texts), 4096):
            found = [e.ids for e in tokenizer.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False)]
            ends = list(accumulate(map(len, found), lambda at, n: at + 4 * n, initial=0))
            whole = np.fromiter(chain.from_iterable(found), "<u4", ends[-1] // 4).tobytes()  # one array for all: most texts are a piece of a few ids
            out += [whole[a:b] for a, b in pairwise(ends)]
        return out

    def ids_of(words: list[str]) -> list[bytes]:
        """Ids of pieces; of a plain word its letters and the signs behind it are looked up apart."""
        out = list(map(known.get, words))
        plain, others, new = [], [], {}
        for k in [k for k, x in enumerate(out) if x is None]:
            word = words[k]
            if word[1:].isalpha() and word.isascii() and (word[0] == " " or word[0].isalpha()):  # as most are: letters, with a blank before them or not
                plain.append(k)
                new[word] = None
                continue
            found = WORD.fullmatch(word)
            xs = [x for x in found.groups() if x] if found else [word] if word.isascii() and not SPACES.search(word, 1) else PIECE.split(word)
            others.append((k, xs))
            for x in xs:
                if x not in known:
                    new[x] = None
        names = list(new)
        new = dict(zip(names, asked(names), strict=True))
        for k in plain:
            out[k] = new[words[k]]
        for k, xs in others:
            out[k] = b"".join([new[x] if x in new else known[x] for x in xs])
        room = KNOWN_PIECES - len(known)
        if room > 0:  # parts first: other words have them too
            known.update({x: ids for x, ids in new.items() if len(x) <= KNOWN_CHARS})
            known.update({words[k]: out[k] for k, _ in others if len(words[k]) <= KNOWN_CHARS})
            for x in list(islice(reversed(known), max(0, len(known) - KNOWN_PIECES))):
                del known[x]
        return out

    def split(texts: pa.Array) -> list[np.ndarray]:
        """Arrow cuts at each single blank and numbers the distinct pieces; the first piece of a text has no blank before it."""
        lists = pc.split_pattern(texts, " ")
        starts = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False) + np.int32(len(coded.dictionary))
        code[starts[:-1]] -= len(coded.dictionary)
        used, code = ranked(code, 2 * len(coded.dictionary))
        words = coded.dictionary.take(pa.array(used % len(coded.dictionary))).to_numpy(zero_copy_only=False).tolist()
        found = ids_of([w if k < len(coded.dictionary) else " " + w for k, w in zip(used.tolist(), words, strict=True)])
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, place = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        many = size[code]
        ends = np.cumsum(many)
        at = np.repeat((place[code] - (ends - many)).astype(np.int32), many)  # a batch has far fewer ids than 2**31
        at += np.arange(len(at), dtype=np.int32)
        ids = pool[at]
        edges = np.append(0, ends)[starts]
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def encode(column: pa.Array) -> list[np.ndarray]:
        """Millions of small objects are made and none in circles: the collector, which would look through them again and again, waits."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return encoded(column.fill_null(""))
        finally:
            if collects:
                gc.enable()

    def encoded(column: pa.Array) -> list[np.ndarray]:
        whole = np.full(len(column), not by_piece)
        for text in special:
            whole |= pc.match_substring(column, text).to_numpy(zero_copy_only=False)
        odd = ~whole & pc.match_substring_regex(column, ODD_BLANKS).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(column)
        for which, how in ((whole, lambda a: [np.frombuffer(x, "<u4") for x in asked(a.to_pylist())]), (odd, lambda a: [np.frombuffer(b"".join(ids_of(PIECE.split(x))), "<u4") for x in a.to_pylist()]), (~whole & ~odd, split)):
            places = np.flatnonzero(which)
            if len(places):
                for k, ids in zip(places.tolist(), how(column.take(pa.array(places))), strict=True):
                    out[k] = ids
        return out

    return encode, tokenizer.get_vocab_size(with_added_tokens=True)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode the texts, each followed by end_id, and write them as shard files under path, in ascending order of ids.

    Texts are range-split by id, and each range writes its shards; special strings in a text
    follow the library's default. A null text is empty; rows without an id come first; rows of one
    id are ordered by a hash of their text; repeated rows are written as often; an empty table
    gives no shards; other columns are ignored, whatever their names. The vocabulary travels with
    the function.
    """
    with open(tokenizer_path, "rb") as file:
        content = file.read()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Copies of one row may be very many: they are told apart by where they were read.
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("nth")]
    rows = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, vocabulary = encoder(content)
        bits = max(vocabulary - 1, end_id, 1).bit_length()
        end, partition, nth, before = np.array([end_id], "<u4"), TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        documents: list = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal nth, before
            ids = np.concatenate(held)
            found = shard_file(ids, documents, lengths, bits, {"partition": partition, "nth": nth, "before": before})
            nth, before = nth + 1, before + len(ids)
            for kept in (held, documents, lengths):
                kept.clear()
            return pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], names=["shard"])

        total = 0
        for batch in batches:
            for row_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                size = len(ids) + 1
                if held and total + size > shard_tokens:
                    yield flush()
                    total = 0
                held += (ids, end)
                documents.append(row_id)
                lengths.append(size)
                total += size
        if held:
            yield flush()

    # One file a shard, through Spark's own writer: any store, and a lost task leaves nothing behind. The line end after the last block is ignored.
    rows.mapInArrow(tidy(shards), "shard binary").select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content")


def read_tokens(spark: SparkSession, path: str, id_kind: str = "long", with_ids: bool = True) -> DataFrame:
    """Per document of the shard files under path: id, start (ids of all documents before it), n_tokens (with the end), ids_crc32, and its ids if with_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in chain.from_iterable(b.column(0) for b in batches):
            head, lengths, matrix = open_shard(content.as_buffer())
            ids = matrix.all().astype("<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [pa.array([head["partition"]] * len(lengths), pa.int64()), pa.array(head["documents"]), pa.array(starts + head["before"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int32))))
            kinds = [pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=False)], names=["partition", "id", "at", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    kind = pa.string() if id_kind == "string" else pa.int64()
    schema = f"partition long, id {'string' if id_kind == 'string' else 'long'}, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = shard_files(spark, path).mapInArrow(tidy(run), schema)
    found = materialise(found, "token-rows")
    # How many ids the ranges before hold: sums of ranges, composed in a tree.
    total = found.groupBy("partition").agg(F.sum("n_tokens").alias("n")).select(F.col("partition").alias("at"), F.to_json(F.struct("n")).alias("state"))
    earlier = scanned(levels(materialise(total, "token-sums"), add, FAN), add, FAN).select(F.col("at").alias("partition"), F.coalesce(F.get_json_object("before", "$.n").cast("long"), F.lit(0)).alias("earlier"))
    found = found.join(earlier.hint("shuffle_hash") if with_ids else earlier, "partition")
    return found.select(F.col("id").cast(id_kind), (F.col("at") + F.col("earlier")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def add(left: dict | None, right: dict | None) -> dict | None:
    return {"n": left["n"] + right["n"]} if left and right else left or right


def occurrences(spark: SparkSession, path: str, token: int, id_kind: str = "long") -> DataFrame:
    """Per occurrence of a token in the shard files: id of the document and offset in it, found by select in the bit-planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in chain.from_iterable(b.column(0) for b in batches):
            head, lengths, matrix = open_shard(content.as_buffer())
            places = np.asarray([matrix.locate(token, k) for k in range(matrix.count(token))], np.int64)
            ends = np.cumsum(lengths)
            owner = np.searchsorted(ends, places, "right")
            yield pa.RecordBatch.from_arrays([pa.array([head["documents"][k] for k in owner.tolist()], pa.string() if id_kind == "string" else pa.int64()), pa.array(places - (ends - lengths)[owner], pa.int64())], names=["id", "offset"])

    return shard_files(spark, path).mapInArrow(tidy(run), f"id {'string' if id_kind == 'string' else 'long'}, offset long").select(F.col("id").cast(id_kind), "offset")


def token_digest(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id") -> DataFrame:
    """Write the ids of docs under path, read them back, and state where each document's ids lie and their CRC-32."""
    write_tokens(docs, tokenizer_path, path, id_col)
    return read_tokens(docs.sparkSession, path, id_type(docs, id_col), with_ids=False).withColumnRenamed("id", id_col)
