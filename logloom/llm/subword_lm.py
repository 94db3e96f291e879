"""LM scoring: marginal likelihood of a text over all segmentations into subword pieces.

The vocabulary is an existing one; its scores start the piece probabilities, which expectation
maximisation over the training words then fits. Pieces never cross white space, so a text's
probability is the product of its words' marginals and the probability of its end, and each
distinct word is scored once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_type, map_arrow, materialise, tidy

#: Each task counts words in a table of at most this many, then hands it on.
TASK_WORDS = 300_000
#: At most this many words, the most frequent, are sent to every worker; the others are joined.
KNOWN_WORDS = 200_000
#: And at most so many bytes of words; and words of one length are scored together up to so many characters.
KNOWN_BYTES, GROUP_CHARS = 8 * 1024 * 1024, 400_000
#: Additive smoothing of word counts (fixed by the contract) and of piece counts.
WORD_PRIOR, PIECE_PRIOR = 0.1, 0.1
SPACE = "▁"
END = b""


class Lattice:
    """Forward and backward recursions over the segmentation lattices of many words at once.

    Pieces are looked up by a rolling hash in one open table for each piece length. A character
    that is no piece itself falls back to the pieces of its UTF-8 bytes.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str], logp: np.ndarray, byte_ids: list[int]) -> None:
        self.logp, self.byte_ids = np.append(logp, -np.inf), np.array(byte_ids)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p:
                by_length.setdefault(len(p), []).append(i)
        self.tables = {k: self._table([pieces[i] for i in ids], ids) for k, ids in sorted(by_length.items())}
        self.longest = max(self.tables, default=1)

    def _table(self, pieces: list[str], ids: list[int]) -> tuple[np.ndarray, np.ndarray, int, int]:
        bits = max(4, int(np.ceil(np.log2(8 * len(pieces)))))
        keys, values, most = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), 1
        codes = np.array([[ord(c) for c in p] for p in pieces], np.uint64)
        hashes = np.zeros(len(pieces), np.uint64)
        for k in range(codes.shape[1]):
            hashes = hashes * self.BASE + codes[:, k]
        for h, i in zip(hashes.tolist(), ids, strict=True):
            slot, probes = self._slot(h, bits), 1
            while values[slot] >= 0:
                slot, probes = (slot + 1) % (1 << bits), probes + 1
            keys[slot], values[slot], most = h, i, max(most, probes)
        return keys, values, bits, most

    @staticmethod
    def _slot(h: int, bits: int) -> int:
        return (h * 0xD1342543DE82EF95 & (1 << 64) - 1) >> (64 - bits)

    def _find(self, length: int, h: np.ndarray) -> np.ndarray:
        keys, values, bits, most = self.tables[length]
        slot = ((h * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - bits)).astype(np.int64)
        out = np.where(keys[slot] == h, values[slot], -1)
        for k in range(1, most):
            at = (slot + k) & ((1 << bits) - 1)
            out = np.where((out < 0) & (keys[at] == h), values[at], out)
        return out

    def arcs(self, codes: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """For each piece length the piece ids by start (-1: none), and the log weight of the byte fallback by position (-inf: unused)."""
        n, h, found = codes.shape[1], None, {}
        for k in range(1, min(self.longest, n) + 1):
            h = codes if h is None else h[:, : n - k + 1] * self.BASE + codes[:, k - 1 :]
            if k in self.tables:
                ids = self._find(k, h)
                if k == 1 or (ids >= 0).any():
                    found[k] = ids
        single = found.setdefault(1, np.full(codes.shape, -1))
        fallback = np.full(codes.shape, -np.inf)
        if (missing := single < 0).any():
            for c in np.unique(codes[missing]):
                fallback[missing & (codes == c)] = sum(self.logp[self.byte_ids[b]] for b in chr(int(c)).encode("utf-8", "surrogatepass"))
        return found, fallback

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        stack = np.array(terms)
        top = stack.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(stack - safe).sum(axis=0))

    def forward(self, codes: np.ndarray, arcs: tuple[dict[int, np.ndarray], np.ndarray]) -> list[np.ndarray]:
        found, fallback = arcs
        alpha = [np.zeros(len(codes))]
        for j in range(1, codes.shape[1] + 1):
            alpha.append(self._sum([alpha[j - k] + self.logp[ids[:, j - k]] for k, ids in found.items() if k <= j] + [alpha[j - 1] + fallback[:, j - 1]]))
        return alpha

    def expect(self, codes: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> None:
        """Add to counts how often each piece is used in the words, in expectation."""
        arcs = found, fallback = self.arcs(codes)
        alpha, n = self.forward(codes, arcs), codes.shape[1]
        beta = [np.zeros(len(codes))] * (n + 1)
        for i in range(n - 1, -1, -1):
            beta[i] = self._sum([self.logp[ids[:, i]] + beta[i + k] for k, ids in found.items() if i + k <= n] + [fallback[:, i] + beta[i + 1]])
            for k, ids in found.items():
                if i + k <= n and (used := ids[:, i] >= 0).any():
                    p = np.exp(alpha[i] + self.logp[ids[:, i]] + beta[i + k] - alpha[n]) * weights
                    counts += np.bincount(ids[used, i], p[used], len(counts))
            for at in np.flatnonzero(np.isfinite(fallback[:, i])):
                p = float(np.exp(alpha[i][at] + fallback[at, i] + beta[i + 1][at] - alpha[n][at]) * weights[at])
                for b in chr(int(codes[at, i])).encode("utf-8", "surrogatepass"):
                    counts[self.byte_ids[b]] += p

    @staticmethod
    def groups(words: list[bytes], most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and code points of words of one length each, the mark of a word's start in front."""
        texts = [SPACE + w.decode("utf-8", "replace") for w in words]
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            step = max(1, min(most, GROUP_CHARS // int(lengths[order[a]])))
            for at in range(a, b, step):
                part = order[at : min(b, at + step)]
                yield part, np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), -1).astype(np.uint64)

    def score(self, words: list[bytes]) -> np.ndarray:
        """log10 marginal probability of each word."""
        out = np.zeros(len(words))
        for part, codes in self.groups(words):
            out[part] = self.forward(codes, self.arcs(codes))[-1] / np.log(10)
        return out


def read_vocabulary(path: str) -> tuple[list[str], np.ndarray, list[int]]:
    """Pieces (empty for control and byte pieces), log probabilities from their scores, and the ids of the 256 byte pieces.

    Scores of a unigram model are log probabilities. Scores that are negative ranks, as merges
    have them, become Zipf's law over the ranks.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    scores = np.array([model.get_score(i) for i in range(size)])
    plain = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(size)])
    pieces = [model.id_to_piece(i) if plain[i] else "" for i in range(size)]
    by_rank = (scores[plain] == np.round(scores[plain])).all()
    logp = -np.log(np.abs(np.maximum(scores, -1e7)) + 2.7) if by_rank else scores.astype(float)
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):  # a vocabulary without byte pieces gets its own
        byte_ids = list(range(size, size + 256))
        pieces, logp = pieces + [""] * 256, np.append(logp, np.full(256, logp[plain].min()))
    logp[byte_ids] = min(logp[byte_ids].min(), logp[np.append(plain, np.zeros(len(logp) - size, bool))].min())
    logp[[i for i in range(len(logp)) if not pieces[i] and i not in set(byte_ids)]] = -np.inf
    return pieces, logp - np.log(np.exp(logp).sum()), byte_ids


def count_words(docs: DataFrame, id_col: str, text_col: str, held_folds: int) -> DataFrame:
    """word (binary; empty: the end), c in training rows, and all: in all rows. Distinct words, tables bounded in each task."""
    rows = docs.select((fold(id_col, held_folds) == 0).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush(kind: int) -> pa.RecordBatch:
            words, numbers = list(counts[kind]), np.fromiter(counts[kind].values(), np.int64, len(counts[kind]))
            counts[kind].clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(numbers * (kind == 0)), pa.array(numbers)], names=["word", "c", "all"])

        for batch in batches:
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = counts[int(held)]
                mine.update((text or "").encode().lower().split())
                mine[END] += 1
                if len(mine) > TASK_WORDS:
                    yield flush(int(held))
        for kind in (0, 1):
            if counts[kind]:
                yield flush(kind)

    return rows.mapInArrow(tidy(run), "word binary, c long, all long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("all").alias("all"))


def fit_pieces(words: DataFrame, pieces: list[str], logp: np.ndarray, byte_ids: list[int], ends: int, rounds: int) -> np.ndarray:
    """Piece log probabilities (natural) after rounds of expectation maximisation over all training words.

    The ends of the texts take their share of the probability. Without training words the
    scores of the vocabulary stay.
    """
    usable = np.isfinite(logp)
    for _ in range(rounds):
        now = logp

        def make(now=now):
            lattice = Lattice(pieces, now, byte_ids)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                counts, weights = np.zeros(len(now)), np.array(batch.column(1).to_pylist(), float)
                for part, codes in lattice.groups(batch.column(0).to_pylist()):
                    lattice.expect(codes, weights[part], counts)
                used = np.flatnonzero(counts)
                return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], names=["piece", "n"])

            return each

        found = map_arrow(words.where("c > 0").where(F.length("word") > 0).select("word", "c"), make, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most one row a piece
        counts = np.where(usable, PIECE_PRIOR, 0.0)
        for r in found:
            counts[r.piece] += r.n
        with np.errstate(divide="ignore"):
            logp = np.log(counts) - np.log(counts.sum() + max(ends, 1))
    return logp


def score_texts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", held_folds: int = 10, rounds: int = 1) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the smoothed word-unigram log10 probability; score the subword-lattice one. The
    words of training rows (fold not 0 of held_folds) give all counts. At most KNOWN_WORDS words
    go to the workers, whatever the corpus; a text's other words are joined to the word table, so
    every word counts. Null and empty texts are their end alone; rows with equal id and text are
    scored once and returned as often as they came; an empty table gives none; other columns are
    ignored.
    """
    pieces, logp, byte_ids = read_vocabulary(vocabulary_path)
    words = materialise(count_words(docs, id_col, text_col, held_folds), "lm-words")
    total = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum(F.when(F.length("word") == 0, F.col("c"))).alias("ends")).first()
    n, v, ends = total.n or 0, total.v or 0, total.ends or 0
    logp = fit_pieces(words, pieces, logp, byte_ids, ends, rounds)
    # Pieces and the end share the probability; unfitted scores leave the end one half.
    if not (ends and rounds):
        logp = logp - np.log(2)
    end_score = log10(max(1 - np.exp(logp[np.isfinite(logp)]).sum(), 1e-300))

    def scorer():
        lattice = Lattice(pieces, logp, byte_ids)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = batch.column(0).to_pylist()
            marginal = np.where([len(w) > 0 for w in found], lattice.score(found), end_score) if found else np.zeros(0)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(marginal, pa.float64())], names=["word", "c", "all", "marginal"])

        return each

    words = materialise(map_arrow(words, scorer, "word binary, c long, all long, marginal double"), "lm-scored-words")
    # The most frequent words, down to a count that keeps their number and their bytes within bounds.
    level = F.floor(F.log2("all") * 16)
    sizes = words.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("size")).collect()  # some hundred levels
    top, kept, taken = None, 0, 0
    for at, number, size in sorted(((r.level, r.n, r["size"] or 0) for r in sizes), reverse=True):
        if kept + number > KNOWN_WORDS or taken + size > KNOWN_BYTES:
            break
        top, kept, taken = at, kept + number, taken + size
    known = words.where(level >= top).select("word", "c", "marginal").collect() if top is not None else []
    per_word = log10(n + WORD_PRIOR * (v + 1)) if n + v else 0.0
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast((b"\n".join(r.word for r in known), np.array([r.c for r in known], np.int64), np.array([r.marginal for r in known])))
    some = bool(known)
    kind = id_type(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), (fold(id_col, held_folds) == 0).alias("held_out"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.col(text_col).alias("text"))

    def head():
        joined, c, marginal = table.value
        at = {w: i for i, w in enumerate(joined.split(b"\n"))} if some else {}
        log_c = np.log10(c + WORD_PRIOR)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            index, word, tf, tokens, base, hits, score, first = [], [], [], [], [], [], [], []
            for i, (h, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                counts = Counter((text or "").encode().lower().split())
                counts[END] += 1
                slots = [at.get(w, -1) for w in counts]
                numbers = np.fromiter(counts.values(), np.int64, len(counts))
                here = np.array(slots)
                if (here < 0).any():
                    rest = [w for w, s in zip(counts, slots, strict=True) if s < 0]
                    index += [i] * len(rest)
                    word += rest
                    tf += numbers[here < 0].tolist()
                    for store in (tokens, base, hits, score, first):
                        store += [0] * len(rest)
                inside, many = here[here >= 0], numbers[here >= 0]
                index.append(i)
                word.append(b"\xff" + h.to_bytes(8, "big", signed=True))  # no word, and spread over the partitions
                tf.append(0)
                tokens.append(int(numbers.sum()))
                base.append(float(log_c[inside] @ many))
                hits.append(int(many[c[inside] > 0].sum()))
                score.append(float(marginal[inside] @ many))
                first.append(1)
            take = pa.array(index, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(word, pa.binary()), pa.array(tf, pa.int64()), pa.array(tokens, pa.int64()), pa.array(base, pa.float64()), pa.array(hits, pa.int64()), pa.array(score, pa.float64()), pa.array(first, pa.int64())], names=["id", "held_out", "h", "word", "tf", "tokens", "base", "hits", "score", "first"])

        return each

    parts = map_arrow(rows, head, f"id {kind}, held_out boolean, h long, word binary, tf long, tokens long, base double, hits long, score double, first long")
    rare = words.where(level < top) if top is not None else words
    joined = parts.join(rare.select("word", "c", "marginal"), "word", "left")
    tf = F.col("tf")
    sums = joined.groupBy("id", "held_out", "h").agg(
        F.sum("first").alias("copies"),
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("hits") + F.when(F.col("c") > 0, tf).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(tf > 0, tf * F.log10(F.coalesce("c", F.lit(0)) + WORD_PRIOR)).otherwise(0)).alias("base"),
        F.sum(F.col("score") + F.coalesce(tf * F.col("marginal"), F.lit(0.0))).alias("score"),
    )
    one = lambda c: (F.col(c) / F.col("copies")).cast("long")
    sums = sums.select(F.col("id").alias(id_col), "held_out", one("n_tokens").alias("n_tokens"), one("n_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies") - one("n_tokens") * F.lit(per_word)).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"), "copies")
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")
