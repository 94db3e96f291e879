"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and unlabelled text train a logistic model on rule statistics and on how much
more often the words and pairs of words of a text stand in positives than elsewhere. The class
prior is estimated from scores of a first model that tells positives from unlabelled text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, id_type, joined_by, map_arrow, materialise, tidy
from .jaccard_join import M1, mix
from .text_stats import FEATURES, features, stats

BINS = 400
#: Words are counted in so many hash buckets, and pairs of words in as many.
BUCKETS = 1 << 15
#: The model's inputs: the statistics, and the mean evidence of words and of pairs.
INPUTS = len(FEATURES) + 2


@dataclass(frozen=True)
class Scaler:
    """Centre and spread of each feature over the positives."""

    centre: np.ndarray
    spread: np.ndarray

    def expand(self, rows: np.ndarray) -> np.ndarray:
        """Scaled features, how far each lies off the centre, and a constant."""
        z = (rows - self.centre) / self.spread
        near, far = np.clip(z, -4, 4), np.log1p(np.maximum(np.abs(z) - 2, 0))
        return np.hstack([near, near**2 / 4, far, np.ones((len(rows), 1))])


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the words, and from BUCKETS on of the pairs of words, of a text."""
    words = (text or "").encode().lower().split()
    h = mix(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * M1)
    pairs = mix(h[:-1] * M1 + h[1:]) % np.uint64(BUCKETS) + np.uint64(BUCKETS)
    return np.unique(np.concatenate([h % np.uint64(BUCKETS), pairs])).astype(np.uint16)


def vectors(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """Per row: id, held_out, the statistics and, as 16-bit numbers, the buckets of its words and pairs."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(2).to_pylist()
            found = [features(stats(x)) for x in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64())), pa.array([grams(x).tobytes() for x in texts], pa.binary())], names=["id", "held_out", "features", "grams"])

        return each

    return map_arrow(docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text")), make, f"id {id_type(docs, id_col)}, held_out boolean, features array<double>, grams binary")


def buckets_of(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column, and the row of each."""
    many = np.array([len(x) // 2 for x in column.to_pylist()], np.int64)
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint16).astype(np.int64)
    return flat, np.repeat(np.arange(len(many)), many)


def gram_counts(train: DataFrame) -> np.ndarray:
    """counts[0, b] positives and counts[1, b] training rows that have bucket b; a table of fixed size, summed by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2 * BUCKETS), np.int64)
        for batch in batches:
            flat, row = buckets_of(batch.column(1))
            positive = np.array(batch.column(0).to_pylist(), bool)
            counts[0] += np.bincount(flat[positive[row]], minlength=2 * BUCKETS)
            counts[1] += np.bincount(flat, minlength=2 * BUCKETS)
        seen = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0, seen]), pa.array(counts[1, seen])], names=["bucket", "p", "u"])

    out = np.zeros((2, 2 * BUCKETS))
    for r in train.select("positive", "grams").mapInArrow(tidy(run), "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).collect():
        out[:, r.bucket] = r.p, r.u
    return out


def with_evidence(table: DataFrame, counts: np.ndarray, positives: int, rows: int, prior_rows: float = 2.0) -> DataFrame:
    """table with the mean evidence of its words and of its pairs behind the statistics: features, from the text alone, for scores.

    In own, a training row doesn't count itself: the model is fitted on that, or else it would
    trust words that only one row has.
    """
    kinds = table.schema["id"].dataType.simpleString()

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            held, positive = (np.array(batch.column(c).to_pylist(), bool) for c in ("held_out", "positive"))
            flat, row = buckets_of(batch.column("grams"))
            share = positives / max(rows, 1)
            parts = [(part, np.bincount(row[part], minlength=len(batch)) + 5) for part in (flat < BUCKETS, flat >= BUCKETS)]
            statistics = np.array(batch.column("features").to_pylist(), float).reshape(len(batch), -1)

            def whole(less_p: np.ndarray, less_u: np.ndarray) -> pa.ListArray:
                evidence = np.log((counts[0][flat] - less_p + prior_rows) / ((counts[1][flat] - less_u) * share + prior_rows))
                means = [np.bincount(row[part], evidence[part], minlength=len(batch)) / n for part, n in parts]
                return pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * INPUTS, pa.int32()), pa.array(np.hstack([statistics, np.array(means).T]).ravel()))

            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), batch.column("positive"), whole(np.zeros(1), np.zeros(1)), whole(positive[row], ~held[row])], names=["id", "held_out", "positive", "features", "own"])

        return each

    return map_arrow(table.select("id", "held_out", "positive", "features", "grams"), make, f"id {kinds}, held_out boolean, positive boolean, features array<double>, own array<double>")


def rows_of(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), INPUTS)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def sums(train: DataFrame, scaler: Scaler, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over all training rows that risk, gradient and Hessian need: one short column of numbers a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            x, positive = scaler.expand(rows_of(batch.column("features"))), np.array(batch.column("positive").to_pylist(), bool)
            z = x @ weights
            s, p = sigmoid(z), x[positive]
            total = total + np.array([float(len(x)), float(len(p)), softplus(z).sum(), softplus(-z[positive]).sum(), softplus(z[positive]).sum(), *(s @ x), *((s[positive] - 1) @ p), *(s[positive] @ p), *((x.T * (s * (1 - s))) @ x).ravel()])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["k", "v"])

    found = {r.k: r.v for r in train.select("positive", "features").mapInArrow(tidy(run), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    flat, d = np.array([found[k] for k in range(len(found))]), len(weights)
    u, p = max(flat[0], 1), max(flat[1], 1)
    return {"u": flat[0], "p": flat[1], "u_neg": flat[2] / u, "p_pos": flat[3] / p, "p_neg": flat[4] / p, "g_u": flat[5 : 5 + d] / u, "g_pos": flat[5 + d : 5 + 2 * d] / p, "g_neg": flat[5 + 2 * d : 5 + 3 * d] / p, "h_u": flat[5 + 3 * d :].reshape(d, d) / u}


def fit(train: DataFrame, scaler: Scaler, prior: float, steps: int, ridge: float = 1e-4, beta: float = 0.0) -> np.ndarray:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) by damped Newton steps over all rows.

    Where the second term falls under -beta, the step climbs back along it, as the non-negative
    estimator asks; otherwise logistic loss makes the risk convex.
    """
    d = 3 * INPUTS + 1
    weights, best, best_weights, rate = np.zeros(d), np.inf, np.zeros(d), 1.0
    for _ in range(steps):
        s = sums(train, scaler, weights)
        rest = s["u_neg"] - prior * s["p_neg"]
        risk = prior * s["p_pos"] + max(0.0, rest) + ridge / 2 * weights @ weights
        if risk < best:
            if best - risk < 1e-6:
                return weights
            best, best_weights, rate = risk, weights, min(1.0, rate * 2)
        else:
            weights, rate = (weights + best_weights) / 2, rate / 2
            if rate < 1e-3:
                break
            continue
        gradient = prior * s["g_pos"] + s["g_u"] - prior * s["g_neg"] if rest >= -beta else prior * s["g_neg"] - s["g_u"]
        step = np.linalg.solve(s["h_u"] + (ridge + 1e-3) * np.eye(d), gradient + ridge * weights)
        weights = weights - rate * step * min(1.0, 8 / max(np.abs(step).max(), 1e-9))
    return best_weights


def score(table: DataFrame, scaler: Scaler, weights: np.ndarray, extra: str, kinds: str) -> DataFrame:
    """The columns named in extra, and the model's probability."""
    names = extra.split()

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = sigmoid((scaler.expand(rows_of(batch.column("features"))) * weights).sum(axis=1))  # row by row: equal texts have equal scores to the last bit
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p)], names=[*names, "score"])

        return each

    return map_arrow(table.select(*names, "features"), make, f"{kinds}, score double")


def estimate_prior(train: DataFrame, scaler: Scaler, weights: np.ndarray, confidence: float = 0.05) -> float:
    """Share of positives in the unlabelled text, from its scores by a positive-against-unlabelled model.

    Any set of scores holds at least the share prior times its share of the positives. Of the
    sets above each bin, the one whose ratio plus the error of both shares is least gives the ratio.
    """
    counts = np.zeros((2, BINS))
    for r in score(train, scaler, weights, "positive", "positive boolean").groupBy("positive", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")).count().collect():
        counts[0, r.bin] += r["count"]
        counts[1, r.bin] += r["count"] * r.positive
    above = counts[:, ::-1].cumsum(axis=1)
    n = np.maximum(counts.sum(axis=1), 1)
    share = above / n[:, None]
    error = np.sqrt(np.log(4 / confidence) / 2 / n)
    ratio = (share[0] + error[0] + error[1]) / np.maximum(share[1], 1e-9)
    usable = share[1] > 0.1
    best = int(np.argmin(np.where(usable, ratio, np.inf)))
    return float(np.clip(share[0][best] / share[1][best] if usable.any() else 0.5, 0.02, 0.98))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_fold: int = 1, steps: int = 16) -> DataFrame:
    """Per row: id, held_out, score (0 to 1, higher: of quality), predicted, prior.

    Positives are the rows of label 1 outside the held-out fold; unlabelled text is every row
    outside it, whatever its label; both enter the risk in full. Ids and labels only choose the
    rows to learn from: the score is one function of the text, for training rows as for others,
    so equal texts have equal scores.

    A null text is empty and scored like one. Null ids are unlabelled. Several labels of one id:
    the largest. Without positives the score is 0.5. Repeated rows give repeated rows; an empty
    table gives none; other columns are ignored.
    """
    kind = id_type(docs, id_col)
    table = vectors(docs, id_col, text_col, fold(id_col, folds) == held_fold)
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).where("label = 1").select("id", F.lit(True).alias("known"), F.lit(1).alias("times"))
    # Vectors are long, labels short: labels that fit a broadcast, measured, spare the vectors the shuffle.
    table = materialise(joined_by(table, known, "id", "times").select("id", "held_out", (F.coalesce("known", F.lit(False)) & ~F.col("held_out")).alias("positive"), "features", "grams"), "quality-vectors")
    size = table.where("NOT held_out").agg(F.count("*").alias("rows"), F.count_if("positive").alias("positives")).first()
    table = materialise(with_evidence(table, gram_counts(table.where("NOT held_out")), size.positives, size.rows), "quality-inputs")
    train = table.where("NOT held_out").select("positive", F.col("own").alias("features"))
    moments = train.where("positive").select(*[f(F.col("features")[k]).alias(f"{name}{k}") for k in range(INPUTS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if moments["m0"] is None:
        return table.select(F.col("id").alias(id_col), "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"), F.lit(None).cast("double").alias("prior"))
    scaler = Scaler(np.array([moments[f"m{k}"] for k in range(INPUTS)]), np.maximum([moments[f"s{k}"] for k in range(INPUTS)], 1e-3))
    prior = estimate_prior(train, scaler, fit(train, scaler, 0.5, steps))
    weights = fit(train, scaler, prior, steps)
    return score(table, scaler, weights, "id held_out", f"id {kind}, held_out boolean").select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.lit(prior).alias("prior"))
