"""Quality rules: an isolation forest on rule statistics, calibrated on labelled rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_arrow, materialise
from .text_stats import FEATURES, features, stats

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Scores are calibrated on a histogram with this many bins.
BINS = 1000
#: The forest splits on these features: not on length or language, nor on what the base bounds.
SPLIT_ON = [FEATURES.index(x) for x in ("mean_word", "symbol_rate", "distinct_rate", "top_rate", "upper_rate", "loud_rate", "long_rate")]


@dataclass
class IsolationForest:
    """Trees of random axis-parallel splits; a short mean path to a leaf marks an odd row.

    fit() draws tree_rows rows for each of n_trees trees from the rows given, and stops a tree
    at depth log2(tree_rows), as the method's authors do. Reruns with one seed agree.
    """

    n_trees: int = 128
    tree_rows: int = 256
    seed: int = 7
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    depth: int = 0
    norm: float = 1.0

    @staticmethod
    def mean_path(n: np.ndarray | float) -> np.ndarray:
        """Mean path length of an unsuccessful search in a binary tree of n rows."""
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def fit(self, rows: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        size = min(self.tree_rows, len(rows))
        self.depth, self.norm = max(1, int(np.ceil(np.log2(max(size, 2))))), max(float(self.mean_path(size)), 1e-9)
        for _ in range(self.n_trees):
            column, cut, left, path = [], [], [], []
            todo = [(rows[rng.choice(len(rows), size, replace=False)], 0, 0)]
            for store, value in ((column, 0), (cut, np.inf), (left, 0), (path, 0.0)):
                store.append(value)
            while todo:
                part, at, depth = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                wide = np.flatnonzero(high > low)
                left[at], path[at] = at, depth + float(self.mean_path(len(part)))
                if depth >= self.depth or len(part) < 2 or not len(wide):
                    continue
                k = int(rng.choice(wide))
                column[at], cut[at], left[at] = k, float(rng.uniform(low[k], high[k])), len(cut)
                for store, value in ((column, 0), (cut, np.inf), (left, 0), (path, 0.0)):
                    store += [value, value]
                below = part[:, k] < cut[at]
                todo += [(part[below], left[at], depth + 1), (part[~below], left[at] + 1, depth + 1)]
            self.trees.append((np.array(column), np.array(cut), np.array(left), np.array(path)))
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the mean path, the higher."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for column, cut, left, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = left[at] + (rows[each, column[at]] >= cut[at])  # a leaf's cut is infinite and it points to itself
            total += path[at]
        return 2.0 ** -(total / max(1, len(self.trees)) / self.norm)


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the counts of the rules (long), the features of the forest (array<double>) and the columns keep as keep_*."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [stats(x) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([int(s[c]) for s in found], pa.int64()) for c in COUNTS), pa.array([features(s) for s in found], pa.list_(pa.float64())), *batch.columns[2:]], names=["id", *COUNTS, "features", *batch.schema.names[2:]])

        return each

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep]), make, f"id {id_type(docs, id_col)}, {', '.join(f'{c} long' for c in COUNTS)}, features array<double>" + kept_schema(docs, keep))


def kept_schema(docs: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f", keep_{c} {id_type(docs, c)}" for c in keep)


def matrix(column: pa.ListArray) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), len(FEATURES))[:, SPLIT_ON]


def threshold(good: np.ndarray, keep: float) -> float:
    """From the histogram of the good rows' scores, the score above which rows are rejected.

    The least edge of a bin with which at least the share keep of the good rows stays. Without good rows: 1 (all stay).
    """
    if not good.sum():
        return 1.0
    return (int(np.searchsorted(np.cumsum(good), keep * good.sum())) + 1) / len(good)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 8192, keep: float = 0.997, min_words: int = 10, repeat_percent: int = 20, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, counts, base_failed, anomaly (double, 0 to 1) and kept.

    base_failed: fewer than min_words words, or over repeat_percent % of the words in repeated
    5-word windows. Of the others, the forest rejects those whose anomaly is above a threshold
    calibrated on all labelled rows. The forest is fitted on a bounded sample: the fit_rows
    labelled rows with the smallest hashes, of either label; all else covers all rows.

    A null text is empty (base_failed). Several labels of one id: the largest counts. No labels:
    base_failed alone decides. Repeated rows give repeated rows; an empty table gives none; carry
    names further columns of docs to return, others are ignored.
    """
    carried = [F.col(f"keep_{c}").alias(c) for c in carry]
    table = materialise(
        rule_statistics(docs, id_col, text_col, carry).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))),
        "rule-statistics",
    )
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).where("label IS NOT NULL")
    labelled = table.where("NOT base_failed").join(known, "id").select("id", "features", "label")
    rows = labelled.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(fit_rows).select("features").collect()
    if not rows:
        return table.select(F.col("id").alias(id_col), *COUNTS, "base_failed", F.lit(0.0).alias("anomaly"), (~F.col("base_failed")).alias("kept"), *carried)
    forest = IsolationForest(seed=seed).fit(np.array([r.features for r in rows])[:, SPLIT_ON])

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = forest.score(matrix(batch.column("features")))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "features"), pa.array(scores)], names=[*(c for c in batch.schema.names if c != "features"), "anomaly"])

        return each

    kind = id_type(docs, id_col)
    binned = map_arrow(labelled.select("id", "label", "features"), make, f"id {kind}, label {labelled.schema['label'].dataType.simpleString()}, anomaly double")
    histogram = np.zeros(BINS)
    for r in binned.where("label = 1").groupBy(F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).alias("bin")).count().collect():
        histogram[r.bin] += r["count"]
    limit = threshold(histogram, keep)
    scored = map_arrow(table, make, f"id {kind}, {', '.join(f'{c} long' for c in COUNTS)}{kept_schema(docs, carry)}, base_failed boolean, anomaly double")
    return scored.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "anomaly", (~F.col("base_failed") & (F.col("anomaly") <= limit)).alias("kept"), *carried)
