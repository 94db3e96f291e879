"""Mixing sources to target weights: counts by exact length, knapsack for the rest, seeded picks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_by, materialise

#: The weights of the sources in order, repeating, and how often a document may be taken.
WEIGHTS, MOST = (1, 2, 3), 3
#: The dynamic programme keeps at most about this many sums, whatever the size of the source.
KNAPSACK_STATES = 65_536
#: So many documents of a length, at most, are put back before the dynamic programme chooses among them again.
GIVEN_BACK = 3
#: A (source, length) group is ranked in slices of about this many documents.
SLICE_ROWS = 20_000


def word_count(text_col: str) -> Column:
    """Words of the text, apart by ASCII white space; a null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def programme(lengths: list[int], counts: list[int], budget: int, states: int) -> list[int]:
    """How many documents of each length to take for the most words within budget: a bounded knapsack.

    Sums are kept by their multiple of a unit, one for each, so that there are about states of
    them whatever the budget; up to states words (of which the lengths' common divisor is one)
    the result is the best there is, beyond that it misses little more than a unit. Copies come
    in powers of two. by[b] is the item that made the sum kept for b; what it added to was made
    by earlier items, as a sum is never replaced.
    """
    step = math.gcd(*lengths) or 1
    best = budget - budget % step
    unit = step * -(-best // (step * states)) or 1
    reached, by, items = np.full(best // unit + 1, -1, np.int64), np.full(best // unit + 1, -1, np.int32), []
    reached[0], last = 0, best // unit
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        left, power = min(counts[i], best // lengths[i]) if lengths[i] else 0, 1
        while left > 0 and reached[last] < 0:
            k = min(power, left)
            sums = reached[reached >= 0] + k * lengths[i]
            sums = sums[sums <= best]
            sums = sums[reached[sums // unit] < 0]
            reached[sums // unit], by[sums // unit] = sums, len(items)
            items.append((i, k))
            left, power = left - k, power * 2
    take, words = [0] * len(lengths), int(reached.max())
    while words:
        i, k = items[by[words // unit]]
        take[i] += k
        words -= k * lengths[i]
    return take


def subset(lengths: list[int], counts: list[int], budget: int, states: int = KNAPSACK_STATES) -> list[int]:
    """How many documents of each length to take so that their words come nearest under budget.

    Every length gives its proportional share first. A few documents of each go back, and the
    programme chooses among them and all others; then again with no more given back than it
    settles exactly. What misses the budget is compared with the programme over the whole budget, and the
    nearer of the two counts.
    """
    total = sum(x * n for x, n in zip(lengths, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    words = lambda take: sum(x * k for x, k in zip(lengths, take, strict=True))

    def improved(take: list[int], window: int | None) -> list[int]:
        rest, kept = budget - words(take), list(take)
        for i, x in enumerate(lengths):
            k = min(take[i], GIVEN_BACK, (window - rest) // x if window is not None else GIVEN_BACK) if x else 0
            if k > 0:
                kept[i], rest = kept[i] - k, rest + k * x
        more = programme(lengths, [n - k for n, k in zip(counts, kept, strict=True)], rest, states)
        found = [a + b for a, b in zip(kept, more, strict=True)]
        return found if words(found) > words(take) else take

    found = []
    for first in ([n * budget // total for n in counts], [0] * len(counts)):
        found.append(improved(improved(first, None), states))
        if words(found[-1]) == budget - budget % math.gcd(*lengths):
            break
    return max(found, key=words)


def ranked_sources(histogram: DataFrame) -> DataFrame:
    """(source, source_size, nth): the sources numbered from 0 in code-point order, null last; ranges are numbered apart."""
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")).withColumn("last", F.col("source").isNull())
    ranges = max(1, histogram.sparkSession.sparkContext.defaultParallelism)
    sources = materialise(sources.repartitionByRange(ranges, "last", "source").withColumn("range", F.spark_partition_id()), "mix-sources")
    before = sources.groupBy("range").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    nth = F.row_number().over(Window.partitionBy("range").orderBy("last", "source")) - 1
    return sources.withColumn("in_range", nth).join(F.broadcast(before), "range").select("source", "source_size", (F.col("before") + F.col("in_range")).alias("nth"))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources with target: shares of all words by weight, none above most times its source's size.

    What is above goes back to the others by weight until none is; sources without words get 0.
    Every round is one sum over the sources, and ends the sources that are full.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    sources = materialise(sources.withColumn("weight", weight), "mix-weights")
    unit, full = 0.0, -1
    while True:
        is_full = F.col("weight") * unit > F.lit(most) * F.col("source_size")
        now = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(is_full, F.col("source_size")).otherwise(0)).alias("ended"), F.sum(F.when(~is_full, F.col("weight")).otherwise(0)).alias("open"), F.count_if(is_full).alias("full")).first()
        if now.full == full or not now.open:
            return sources.select("source", "source_size", F.when(is_full, most * F.col("source_size")).otherwise(F.col("weight") * unit).cast("double").alias("target"))
        full, unit = now.full, max(unit, (now["all"] - most * now.ended) / now.open)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 11, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, source, size (words), source_size, target, repeats (0 to most) and taken words.

    Sources stand in code-point order, null last, and weigh 1, 2, 3 in turn. A source's documents
    are all taken as often as its target holds its size; for the rest of the target, documents are
    counted by exact length, a bounded knapsack over the whole rest says how many of each length to take, and those
    with the smallest seeded hashes are taken. The same rows give the same mix, in any order.

    A text without words, or null, has size 0 and is never taken. Rows without an id are told
    apart by their texts; of rows alike in id and text, as many are taken as the count says. An
    empty table gives no rows. keep names further columns of docs to return.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)).alias("h"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    light = materialise(rows.select("id", "h", "source", "size"), "mix-sizes")  # texts are read once more at most, where they are kept
    rows = rows if keep else light
    # One row for each source and length: as many as a source has lengths, however many documents.
    histogram = materialise(light.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    aim = with_targets(ranked_sources(histogram), weights, most)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        group = group.sort_values("size")
        whole = min(most, int(target // size)) if size else 0
        left = int(target - whole * size) if whole < most else 0
        group["whole"] = np.where(group["size"] > 0, whole, 0)
        group["more"] = subset(group["size"].tolist(), group["n"].tolist(), left)
        return group[["source", "size", "n", "source_size", "target", "whole", "more"]]

    plan = histogram.alias("h").join(aim.alias("a"), F.col("h.source").eqNullSafe(F.col("a.source"))).select("h.source", "size", "n", "source_size", "target")
    plan = materialise(plan.groupBy("source").applyInPandas(choose, "source string, size long, n long, source_size long, target double, whole int, more long"), "mix-plan")
    return pick(rows, light, plan).select(F.col("id").alias(id_col), *[F.col(f"keep_{c}").alias(c) for c in keep if c not in (id_col, source_col)], F.col("source").alias(source_col), "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def pick(rows: DataFrame, light: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with repeats (light: the same rows without what is kept): of each (source, size) all n are taken whole times, and the more of them with the smallest hashes once more.

    A large group is cut into slices by hash, so that none is ranked in one task: slices that
    lie wholly under the cut are taken, and only the slice that holds the cut is ranked. Groups
    that hold many of all rows are broadcast with their plan.
    """
    group = F.struct("source", "size")
    rows, light, plan = rows.withColumn("g", group), light.withColumn("g", group), plan.withColumn("g", group).drop("source", "size")
    open_plan = plan.where("more > 0 AND more < n").select("g", "n", "more")
    # Where all or none of a length is taken, nothing is ranked.
    ranked = joined_by(light.select("g", "id", "h"), open_plan, "g", "n", how="inner", keep=True).withColumn("slice", slice_of("n"))
    counts = ranked.groupBy("g", "slice").agg(F.count("*").alias("in_slice"), F.first("more").alias("more"))
    earlier = F.sum("in_slice").over(Window.partitionBy("g").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    cuts = materialise(counts.withColumn("left", F.col("more") - F.coalesce(earlier, F.lit(0))).where("left > 0").select("g", "slice", "left", "in_slice"), "mix-slices")
    inside = ranked.join(cuts.where("left < in_slice").select("g", "slice", "left"), ["g", "slice"])
    order, alike = Window.partitionBy("g", "slice").orderBy("h", "id"), Window.partitionBy("g", "slice", "h", "id")
    inside = inside.withColumn("rank", F.row_number().over(order)).withColumn("first", F.rank().over(order)).withColumn("alike", F.count("*").over(alike))
    last = inside.where("rank = left").select("g", "slice", F.struct("h", "id").alias("edge"), (F.col("rank") - F.col("first") + 1).alias("quota"), "alike")
    edges = cuts.join(last, ["g", "slice"], "left").groupBy("g").agg(F.max(F.when(F.col("left") >= F.col("in_slice"), F.col("slice"))).alias("full_slice"), F.max_by(F.struct("slice", "edge"), F.when(F.col("edge").isNotNull(), 1)).alias("cut"), F.max(F.when(F.col("alike") > F.col("quota"), F.col("quota"))).alias("quota"))
    edges = materialise(edges, "mix-edges")
    out = joined_by(rows, plan.join(edges, "g", "left"), "g", "n", keep=True)
    on_edge = F.struct("h", "id") == F.col("cut.edge")
    under = (F.col("h") < F.col("cut.edge.h")) | ((F.col("h") == F.col("cut.edge.h")) & F.coalesce(F.col("id") <= F.col("cut.edge.id"), F.col("id").isNull()))
    once = F.when(F.col("more") >= F.col("n"), True).when(F.col("more") <= 0, False).when(F.col("slice") <= F.coalesce("full_slice", F.lit(-1)), True).when(F.col("slice") == F.col("cut.slice"), under).otherwise(False)
    out = out.withColumn("slice", slice_of("n")).withColumn("once", F.coalesce(once, F.lit(False)))
    if edges.where("quota IS NOT NULL").limit(1).count():  # rows alike on both sides of a cut: as many as the count says
        some = F.coalesce(on_edge & (F.col("slice") == F.col("cut.slice")) & F.col("quota").isNotNull(), F.lit(False))
        nth = F.row_number().over(Window.partitionBy("g", "h", "id").orderBy(F.lit(0)))
        out = out.where(~some).unionByName(out.where(some).withColumn("once", nth <= F.col("quota")))
    return out.withColumn("repeats", (F.col("whole") + F.when(F.col("once") & (F.col("size") > 0), 1).otherwise(0)).cast("long"))


def slice_of(n: str) -> Column:
    return F.pmod(F.shiftrightunsigned("h", 1), F.ceil(F.col(n) / SLICE_ROWS))
