"""Benchmark decontamination: a prefix-filtered set join over item-sized windows, all native.

The words of a window are ordered by how rare they are in the documents. Containment of a whole
window needs all its words, so one prefix token, the rarest, is enough to join on: each word of a
document that is some window's rarest token proposes a start. Positional and length bounds drop
starts that leave the document, and the rest is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bounded, materialise

WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The words before lower-casing: for counting alone.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """Words of a text after lower-casing A-Z; none for a null."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # lower() changes more than A-Z outside ASCII; translate() is slower.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, APART), "")


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Distinct (item, win): all runs of window words; an item of fewer words is one window."""
    split = items.select(F.col(item_col).cast("string").alias("item"), words(text_col).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return split.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), window).alias("win")).distinct()


def prefix_tokens(windows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Each distinct win with its rarest word over all documents (key), where it stands in it (off), and its length."""
    tokens = windows.select("win").distinct().select("win", F.posexplode("win").alias("off", "token"))
    vocabulary = tokens.select("token").distinct()
    seen = docs.select(F.explode(words(text_col)).alias("token")).join(bounded(vocabulary), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = tokens.join(materialise(seen, "decontamination-counts"), "token", "left")
    rarest = ranked.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("r"))
    # A window with a word that no document has occurs nowhere.
    return rarest.where("r.n > 0").select(F.col("r.token").alias("key"), F.col("r.off").alias("off"), F.size("win").alias("len"), "win")


def window_matches(docs: DataFrame, tokens: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Verified occurrences: (id, h, start, len, win), start counted from 0; h tells rows of one id apart by text."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), words(text_col).alias("w"))
    measured = bounded(tokens)
    if measured is not tokens:
        # The build side is broadcast: a document's words never leave its row.
        each = rows.select("id", "h", F.size("w").alias("n"), "w", F.posexplode("w").alias("pos", "key"))
        fits = (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("len") <= F.col("n"))
        same = F.slice("w", F.col("pos") - F.col("off") + 1, F.col("len")) == F.col("win")
        tokens = measured
    else:
        # Both sides are shuffled by the token: each occurrence carries only the words that a window around it can hold.
        each = rows.select("id", "h", "w", F.posexplode("w").alias("pos", "key"))
        first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
        each = each.select("id", "h", "pos", "key", F.slice("w", first + 1, 2 * window - 1).alias("near"), (F.col("pos") - first).alias("inside"), F.size("w").alias("n"))
        fits = (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("len") <= F.col("n"))
        same = F.slice("near", F.col("inside") - F.col("off") + 1, F.col("len")) == F.col("win")
    found = each.join(tokens, "key").where(fits).where(same)
    return found.select("id", "h", (F.col("pos") - F.col("off")).alias("start"), "len", "win").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, percent: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, n_words, n_hit (words inside any occurrence of a window), items (sorted ids of the items with one), contaminated.

    contaminated: some word is hit, and at least percent % of the words are. Null and empty texts
    have no words; items without words have no windows; repeated rows give repeated rows with
    equal results; an empty side gives no hits; null item ids are left out of items; keep
    names further columns of docs to return, others are ignored.
    """
    windows = materialise(item_windows(items, item_col, item_text_col, window), "decontamination-windows")
    tokens = materialise(prefix_tokens(windows, docs, text_col), "decontamination-tokens")
    found = materialise(window_matches(docs, tokens, id_col, text_col, window), "decontamination-matches")
    before = Window.partitionBy("id", "h").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    hits = found.select("id", "h", "start", "len").distinct().withColumn("covered", F.coalesce(F.max(end).over(before), F.lit(0)))
    hits = hits.groupBy("id", "h").agg(F.sum(F.greatest(end - F.greatest("start", "covered"), F.lit(0))).alias("n_hit"))
    of = found.select("id", "h", "win").distinct().join(bounded(windows), "win").where("item IS NOT NULL").groupBy("id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    both = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    facts = hits.alias("x").join(of.alias("o"), both("x", "o"), "left").select("x.*", "o.items")
    out = rows.alias("d").join(facts.alias("f"), both("d", "f"), "left").select("d.id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *[f"d.keep_{c}" for c in keep])
    rate = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", rate.alias("contaminated"), *[F.col(f"keep_{c}").alias(c) for c in keep])


def contamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
