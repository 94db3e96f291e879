"""The corpus pipeline: filter, deduplicate, decontaminate, mask, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the result is
written as Parquet and read again. All but the last return the columns of documents.

In every stage: a null or empty text has no words (the first stage rejects it), a null source is
a source of its own, other nulls are carried along; rows without an id and rows of one id are
told apart by their texts; an empty table gives an empty one; columns beyond those of documents
are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import bounded, materialise, table
from logloom.llm.decontamination import decontaminate
from logloom.llm.jaccard_join import jaccard_join
from logloom.llm.mixing import mix
from logloom.llm.pii import find_pii
from logloom.llm.quality_rules import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express the isolation forest, the added PII spans or the seeded mix: tests/llm/test_pipeline.py compares with a plain-Python version.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key: ids may be null or repeated, so a row is known by its id and the hash of its text; rows without an id come last."""
    return docs.withColumn("row_key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_hash")))


def same_row(left: str, right: str):
    """Rows of one id are told apart by their text."""
    return F.col(f"{left}.row_key.doc_id").eqNullSafe(F.col(f"{right}.row_key.doc_id")) & (F.col(f"{left}.row_key.text_hash") == F.col(f"{right}.row_key.text_hash"))


def only(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose row_key is (left_semi) or isn't (left_anti) among chosen."""
    chosen = bounded(materialise(chosen.select("row_key").distinct(), "pipeline-ids"))
    return docs.alias("d").join(chosen.alias("c"), same_row("d", "c"), how).select(*COLUMNS)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules reject go; other rows of their ids stay."""
    docs = keyed(docs)
    verdict = quality_rules(docs, table(spark, sf_dir, "labels"), carry=("row_key",))
    return only(docs, verdict.where("NOT kept"), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, Jaccard 0.8) the row with the smallest id stays, one without an id only if all are; of rows with equal id and text, one."""
    docs = keyed(docs)
    found = jaccard_join(docs, id_col="row_key", shingle=5, percent=80, count_links=False)
    found = materialise(found.where(F.col("row_key") == F.col("component_id")).select("row_key"), "pipeline-firsts")
    out = only(docs, found, "left_semi")
    return keyed(out).dropDuplicates(["row_key"]).select(*COLUMNS) if found.count() > found.distinct().count() else out


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with at least 5 % of their words in passages of the benchmark go."""
    docs = keyed(docs)
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=("row_key",))
    return only(docs, found.where("contaminated"), "left_anti")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text."""
    found = find_pii(docs.select(F.struct(*COLUMNS).alias("row"), "text"), "row")
    text = F.col("masked")
    return found.select("row.doc_id", text.alias("text"), "row.lang", "row.source", F.when(text.isNull(), F.col("row.n_chars")).otherwise(F.char_length(text).cast("long")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (repeats) and the words that makes (taken)."""
    return mix(keyed(docs), id_col="row_key", keep=("doc_id", "text", "lang", "n_chars")).where("repeats > 0").select(*COLUMNS, "repeats", "taken", "target", "source_size")


STAGES = [("quality rules", filter_quality), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", decontaminated), ("PII", mask_pii), ("mixing sources", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{at}")
    return docs
