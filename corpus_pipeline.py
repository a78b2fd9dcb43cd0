"""A corpus pipeline: quality rules, line dedup, near-dedup, personal data and packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the
columns of the documents they were given. A stage's result is written as Parquet to the
folder in ``spark.checkpoint.dir`` and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.line_dedup import EVERY_LINE, without_repeated_lines
from lodestar.llm.near_duplicates import near_duplicate_classes
from lodestar.llm.packing import pack
from lodestar.llm.pii_crf import find_personal_data, fit_pii_field
from lodestar.llm.quality_rules import score_quality
from lodestar.llm.shipping import ship_package
from lodestar.sources.staging import stage
from lodestar.sources.tables import read_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def _with_text(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """The columns of the documents, with a new text and its length."""
    new = F.col(text)
    replaced = {"text": new, "n_chars": F.char_length(new).cast("long")}
    return changed.select(*[replaced[c].alias(c) if c in replaced else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and do not repeat themselves."""
    ship_package(spark)
    kept = score_quality(docs).filter("quality.kept")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line, or nearly, however short."""
    return _with_text(docs, without_repeated_lines(docs, **EVERY_LINE), "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least doc_id.

    Of rows with equal doc_id and text one stays. A document without doc_id stays unless
    its class has one.
    """
    ship_package(spark)
    classes = near_duplicate_classes(docs)
    goes = stage(
        classes.filter("class_id is not null and (doc_id is null or class_id <> doc_id)").select("doc_id", "t").distinct()
    ).select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"))
    repeated = stage(classes.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")).select(
        F.col("doc_id").alias("_d"), F.col("t").alias("_t"), F.lit(True).alias("_again")
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64("text").alias("_h"),
    )
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t"))
    stays = rows.join(goes, same, "left_anti")
    if repeated.isEmpty():
        return stays.select("_row.*")
    marked = stage(stays.join(repeated, same, "left").select("_row", "_id", "_h", "_again"))
    once = marked.filter("_again is null").select("_row").unionByName(
        marked.filter("_again").dropDuplicates(["_id", "_h"]).select("_row")
    )
    return once.select("_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    ship_package(spark)
    return _with_text(docs, find_personal_data(docs, fit_pii_field(docs)), "pii.masked")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids, in sequences that hold the mix of sources."""
    ship_package(spark)
    return pack(docs, TOKENIZER, END_ID, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("personal data", personal_data),
    ("packing", packing),
]

# Suffix arrays, signatures, a fitted field and tokens are beyond SQL; the tests hold the
# pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
