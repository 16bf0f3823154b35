"""From raw documents to token digests: quality, repeated lines, near duplicates, benchmark passages, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept. All but the last return the
columns of ``docs``, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm import bpe, decontaminate, line_dedup, ngram_join, quality, queries
from tidegauge.llm.common import scratch, stored, table
from tidegauge.session import ship_package

#: A trained classifier decides in the first stage; SQL cannot express it.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """``__doc, doc_id, text``: all columns in one, so that no name can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "doc_id", "text")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled rows among ``docs``."""
    ship_package(spark)
    model = queries.quality_model(spark, sf_dir, docs)
    return quality.classify(_packed(docs), model, keep=("__doc",)).where("predicted = 1").select("__doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stay in another one; ``n_chars`` follows the text. A null text stays null."""
    found = line_dedup.dedup_lines(_packed(docs)).select("__doc", "kept")
    new = {"text": F.when(F.col("__doc.text").isNotNull(), F.col("kept")), "n_chars": F.length("kept").cast("long")}
    return found.select(*[(new.get(c, F.col(f"__doc.`{c}`"))).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id."""
    ship_package(spark)
    return ngram_join.one_per_class(_packed(docs)).select("__doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a share of benchmark passages that counts as contamination."""
    ship_package(spark)
    found = decontaminate.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark"), keep=("__doc",))
    return found.where("NOT contaminated").select("__doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of each document."""
    ship_package(spark)
    found = bpe.encode(_packed(docs), public_tokenizers.path(queries.RANKS), keep=("__doc",))
    return found.select("__doc.doc_id", "__doc.lang", "__doc.source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    root = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), root, name)
    return docs
