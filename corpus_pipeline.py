"""A corpus from raw documents to piece ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs.

In every stage a null text counts as empty, and stays null where it is kept; rows that repeat an id and a text get one
and the same decision; rows with a null id are judged by their text, and none goes as a near copy; other columns, whatever
their names, pass through; very long texts are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_dedup, pieces, quality, simhash
from millrace.llm.common import fold, table
from millrace.plans.storage import materialise


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """changed, with the columns of docs; n_chars follows the text."""
    return changed.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; the classifier learns from the labelled ones outside fold 0."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id") != 0)
    return quality.keep(docs, model, threshold=0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without runs of whole lines of 50 words or more that stand earlier."""
    return _with_text(docs, line_dedup.dedup_lines(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, score, others): the best segmentation of each document and the next three."""
    return pieces.encode_nbest(docs, public_tokenizers.path("piece_bpe_32k.model"), n=4)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("sentencepiece_encoding", encode_pieces),
]

#: SQL expresses neither the classifier nor the lattice search; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
