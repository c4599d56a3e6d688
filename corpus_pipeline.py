"""A corpus from raw documents to piece ids, one operator a stage.

Each stage is written as Parquet to the shared folder and read again before the next one, so a lost executor costs no
more than the stage at work. All stages but the last return the columns of ``documents``, also extra ones, whatever their
names. Texts of any length are handled whole, and an empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlora.llm.exact_dedup import drop_exact_copies
from parlora.llm.language_id import keep_identified
from parlora.llm.mixing import mix_sources
from parlora.llm.near_dup import drop_near_duplicates
from parlora.llm.piece_codec import encode
from parlora.llm.scratch import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the corpus's languages go.

    Documents without letters (null, empty or blank texts, digits alone) are in no language and go. Repeated rows and
    rows with a null ``doc_id`` or other nulls are judged by their own text. Of equally near languages the first by name
    is taken, which doesn't matter to what stays.
    """
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that of the least ``doc_id``.

    A null ``doc_id`` comes last; of repeated rows one stays. Rows with a null text, if any came this far, all stay; the
    empty text is a text.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least ``doc_id``.

    Groups are what pairs at or above the threshold connect, ties at the threshold included. Texts that are null or have
    no token, and rows with a null ``doc_id``, are in no group and stay; rows that share a ``doc_id`` stay or go together.
    """
    return drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as the target weights of their sources ask; none goes.

    A null source or language is a category of its own; null and blank texts carry no tokens and get the rate of their
    cell. Repeated rows count as rows. Where no rates meet all constraints, those of the sources are met alone.
    """
    return mix_sources(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with its next best segmentations.

    A null text gives null ids, the empty text none; ties go to longer pieces from the end; repeated rows and null
    ``doc_id`` stay as they are; extra columns are left out.
    """
    return encode(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("piece_encoding", piece_encoding),
]

#: No SQL: MinHash candidates, the Newton iterations and the piece lattice can't be written in it. The tests compare
#: the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
