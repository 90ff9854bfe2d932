"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what the one before kept, written as Parquet and read again:

1. language: documents whose language is not recognised go; a null lang is filled in
2. near_duplicates: one row of each group of near-duplicate rows stays, whatever their ids (five-word shingles, similarity 0.8)
3. personal_data: spans are replaced by their kind in brackets
4. mixture: documents are taken as often as their source's target asks, in training order
5. packing: every document becomes token pieces with a place in a sequence
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from taleframe.llm.common import noted, read, remove, shared_dir, write_table
from taleframe.llm.language import known_language_documents, train_languages
from taleframe.llm.minhash import distinct_documents
from taleframe.llm.mixing import mixed_documents
from taleframe.llm.packing import pack_documents
from taleframe.llm.pii import redact_documents


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the stage before has staged; its result is written by the time that the next one begins.
_left: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """``stage``, after removing the working tables of the stage before, unless ``docs`` still reads them."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not any(path in file for file in docs.inputFiles() for path in _left):
            remove(spark, _left)
        with noted() as paths:
            out = stage(spark, docs, sf_dir)
        _left[:] = paths
        return out

    return run_stage


@_tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is learned from ``docs`` themselves; null, empty and letterless texts go, as all do without labels.

    Repeated rows stay repeated, very long texts are read whole, other columns go; an empty table gives an empty result.
    """
    return known_language_documents(docs, train_languages(docs))


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate rows, repeated rows and null ids included; null and blank texts stay.

    Ties go to the smallest doc_id (null last); other columns go; an empty table gives an empty result.
    """
    return distinct_documents(docs)


@_tidy
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data in its text redacted; null and empty texts stay as they are; other columns go."""
    return redact_documents(docs)


@_tidy
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in part files in the order of training.

    A null source is one source; a null or blank text has no words and is taken as the others of its source that come first;
    repeated rows are decided each; other columns go; an empty table gives an empty result.
    """
    return mixed_documents(docs)


@_tidy
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places, packed inside each part file, so that the order of training holds.

    A null or empty text is one end token; very long texts are cut into pieces; run and place tell repeated rows apart;
    other columns are ignored; an empty table gives an empty result.
    """
    return pack_documents(docs, with_ids=True, ordered=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]
#: Tokens, signatures and a trained model are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each one's result written and read again.

    Rows with a null or blank text, or in no known language, never reach the result; null ids, sources and labels, repeated rows,
    very long texts and columns beyond those of documents are allowed; an empty table gives an empty result.
    """
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        write_table(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
        remove(spark, before)
        before = [path]
    remove(spark, _left)
    _left.clear()
    return docs
