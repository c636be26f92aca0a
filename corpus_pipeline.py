"""A corpus pipeline of five stages, each written and read again as Parquet in the shared folder.

Language ID -> line dedup -> n-gram Jaccard join (one document of each group stays) -> mixing to target weights -> BPE.

Defined cases, for every stage: nulls in any column, empty and very long texts, repeated rows, null or reused ids and an empty table are
handled as the stage's operator says; columns of any name beside those of documents pass through all stages but the last. Rejected are
texts without a letter and texts of an uncertain language; a text that line dedup empties stays as an empty document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowtide.llm import bpe, jaccard, langid, lines, mixing
from flowtide.llm.common import spool, table

#: Documents whose language is less certain than this are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.25
#: Pieces in each generation of the encoder's cache: less memory than its default, since five stages share the workers.
CACHE_PIECES = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language."""
    return langid.keep_known(docs, LEAST_LANGUAGE_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated three-line windows; n_chars follows the text."""
    return lines.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return jaccard.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.resample(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixture's documents."""
    return bpe.encode_and_decode(docs, cache_pieces=CACHE_PIECES, release=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("bpe_tokens", bpe_tokens),
]
#: SQL can't express the classifier nor the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
