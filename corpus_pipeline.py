"""The corpus pipeline: its stages in order, each written as Parquet and read again for the next.

Every stage but the last returns the columns of its input: rejected documents are gone and
secrets are replaced in the text.  The last one returns the packing of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecmosaic.llm.language_id import language_filter
from vecmosaic.llm.near_dup import NearDupOptions, without_near_duplicates
from vecmosaic.llm.packing import pack
from vecmosaic.llm.quality_rules import quality_filter
from vecmosaic.llm.secret_scan import redacted
from vecmosaic.session import written


#: The languages of the corpus; documents in any other one go.
LANGUAGES = ("en",)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host isn't rejected.

    A null, empty or short text goes; a null source is a host of its own; repeated rows are judged
    one by one; an empty table stays empty; very long texts are measured whole; other columns may have
    any names.
    """
    return quality_filter(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of ``LANGUAGES``, predicted as more likely than all others together.

    A text that is null or has no letter goes, unless nothing can be learned (no labelled row), in
    which case every row stays; repeated rows are judged one by one; an empty table stays empty;
    very long texts are read whole; other columns may have any names.
    """
    return language_filter(docs, keep=LANGUAGES)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked from 80 % of their word shingles on.

    The one with the smallest doc_id stays, once if its row repeats; texts of one doc_id that differ
    are judged apart; rows without a doc_id stay, and so does each text without words; an empty table
    stays empty; very long texts are compared whole; other columns may have any names.
    """
    return without_near_duplicates(docs, NearDupOptions(percent=80))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and n_chars brought up to date.

    A null text stays null; repeated rows are redacted one by one; an empty table stays empty; very
    long texts and candidates are scanned whole; other columns may have any names.
    """
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents.

    A null or empty text costs its end token; rows that repeat go to different bins; an empty table
    gives an empty result; a text longer than a bin is cut into pieces; other columns may have any
    names.
    """
    return pack(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: Learned weights and best-fit search can't be put in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of the documents of ``sf_dir`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
