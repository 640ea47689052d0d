"""Corpus pipeline: from raw documents to token ids.

1. language ID: documents whose language isn't recognised go;
2. n-gram Jaccard join: one document of each group of near duplicates stays, the one with the least doc_id;
3. benchmark decontamination: documents with a passage of a benchmark item go;
4. PII: personal data is replaced by format-preserving pseudonyms;
5. BPE: token ids, and the text decoded from them.

Each stage works on all rows that its predecessor kept, which are written as Parquet in the shared folder (see
``spark.checkpoint.dir``) and read again, so a lost executor costs no more than its stage. All but the last return the
columns of documents. Nulls, empty texts, repeated rows and empty tables are as each operator defines them: a null or
wordless text goes in stage 1, repeated rows leave one in stage 2, and a null doc_id stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factlake.llm import bpe, decontam, jaccard, langid, pii
from factlake.llm._common import read, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return langid.identify(docs, keep=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.remove(docs, read(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    return pii.pseudonymise(docs, pii.session_key(docs), count=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text."""
    return bpe.encode_decode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", pseudonyms),
    ("BPE encoding and decoding", tokens),
]

#: SQL can't express stages 1, 3, 4 and 5; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages, applied to documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
