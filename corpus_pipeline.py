"""A corpus pipeline over ``documents``: each stage is (name, function of spark, docs and the table folder).

Every stage works on all that its predecessor kept. The stages filter or select and return the columns of
``documents``, but for the last, which writes token files and returns what it reads back from them.

Defined results: texts that are null, empty or without words share one toxicity score, link with no text and hold no
benchmark window; they have no tokens to mix and become a lone end id. Null languages and sources, and sources of any
name, are values of their own. Rows equal in doc_id and text stay or go together in every stage. Further columns are
kept by all stages but the last. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantaloom.llm import decontamination, jaccard_join, queries, token_files, toxicity
from quantaloom.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.5 go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, queries.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 of five-word shingles one stays."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a ten-word window of a benchmark item go."""
    return decontamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"), n=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in proportion to the weights of domains, languages and sources; a document may come again in a
    later epoch."""
    return queries.mix_documents(docs).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Simple-8b shards; doc_id, start, n_tokens and ids_crc32 as read back from them."""
    return token_files.read(spark, token_files.write(docs, queries.public_tokenizer(), special=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

# learned scores, links and coded files have no SQL form; a test compares run() with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
