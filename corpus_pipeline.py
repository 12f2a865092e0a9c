"""A training corpus from raw documents, in five stages.

language ID -> line dedup -> SimHash near-dedup -> mixing to target weights ->
best-fit packing. Each stage takes what its predecessor kept; all but the last
return the columns of `documents`, the last one row per packed piece.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from isospan.llm.common import read_table, shared_dir
from isospan.llm.langid import recognised
from isospan.llm.linedup import deduplicated
from isospan.llm.mixing import mixed_documents
from isospan.llm.packing import pack
from isospan.llm.simhash import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the trained network recognises; the others go.

    Null texts, texts without a letter and texts that look like noise go; where
    no row is labelled, only the first two. An empty table stays empty.
    """
    return recognised(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the parts of several lines that an earlier place has.

    Every row stays, with what is left of its text; null texts stay null, null
    ids rank last. An empty table stays empty.
    """
    return deduplicated(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the smallest doc_id.

    SimHash fingerprints within 7 bits propose, through the Gray-order index, and
    whole sets confirm. Like texts with fingerprints further apart meet by min-hash
    bands and exact prefixes, but for what the fingerprints have joined.

    Rows without an id rank last; null and empty texts are one group. An empty
    table stays empty.
    """
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, repeated or cut at their source's budget.

    A null source is a source; texts without words are kept once. An empty table
    stays empty.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens stand in sequences of 2048.

    Null and empty texts are their end token; an empty table gives no rows.
    """
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: No SQL: language ID is a trained network and packing runs a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and reread."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
