"""A training-corpus pipeline over ``documents``: toxicity filter, exact and near
deduplication, mixing to target weights, and byte-level BPE encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendaudit.llm import bpe, common, exact_dedup, mixing, queries, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, sf_dir))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its shards' shuffled order."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of ids and decoded text."""
    return bpe.encode_decode(docs, with_ids=True, with_decoded=False)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies),
          ("simhash_near_dedup", drop_near_copies), ("source_mixing", mix_sources),
          ("byte_bpe", encode)]

# The SimHash components and the token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet to the shared folder and
    read again by the next."""
    docs = queries.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.land(docs, name)
    return docs
