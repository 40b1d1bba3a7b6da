"""A corpus pipeline of four stages: toxicity, near-duplicates, benchmark passages, token ids.

Every stage reads what the one before it wrote.  The first three drop rows and keep
the columns of ``documents``; the last returns the token ids of what is left.

Null and empty texts are kept by the first three stages, though of empty texts, which are
equal to each other, one stays.  Repeated rows count as copies; an id with several texts
keeps those that are no copies of others.  Rows without an id are judged by the first and
third stage only.  An empty table goes through as such.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, decontaminate, simhash, toxicity
from strandloom.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more under a model of the labelled rows of ``docs``."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    Texts meet under keys of least shingle hashes, SimHash fingerprints are compared bit-sliced where they meet, and the
    whole texts decide; fingerprints alone cannot find such pairs (see :func:`strandloom.llm.simhash.similar_groups`).
    """
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of ``benchmark``."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)."""
    found = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("byte_bpe", token_ids),
]

#: SimHash linking, learned weights and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
