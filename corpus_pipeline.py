"""From documents to token ids: five stages, each over all that the one before it kept.

Every stage takes any columns beside doc_id and text, whatever their names, and gives them back; the last one gives counts and digests. Null and empty texts are
clean, no near copies but of each other, nothing to cut, free of the benchmark and no tokens. Null ids are kept apart by their texts; rows that repeat an id
and a text are one document. Very long texts are read whole. An empty table passes through, and so does one without labels or benchmark items.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framesift.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from framesift.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model learns from the labelled rows outside the held-out third, and without any keeps all."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links of a similarity of 0.8 or more between sets of five-word shingles reach."""
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 100 that start earlier, in another one or in themselves."""
    return suffix_dedup.cleaned(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 13 words in a row of the benchmark, however long they are, and without a twentieth of their words in shorter items."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the bytes decoded from them."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("suffix_array", cut_repeats), ("decontaminate", drop_contaminated), ("bpe", encode)]

#: The model's training, the components and the token ids are beyond SQL; tests/llm checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
