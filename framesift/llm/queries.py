"""The text operators' queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, decontaminate, licenses, quality, simhash, suffix_dedup, token_counts, toxicity, url_filter, warc
from .common import table


def _simhash(spark, sf_dir):
    out = simhash.components(table(spark, sf_dir, "documents"), shingle=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _decontaminate(spark, sf_dir):
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {
    "op1_license_scan": lambda spark, d: licenses.scan(table(spark, d, "documents")),
    "op2_toxicity": lambda spark, d: toxicity.judge(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_byte_bpe": _bpe,
    "op4_suffix_dedup": _suffix_dedup,
    "op5_url_filter": lambda spark, d: url_filter.filter_urls(table(spark, d, "pages")),
    "op6_token_counts": _token_counts,
    "op7_decontaminate": _decontaminate,
    "op8_quality_rules": lambda spark, d: quality.judge(table(spark, d, "documents")),
    "op9_warc": lambda spark, d: warc.round_trip(table(spark, d, "pages")),
    "op10_simhash": _simhash,
}

ORACLES = {
    "op1_license_scan": licenses.SQL,
    "op4_suffix_dedup": suffix_dedup.SQL,
    "op5_url_filter": url_filter.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op8_quality_rules": quality.SQL,
    "op9_warc": warc.SQL,
    "op10_simhash": simhash.SQL,
}
