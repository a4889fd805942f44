"""Recomputing only what has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S


def cache_key(path: Column, modified: Column, mode: str = "accurate", model: str = "local", host: str = "", tags: bool = True, version: str = S.RULE_VERSION) -> Column:
    """md5 of all that a decision depends on."""
    parts = [path, modified.cast("string"), F.lit(mode), F.lit(model), F.lit(host), F.lit("tags" if tags else "notags"), F.lit(version)]
    return F.md5(F.concat_ws("|", *parts))


def work_list(frames: DataFrame, cached: DataFrame, key: str = "cache_key") -> DataFrame:
    return frames.join(cached.select(key), key, "left_anti")


def with_hits(fresh: DataFrame, frames: DataFrame, cached: DataFrame, key: str = "cache_key") -> DataFrame:
    """Fresh results and, for the other frames, the cached ones."""
    return fresh.unionByName(cached.join(frames.select(key), key, "left_semi"), allowMissingColumns=True)


def to_cache(results: DataFrame, folder: str) -> None:
    """Appends results, but never failures."""
    results.where("decision <> 'Failed'").write.mode("append").parquet(folder)
