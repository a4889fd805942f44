"""Bursts of near-simultaneous, similar frames: runs in time order, best frames, demotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.triage import hamming
from . import ranges

_ORDER = ["capture_time", "filename", "filepath"]


def groups(df: DataFrame, gap: float = S.BURST_GAP_SECONDS, similar: int = S.SIMILAR, rows: int = ranges.ROWS) -> DataFrame:
    """Adds group_id to the frames that have not failed, which alone are returned.

    In the order of capture time (none last), name and path, a frame joins its predecessor's burst if both times are known and
    at most ``gap`` seconds apart, and the hashes, where both are known, differ in at most ``similar`` bits. Frames are ordered in ranges of about
    ``rows``, whatever day they are of and whether their time is known, so a shoot of one day or without times is many tasks.
    """

    def parted(a: Column, b: Column) -> Column:
        close = F.coalesce(b["t"] - a["t"] <= F.expr(f"INTERVAL '{gap}' SECOND"), F.lit(False))
        return ~close | F.coalesce(hamming(a["hi"], a["lo"], b["hi"], b["lo"]) > similar, F.lit(False))

    own = F.struct(F.col("capture_time").alias("t"), F.col("phash_hi").alias("hi"), F.col("phash_lo").alias("lo"))
    return ranges.runs(df.where("decision is null or decision <> 'Failed'"), _ORDER, own, parted, "group_id", rows)


def _quality() -> Column:
    """What makes a frame better than another of its burst, as a struct whose minimum is the best."""
    rank = lambda c, table, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce(F.col(c), F.lit(""))), F.lit(other))
    return F.struct(rank("decision", S.VERDICT_RANK, 3).alias("q1"), rank("subject_sharpness", S.SHARPNESS_RANK, 2).alias("q2"), (-F.coalesce("cv_sharpness", F.lit(0.0))).alias("q3"),
                    F.when(F.col("exposure") == "good", 0).otherwise(1).alias("q4"), F.col("overall_quality").isNull().alias("q5"), (-F.col("overall_quality")).alias("q6"), F.col("filename").alias("q7"), F.col("filepath").alias("q8"))


def annotate(df: DataFrame, gap: float = S.BURST_GAP_SECONDS, similar: int = S.SIMILAR, near: int = S.NEAR_IDENTICAL, demote: bool = True, rows: int = ranges.ROWS) -> DataFrame:
    """df with group_id, group_size, is_best_of_group and duplicate_of; frames kept but not the best of a burst go to Review.

    Failed frames keep the defaults: no group, size one, best. Needs decision, confidence and issues. Size and best of a burst are sums and
    minima taken before the shuffle, so a burst of any length is one row a task; rows that repeat a path are one frame and share its fate.
    """
    g = groups(df, gap, similar, rows)
    best = F.min_by(F.struct(F.col("filename").alias("name"), F.col("filepath").alias("path"), F.col("phash_hi").alias("hi"), F.col("phash_lo").alias("lo")), _quality())
    each = g.groupBy("group_id").agg(best.alias("_best"), F.count("*").cast("int").alias("group_size"))
    g = g.join(each, "group_id").withColumn("is_best_of_group", F.col("filepath") == F.col("_best.path"))
    twin = ~F.col("is_best_of_group") & F.coalesce(hamming(F.col("_best.hi"), F.col("_best.lo"), F.col("phash_hi"), F.col("phash_lo")) <= near, F.lit(False))
    g = g.withColumn("duplicate_of", F.when(twin, F.col("_best.name")))
    if demote:
        moved = ~F.col("is_best_of_group") & (F.col("decision") == "Keep")
        label = F.when(F.col("duplicate_of").isNotNull(), F.concat(F.lit("near-duplicate of "), F.col("_best.name"))).otherwise(F.concat(F.lit("weaker frame in burst of "), F.col("group_size").cast("string")))
        g = g.withColumn("_moved", moved)
        g = g.withColumn("issues", F.when(F.col("_moved") & ~F.array_contains("issues", label), F.array_append("issues", label)).otherwise(F.col("issues")))
        g = g.withColumn("decision", F.when(F.col("_moved"), "Review").otherwise(F.col("decision"))).withColumn("confidence", F.when(F.col("_moved"), F.least("confidence", F.lit(S.DEMOTED_CONFIDENCE))).otherwise(F.col("confidence")))
    else:
        g = g.withColumn("_moved", F.lit(False))
    g = g.withColumnRenamed("_moved", "demoted").drop("_best")
    return g.unionByName(ungrouped(df.where("decision = 'Failed'")))


def ungrouped(df: DataFrame) -> DataFrame:
    """df with the defaults of frames that are in no burst."""
    return df.withColumns({"group_id": F.lit(None).cast("long"), "group_size": F.lit(1), "is_best_of_group": F.lit(True), "duplicate_of": F.lit(None).cast("string"), "demoted": F.lit(False)})


def summary(annotated: DataFrame) -> DataFrame:
    """One row: groups, bursts of more than one frame, frames demoted, near-identical ones, and whether any frame has a hash to compare."""
    grouped = F.col("group_id").isNotNull()
    return annotated.agg(
        F.count_distinct("group_id").alias("groups"), F.count_if(grouped & (F.col("group_size") > 1) & F.col("is_best_of_group")).alias("bursts"),
        F.count_if(grouped & F.col("demoted")).alias("demoted_to_review"), F.count_if(grouped & F.col("duplicate_of").isNotNull()).alias("near_identical"),
        F.coalesce(F.bool_or(grouped & F.col("phash_hi").isNotNull() & F.col("phash_lo").isNotNull()), F.lit(False)).alias("hashing_available"))
