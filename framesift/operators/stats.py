"""Run statistics, top lists, failure runs and the accuracy matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import schema as S
from . import ranges


def decision_counts(df: DataFrame) -> DataFrame:
    """decision, n, percent in the fixed order of decisions; absent ones are hidden. The window is over four rows."""
    c = df.groupBy("decision").agg(F.count("*").alias("n"))
    rank = F.create_map(*[F.lit(x) for kv in S.VERDICT_RANK.items() for x in kv])
    return c.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6)).withColumn("position", F.element_at(rank, "decision")).orderBy("position")


def run_statistics(df: DataFrame) -> DataFrame:
    ok = F.col("decision") != "Failed"
    avg = lambda c: F.round(F.avg(F.when(ok, F.col(c))), 6)
    return df.agg(F.count("*").alias("total_images"), F.count_if(ok).alias("valid"), avg("blur_score").alias("avg_blur"), avg("exposure_score").alias("avg_exposure"),
                  avg("composition_score").alias("avg_composition"), avg("overall_quality").alias("avg_overall"), F.count_if(ok & (F.size("keywords") > 0)).alias("keywords_found"))


def top_rejects(df: DataFrame, k: int = 10) -> DataFrame:
    return df.where("decision = 'Delete'").select("filepath", "confidence").orderBy(F.desc("confidence"), "filepath").limit(k)


def top_keywords(df: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent keywords of frames that have not failed; ties in the order of the text."""
    return df.where("decision <> 'Failed'").select(F.explode("keywords").alias("keyword")).where("keyword <> ''").groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(k)


def top_subjects(df: DataFrame, k: int = 3) -> DataFrame:
    return df.where("decision <> 'Failed' and subject <> ''").groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject").limit(k)


def by_decision(df: DataFrame, folder: str) -> None:
    """One folder for each decision."""
    df.write.partitionBy("decision").parquet(folder)


def failure_runs(df: DataFrame, failed, key: str, order: str, limit: int = S.FAILURE_LIMIT, rows: int = ranges.ROWS) -> DataFrame:
    """Runs of at least ``limit`` consecutive failures in each lane ``key``: (key, first, last, length).

    Rows are ordered in ranges of lane and order, so one long lane is many tasks; a run's ends and length are taken before the shuffle.
    """
    d = df.select(key, order, F.coalesce(failed, F.lit(False)).alias("_f"))
    parted = lambda a, b: ~(a["f"] & b["f"] & a["k"].eqNullSafe(b["k"]))
    d = ranges.runs(d, [key, order], F.struct(F.col("_f").alias("f"), F.col(key).alias("k")), parted, "_g", rows).where("_f")
    found = d.groupBy(key, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))
    return found.where(F.col("length") >= limit).drop("_g")


def eval_matrix(df: DataFrame, truth: DataFrame, on: str) -> DataFrame:
    """kind by decision; frames without a known kind count under '?'. Spark sends the truth to all tasks if it is small."""
    j = df.join(truth, on, "left").withColumn("kind", F.coalesce("kind", F.lit("?")))
    return j.groupBy("kind").pivot("decision", ["Keep", "Review", "Delete"]).count().na.fill(0)


def eval_violations(df: DataFrame, truth: DataFrame, on: str) -> DataFrame:
    """originals deleted, ruined frames kept, and the sizes of both sets."""
    j = df.join(truth, on)
    o = F.col("kind") == "original"
    return j.agg(F.count_if(o & (F.col("decision") == "Delete")).alias("false_deletes"), F.count_if(o).alias("originals"),
                 F.count_if(~o & (F.col("decision") == "Keep")).alias("missed"), F.count_if(~o).alias("ruined"))


def choose_model(installed: DataFrame, families=S.MODEL_FAMILIES) -> DataFrame:
    """The first family that is there, an instruct build before others, then by name."""
    low = F.lower("name")
    rank = F.coalesce(*[F.when(low.startswith(f), i) for i, f in enumerate(families)])
    return installed.withColumn("_r", rank).where("_r is not null").orderBy("_r", ~low.contains("instruct"), "name").limit(1).select("name")


def session_summary(df: DataFrame) -> DataFrame:
    """One row: totals, averages of frames that have not failed, and the most frequent keywords and subjects as arrays."""
    listed = lambda top, c: top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), c))), lambda x: x[c]).alias(f"top_{c}s"))  # noqa: E731  five rows and three
    one = lambda x: x.withColumn("_one", F.lit(1))  # noqa: E731  each is a single row
    return one(run_statistics(df)).join(one(listed(top_keywords(df), "keyword")), "_one").join(one(listed(top_subjects(df), "subject")), "_one").drop("_one")


def save_session(df: DataFrame, folder: str) -> None:
    """The summary as JSON; nothing is written for a run without frames."""
    session_summary(df).where("total_images > 0").write.mode("overwrite").json(folder)


def outcomes(written: DataFrame) -> DataFrame:
    return written.groupBy("outcome").agg(F.count("*").alias("n"))


def readiness(df: DataFrame) -> DataFrame:
    """One row: frames with a decision that did not fail (ready), without one yet (waiting), and failed."""
    return df.agg(F.count_if(F.col("decision").isNotNull() & (F.col("decision") != "Failed")).alias("ready"), F.count_if(F.col("decision").isNull()).alias("waiting"),
                  F.count_if(F.col("decision") == "Failed").alias("failed"))


def pace(df: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: frames, and the mean seconds of one: of ``seconds``, the run's wall time, or of the frames' own times. A run without frames took 0 each."""
    total = F.lit(float(seconds)) if seconds is not None else F.sum("processing_ms") / 1000.0
    return df.agg(F.count("*").alias("frames"), F.round(F.coalesce(F.try_divide(total, F.count("*")), F.lit(0.0)), 6).alias("seconds_each"))


def first_sources(listed: DataFrame, n: int, path: str = "path") -> DataFrame:
    """The first ``n`` files in the order of their paths."""
    return listed.orderBy(path).limit(n)
