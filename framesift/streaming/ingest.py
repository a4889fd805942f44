"""New frames as a stream: decisions as they come, bursts once their time has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schema as S
from ..functions.triage import decide, scores


def frames(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of measured frames, read as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def decisions(stream: DataFrame) -> DataFrame:
    """Scores and decisions; every frame stands for itself, so no state is kept."""
    return decide(scores(stream))


def bursts(decided: DataFrame, gap: float = S.BURST_GAP_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(folder, start, end, frames, kept) of runs of one folder's frames at most ``gap`` seconds apart, once none can come that is less than ``late`` behind.

    By time alone: the test of similar hashes needs the frames in order and belongs to the batch operator. A session ends
    after a gap of its length, while here a gap of exactly that length still joins: hence one microsecond more.
    """
    micros = int(gap * 1_000_000) + 1
    timed = decided.where("capture_time is not null").withColumn("at", F.col("capture_time").cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.regexp_extract("filepath", r"^(.*)/[^/]*$", 1).alias("folder"), F.session_window("at", f"{micros} microseconds").alias("w")).agg(F.count("*").alias("frames"), F.count_if(F.col("decision") == "Keep").alias("kept"))
    return out.select("folder", F.col("w.start").alias("start"), F.expr(f"w.end - INTERVAL '{micros / 1e6:.6f}' SECOND").alias("end"), "frames", "kept")


def append(stream: DataFrame, folder: str, checkpoint: str):
    """Writes all that is there now and stops; running it again goes on from there."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
