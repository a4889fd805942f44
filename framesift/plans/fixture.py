"""A table of frames derived from ``events``, the same in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FRAMES_SQL = """
SELECT event_id AS photo_id,
  concat('/shoot/u', cast(user_id AS varchar(9)), '/IMG_', lpad(cast(event_id AS varchar(9)), 6, '0'),
    CASE event_id % 5 WHEN 0 THEN '.NEF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.HEIC' WHEN 3 THEN '.CR2' ELSE '.tif' END) AS filepath,
  concat('IMG_', lpad(cast(event_id AS varchar(9)), 6, '0'),
    CASE event_id % 5 WHEN 0 THEN '.NEF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.HEIC' WHEN 3 THEN '.CR2' ELSE '.tif' END) AS filename,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END AS capture_time,
  CASE event_id % 4 WHEN 0 THEN 'sharp' WHEN 1 THEN 'acceptable' WHEN 2 THEN 'soft' ELSE 'unusable' END AS subject_sharpness,
  CASE cast(floor(event_id / 4) AS bigint) % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'slightly_off' WHEN 2 THEN 'badly_under' ELSE 'badly_over' END AS exposure,
  CASE cast(floor(event_id / 16) AS bigint) % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'fine' WHEN 2 THEN 'weak' ELSE 'broken' END AS framing,
  CASE cast(floor(event_id / 64) AS bigint) % 7 WHEN 0 THEN 'delete' WHEN 1 THEN 'review' WHEN 2 THEN 'Delete' ELSE 'keep' END AS verdict,
  CASE cast(floor(event_id / 9) AS bigint) % 6 WHEN 0 THEN ' Tilted Horizon ' WHEN 1 THEN 'soft focus|eyes closed' WHEN 2 THEN 'Pocket|shot' WHEN 3 THEN 'Lens Cap on' ELSE '' END AS issues_text,
  CASE WHEN event_id % 53 = 0 THEN NULL ELSE cast((event_id * 13) % 101 AS double) / 100 END AS cv_sharpness,
  CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 11 = 0 THEN cast(0.4 AS double) WHEN event_id % 7 = 0 THEN cast(0.1 AS double) ELSE cast(0.01 AS double) END AS blown_fraction,
  CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 13 = 0 THEN cast(0.15 AS double) ELSE cast(0.02 AS double) END AS crushed_fraction,
  CASE WHEN event_id % 83 = 0 THEN NULL ELSE (cast(floor(event_id / 6) AS bigint) * 2654435761) % 4294967296 END AS phash_hi,
  CASE WHEN event_id % 83 = 0 THEN NULL ELSE cast(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 255 ELSE 65535 END AS bigint) END AS phash_lo,
  event_type AS subject,
  concat(event_type, '|', ' User-', cast(user_id % 5 AS varchar(9)), '|kw_', cast(event_id % 7 AS varchar(9)), '|', upper(event_type), '.') AS keywords_text,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('frame of ', event_type) END AS description,
  CASE WHEN event_id % 4 = 1 THEN '' ELSE 'as told' END AS verdict_reason,
  CASE event_id % 3 WHEN 0 THEN 'Seawall|FrameSift:Keep|old one' WHEN 1 THEN '' ELSE 'KW 1|User 2' END AS old_keywords_text,
  CASE event_id % 5 WHEN 0 THEN 'written last year' ELSE '' END AS old_description,
  CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE NULL END AS old_rating,
  cast(event_id % 997 AS double) AS processing_ms
FROM {events}
"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with arrays for issues and keywords."""
    df = spark.sql(FRAMES_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    listed = lambda c: F.filter(F.split(c, "[|]"), lambda x: x != "")
    return df.withColumns({"technical_issues": F.split("issues_text", "[|]"), "keywords_raw": F.split("keywords_text", "[|]"), "old_keywords": listed("old_keywords_text")})
