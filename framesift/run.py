"""A run over a folder: list, measure, ask, decide, group, record. ``python -m framesift.run FOLDER`` does it from a shell."""

from __future__ import annotations

import argparse
import os
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from typing import ClassVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import schema as S
from .functions import measure, triage, views
from .operators import bursts, cache, metadata, report, stats, vision
from .sources import photos, sidecars

HOST = "http://localhost:11434"


@dataclass
class Config:
    """Settings of a run; numbers below their floor are raised to it."""

    model_name: str | None = None
    host: str = HOST
    timeout_seconds: int = vision.TIMEOUT
    verify_vision: bool = True
    context_tokens: int = vision.CONTEXT_TOKENS
    workers: int = 1
    tagging: bool = True
    recursive: bool = True
    grouping: bool = True
    burst_gap_seconds: float = S.BURST_GAP_SECONDS
    csv_dir: str = "runs"
    cache_dir: str | None = None
    preview_dir: str | None = None
    extensions: tuple[str, ...] = S.PHOTO_EXTENSIONS

    def __post_init__(self):
        self.burst_gap_seconds = max(0.0, float(self.burst_gap_seconds))
        self.context_tokens, self.workers, self.timeout_seconds = max(2048, int(self.context_tokens)), max(1, int(self.workers)), int(self.timeout_seconds)

    # The sections and names of the settings file, which users have written.
    FILE: ClassVar[dict] = {"model": {"name": "model_name", "host": "host", "timeout_seconds": "timeout_seconds", "verify_vision": "verify_vision", "context_tokens": "context_tokens"},
            "processing": {"workers": "workers", "tagging": "tagging", "recursive": "recursive"}, "grouping": {"enabled": "grouping", "burst_gap_seconds": "burst_gap_seconds"},
            "cache": {"dir": "cache_dir"}, "output": {"csv_dir": "csv_dir", "extensions": "extensions", "preview_dir": "preview_dir"}}

    @classmethod
    def load(cls, path: str | None) -> Config:
        """From a YAML file; what it leaves out or leaves blank keeps its default, and so does all of it where there is no file or no YAML in it."""
        told = None
        if path and os.path.isfile(path):
            try:
                import yaml
            except ImportError:
                return cls()
            with open(path, encoding="utf-8") as f:
                try:
                    told = yaml.safe_load(f)
                except (ValueError, yaml.YAMLError):
                    told = None
        if not isinstance(told, dict):
            return cls()
        given = {}
        for section, names in cls.FILE.items():
            part = told.get(section)
            given |= {names[k]: v for k, v in part.items() if k in names and v is not None} if isinstance(part, dict) else {}
        if "extensions" in given:
            given["extensions"] = photos.extensions(",".join(map(str, given["extensions"])))
        if given.get("cache_dir"):
            given["cache_dir"] = os.path.expanduser(given["cache_dir"])
        return cls(**given)


def _listed(spark: SparkSession, folder: str, config: Config, mode: str) -> tuple[DataFrame, DataFrame | None]:
    """The frames to work on, and what an earlier run has found about the others' folder, if any."""
    listed = photos.frames(spark, folder, config.extensions, config.recursive)
    listed = listed.withColumn("cache_key", cache.cache_key(F.col("path"), F.col("modificationTime"), mode=mode, model=config.model_name or "local", host="" if mode == "fast" else config.host, tags=config.tagging or mode == "fast"))
    old = None
    if config.cache_dir:
        try:
            old = spark.read.parquet(config.cache_dir)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return listed, old


def _pictures(spark: SparkSession, folder: str, config: Config) -> DataFrame:
    """Pixels of all that can be decoded: pictures by the JVM, raw files by their previews where there is a folder for these."""
    seen = photos.pixels(spark, folder, config.recursive)
    return seen.unionByName(photos.raw_pixels(spark, folder, config.preview_dir, recursive=config.recursive)) if config.preview_dir else seen


def _judged(df: DataFrame, failed, why: str) -> DataFrame:
    """Scores and decisions; frames of which nothing is known are Failed."""
    df = df.withColumn("exposure", F.coalesce("exposure", F.lit("good")))
    df = triage.decide(triage.scores(df)).withColumn("filename", F.regexp_extract("filepath", r"([^/]*)$", 1))
    return df.withColumns({"decision": F.when(failed, "Failed").otherwise(F.col("decision")), "confidence": F.when(failed, 0.0).otherwise(F.col("confidence")),
                           "issues": F.when(failed, F.array(F.lit(why))).otherwise(F.col("issues"))})


def _finished(spark: SparkSession, df: DataFrame, listed: DataFrame, config: Config) -> DataFrame:
    """Results with those of earlier runs, added to the cache, and grouped."""
    if config.cache_dir:
        df = df.persist()
        cache.to_cache(df, config.cache_dir)
        kept = spark.read.parquet(config.cache_dir).join(listed.select("cache_key"), "cache_key", "left_semi").dropDuplicates(["cache_key"])
        df = kept.unionByName(df.where("decision = 'Failed'"), allowMissingColumns=True)
    # bursts look at the frames several times; they are small rows without pixels
    return bursts.annotate(df.persist(), config.burst_gap_seconds) if config.grouping else bursts.ungrouped(df)


def fast(spark: SparkSession, folder: str, config: Config = Config()) -> DataFrame:
    """Decisions from measurements alone, which never delete; files that cannot be decoded are Failed.

    With a cache folder only frames whose key is new are measured; their results, failures apart, are added to it before bursts are looked for.
    """
    listed, old = _listed(spark, folder, config, "fast")
    todo = listed if old is None else cache.work_list(listed, old)
    df = todo.join(measure.measure(_pictures(spark, folder, config)), "path", "left").withColumnRenamed("path", "filepath")
    df = df.withColumn("_t", triage.fast_triage(F.col("cv_sharpness"), F.coalesce("exposure", F.lit("good"))))
    words = F.array().cast("array<string>")
    df = df.withColumns({"subject_sharpness": F.col("_t.subject_sharpness"), "verdict": F.col("_t.verdict"), "framing": F.lit("fine"), "subject": F.lit(""), "technical_issues": words, "verdict_reason": F.lit(""),
                         "keywords": words, "description": F.lit(""), "processing_ms": F.lit(0.0)}).drop("_t")
    return _finished(spark, _judged(df, F.col("peak_tile_var").isNull(), "could not be decoded"), listed, config)


Client = Callable[[], Callable[[bytes | list[bytes]], str]]


def accurate(spark: SparkSession, folder: str, triage_client: Client, tags_client: Client | None = None, config: Config = Config()) -> DataFrame:
    """Decisions of a model and of measurements together; a frame without a usable answer is Failed, never guessed.

    ``workers`` bounds how many pictures are asked about at once. Descriptions are asked for only of frames that the model would not delete.
    """
    listed, old = _listed(spark, folder, config, "accurate")
    todo = listed if old is None else cache.work_list(listed, old)
    pictures = _pictures(spark, folder, config).join(todo.select("path"), "path", "left_semi")
    shown = views.views(pictures)
    asked = vision.ask(shown, triage_client, "answer", "views", config.workers).select("path", vision.triaged(F.col("answer")).alias("t"))
    seen = measure.measure(pictures).drop("exposure")
    df = todo.join(seen, "path", "left").join(asked.select("path", "t.*"), "path", "left")
    none = F.array().cast("array<string>")
    if tags_client:
        told = vision.describe(shown.join(asked.select("path", "t.verdict"), "path"), tags_client, "views", config.workers).select("path", "description", "keywords")
        df = df.join(told, "path", "left").withColumns({"description": F.coalesce("description", F.lit("")), "keywords": F.coalesce("keywords", none)})
    else:
        df = df.withColumns({"description": F.lit(""), "keywords": none})
    df = df.withColumnRenamed("path", "filepath").withColumns({"technical_issues": F.coalesce("technical_issues", none), "verdict_reason": F.coalesce("verdict_reason", F.lit("")), "processing_ms": F.lit(0.0)})
    return _finished(spark, _judged(df, F.col("verdict").isNull(), "no usable answer or picture"), listed, config)


def summary(out: DataFrame, seconds: float) -> list[str]:
    """The lines that end a run: counts, bursts, the surest rejects, the pace. All of it is small sums and ten rows."""
    lines = [f"{r['decision']:8} {r['n']:8} {r['percent']:6.1f} %" for r in stats.decision_counts(out).collect()]
    b = bursts.summary(out).first()
    if b["bursts"]:
        lines.append(f"{b['bursts']} bursts, {b['demoted_to_review']} weaker frames sent to review, {b['near_identical']} nearly the same")
    deleted = out.where("decision = 'Delete'")
    top = deleted.orderBy(F.desc("confidence"), "filepath").limit(10).select("filename", F.array_join("issues", ", ").alias("why")).collect()
    lines += [f"  {r['filename']}  {r['why'] or 'no reason told'}" for r in top]
    if (n := deleted.count()) > len(top):
        lines.append(f"  and {n - len(top)} more; no file was touched")
    pace = stats.pace(out, seconds).first()
    return [*lines, f"{pace['frames']} photographs, {pace['seconds_each']:.1f} s each"]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("folder")
    p.add_argument("--config", help="a YAML file of settings")
    p.add_argument("--fast", action="store_true", help="measurements only; never deletes")
    p.add_argument("--model")
    p.add_argument("--host")
    p.add_argument("--workers", type=int)
    p.add_argument("--no-tags", action="store_true")
    p.add_argument("--skip-vision-check", action="store_true")
    p.add_argument("--extensions")
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--no-grouping", action="store_true")
    p.add_argument("--cache-dir")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--preview-dir", help="folder, mounted on the executors, for previews of raw files")
    p.add_argument("--sidecars", choices=("none", "on1", "xmp"), default="none")
    p.add_argument("--override", action="store_true", help="replace old keywords and descriptions")
    p.add_argument("--suggest-ratings", action="store_true", help="rate photographs that have no rating")
    p.add_argument("--dry-run", action="store_true", help="write no sidecars")
    p.add_argument("--csv", "--csv-file", help="folder for the run record; else one named for the time, in the settings' csv_dir")
    p.add_argument("--report", action=argparse.BooleanOptionalAction, default=False, help="cards and thumbnails beside the record")
    p.add_argument("--detail", action="store_true", help="print each decision")
    p.add_argument("--timestamp", default="")
    a = p.parse_args(argv)
    c = Config.load(a.config)
    c.model_name, c.host, c.workers = a.model or c.model_name, a.host or c.host, max(1, a.workers or c.workers)
    c.recursive, c.grouping, c.tagging = c.recursive and not a.no_recursive, c.grouping and not a.no_grouping, c.tagging and not a.no_tags
    c.extensions = photos.extensions(a.extensions) if a.extensions else c.extensions
    c.cache_dir, c.preview_dir = None if a.no_cache else a.cache_dir or c.cache_dir, a.preview_dir or c.preview_dir
    spark = SparkSession.builder.appName("framesift").getOrCreate()
    begun, now = time.time(), a.timestamp or datetime.now().isoformat(sep=" ", timespec="seconds")
    if a.fast:
        out = fast(spark, a.folder, c).persist()
    else:
        try:
            have = vision.installed(spark, c.host)
            model = c.model_name or next((r["name"] for r in stats.choose_model(have).collect()), None)
            if not model or have.where(F.col("name") == model).isEmpty():
                print(f"no model to ask at {c.host}: {model or 'none of the known families is installed'}")
                return 1
            client = lambda prompt, schema=None: vision.http_client(c.host, model, prompt, schema, c.timeout_seconds, c.context_tokens)
            if c.verify_vision and not a.skip_vision_check and not vision.can_see(client(vision.CANARY_PROMPT)(), int(begun)):
                print(f"{model} does not see what it is shown")
                return 1
        except OSError as e:
            print(f"no model server at {c.host}: {e}")
            return 1
        c.model_name = model
        out = accurate(spark, a.folder, client(vision.TRIAGE_PROMPT, vision.TRIAGE_SCHEMA), client(vision.TAGS_PROMPT, vision.TAGS_SCHEMA) if c.tagging else None, c).persist()
    record = a.csv or f"{c.csv_dir if '://' in c.csv_dir or os.path.isabs(c.csv_dir) else os.path.join(a.folder, c.csv_dir)}/run_{''.join(x for x in now if x.isdigit())}.csv"
    report.write_csv(out, record, now)
    if a.report:
        report.write_page(out, f"{record}.page")
        report.write_thumbs(_pictures(spark, a.folder, c), f"{record}.page/thumbs").write.format("noop").mode("overwrite").save()
    if a.sidecars != "none" and not a.dry_run:
        done = sidecars.save(spark, out, a.folder, a.sidecars, now, metadata.WriteOptions(rating=a.suggest_ratings, override=a.override))
        for r in stats.outcomes(done).collect():  # three rows at most
            print(f"sidecars {r['outcome']}: {r['n']}")
    if a.detail:
        for r in report.ordered(out).select(F.concat_ws("\n", metadata.row_text(), metadata.verdict_text()).alias("x")).toLocalIterator():  # one part at a time
            print(r["x"])
    print("\n".join(summary(out, time.time() - begun)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
