"""What goes into sidecars, run records and reports; nothing here touches a photograph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.keywords import issues_text, merged
from ..functions.triage import rating


@dataclass(frozen=True)
class WriteOptions:
    """Which parts of a result reach the sidecar; a rating column of None leaves ratings alone."""

    keywords: bool = True
    own_keywords: bool = True
    description: bool = True
    analysis: bool = True
    rating: bool = False
    force_rating: bool = False
    force_description: bool = False
    override: bool = False


def two(c) -> Column:
    return F.format_string("%.2f", c)


def analysis_block(tool: str = S.TOOL) -> Column:
    """Ten fields, and reason and measured_sharpness where there are any; map of strings."""
    fields = [("decision", F.col("decision")), ("confidence", two("confidence")), ("issues", issues_text()), ("subject_sharpness", F.col("subject_sharpness")), ("exposure", F.col("exposure")),
              ("framing", F.col("framing")), ("blur_score", two("blur_score")), ("exposure_score", two("exposure_score")), ("composition_score", two("composition_score")),
              ("overall_quality", two("overall_quality")), ("reason", F.when(F.col("verdict_reason") != "", F.col("verdict_reason"))),
              ("measured_sharpness", F.when(F.col("cv_sharpness").isNotNull(), two("cv_sharpness")))]
    return F.map_filter(F.create_map(*[x for k, v in fields for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def camel(name: Column) -> Column:
    """snake_case as camelCase."""
    parts = F.split(name, "_")
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.initcap(x)), ""))


def analysis_attributes(block: Column | None = None) -> Column:
    """The block under the names of an XMP file's attributes."""
    return F.transform_keys(analysis_block() if block is None else block, lambda k, _: camel(k))


def analysis_summary(tool: str = S.TOOL) -> Column:
    or_dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(F.col(c))
    role = F.when(F.col("is_best_of_group"), "best").otherwise("alternate")
    return F.concat_ws(" | ", F.concat(F.lit(f"{tool}: "), "decision", F.lit(" ("), two("confidence"), F.lit(")")), F.concat(F.lit("sharpness "), or_dash("subject_sharpness")),
                       F.concat(F.lit("exposure "), or_dash("exposure")), F.concat(F.lit("framing "), or_dash("framing")),
                       F.when(F.col("group_size") > 1, F.concat(F.lit("burst "), role, F.lit(" of "), F.col("group_size").cast("string"))),
                       F.when(F.size("issues") > 0, F.concat(F.lit("issues: "), F.array_join("issues", ", "))), F.when(F.col("verdict_reason") != "", F.col("verdict_reason")))


def row_text() -> Column:
    """A frame's line in a list: what was decided, then its name."""
    return F.concat(F.rpad(F.coalesce("decision", F.lit("...")), 7, " "), F.lit(" "), F.col("filename"))


def verdict_text() -> Column:
    """What is known of a frame, a line each: categories, subject, issues, the model's reason, its place in a burst."""
    told = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(F.col(c))
    role = F.when(F.col("is_best_of_group"), "best").otherwise("alternate")
    return F.concat_ws("\n", F.concat(F.lit("sharpness "), told("subject_sharpness"), F.lit(", exposure "), told("exposure"), F.lit(", framing "), told("framing")),
                       F.when(F.col("subject") != "", F.concat(F.lit("subject: "), "subject")), F.when(F.size("issues") > 0, F.concat(F.lit("issues: "), F.array_join("issues", ", "))),
                       F.when(F.col("verdict_reason") != "", F.col("verdict_reason")), F.when(F.col("group_size") > 1, F.concat(F.lit("burst: "), role, F.lit(" of "), F.col("group_size").cast("string"))))


def on1_fields(df: DataFrame, o: WriteOptions = WriteOptions()) -> DataFrame:
    """Adds out_keywords, out_description and out_rating for a JSON sidecar with old_keywords, old_description and old_rating.

    Descriptions and ratings fill empty slots only, unless forced; a rating of 0 is an empty slot.
    """
    desc, old = F.coalesce("description", F.lit("")), F.coalesce("old_description", F.lit(""))
    write = (desc != "") & (F.lit(o.override or o.force_description) | (old == "")) if o.description else F.lit(False)
    stars = rating(F.col("overall_quality")) if o.rating else F.lit(None).cast("int")
    free = F.lit(o.force_rating) | (F.coalesce(F.col("old_rating").try_cast("int"), F.lit(0)) == 0)
    return df.withColumns({"out_keywords": merged(F.col("old_keywords"), F.col("keywords"), o.override, o.keywords, o.own_keywords),
                           "out_description": F.when(write, desc).otherwise(F.col("old_description")),
                           "out_rating": F.when(stars.isNotNull() & free, stars).otherwise(F.col("old_rating").try_cast("int"))})


def xmp_fields(df: DataFrame, o: WriteOptions = WriteOptions(), tool: str = S.TOOL) -> DataFrame:
    """The same for an XMP sidecar, whose old rating is text: here the model's description replaces an old one, and a file without one gets the decision."""
    desc, old = F.coalesce("description", F.lit("")), F.coalesce("old_description", F.lit(""))
    had = F.regexp_replace(F.coalesce(F.col("old_rating").cast("string"), F.lit("")), r"^\s+|\s+$", "")
    real = (had != "") & (had != "0")
    stars = rating(F.col("overall_quality")).cast("string") if o.rating else F.lit(None).cast("string")
    text = F.when(F.lit(o.description) & (desc != ""), desc).when(F.lit(not o.override) & (old != ""), old).when(F.lit(o.description), F.concat(F.lit(f"{tool}: "), "decision")).otherwise("")
    return df.withColumns({"out_keywords": merged(F.col("old_keywords"), F.col("keywords"), o.override, o.keywords, o.own_keywords), "out_description": text,
                           "out_rating": F.when(real & F.lit(not o.force_rating), had).when(stars.isNotNull(), stars).when(real, had)})


def sidecar_path(photos: DataFrame, listing: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds xmp_path: an existing file named for the stem, else one named for the whole name, else the first form.

    A file that is listed twice counts once. ``within`` names columns of both tables that tell apart what is listed under like paths.
    """
    stem = F.regexp_replace("filepath", r"\.[^./]+$", "")
    p = photos.withColumns({"_a": F.concat(stem, F.lit(".xmp")), "_b": F.concat("filepath", F.lit(".xmp"))})
    have = listing.select(F.col("path").alias("_x"), *[F.col(c).alias(f"_x_{c}") for c in within]).distinct()

    def look(df: DataFrame, key: str) -> DataFrame:
        on = [F.col(key) == F.col("_x"), *[F.col(c).eqNullSafe(F.col(f"_x_{c}")) for c in within]]
        return df.join(have, on, "left").drop(*[f"_x_{c}" for c in within])

    p = look(look(p, "_a").withColumnRenamed("_x", "_xa"), "_b")
    return p.withColumn("xmp_path", F.coalesce("_xa", "_x", "_a")).drop("_a", "_b", "_xa", "_x")


def csv_rows(df: DataFrame, timestamp: str) -> DataFrame:
    """The run record: 21 columns of text, one timestamp for the run; measured sharpness is blank where unknown."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    c = {"timestamp": F.lit(timestamp), "filepath": F.col("filepath"), "filename": F.col("filename"), "decision": F.col("decision"), "confidence": two("confidence"), "issues": F.array_join("issues", "; "),
         "subject": text("subject"), "subject_sharpness": text("subject_sharpness"), "exposure": text("exposure"), "framing": text("framing"), "blur_score": two("blur_score"), "exposure_score": two("exposure_score"),
         "composition_score": two("composition_score"), "overall_score": two("overall_quality"), "measured_sharpness": F.when(F.col("cv_sharpness").isNull(), "").otherwise(two("cv_sharpness")),
         "burst_size": F.col("group_size").cast("string"), "best_of_burst": F.when(F.col("is_best_of_group"), "yes").otherwise("no"), "duplicate_of": text("duplicate_of"), "description": text("description"),
         "keywords": F.array_join("keywords", ", "), "processing_ms": F.format_string("%.0f", F.coalesce("processing_ms", F.lit(0.0)))}
    return df.select(*[c[n].alias(n) for n in S.CSV_COLUMNS])


def report_sections(df: DataFrame) -> DataFrame:
    """Adds section (its order in the report) and position (what its cards are sorted by); issues is text here or an array."""
    issues = F.array_join("issues", "; ") if dict(df.dtypes)["issues"].startswith("array") else F.coalesce("issues", F.lit(""))
    alternate = issues.contains("burst of") | issues.contains("near-duplicate")
    section = (F.when(F.col("decision") == "Delete", 1).when((F.col("decision") == "Review") & ~alternate, 2).when(F.col("decision") == "Review", 3).when(F.col("decision") == "Keep", 4).otherwise(5))
    return df.withColumn("section", section).withColumn("position", F.when(section == 2, issues).otherwise(""))
