"""Scores, issues, the two-witness decision and ratings, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S

STRIP = r"^\s+|\s+$"


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end; ``trim`` takes spaces only."""
    return F.regexp_replace(c, STRIP, "")


def _points(c: Column, table: dict[str, int]) -> Column:
    return reduce(lambda out, kv: F.when(c == kv[0], kv[1]).otherwise(out), table.items(), F.lit(S.UNKNOWN))


def scores(df: DataFrame) -> DataFrame:
    """Adds blur_score, exposure_score, composition_score and overall_quality; missing categories take their defaults, unknown ones score a half."""
    a = _points(F.coalesce("subject_sharpness", F.lit("acceptable")), S.SHARPNESS)
    b = _points(F.coalesce("exposure", F.lit("good")), S.EXPOSURE)
    c = _points(F.coalesce("framing", F.lit("fine")), S.FRAMING)
    table = F.str_to_map(F.lit(",".join(f"{k}:{v!r}" for k, v in S.OVERALL.items())))
    return df.withColumns({"blur_score": a / 100.0, "exposure_score": b / 100.0, "composition_score": c / 100.0,
                           "overall_quality": F.element_at(table, F.concat_ws("|", a, b, c)).cast("double")})


def sharpness_score(variance: Column) -> Column:
    """Position of a peak tile variance between the floor and the ceiling, on a log scale, clipped to 0..1."""
    span = F.log10(F.lit(S.VARIANCE_CEILING)) - F.log10(F.lit(S.VARIANCE_FLOOR))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log10(F.greatest(variance, F.lit(1e-6))) - F.log10(F.lit(S.VARIANCE_FLOOR))) / span))


def exposure_category(blown: Column, crushed: Column, mean: Column) -> Column:
    """over before under before mild; a failed measurement (null) is good."""
    return (F.when((blown >= S.SEVERE_CLIP) | (mean >= S.VERY_BRIGHT), "badly_over").when((crushed >= S.SEVERE_CLIP) | (mean <= S.VERY_DARK), "badly_under")
            .when((blown >= S.MILD_CLIP) | (crushed >= S.MILD_CLIP), "slightly_off").otherwise("good"))


def exposure_stats(blown: Column, crushed: Column, mean: Column, contrast: Column) -> Column:
    """The measurement as a struct; a failed one (null mean) reads as a good exposure of middle grey, marked as not available."""
    known = mean.isNotNull()
    return F.struct(F.when(known, exposure_category(blown, crushed, mean)).otherwise("good").alias("category"), F.coalesce(blown, F.lit(0.0)).alias("blown_fraction"),
                    F.coalesce(crushed, F.lit(0.0)).alias("crushed_fraction"), F.coalesce(mean, F.lit(0.5)).alias("mean_level"), F.coalesce(contrast, F.lit(0.0)).alias("contrast"), known.alias("available"))


def is_severe(available: Column, category: Column) -> Column:
    return F.coalesce(available & category.isin("badly_over", "badly_under"), F.lit(False))


def fast_triage(cv: Column, exposure: Column) -> Column:
    """(subject_sharpness, verdict) from measurements alone; one witness never deletes."""
    sharp = F.when(cv.isNull(), "acceptable").when(cv >= S.SHARP_EVIDENCE, "sharp").when(cv >= S.FAST_SOFT, "acceptable").otherwise("soft")
    return F.struct(sharp.alias("subject_sharpness"), F.when((sharp == "soft") | (exposure != "good"), "review").otherwise("keep").alias("verdict"))


def described_issues() -> Column:
    sharp = F.when(F.col("subject_sharpness") == "unusable", "subject out of focus").when(F.col("subject_sharpness") == "soft", "soft focus")
    light = (F.when(F.col("exposure") == "badly_under", "severely underexposed").when(F.col("exposure") == "badly_over", "severely overexposed")
             .when(F.col("exposure") == "slightly_off", "exposure slightly off"))
    frame = F.when(F.col("framing") == "broken", "framing broken").when(F.col("framing") == "weak", "weak framing")
    told = F.filter(F.transform(F.coalesce("technical_issues", F.array().cast("array<string>")), lambda x: F.lower(stripped(x))), lambda x: x != "")
    return F.array_distinct(F.concat(F.array_compact(F.array(sharp, light, frame)), told))


def has_fatal_issue() -> Column:
    """Phrases are looked for across issues joined by one space, so they may span two."""
    text = F.lower(F.array_join("technical_issues", " "))
    return F.coalesce(reduce(lambda a, b: a | b, [text.contains(x) for x in S.FATAL]), F.lit(False))


def decide(df: DataFrame) -> DataFrame:
    """Adds decision, confidence and issues. Delete needs the model and a second witness; measurements alone only raise concerns."""
    no = F.lit(False)
    verdict = F.lower(F.when(F.coalesce("verdict", F.lit("")) == "", "review").otherwise(F.col("verdict")))
    sharp, light = F.coalesce("subject_sharpness", F.lit("")), F.coalesce("exposure", F.lit(""))
    badly = light.isin("badly_under", "badly_over")
    blur = (sharp == "unusable") & F.coalesce(F.col("cv_sharpness") < S.SHARP_EVIDENCE, no)
    clipped = F.coalesce((F.col("blown_fraction") >= S.SEVERE_CLIP) | (F.col("crushed_fraction") >= S.SEVERE_CLIP), no) & F.col("blown_fraction").isNotNull() & F.col("crushed_fraction").isNotNull()
    unreported = light.isin("good", "slightly_off", "") & clipped
    no_detail = F.coalesce(F.col("cv_sharpness") < S.NO_DETAIL, no)
    fine = sharp.isin("sharp", "acceptable") & (light == "good")
    out = lambda d, c, extra=None: F.struct(F.lit(d).alias("decision"), F.lit(c).alias("confidence"), F.lit(extra).cast("string").alias("extra"))
    delete, keep = verdict == "delete", verdict == "keep"
    rule = (F.when(delete & F.col("_fatal"), out("Delete", 0.90)).when(delete & (blur | (badly & clipped)), out("Delete", 0.85)).when(delete, out("Review", 0.55))
            .when(keep & unreported, out("Review", 0.55, "histogram shows clipping the model did not report"))
            .when(keep & no_detail, out("Review", 0.55, "no critically sharp region found in frame"))
            .when(keep & fine & (F.col("framing") == "broken"), out("Review", 0.55))
            .when(keep & fine & (sharp == "sharp"), out("Keep", 0.90)).when(keep & fine, out("Keep", 0.75))
            .when(keep & ((sharp == "unusable") | badly), out("Review", 0.50)).when(keep, out("Keep", 0.65)).otherwise(out("Review", 0.50)))
    df = df.withColumn("_fatal", has_fatal_issue()).withColumn("_rule", rule)
    issues = F.concat(described_issues(), F.array_compact(F.array("_rule.extra")))
    return df.withColumns({"decision": F.col("_rule.decision"), "confidence": F.col("_rule.confidence"), "issues": issues}).drop("_rule", "_fatal")


def rating(quality: Column) -> Column:
    return F.when(quality >= 0.85, 5).when(quality >= 0.70, 4).when(quality >= 0.50, 3).when(quality >= 0.30, 2).otherwise(1)


def hamming(hi1: Column, lo1: Column, hi2: Column, lo2: Column) -> Column:
    """Differing bits of two 64-bit hashes held as halves; null where either is missing."""
    return F.bit_count(hi1.bitwiseXOR(hi2)) + F.bit_count(lo1.bitwiseXOR(lo2))
