"""Decisions as a reader leaves them: texts edited, parts ticked or not, frames left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keywords import edited, merged

#: The parts of a result that can be ticked, and whether they are where nothing was said.
PARTS = {"include": True, "keywords": True, "own_keywords": True, "description": True, "analysis": True, "rating": False}


def applied(results: DataFrame, edits: DataFrame) -> DataFrame:
    """The ready frames that are to be written, with their edits.

    edits has filepath and any of keywords_text, description_text, stars (1 to 5) and tick_<part> for the parts of ``PARTS``; a frame without a row, and a null
    in one, keeps what the run found and the parts' defaults. Frames that failed or have no decision are not ready. One row a frame is expected of edits.
    """
    kinds = {"keywords_text": "string", "description_text": "string", "stars": "int", **{f"tick_{p}": "boolean" for p in PARTS}}
    have = set(edits.columns)
    e = edits.select(F.col("filepath").alias("_path"), *[F.col(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    d = results.drop(*kinds).where("decision is not null and decision <> 'Failed'").join(e, F.col("filepath") == F.col("_path"), "left").drop("_path")
    d = d.withColumns({f"tick_{p}": F.coalesce(f"tick_{p}", F.lit(on)) for p, on in PARTS.items()}).where("tick_include")
    return d.withColumns({"keywords": F.when(F.col("keywords_text").isNotNull(), edited(F.col("keywords_text"))).otherwise(F.col("keywords")),
                          "description": F.coalesce("description_text", "description")}).drop("keywords_text", "description_text", "tick_include")


def fields(df: DataFrame) -> DataFrame:
    """Adds out_keywords, out_description and out_rating by each frame's own ticks, for rows of ``applied`` with the old fields of their sidecars.

    A ticked description or rating replaces an old one, since a tick is a deliberate act; an empty description and an unset rating replace nothing.
    """
    none = F.array().cast("array<string>")
    words, own = F.col("tick_keywords"), F.col("tick_own_keywords")
    model: Column = F.when(words, F.coalesce("keywords", none)).otherwise(none)
    old = F.col("old_keywords")
    keywords = F.when(own, merged(old, model)).when(words, merged(old, model, decision=False)).otherwise(F.coalesce(old, none))
    new = F.coalesce("description", F.lit(""))
    return df.withColumns({"out_keywords": keywords, "out_description": F.when(F.col("tick_description") & (new != ""), new).otherwise(F.coalesce("old_description", F.lit(""))),
                           "out_rating": F.when(F.col("tick_rating") & F.col("stars").isNotNull(), F.col("stars").cast("string")).otherwise(F.col("old_rating").cast("string"))})


def default_styles(results: DataFrame, listing: DataFrame) -> DataFrame:
    """One row (on1, xmp): the sidecars that the folder uses already. on1 if any ready frame has one, else xmp; the listing has a path for each file."""
    stem = F.regexp_replace("filepath", r"\.[^./]+$", "")
    ready = results.where("decision is not null and decision <> 'Failed'").select(F.concat(stem, F.lit(".on1")).alias("path"))
    some = ready.join(listing.select("path"), "path", "left_semi").agg((F.count("*") > 0).alias("on1"))
    return some.select("on1", (~F.col("on1")).alias("xmp"))
