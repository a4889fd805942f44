"""Keyword cleaning and merging, with order kept."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schema as S
from .expr import let
from .triage import rating, stripped

PUNCTUATION = r"""^[ .,;:!?"']+|[ .,;:!?"']+$"""


def clean(raw: Column, limit: int = S.KEYWORD_LIMIT) -> Column:
    """Underscores and hyphens to spaces, spaces collapsed, lower case, punctuation off both ends, blanks and repeats dropped, the first ``limit``."""
    one = lambda x: F.regexp_replace(F.lower(stripped(F.regexp_replace(F.translate(x, "_-", "  "), r"\s+", " "))), PUNCTUATION, "")
    return F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), one), lambda x: x != "")), 1, limit)


def own(keyword: Column) -> Column:
    return keyword.rlike("^(" + "|".join(S.OWN_PREFIXES) + ")")


def deduplicated(keywords: Column) -> Column:
    """The first spelling of each keyword, compared without case and outer white space; blanks go. Two sorts, so long lists cost no square."""
    tag = lambda x, i: F.struct(F.lower(stripped(x)).alias("k"), i.alias("i"), x.alias("x"))
    first = lambda s: F.filter(s, lambda e, i: (e["k"] != "") & ~F.coalesce(F.get(s, i - 1)["k"] == e["k"], F.lit(False)))
    by_place = lambda s: F.array_sort(F.transform(first(s), lambda e: F.struct(e["i"], e["x"])))
    return let(F.array_sort(F.transform(F.array_compact(keywords), tag)), lambda s: F.transform(by_place(s), lambda e: e["x"]))


def issues_text() -> Column:
    return F.when(F.size("issues") > 0, F.array_join("issues", ", ")).otherwise("none")


def decision_keywords(tool: str = S.TOOL) -> Column:
    """The engine's own keywords of a decided, burst-annotated frame."""
    role = F.when(F.col("is_best_of_group"), "best").otherwise("alternate")
    burst = F.when(F.col("group_size") > 1, F.concat(F.lit(f"{tool}Burst:"), role, F.lit("-of-"), F.col("group_size").cast("string")))
    twin = F.when(F.coalesce("duplicate_of", F.lit("")) != "", F.concat(F.lit(f"{tool}Duplicate:"), "duplicate_of"))
    return F.array_compact(F.array(
        F.concat(F.lit(f"{tool}:"), "decision"), F.concat(F.lit(f"{tool}Confidence:"), F.format_string("%.2f", "confidence")),
        F.concat(F.lit(f"{tool}Issues:"), issues_text()), F.concat(F.lit(f"{tool}Rating:"), rating(F.col("overall_quality")).cast("string")), burst, twin))


def merged(existing: Column, model: Column, override: bool = False, keywords: bool = True, decision: bool = True, tool: str = S.TOOL) -> Column:
    """Kept, then the first model keywords, then the engine's own; untouched where both sources are off and nothing is overridden."""
    none = F.array().cast("array<string>")
    if not (keywords or decision or override):
        return F.coalesce(existing, none)
    parts = [none if override else F.filter(F.coalesce(existing, none), lambda x: ~own(x))]
    if keywords:
        parts.append(F.slice(F.coalesce(model, none), 1, S.SIDECAR_KEYWORDS))
    if decision:
        parts.append(decision_keywords(tool))
    return deduplicated(F.concat(*parts))


def edited(text: Column) -> Column:
    """A comma-separated edit as keywords."""
    return F.filter(F.transform(F.split(text, ","), stripped), lambda x: x != "")
