"""Global order without a global window: ranges of a sort key, with what crosses their borders carried in a table of ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that one range, and so one task, orders; there are never more than MOST ranges, whose bounds are literals of the plan.
ROWS, MOST = 500_000, 1024
#: Keys that the driver looks at for the bounds.
SAMPLE = 20_000


def _bounds(df: DataFrame, key: list[str], rows: int) -> list:
    total = df.count()
    parts = min(MOST, -(-total // rows))
    if parts < 2:
        return []
    step = max(1, total // SAMPLE)
    some = df.select(*key).where(F.pmod(F.xxhash64(*key), F.lit(step)) == 0) if step > 1 else df.select(*key)
    # as text, which casts back to the same value; about SAMPLE rows of keys at most twice over
    found = [tuple(r) for r in some.orderBy(*[F.col(c).asc_nulls_last() for c in key]).select(*[F.col(c).cast("string") for c in key]).limit(2 * SAMPLE).collect()]
    return sorted({found[len(found) * i // parts]: i for i in range(1, parts)}.items(), key=lambda x: x[1]) if found else []


def ranged(df: DataFrame, key: list[str], name: str, rows: int = ROWS, like: DataFrame | None = None) -> DataFrame:
    """df with the number of its range, or df itself if all of it is one: rows with a smaller key are in the same range or one before it; nulls come last.

    The key is counted and sampled in jobs of their own, so df is best read from a table. Where it comes of long work, ``like`` is counted
    and sampled in its place: a cheaper table of no fewer rows with the same key columns, whose keys lie about as df's do. Any bounds give the same order.
    Equal keys share a range; give the key a last column that tells rows apart where many could be equal.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def value(c: str, text: str | None) -> list[Column]:
        v = F.lit(text).cast(kinds[c])
        return [F.lit(text is None), v]

    own = F.struct(*[x for c in key for x in (F.col(c).isNull(), F.col(c))])
    marks = [F.struct(*[x for c, t in zip(key, b) for x in value(c, t)]) for b, _ in _bounds(df if like is None else like, key, rows)]
    if not marks:
        return df
    bounds = F.array(*marks)
    # halving the steps finds the number of bounds that are not above the key
    steps = [1 << i for i in reversed(range(len(marks).bit_length()))]
    at = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda a, s: F.when((a + s <= len(marks)) & F.coalesce(F.get(bounds, a + s - 1) <= own, F.lit(False)), a + s).otherwise(a))
    return df.withColumn(name, at)


def runs(df: DataFrame, key: list[str], own: Column, parted: Callable[[Column, Column], Column], name: str = "run", rows: int = ROWS, like: DataFrame | None = None) -> DataFrame:
    """df with the number of its run: in the order of the key a row begins a run where ``parted(before, own)`` holds of the row before it and itself.

    ``own`` is a struct of what the test looks at. Within a range a window finds the runs; a table with a row a range carries
    the last row and the number of runs on, and says whether a range's first row goes on with the run before it. ``like`` is as in ``ranged``.
    """
    d = ranged(df, key, "_range", rows, like)
    alone = d is df  # all rows are one range: nothing crosses a border
    w = (Window if alone else Window.partitionBy("_range")).orderBy(*[F.col(c).asc_nulls_last() for c in key])
    d = d.withColumn("_own", own)
    d = d.withColumns({"_at": F.row_number().over(w), "_before": F.lag("_own").over(w)})
    d = d.withColumn("_run", F.sum(F.when((F.col("_at") > 1) & ~parted(F.col("_before"), F.col("_own")), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if alone:
        return d.withColumn(name, (F.col("_run") - 1).cast("long")).drop("_own", "_at", "_before", "_run")
    each = d.groupBy("_range").agg(F.min_by("_own", "_at").alias("_first"), F.max_by("_own", "_at").alias("_last"), F.max("_run").alias("_n"))
    order = Window.orderBy("_range")  # over ranges, of which there are MOST at most, not rows
    each = each.withColumn("_prior", F.lag("_last").over(order))
    joined = F.col("_prior").isNotNull() & ~parted(F.col("_prior"), F.col("_first"))
    each = each.withColumn("_joined", F.when(joined, 1).otherwise(0))
    each = each.select("_range", (F.sum(F.col("_n") - F.col("_joined")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_off"))
    # every row has its range there; an inner join would ask for ranges that are not null on one side alone, and all before it would run twice
    return d.join(each, "_range", "left").withColumn(name, (F.col("_off") + F.col("_run") - 1).cast("long")).drop("_range", "_own", "_at", "_before", "_run", "_off")
