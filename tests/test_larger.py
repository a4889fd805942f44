"""Queries on tables of which the small ones are no measure: long event numbers, repeated paths, many ranges."""

import shutil

import pytest
from pyspark.sql import functions as F

from framesift.operators import metadata, ranges, resolve
from framesift.plans import queries as Q


@pytest.fixture
def long_numbers(spark, tmp_path):
    """Events of few users with numbers of seven digits, beside those of six that their paths are cut to."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 100").withColumn("user_id", F.col("user_id") % 2)
    e.unionByName(e.withColumn("event_id", F.col("event_id") + 1_000_000)).unionByName(e.withColumn("event_id", F.col("event_id") + 100_000)).coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "sf").mkdir()
    shutil.copy(next((tmp_path / "written").glob("*.parquet")), tmp_path / "sf" / "events.parquet")
    return str(tmp_path / "sf")


def test_xmp_paths_of_frames_that_share_a_path(compare, long_numbers):
    compare(Q.QUERIES["xmp_paths"], Q.ORACLES["xmp_paths"], long_numbers)


def test_a_sidecar_listed_twice_counts_once(spark):
    photos = spark.createDataFrame([("/s/a.nef", 1), ("/s/b.nef", 1), ("/s/c.nef", 1), ("/s/a.nef", 2), ("/s/a.nef", None)], "filepath string, card int")
    listing = spark.createDataFrame([("/s/a.xmp", 1), ("/s/a.xmp", 1), ("/s/b.nef.xmp", 1), ("/s/b.nef.xmp", 1), ("/s/a.nef.xmp", None)], "path string, card int")
    of = lambda *x: sorted(tuple(r) for r in metadata.sidecar_path(photos, listing, *x).select(F.coalesce("card", F.lit(0)), "filepath", "xmp_path").collect())
    assert of(("card",)) == [(0, "/s/a.nef", "/s/a.nef.xmp"), (1, "/s/a.nef", "/s/a.xmp"), (1, "/s/b.nef", "/s/b.nef.xmp"), (1, "/s/c.nef", "/s/c.xmp"), (2, "/s/a.nef", "/s/a.xmp")]
    assert [x[2] for x in of()] == ["/s/a.xmp", "/s/a.xmp", "/s/b.nef.xmp", "/s/c.xmp", "/s/a.xmp"]


def test_resolved_by_path_looks_for_its_bounds_in_the_listing(compare, monkeypatch):
    """Resolving is long work: it is neither counted nor sampled to be put in order, and many ranges give the SQL's places."""
    seen, of = [], ranges._bounds
    monkeypatch.setattr(ranges, "_bounds", lambda df, key, rows: seen.append(df) or of(df, key, 50))
    compare(Q.QUERIES["resolved_by_path"], Q.ORACLES["resolved_by_path"], "/root/testdata/sf0.001")
    (looked_at,) = seen
    assert "Join" not in looked_at._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("low,high", [(0, 400), (390, 1000), (5000, 9000)])
def test_bounds_of_another_table_give_the_same_order(spark, low, high):
    df = spark.range(400).select((F.col("id") * 7 % 400).alias("k"))
    got = ranges.runs(df, ["k"], F.struct(F.lit(1).alias("x")), lambda a, b: F.lit(True), "place", 30, spark.range(low, high).select(F.col("id").alias("k"))).collect()
    assert sorted((r["k"], r["place"]) for r in got) == [(i, i) for i in range(400)]


def test_the_index_of_odd_names(spark):
    names = ["D1.NEF", "d1.Jpg", ".D1.NEF", "sub/.D2.nef", "sub.nef/D3", "D4.nef.txt", ".nef", "a..cr2", "b.c.TIFF", "x y.heic", "D5.xnef", "D6.1nef", "sub/D1.dng"]
    got = {(r["folder"], r["key"]): (r["original"], r["render"]) for r in resolve.folder_index(spark.createDataFrame([(f"/p/{n}",) for n in names], "path string")).collect()}
    assert got == {("/p", "d1"): ("/p/D1.NEF", "/p/d1.Jpg"), ("/p", "a."): ("/p/a..cr2", None), ("/p", "b.c"): (None, "/p/b.c.TIFF"), ("/p", "x y"): ("/p/x y.heic", None), ("/p/sub", "d1"): ("/p/sub/D1.dng", None)}
