import random

import pytest
from pyspark.sql import Window, functions as F

from framesift import schema as S
from framesift.functions import keywords as K, triage as T
from framesift.operators import bursts, ranges, stats

FRAME = ("filepath string, filename string, capture_time timestamp_ntz, phash_hi long, phash_lo long, subject_sharpness string, exposure string, framing string, technical_issues array<string>, "
         "verdict string, verdict_reason string, cv_sharpness double, blown_fraction double, crushed_fraction double")
SHARP, SOFT = S.SHARP_EVIDENCE + 0.2, S.SHARP_EVIDENCE - 0.3


def frame(**k):
    base = dict(filepath="/a/x.nef", filename="x.nef", capture_time=None, phash_hi=None, phash_lo=None, subject_sharpness="sharp", exposure="good", framing="fine", technical_issues=[], verdict="keep",
                verdict_reason="", cv_sharpness=SHARP, blown_fraction=0.0, crushed_fraction=0.0)
    return tuple((base | k).values())


CASES = [
    ({}, "Keep", 0.90), ({"subject_sharpness": "acceptable"}, "Keep", 0.75), ({"subject_sharpness": "soft"}, "Keep", 0.65), ({"subject_sharpness": "soft", "framing": "broken"}, "Keep", 0.65), ({"framing": "broken"}, "Review", 0.55),
    ({"verdict": "delete", "technical_issues": ["Lens Cap on"]}, "Delete", 0.90), ({"verdict": "delete", "technical_issues": ["Pocket", "shot"]}, "Delete", 0.90), ({"verdict": "keep", "technical_issues": ["lens cap"]}, "Keep", 0.90),
    ({"verdict": "DELETE", "subject_sharpness": "unusable", "cv_sharpness": SOFT}, "Delete", 0.85), ({"verdict": "delete", "subject_sharpness": "unusable"}, "Review", 0.55), ({"verdict": "delete", "subject_sharpness": "unusable", "cv_sharpness": None}, "Review", 0.55),
    ({"verdict": "delete", "exposure": "badly_over", "blown_fraction": 0.15}, "Delete", 0.85), ({"verdict": "delete", "exposure": "badly_under", "blown_fraction": 0.3}, "Delete", 0.85), ({"verdict": "delete", "exposure": "badly_over", "blown_fraction": None, "crushed_fraction": 0.9}, "Review", 0.55),
    ({"blown_fraction": 0.2}, "Review", 0.55), ({"cv_sharpness": 0.1}, "Review", 0.55), ({"subject_sharpness": "unusable", "cv_sharpness": None}, "Review", 0.50), ({"exposure": "badly_over"}, "Review", 0.50),
    ({"verdict": "review"}, "Review", 0.50), ({"verdict": ""}, "Review", 0.50), ({"verdict": None}, "Review", 0.50), ({"verdict": "what"}, "Review", 0.50), ({"cv_sharpness": None, "blown_fraction": None, "crushed_fraction": None}, "Keep", 0.90),
]


def test_decision_table(spark):
    df = spark.createDataFrame([frame(filepath=str(i), **k) for i, (k, _, _) in enumerate(CASES)], FRAME)
    got = {int(r["filepath"]): (r["decision"], r["confidence"]) for r in T.decide(T.scores(df)).collect()}
    assert got == {i: (d, c) for i, (_, d, c) in enumerate(CASES)}


def test_no_deletion_without_the_model(spark):
    r = random.Random(1)
    rows = [frame(subject_sharpness=r.choice([*S.SHARPNESS, None, "?"]), exposure=r.choice([*S.EXPOSURE, None]), framing=r.choice([*S.FRAMING, None]), verdict=r.choice(["keep", "review", "", None]), cv_sharpness=r.choice([None, 0.0, 0.5, 1.0]),
                  blown_fraction=r.choice([None, 0.0, 1.0]), crushed_fraction=r.choice([None, 0.0, 1.0]), technical_issues=r.choice([[], None, ["lens cap"]])) for _ in range(300)]
    out = T.decide(T.scores(spark.createDataFrame(rows, FRAME)))
    assert out.where("decision = 'Delete' or decision is null").count() == 0 and out.count() == 300


def test_issues_and_scores(spark):
    df = spark.createDataFrame([frame(subject_sharpness="unusable", exposure="slightly_off", framing="weak", technical_issues=[" Soft ", "soft", "", "weak framing"]), frame(subject_sharpness=None, exposure="odd")], FRAME)
    a, b = T.decide(T.scores(df)).collect()
    assert a["issues"] == ["subject out of focus", "exposure slightly off", "weak framing", "soft"]
    assert (b["blur_score"], b["exposure_score"], b["overall_quality"]) == (0.7, 0.5, round(0.55 * 0.7 + 0.3 * 0.5 + 0.15 * 0.65, 3))


def test_keywords(spark):
    df = spark.createDataFrame([(["Sea_Wall", " fog ", "FOG", "a-b", "...", "!", "  many   spaces "],), ([],), (None,)], "k array<string>")
    assert [r[0] for r in df.select(K.clean(F.col("k"))).collect()] == [["sea wall", "fog", "a b", "many spaces"], [], []]
    df = spark.createDataFrame([(["Vancouver", "vancouver ", " ", "Fog", "VANCOUVER"],), ([],)], "k array<string>")
    assert [r[0] for r in df.select(K.deduplicated(F.col("k"))).collect()] == [["Vancouver", "Fog"], []]
    assert spark.range(1).select(K.edited(F.lit(" a, ,b ,"))).first()[0] == ["a", "b"]


def shots(seed, n=400):
    import datetime as dt

    r, t, rows = random.Random(seed), dt.datetime(2024, 5, 1, 23, 0, 0), []
    for i in range(n):
        t += dt.timedelta(seconds=r.choice([0, 1, 3, 3, 4, 60, 9000, 50_000]))
        near = r.choice([0, 1, 0xFF, 0xFFFFF])
        rows.append(frame(filepath=f"/s/{i:04}.nef", filename=f"{i:04}.nef", capture_time=None if r.random() < 0.05 else t, phash_hi=None if r.random() < 0.1 else near, phash_lo=0, verdict=r.choice(["keep", "review"]), subject_sharpness=r.choice([*S.SHARPNESS])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_bucketed_scan_equals_one_window(spark, seed):
    df = T.decide(T.scores(spark.createDataFrame(shots(seed), FRAME)))
    w = Window.orderBy(F.col("capture_time").asc_nulls_last(), "filename", "filepath")
    same = (F.col("capture_time") - F.lag("capture_time").over(w) <= F.expr("INTERVAL '3' SECOND")) & F.coalesce(T.hamming(F.col("phash_hi"), F.col("phash_lo"), F.lag("phash_hi").over(w), F.lag("phash_lo").over(w)) <= S.SIMILAR, F.lit(True))
    plain = df.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("g", F.sum("new").over(w) - 1)
    want = {r["filepath"]: r["g"] for r in plain.collect()}
    for rows in (10_000, 37, 5):
        assert {r["filepath"]: r["group_id"] for r in bursts.groups(df, rows=rows).collect()} == want


@pytest.mark.parametrize("times", ["one day", "none", "one moment"])
def test_a_shoot_is_many_tasks(spark, times):
    """Neither one day, nor one moment, nor frames without times meet in one range."""
    import datetime as dt

    t = dt.datetime(2024, 5, 1)
    at = {"one day": lambda i: t + dt.timedelta(seconds=i % 1000), "none": lambda i: None, "one moment": lambda i: t}[times]
    df = spark.createDataFrame([frame(filepath=f"/s/{i:04}.nef", filename=f"{i % 7}.nef", capture_time=at(i)) for i in range(1000)], FRAME).withColumn("decision", F.lit("Keep"))
    sizes = [r["count"] for r in ranges.ranged(df, ["capture_time", "filename", "filepath"], "r", 100).groupBy("r").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 150
    got = {r["group_id"] for r in bursts.groups(df, rows=100).collect()}
    assert len(got) == (1000 if times == "none" else 1)


def test_failure_runs_over_ranges(spark):
    r = random.Random(8)
    rows = [(r.randrange(3) if i % 2 else None, i, r.random() < 0.8) for i in range(600)]
    df = spark.createDataFrame(rows, "lane int, i int, bad boolean")
    want = []
    for lane in (0, 1, 2, None):
        run = []
        for _, i, bad in [x for x in rows if x[0] == lane] + [(lane, None, False)]:
            if bad:
                run.append(i)
            else:
                if len(run) >= 4:
                    want.append((lane, run[0], run[-1], len(run)))
                run = []
    for size in (10_000, 50):
        got = [tuple(x) for x in stats.failure_runs(df, F.col("bad"), "lane", "i", 4, size).select("lane", "first", "last", "length").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_ranges_of_odd_keys(spark):
    r = random.Random(9)
    rows = [(r.choice([None, "", "a", "a'b\\", "é", "zz"]), r.choice([None, -5, 7, 10**12])) for _ in range(300)]
    df = ranges.ranged(spark.createDataFrame(rows, "s string, n long"), ["s", "n"], "r", 20)
    got = [x["r"] for x in df.orderBy(F.col("s").asc_nulls_last(), F.col("n").asc_nulls_last()).collect()]
    assert got == sorted(got) and len(set(got)) > 5
    none = df.limit(0).drop("r")
    assert ranges.ranged(none, ["s"], "r") is none and ranges.runs(none, ["s"], F.struct("s"), lambda a, b: F.lit(True)).count() == 0


def test_demotion_only_moves_keeps_to_review(spark):
    df = T.decide(T.scores(spark.createDataFrame(shots(3), FRAME)))
    before = {r["filepath"]: r["decision"] for r in df.collect()}
    out = bursts.annotate(df).collect()
    assert all(r["decision"] == before[r["filepath"]] or (before[r["filepath"]], r["decision"]) == ("Keep", "Review") and r["confidence"] <= 0.6 and not r["is_best_of_group"] for r in out)
    best = [r["group_id"] for r in out if r["is_best_of_group"]]
    assert len(best) == len(set(best)) == len({r["group_id"] for r in out}) and any(r["demoted"] for r in out)


def test_failed_frames_and_empty_tables(spark):
    df = T.decide(T.scores(spark.createDataFrame(shots(4, 5), FRAME))).withColumn("decision", F.lit("Failed"))
    out = bursts.annotate(df).collect()
    assert len(out) == 5 and all(r["group_id"] is None and r["group_size"] == 1 and r["is_best_of_group"] for r in out)
    assert bursts.annotate(df.limit(0)).count() == 0
