"""Scanning, measuring, sidecars, reports, runs over a folder, and what must never be done to photographs."""

import ast
import datetime as dt
import http.server
import json
import pathlib
import re
import struct
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift import run, schema as S
from framesift.functions import measure as M, views
from framesift.operators import edits, evalset, metadata, report, resolve, stats, vision
from framesift.sources import files, photos, sidecars
from framesift.streaming import ingest

REPO = pathlib.Path(__file__).parent.parent


def png(pixels):
    h, w, _ = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(seed=0, size=(240, 320)):
    r = np.random.default_rng(seed)
    return np.repeat(np.repeat(r.integers(40, 200, (size[0] // 4, size[1] // 4, 3), np.uint8), 4, 0), 4, 1)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PNG").write_bytes(png(picture(1)))
    (tmp_path / "sub" / "b.png").write_bytes(png(picture(2)))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    for n in ("c.HEIC", "d.heic", "e.NEF", "f.JPG", "ignore.txt", "movie.MOV"):
        (tmp_path / n).write_bytes(b"x")
    return tmp_path


def test_scan_ignores_case(spark, folder):
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())
    assert names(photos.scan(spark, str(folder))) == ["c.HEIC", "d.heic", "e.NEF", "f.JPG"]
    assert names(photos.scan(spark, str(folder), photos.extensions("PNG, .nef"))) == ["a.PNG", "b.png", "broken.png", "e.NEF"]
    assert names(photos.scan(spark, str(folder), (".png",), recursive=False)) == ["a.PNG", "broken.png"]


def tiff(order, text, sub):
    """A header whose directory has the date, or one that leads to the original time."""
    ifd = lambda es: struct.pack(order + "H", len(es)) + b"".join(struct.pack(order + "HHII", *e) for e in es) + bytes(4)
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    return head + (ifd([(0x8769, 4, 1, 26)]) + ifd([(0x9003, 2, 20, 44)]) if sub else ifd([(0x0132, 2, 20, 26)])) + text.encode() + b"\0"


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("sub", [True, False])
def test_capture_time(order, sub):
    t = tiff(order, "2024:05:06 07:08:09", sub)
    assert photos.exif_time(t) == dt.datetime(2024, 5, 6, 7, 8, 9)
    assert photos.exif_time(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + t) == dt.datetime(2024, 5, 6, 7, 8, 9)
    assert photos.exif_time(t[:30]) is None and photos.exif_time(b"") is None and photos.exif_time(tiff(order, "0000:00:00 00:00:00", sub)) is None


def test_measurements_tell_variants_apart(spark, folder):
    v = evalset.variants(photos.pixels(spark, str(folder)))
    got = {(r["path"].rsplit("/", 1)[1][0], r["kind"]): r for r in M.measure(v).collect()}
    assert len(got) == 8
    for p in "ab":
        assert got[p, "original"]["cv_sharpness"] > 0.55 > 0.1 > got[p, "defocus"]["cv_sharpness"]
        assert got[p, "original"]["exposure"] == "good" and got[p, "underexposed"]["exposure"] == "badly_under" and got[p, "overexposed"]["exposure"] == "badly_over"
        a, b = got[p, "original"], got[p, "defocus"]
        assert (a["phash_hi"] ^ b["phash_hi"]).bit_count() + (a["phash_lo"] ^ b["phash_lo"]).bit_count() < 24
    a, b = got["a", "original"], got["b", "original"]
    assert (a["phash_hi"] ^ b["phash_hi"]).bit_count() + (a["phash_lo"] ^ b["phash_lo"]).bit_count() > 12


def test_tiles_and_tiny_pictures():
    flat = np.full((50, 70), 128.0)
    tiles, whole = M.tile_variances(flat)
    assert len(tiles) == 64 and set(tiles) == {0.0} and whole == 0.0
    for shape in ((1, 1, 3), (1, 9, 3), (5, 5, 1), (33, 17, 4)):
        assert all(x is not None for x in M.measured(np.zeros(shape, np.uint8)))
    grey = np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert M.shrink(grey, 2, 2).tolist() == [[13.5, 17.5], [45.5, 49.5]]


def test_fast_run_and_cache(spark, folder, tmp_path_factory):
    cache = str(tmp_path_factory.mktemp("c") / "cache")
    conf = run.Config(extensions=(".png", ".nef"), cache_dir=cache)
    out = {r["filename"]: r for r in run.fast(spark, str(folder), conf).collect()}
    assert {n: r["decision"] for n, r in out.items()} == {"a.PNG": "Keep", "b.png": "Keep", "broken.png": "Failed", "e.NEF": "Failed"}
    assert spark.read.parquet(cache).count() == 2
    again = run.fast(spark, str(folder), conf)
    assert again.count() == 4 and spark.read.parquet(cache).count() == 2
    csv = str(tmp_path_factory.mktemp("r") / "csv")
    report.write_csv(again, csv, "2024-01-01 00:00:00")
    back = report.read_csv(spark, csv)
    assert tuple(back.columns) == S.CSV_COLUMNS and back.count() == 4
    page = report.render(back.withColumn("filename", F.lit("<b>&")))
    assert "Keeps" in page and "Failed" in page and "&lt;b&gt;&amp;" in page and "Rejects" not in page
    s = stats.session_summary(again).first()
    assert s["total_images"] == 4 and s["valid"] == 2 and s["top_keywords"] == []


def decided(spark, path, **k):
    base = dict(filepath=str(path), filename=path.name, decision="Keep", confidence=0.88, issues=[], subject_sharpness="sharp", exposure="good", framing="strong", blur_score=0.9, exposure_score=0.9, composition_score=0.9, overall_quality=0.9,
                verdict_reason='a "quoted" <reason>', cv_sharpness=0.8, keywords=["seawall", "fog"], description="A bridge in fog", group_size=1, is_best_of_group=True, duplicate_of=None, old_keywords=[], old_description="", old_rating=None) | k
    kinds = ("filepath string, filename string, decision string, confidence double, issues array<string>, subject_sharpness string, exposure string, framing string, blur_score double, exposure_score double, composition_score double, overall_quality double, "
             "verdict_reason string, cv_sharpness double, keywords array<string>, description string, group_size int, is_best_of_group boolean, duplicate_of string, old_keywords array<string>, old_description string, old_rating string")
    return spark.createDataFrame([tuple(base.values())], kinds).withColumns({"analysis": metadata.analysis_block(), "summary": metadata.analysis_summary()})


def on1(path, meta):
    path.with_suffix(".on1").write_text(json.dumps({"photos": {"id": {"name": path.name, "metadata": meta, "ml_classes": {"classifications": [{"type": "PartialLabelingCSL"}, {"type": "other"}]}}}, "version": 7}))


@pytest.mark.parametrize("meta,options,want", [
    ({}, {}, {"Description": "A bridge in fog", "Keywords": ["seawall", "fog"]}),
    ({"Keywords": ["Vancouver", "FrameSift:Delete"]}, {}, {"Keywords": ["Vancouver", "seawall", "fog"]}),
    ({"Keywords": ["Seawall"]}, {}, {"Keywords": ["Seawall", "fog"]}),
    ({"Keywords": ["Vancouver"]}, {"override": True}, {"Keywords": ["seawall", "fog"]}),
    ({"Keywords": ["Vancouver"]}, {"keywords": False, "own_keywords": False}, {"Keywords": ["Vancouver"]}),
    ({"Rating": 2}, {"rating": True}, {"Rating": 2}), ({"Rating": 2}, {"rating": True, "force_rating": True}, {"Rating": 5}), ({}, {"rating": True}, {"Rating": 5}),
    ({"Description": "written last year"}, {}, {"Description": "written last year"}), ({"Description": "written last year"}, {"force_description": True}, {"Description": "A bridge in fog"}),
])
def test_on1(spark, tmp_path, meta, options, want):
    photo = tmp_path / "x.nef"
    on1(photo, meta)
    old = sidecars.read(spark, str(tmp_path), "on1").first()
    o = metadata.WriteOptions(**options)
    df = metadata.on1_fields(decided(spark, photo, old_keywords=old["old_keywords"], old_description=old["old_description"], old_rating=old["old_rating"] or None), o)
    assert sidecars.write(df, "on1", "now", o.override).first()["outcome"] == "written"
    data = json.loads(photo.with_suffix(".on1").read_text())
    m, classes = data["photos"]["id"]["metadata"], data["photos"]["id"]["ml_classes"]["classifications"]
    foreign = [k for k in m["Keywords"] if not k.startswith("FrameSift")]
    assert {k: foreign if k == "Keywords" else m[k] for k in want} == want
    assert data["version"] == 7 and len(classes) == (1 if o.override else 2) and m["FrameSiftAnalysis"]["decision"] == "Keep" and m["MetadataDateOffset"] == 0


def test_sidecars_that_are_not_there(spark, tmp_path):
    photo = tmp_path / "y.nef"
    df = metadata.on1_fields(decided(spark, photo))
    assert sidecars.write(df, "on1", "now").first()["outcome"] == "missing"
    photo.with_suffix(".on1").write_text("{damaged")
    assert sidecars.write(df, "on1", "now").first()["outcome"] == "missing" and photo.with_suffix(".on1").read_text() == "{damaged"
    assert sidecars.write(df.withColumn("decision", F.lit("Failed")), "on1", "now").count() == 0
    with pytest.raises(ValueError):
        sidecars.write(df, "other", "now")
    with pytest.raises(ValueError):
        sidecars._put(str(photo), "x")


def test_xmp_round_trip(spark, tmp_path):
    photo = tmp_path / "z & z.nef"
    df = metadata.xmp_fields(decided(spark, photo), metadata.WriteOptions(rating=True))
    df = metadata.sidecar_path(df, spark.createDataFrame([("none",)], "path string"))
    assert df.first()["xmp_path"] == str(photo.with_suffix(".xmp"))
    assert sidecars.write(df, "xmp", "2024-01-01T00:00:00").first()["outcome"] == "written"
    got = sidecars.read(spark, str(tmp_path), "xmp").first()
    assert got["old_rating"] == "5" and got["old_description"] == "A bridge in fog" and got["old_keywords"][:2] == ["seawall", "fog"]
    text = photo.with_suffix(".xmp").read_text()
    assert "&quot;quoted&quot;" in text and "measuredSharpness" in text and sidecars.parse_xmp("<broken") == {"keywords": [], "description": "", "rating": ""}


@pytest.mark.parametrize("given,there,want", [
    ("D1.tif", ["D1.NEF", "D1.tif"], "D1.NEF"), ("D1-2.tif", ["D1.NEF", "D1-2.tif"], "D1.NEF"), ("D1 copy.psd", ["D1.NEF", "D1 copy.psd"], "D1.NEF"), ("D1-Edit.tif", ["d1.nef", "D1-Edit.tif"], "d1.nef"),
    ("holiday.jpg", ["holiday.jpg"], "holiday.jpg"), ("D1.on1", ["D1.on1", "D1.NEF"], "D1.NEF"), ("D1.on1", ["D1.on1", "D1.jpg"], "D1.jpg"), ("clip.MOV", ["clip.MOV"], None), (".D1.tif", [".D1.tif", "D1.NEF"], None)])
def test_resolve(spark, given, there, want):
    paths = lambda x: spark.createDataFrame([(f"/p/{n}",) for n in x], "path string")
    got = resolve.resolve(paths([given]), paths(there)).collect()
    assert [r["photo"] for r in got] == ([f"/p/{want}"] if want else [])
    assert all(r["was_redirected"] == (given != want) for r in got)


def test_model_answers(spark):
    full = {"subject": "s", "subject_sharpness": "sharp", "exposure": "good", "framing": "fine", "technical_issues": [], "verdict": "keep", "verdict_reason": "r"}
    answers = [json.dumps(full), json.dumps(full | {"verdict": "maybe"}), "nonsense", None, json.dumps({k: v for k, v in full.items() if k != "subject"})]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    assert [r["x"] is not None for r in df.select("i", vision.triaged(F.col("a")).alias("x")).orderBy("i").collect()] == [True, False, False, False, False]

    def client():
        def say(image):
            if image == b"down":
                raise ConnectionError
            return json.dumps({"description": "d", "keywords": ["A_b", "a b"]})

        return say

    frames = spark.createDataFrame([(1, b"x", "keep"), (2, b"x", "delete"), (3, b"down", None)], "id int, content binary, verdict string")
    got = {r["id"]: (r["description"], r["keywords"]) for r in vision.describe(frames, client).collect()}
    assert got == {1: ("d", ["a b"]), 2: ("", []), 3: ("", [])}
    assert vision.canary("red", "circle")[:4] == b"\x89PNG" and vision.sees("A Red circle.", "red", "circle") and not vision.sees("blue circle", "red", "circle")


def test_stream(spark, tmp_path):
    from .test_decision import FRAME, frame

    t = dt.datetime(2024, 1, 1)
    at = [0, 3, 6, 10, 3000, 9000]
    df = spark.createDataFrame([frame(filepath=str(i), capture_time=t + dt.timedelta(seconds=s)) for i, s in enumerate(at)], FRAME)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.decisions(ingest.frames(spark, str(tmp_path / "in"), df.schema))
    ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("decision = 'Keep'").count() == 6
    ingest.append(ingest.bursts(stream), str(tmp_path / "b"), str(tmp_path / "c2")).awaitTermination()
    got = sorted((r["start"], r["end"], r["frames"]) for r in spark.read.parquet(str(tmp_path / "b")).selectExpr("cast(start as timestamp_ntz) start", "cast(end as timestamp_ntz) end", "frames").collect())
    s = lambda n: t + dt.timedelta(seconds=n)
    assert got == [(s(0), s(6), 3), (s(10), s(10), 1), (s(3000), s(3000), 1)]


def raw(jpeg, small=b"\xff\xd8\xff\xd9"):
    """A TIFF-based raw file: a small preview in its first table, a large one in a table below it."""
    ifd = lambda es: struct.pack("<H", len(es)) + b"".join(struct.pack("<HHII", *e) for e in es) + bytes(4)
    main, sub = 8, 8 + 2 + 3 * 12 + 4
    data = sub + 2 + 2 * 12 + 4
    return b"II*\0" + struct.pack("<I", main) + ifd([(0x014A, 4, 1, sub), (0x0201, 4, 1, data), (0x0202, 4, 1, len(small))]) + ifd([(0x0201, 4, 1, data + len(small)), (0x0202, 4, 1, len(jpeg))]) + small + jpeg


@pytest.fixture
def jpeg(spark):
    """A JPEG of the test picture, made by the JVM."""
    jvm, p = spark.sparkContext._jvm, picture(5)
    img = jvm.java.awt.image.BufferedImage(p.shape[1], p.shape[0], 5)
    values = spark.sparkContext._gateway.new_array(jvm.int, p.size)
    for i, v in enumerate(p[..., ::-1].ravel().tolist()):
        values[i] = v
    img.getRaster().setPixels(0, 0, p.shape[1], p.shape[0], values)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(img, "jpg", out)
    return bytes(out.toByteArray())


def test_previews_of_raw_files(jpeg):
    assert photos.preview(raw(jpeg)) == jpeg
    assert photos.preview(b"FUJIFILMCCD-RAW " + bytes(68) + struct.pack(">II", 92, len(jpeg)) + jpeg) == jpeg
    assert photos.preview(b"\0\0\0\x18ftypcrx " + bytes(100) + jpeg + b"tail") == jpeg
    assert photos.preview(b"") is None and photos.preview(b"II*\0" + bytes(3)) is None and photos.preview(b"II*\0\x08\0\0\0" + b"\xff" * 40) is None


def test_names_that_spark_passes_over(spark, tmp_path, jpeg):
    (tmp_path / "_in").mkdir()
    (tmp_path / "ok.png").write_bytes(png(picture(1)))
    (tmp_path / "_DSC1.PNG").write_bytes(png(picture(2)))
    (tmp_path / "_in" / "x y;{1}.nef").write_bytes(raw(jpeg))
    (tmp_path / "plain.NEF").write_bytes(raw(jpeg))
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "_other.txt").write_bytes(b"")
    kinds = (".png", ".nef")
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())
    assert names(photos.scan(spark, str(tmp_path), kinds)) == ["_DSC1.PNG", "empty.png", "ok.png", "plain.NEF", "x y;{1}.nef"]
    assert names(photos.scan(spark, str(tmp_path), kinds, recursive=False)) == ["_DSC1.PNG", "empty.png", "ok.png", "plain.NEF"]
    out = run.fast(spark, str(tmp_path), run.Config(extensions=kinds, preview_dir=str(tmp_path.parent / f"{tmp_path.name}_p")))
    got = {r["filename"]: r["decision"] for r in out.collect()}
    assert got.pop("empty.png") == "Failed" and len(got) == 4 and set(got.values()) <= {"Keep", "Review"}


def test_time_behind_a_large_segment(spark, tmp_path):
    pad = b"".join(b"\xff\xe2" + struct.pack(">H", 65_002) + bytes(65_000) for _ in range(5))
    t = b"Exif\0\0" + tiff("<", "2024:05:06 07:08:09", True)
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8" + pad + b"\xff\xe1" + struct.pack(">H", len(t) + 2) + t + b"\xff\xda")
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xda Exif\0\0 later")
    got = {r["path"][-5:]: r["capture_time"] for r in photos.capture_times(spark, str(tmp_path)).collect()}
    assert got["a.jpg"] == dt.datetime(2024, 5, 6, 7, 8, 9) and got["b.jpg"].year > 2024
    assert photos.exif_time((tmp_path / "a.jpg").read_bytes()) == dt.datetime(2024, 5, 6, 7, 8, 9)


def test_views_thumbnails_and_sets(spark, folder, tmp_path_factory):
    big = np.zeros((900, 1500, 3), np.uint8)
    assert views.centre(big).shape == (768, 768, 3) and views.centre(big[:700]) is None and views.fit(big, 360).shape == (216, 360, 3) and len(views.shown(big)) == 2
    out = tmp_path_factory.mktemp("o")
    pictures = photos.pixels(spark, str(folder))
    thumbs = report.write_thumbs(pictures, str(out / "t"))
    first = {r["path"][-5:]: (r["thumb"], r["outcome"]) for r in thumbs.collect()}
    assert [x[1] for x in first.values()].count("written") == 2 and {r["outcome"] for r in thumbs.collect()} == {"kept", "failed"}
    back = spark.read.format("image").load(first["a.PNG"][0]).select("image.*").first()
    assert (back["height"], back["width"]) == (240, 320) and bytes(back["data"]) == picture(1)[..., ::-1].tobytes()
    made = {(r["filename"], r["kind"]) for r in evalset.write(pictures, str(out / "e")).collect()}
    assert len(made) == 8 and ("a__defocus.png", "defocus") in made and len(list((out / "e").iterdir())) == 8
    with pytest.raises(ValueError):
        files.put(str(folder / "a.PNG"), b"x")


@pytest.fixture
def server():
    """A model server that sees colours by name only if told to, and judges by the size of what it is sent."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def say(self, body, code=200):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.say({"models": [{"name": "llava:7b"}, {"name": "qwen3-vl:8b-instruct"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            if "format" not in body:
                return self.say({"response": "A yellow triangle"})
            if "verdict" in body["format"]["properties"]:
                full = {"subject": "s", "subject_sharpness": "sharp", "exposure": "good", "framing": "fine", "technical_issues": [], "verdict": "keep", "verdict_reason": "r"}
                return self.say({"response": json.dumps(full)})
            self.say({"response": json.dumps({"description": "told", "keywords": ["A_b", "a b", "c"]})})

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_run_with_a_model(spark, folder, server, tmp_path_factory, capsys):
    host, asked = server
    assert stats.choose_model(vision.installed(spark, host)).first()["name"] == "qwen3-vl:8b-instruct"
    say = vision.http_client(host, "m", vision.CANARY_PROMPT)()
    assert vision.can_see(say, 1) and not vision.can_see(say, 0) and not vision.can_see(say, 7)
    assert not vision.can_see(vision.http_client("http://127.0.0.1:9", "m", "x", timeout=1)())
    out = tmp_path_factory.mktemp("run")
    args = [str(folder), "--host", host, "--extensions", "png", "--no-cache", "--csv", str(out / "r"), "--report", "--sidecars", "xmp", "--suggest-ratings", "--detail", "--skip-vision-check", "--timestamp", "2024-01-01 00:00:00"]
    assert run.main(args) == 0
    said = capsys.readouterr().out
    assert "sidecars written: 2" in said and "sharpness sharp" in said and "photographs" in said
    assert "told" in (folder / "a.xmp").read_text() and not (folder / "broken.xmp").exists()
    assert {b["options"]["temperature"] for b in asked} == {0} and len([b for b in asked if "keywords" in str(b.get("format"))]) == 2
    back = report.read_csv(spark, str(out / "r"))
    assert {r["filename"]: r["decision"] for r in back.collect()} == {"a.PNG": "Keep", "b.png": "Keep", "broken.png": "Failed"}
    assert [r["filename"] for r in back.collect()] == sorted(r["filename"] for r in back.collect())
    page = next((out / "r.page" / "section=4").glob("*.htm")).read_text()
    thumbs = {x.name for x in (out / "r.page" / "thumbs").iterdir()}
    assert page.startswith("<!doctype html>") and len(thumbs) == 2 and set(re.findall(r'src="../thumbs/([^"]+)"', page)) == thumbs and page.count("<div") == 2
    index = next((out / "r.page" / "index").glob("*.htm")).read_text()
    assert all((out / "r.page" / "index" / x).is_file() for x in re.findall(r'href="([^"]+)"', index)) and "Keeps" in index and "Failed" in index
    assert run.main([*args[:2], "http://127.0.0.1:9", *args[3:]]) == 1
    assert run.main([str(folder), "--fast", "--extensions", "png", "--csv", str(out / "f"), "--sidecars", "xmp", "--dry-run"]) == 0


def test_old_sidecars_flow_into_new_ones(spark, tmp_path):
    names = ("a.nef", "b.nef", "c.nef")
    df = decided(spark, tmp_path / "a.nef")
    for n in names[1:]:
        df = df.unionByName(decided(spark, tmp_path / n))
    df = df.drop("old_keywords", "old_description", "old_rating", "analysis", "summary")
    on1(tmp_path / "a.nef", {"Keywords": ["Vancouver"], "Rating": 2, "Description": "last year"})
    (tmp_path / "b.on1").write_text("{damaged")
    done = {r["filepath"][-5:]: r["outcome"] for r in sidecars.save(spark, df, str(tmp_path), "on1", "now", metadata.WriteOptions(rating=True)).collect()}
    assert done == {"a.nef": "written", "b.nef": "missing", "c.nef": "missing"}
    m = json.loads((tmp_path / "a.on1").read_text())["photos"]["id"]["metadata"]
    assert m["Keywords"][:3] == ["Vancouver", "seawall", "fog"] and m["Rating"] == 2 and m["Description"] == "last year"
    old = sidecars.compose_xmp("t", ["Old"], "before", "3", None, None, "d")
    (tmp_path / "a.nef.xmp").write_text(old)
    (tmp_path / "b.xmp").write_text(old)
    assert sidecars.save(spark, df, str(tmp_path), "xmp", "now", metadata.WriteOptions(rating=True)).where("outcome = 'written'").count() == 3
    for n, rating, first in (("a.nef.xmp", "3", "Old"), ("b.xmp", "3", "Old"), ("c.xmp", "5", "seawall")):
        got = sidecars.parse_xmp((tmp_path / n).read_text())
        assert (got["rating"], got["keywords"][0], got["description"]) == (rating, first, "A bridge in fog")
    s = edits.default_styles(df, spark.createDataFrame([(str(tmp_path / "a.on1"),)], "path string")).first()
    assert (s["on1"], s["xmp"]) == (True, False) and edits.default_styles(df, spark.createDataFrame([], "path string")).first()["xmp"]


def test_settings(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("model:\n  name:\n  context_tokens: 5\nprocessing: {workers: 0, tagging: false}\ngrouping: {enabled: false, burst_gap_seconds: -1}\noutput: {extensions: [nef, .JPG]}\ncache: {dir: ''}\nother: 1\n")
    c = run.Config.load(str(f))
    assert (c.model_name, c.context_tokens, c.workers, c.tagging, c.grouping, c.burst_gap_seconds, c.extensions, c.cache_dir) == (None, 2048, 1, False, False, 0.0, (".nef", ".jpg"), "")
    f.write_text("[broken")
    assert run.Config.load(str(f)) == run.Config() == run.Config.load(None) == run.Config.load(str(tmp_path / "none"))
    # the suffixes are said once: every default one is of a kind, no kind overlaps another, and the settings' default is the list
    kinds = (S.RAW_EXTENSIONS, S.HEIF_EXTENSIONS, S.AMBIGUOUS_EXTENSIONS)
    assert set(run.Config().extensions) == {x for k in kinds for x in k} and len(S.PHOTO_EXTENSIONS) == sum(map(len, kinds)) == 12
    assert not set(S.PHOTO_EXTENSIONS) & set(S.RENDER_EXTENSIONS + S.SIDECAR_EXTENSIONS) and all(x == x.lower() and x[0] == "." for x in S.PHOTO_EXTENSIONS + S.RENDER_EXTENSIONS + S.SIDECAR_EXTENSIONS)


def test_records_by_name_and_decision(spark, tmp_path):
    df = decided(spark, tmp_path / "a.nef").unionByName(decided(spark, tmp_path / "b.nef", decision="Delete"))
    stats.by_decision(df, str(tmp_path / "d"))
    assert sorted(x.name for x in (tmp_path / "d").iterdir() if x.is_dir()) == ["decision=Delete", "decision=Keep"] and spark.read.parquet(str(tmp_path / "d")).count() == 2
    for n in ("run_1.csv", "run_20.csv", "other.csv"):
        (tmp_path / n).mkdir()
    assert report.latest(spark, str(tmp_path)).endswith("run_20.csv")
    with pytest.raises(FileNotFoundError):
        report.latest(spark, str(tmp_path / "d"))
    full = df.withColumns({"subject": F.lit("sea"), "blur": F.lit(0)})
    stats.save_session(full, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first()["top_subjects"] == ["sea"]
    stats.save_session(full.limit(0), str(tmp_path / "n"))
    assert not [x for x in (tmp_path / "n").iterdir() if x.suffix == ".json" and x.stat().st_size]
    assert stats.pace(df, 5.0).first()["seconds_each"] == 2.5 and stats.pace(df.withColumn("processing_ms", F.lit(1.0)).limit(0)).first()["seconds_each"] == 0


def test_nothing_moves_or_deletes_files():
    """No call in the library that could rename, move or remove a file, but for the one that puts a sidecar in place."""
    bad = {"unlink", "remove", "rmtree", "rename", "renames", "rmdir", "removedirs", "move", "truncate", "send2trash"}
    for p in (REPO / "framesift").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            if isinstance(node, ast.Call):
                f = node.func
                name = f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", "")
                owner = f.value.id if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) else ""
                assert name not in bad, f"{p}:{node.lineno}"
                assert (owner, name) != ("os", "replace") or p.name in ("sidecars.py", "files.py"), f"{p}:{node.lineno}"


def test_library_does_not_import_the_text_operators():
    for p in (REPO / "framesift").rglob("*.py"):
        assert "llm" in p.parts or not re.search(r"\bllm\b", p.read_text()), p
