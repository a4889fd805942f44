"""Photographs as tables: listing, capture times, decoded pixels."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from .files import put

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".gif")
# Tags of EXIF and TIFF, and of the formats built on it, that hold times, tables and previews.
_TAKEN, _CHANGED, _EXIF = 0x9003, 0x0132, 0x8769
_STRIPS, _STRIP_SIZES, _SUBFOLDERS, _JPEG_AT, _JPEG_SIZE, _WHOLE_JPEG = 0x0111, 0x0117, 0x014A, 0x0201, 0x0202, 0x002E


def extensions(override: str | None = None) -> tuple[str, ...]:
    """The suffixes to look for; an override is comma-separated, with or without dots, in any case."""
    if not override:
        return S.PHOTO_EXTENSIONS
    parts = [x.strip().lower() for x in override.split(",")]
    return tuple(x if x.startswith(".") else f".{x}" for x in parts if x)


_STATUS = re.compile(r"FileStatus\{path=(.*?); isDirectory=(true|false);(?: length=(\d+);.*?)? modification_time=(\d+);", re.DOTALL)


def left_out(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = S.PHOTO_EXTENSIONS, recursive: bool = True) -> list[tuple[str, int, int]]:
    """(path, modified in ms, length) of the photographs that Spark's file sources pass over: empty ones, and such as begin, or lie in a folder that begins, with a dot or an underscore.

    Cameras name files ``_DSC0001.NEF``. The driver lists the folder level by level, as Spark's own listing does; only these few are kept.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.makeQualified(at(folder)).toString()
    found, level = [], [root]
    while level:
        below = []
        for listed in level:
            for path, is_folder, length, modified in _STATUS.findall(jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(at(listed)))):
                names = path[len(root) :].strip("/").split("/")
                if is_folder == "true":
                    below.append(path)
                elif names[-1].lower().endswith(suffixes) and (length == "0" or any(x.startswith((".", "_")) for x in names)):
                    found.append((path, int(modified), int(length)))
        level = below if recursive else []
    return sorted(found)


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = S.PHOTO_EXTENSIONS, recursive: bool = True) -> DataFrame:
    """path, modificationTime and length of the photographs below a folder, whatever the case of their suffix or the start of their name; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    files = _of(files, suffixes).select("path", "modificationTime", "length")
    more = left_out(spark, folder, suffixes, recursive)
    if not more:
        return files
    extra = spark.createDataFrame(more, "path string, ms long, length long").select("path", F.timestamp_millis("ms").alias("modificationTime"), "length")
    return files.where("length > 0").unionByName(extra)


def _of(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))


def _told(path: str) -> str | None:
    """The time that a mounted file tells, of which no more is read than it takes: a JPEG's segments before its picture, else the first megabyte, else all."""
    with open(path.removeprefix("file:"), "rb") as f:
        head = f.read(2)
        if head != b"\xff\xd8":
            head += f.read(1 << 20)
            return exif_text(head) or exif_text(head + f.read())
        while len(mark := f.read(4)) == 4 and mark[0] == 0xFF and mark[1] != 0xDA:
            body = f.read(max(0, int.from_bytes(mark[2:], "big") - 2))
            if mark[1] == 0xE1 and body.startswith(b"Exif\0\0"):
                return exif_text(head + mark + body)
    return None


def _segment(content: bytes) -> int | None:
    """Where a JPEG's EXIF block begins, its segments followed one by one."""
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return at + 10
        at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def exif_text(content: bytes) -> str | None:
    """When a JPEG or a TIFF-based raw file says it was taken, as it says it: its original time, else its date."""
    at = 0
    if content[:2] == b"\xff\xd8":
        found = _segment(content)
        if found is None:
            return None
        at = found
    order = {b"II": "<", b"MM": ">"}.get(content[at : at + 2])
    if order is None:
        return None

    def entries(offset: int) -> dict[int, tuple[int, int, int]]:
        (n,) = struct.unpack_from(order + "H", content, at + offset)
        out = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", content, at + offset + 2 + 12 * i)
            (value,) = struct.unpack_from(order + "I", content, at + offset + 10 + 12 * i)
            out[tag] = (kind, count, value)
        return out

    try:
        main = entries(struct.unpack_from(order + "I", content, at + 4)[0])
        found = entries(main[_EXIF][2]).get(_TAKEN) if _EXIF in main else None
        kind, count, value = found or main[_CHANGED]
        return content[at + value : at + value + count].rstrip(b"\0 ").decode("ascii") or None
    except (KeyError, struct.error, ValueError):
        return None


def exif_timestamp(text: Column) -> Column:
    """A camera's date, ``2024:05:06 07:08:09``, as a timestamp without a zone; null for anything else, also for days that do not exist."""
    iso = F.regexp_replace(text, r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})$", "$1-$2-$3T$4")
    return F.when(iso.contains("T"), iso).try_cast("timestamp_ntz")


def exif_time(content: bytes) -> datetime | None:
    """The same of one file's bytes, as Python reads it."""
    try:
        return datetime.strptime(exif_text(content) or "", "%Y:%m:%d %H:%M:%S")
    except ValueError:
        return None


def _contents(spark: SparkSession, folder: str, listed: DataFrame, recursive: bool) -> DataFrame:
    """listed with content: null where the store is mounted, since tasks then open the files themselves; Spark reads files in other stores."""
    if _is_mounted(spark, folder):
        return listed.withColumn("content", F.lit(None).cast("binary"))
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "content")
    return listed.join(whole, "path", "left")


def frames(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = S.PHOTO_EXTENSIONS, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length and capture_time: what the file says, else when it was last changed, in the session's time zone.

    Mounted files are opened where the listing says they are, and of a JPEG only the segments before the picture are read; files in other stores are read by Spark.
    """
    listed = scan(spark, folder, suffixes, recursive).withColumn("modified", F.col("modificationTime").cast("timestamp_ntz"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            times = []
            for k in range(b.num_rows):
                path, content = b.column(0)[k].as_py(), b.column(4)[k].as_py()
                try:
                    times.append(exif_text(content) if content is not None else _told(path) if path.startswith("file:") else None)
                except OSError:  # gone or unreadable: the listing's time holds
                    times.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(times, pa.string())], [*b.schema.names[:4], "told"])

    d = _contents(spark, folder, listed, recursive).select("path", "modificationTime", "length", "modified", "content")
    out = d.mapInArrow(of, "path string, modificationTime timestamp, length long, modified timestamp_ntz, told string")
    return out.select("path", "modificationTime", "length", F.coalesce(exif_timestamp(F.col("told")), "modified").alias("capture_time"))


def _is_mounted(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"


def capture_times(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = S.PHOTO_EXTENSIONS, recursive: bool = True) -> DataFrame:
    """path and capture_time of the photographs below a folder."""
    return frames(spark, folder, suffixes, recursive).select("path", "capture_time")


def pixels(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, height, width, channels and data (BGR) of JPEG, PNG, BMP and GIF files, decoded in the JVM; data is empty where that failed."""
    i = spark.read.format("image").option("recursiveFileLookup", str(recursive).lower()).option("dropInvalid", "false").load(folder)
    # the two sources spell local paths unlike
    i = i.select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return _of(i, IMAGE_SUFFIXES)


def preview(content: bytes) -> bytes | None:
    """The largest JPEG that a raw file holds as a preview: by the tables of a TIFF-based file, by the header of a RAF, else by its markers."""
    found = []
    if content[:15] == b"FUJIFILMCCD-RAW" and len(content) >= 92:
        found.append(struct.unpack_from(">II", content, 84))
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order and len(content) >= 8:
        todo, seen = [struct.unpack_from(order + "I", content, 4)[0]], set()
        while todo:
            at = todo.pop()
            if at in seen or not 0 < at < len(content) - 2:
                continue
            seen.add(at)
            tags = {}
            try:
                (n,) = struct.unpack_from(order + "H", content, at)
                for i in range(n):
                    tag, kind, count = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
                    size = {3: 2, 4: 4, 13: 4}.get(kind, 1)
                    place = at + 10 + 12 * i if size * count <= 4 else struct.unpack_from(order + "I", content, at + 10 + 12 * i)[0]
                    tags[tag] = struct.unpack_from(f"{order}{min(count, 64)}{'H' if kind == 3 else 'I'}", content, place) if kind in (3, 4, 13) and count else (place, count)
                todo.append(struct.unpack_from(order + "I", content, at + 2 + 12 * n)[0])
            except struct.error:
                pass
            todo += [x for t in (_SUBFOLDERS, _EXIF) for x in tags.get(t, ())]
            if _JPEG_AT in tags and _JPEG_SIZE in tags:
                found.append((tags[_JPEG_AT][0], tags[_JPEG_SIZE][0]))
            if len(tags.get(_STRIPS, ())) == 1 and _STRIP_SIZES in tags:
                found.append((tags[_STRIPS][0], tags[_STRIP_SIZES][0]))
            if _WHOLE_JPEG in tags:
                found.append(tags[_WHOLE_JPEG][:2])
    cut = [content[a : a + n] for a, n in found]
    if not any(x[:3] == b"\xff\xd8\xff" for x in cut):
        starts = [m.start() for m in re.finditer(b"\xff\xd8\xff[\xdb\xe0\xe1]", content)]
        cut = [content[a : content.find(b"\xff\xd9", a) + 2] for a in starts]
    # a lossless JPEG is the sensor's data and no preview
    cut = [x for x in cut if x[:3] == b"\xff\xd8\xff" and b"\xff\xc3" not in x[:4096]]
    return max(cut, key=len, default=None)


def previews(spark: SparkSession, folder: str, out: str, suffixes: tuple[str, ...] = S.RAW_EXTENSIONS, recursive: bool = True) -> DataFrame:
    """(path, preview): what the JVM can decode of the files that its image source cannot read, written to ``out``, which the executors have mounted; null where there is none.

    That is the preview of a raw file, and the picture itself where its name makes Spark pass over it. A preview's name is the hash of its photograph's
    path, so a task that runs twice writes the same file again. Nothing is written beside the photographs.
    """
    out = out.removeprefix("file:").rstrip("/")
    hidden = F.regexp_extract("path", r"([^/]*)$", 1).rlike("^[._]")
    raw = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes)
    listed = scan(spark, folder, tuple(dict.fromkeys(suffixes + IMAGE_SUFFIXES)), recursive).where((raw | hidden) & (F.col("length") > 0)).select("path", raw.alias("raw"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(out, exist_ok=True)
        for b in batches:
            for k in range(b.num_rows):
                path, raw, content = (c[k].as_py() for c in b.columns)
                name = None
                try:
                    if content is None and path.startswith("file:"):
                        with open(path.removeprefix("file:"), "rb") as f:
                            content = f.read()
                    picture = preview(content) if raw and content else content
                    if picture:
                        name = f"{out}/{hashlib.md5(path.encode()).hexdigest()}{'.jpg' if raw else os.path.splitext(path)[1].lower()}"
                        put(name, picture)
                except OSError:
                    name = None
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([name], pa.string())], ["path", "preview"])

    return _contents(spark, folder, listed, recursive).select("path", "raw", "content").mapInArrow(of, "path string, preview string")


def raw_pixels(spark: SparkSession, folder: str, out: str, suffixes: tuple[str, ...] = S.RAW_EXTENSIONS, recursive: bool = True) -> DataFrame:
    """What ``pixels`` gives, for the files of ``previews``, which are written to ``out`` when this is called and decoded in the JVM."""
    index = f"{out.rstrip('/')}/_index"
    previews(spark, folder, out, suffixes, recursive).where("preview is not null").select("path", F.md5("path").alias("key")).write.mode("overwrite").parquet(index)
    made = pixels(spark, out, False).withColumn("key", F.regexp_extract("path", r"([0-9a-f]{32})\.[a-z]+$", 1)).drop("path")
    return spark.read.parquet(index).join(made, "key").select("path", "height", "width", "channels", "data")
