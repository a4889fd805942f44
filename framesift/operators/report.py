"""The run record as CSV and a page that shows it."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.views import thumbnails
from ..sources.files import put
from .metadata import csv_rows, report_sections

TITLES = {1: "Rejects", 2: "Flagged", 3: "Burst alternates", 4: "Keeps", 5: "Failed"}


def ordered(df: DataFrame) -> DataFrame:
    """Results in the order of their names; a path settles equal ones."""
    return df.orderBy("filename", "filepath")


def write_csv(df: DataFrame, folder: str, timestamp: str) -> None:
    """The run record in the order of file names: a range of names in each part, the parts in order."""
    csv_rows(ordered(df), timestamp).write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(folder)


def latest(spark: SparkSession, folder: str) -> str:
    """The last run record below a folder, by name: records are named for their time."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/run_*.csv")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise FileNotFoundError(f"no run_*.csv below {folder}")
    return max(x.getPath().toString() for x in found)


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(folder).na.fill("")


def cards(df: DataFrame, thumbs: str = "thumbs") -> DataFrame:
    """(section, position, filepath, html): a card for each frame, escaped on the executors; ``thumbs`` is where the page finds its thumbnails."""
    e = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    thumb = F.concat(F.md5("filepath"), F.lit(".png"))
    html = F.concat(F.lit('<div class="card"><a href="file://'), e("filepath"), F.lit('"><img loading="lazy" src="' + thumbs + '/'), thumb, F.lit('"></a><b>'), e("filename"), F.lit("</b> "), e("decision"), F.lit(" "), e("confidence"), F.lit("<p>"), e("issues"), F.lit("</p></div>"))
    return report_sections(df).select("section", "position", "filepath", html.alias("html"))


_HEAD = "<!doctype html><meta charset=utf-8><title>{}</title><style>.card{{display:inline-block;width:22em;margin:.4em;vertical-align:top}}.card img{{max-width:100%}}</style>"


def render(run: DataFrame, title: str = "Run") -> str:
    """The whole page as text, in the order of the sections; for tests and for a shoot that one reader can look through. ``write_page`` makes the files."""
    out, now = [_HEAD.format(escape(title))], 0
    for r in cards(run).orderBy("section", "position", "filepath").toLocalIterator():
        if r["section"] != now:
            out.append(("</details>" if now else "") + f"<details{' open' if r['section'] < 3 else ''}><summary>{TITLES[r['section']]}</summary>")
            now = r["section"]
        out.append(r["html"])
    return "\n".join(out) + ("</details>" if now else "")


def _write_html(df: DataFrame, folder: str, head: str, *sections: str) -> None:
    """One column of HTML as files that begin with ``head``; rows are written as they are."""
    html = df.withColumnRenamed("html", head).write.mode("overwrite")
    html = html.partitionBy(*sections) if sections else html
    html.option("extension", "htm").option("header", "true").option("quote", "\0").option("escape", "\0").option("delimiter", "\1").option("emptyValue", "").csv(folder)


def write_page(run: DataFrame, folder: str, title: str = "Run") -> None:
    """The report as files that executors write: a folder for each section (``section=1``, rejects, to 5, failed) with pages of cards in the section's order, and ``index`` with links to all pages.

    Nothing but the cards of one page is held anywhere, so any number of frames can be written; thumbnails belong into ``thumbs`` beside the sections.
    """
    spark = run.sparkSession
    c = cards(run, "../thumbs").repartitionByRange("section", "position", "filepath").sortWithinPartitions("section", "position", "filepath")
    head = _HEAD.format(escape(title)).replace("`", "")
    _write_html(c.select("section", "html"), folder, head, "section")
    pages = sorted(x.rsplit("/", 2)[-2:] for x in spark.read.text(folder).inputFiles())
    links = [(f'<p>{TITLES[int(of.split("%3D")[-1].split("=")[-1])]}: <a href="../{escape(of)}/{escape(name)}">page {i}</a></p>',) for i, (of, name) in enumerate(pages, 1)]
    _write_html(spark.createDataFrame(links, "html string").coalesce(1), f"{folder.rstrip('/')}/index", head)


def write_thumbs(images: DataFrame, folder: str) -> DataFrame:
    """(path, thumb, outcome) of writing a small PNG of each picture to ``folder``, which the executors have mounted: written, kept (it was there) or failed.

    A thumbnail's name is the hash of its photograph's path, as the cards expect it. Writing happens as the result is read.
    """
    folder = folder.removeprefix("file:").rstrip("/")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for k in range(b.num_rows):
                path, small = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                name = f"{folder}/{hashlib.md5(path.encode()).hexdigest()}.png"
                said = "kept" if os.path.exists(name) else "failed" if small is None else "written"
                if said == "written":
                    put(name, small)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (path, name, said)], ["path", "thumb", "outcome"])

    return thumbnails(images).mapInArrow(of, "path string, thumb string, outcome string")
