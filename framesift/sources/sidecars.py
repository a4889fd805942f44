"""Sidecars: reading what is there, composing what will be, writing it in place of the old file. Photographs are never opened for writing."""

from __future__ import annotations

import json
import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..operators import metadata

# Namespaces, class names and field names of foreign formats, which other programs read.
_NS = {"x": "adobe:ns:meta/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xmp": "http://ns.adobe.com/xap/1.0/", "dc": "http://purl.org/dc/elements/1.1/",
       "photoshop": "http://ns.adobe.com/photoshop/1.0/", "framesift": "urn:framesift:1.0"}
#: Classifications that regenerate keywords by themselves; an override takes them out.
REGENERATING = ("ONPanopticSegmenterV0", "PartialLabelingCSL")
ON1 = "photos map<string,struct<name:string,metadata:struct<Keywords:array<string>,Description:string,Rating:string>>>"
SIDECARS = "path string, name string, old_keywords array<string>, old_description string, old_rating string"
_q = lambda prefix, tag: f"{{{_NS[prefix]}}}{tag}"


def parse_xmp(text: str) -> dict:
    """keywords, description and rating of an XMP sidecar; a damaged file is as good as none."""
    out: dict = {"keywords": [], "description": "", "rating": ""}
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return out
    node = next((e for e in root.iter() if e.tag.endswith("Description")), None)
    if node is None:
        return out
    out["rating"] = next((v for k, v in node.attrib.items() if k.endswith("Rating")), "")
    out["keywords"] = [li.text for li in node.iterfind(f"{_q('dc', 'subject')}//{_q('rdf', 'li')}") if li.text]
    out["description"] = next((li.text for li in node.iterfind(f"{_q('dc', 'description')}//{_q('rdf', 'li')}") if li.text), "")
    return out


def read(spark: SparkSession, folder: str, style: str) -> DataFrame:
    """path, name, old_keywords, old_description and old_rating from all ``xmp`` or ``on1`` files below a folder; a row for each photograph that an on1 file names.

    A damaged file is as good as none. A rating of 0 is none.
    """
    if style not in ("on1", "xmp"):
        raise ValueError(f"unknown sidecar style {style!r}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.lower("path").endswith(f".{style}")).select("path", F.decode("content", "UTF-8").alias("text"))
    if style == "on1":
        m = F.col("e.metadata")
        rows = files.select("path", F.explode(F.map_values(F.from_json("text", ON1)["photos"])).alias("e"))
        rating = F.when(m["Rating"] != "0", m["Rating"])
        return rows.where("e.name is not null").select("path", F.col("e.name").alias("name"), F.coalesce(m["Keywords"], F.array().cast("array<string>")).alias("old_keywords"),
                                                       F.coalesce(m["Description"], F.lit("")).alias("old_description"), F.coalesce(rating, F.lit("")).alias("old_rating"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [parse_xmp(text) for text in b.column(1).to_pylist()]
            cols = [pa.array([None] * len(told), pa.string()), pa.array([m["keywords"] for m in told], pa.list_(pa.string())), *(pa.array([m[k] for m in told], pa.string()) for k in ("description", "rating"))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["path", "name", "old_keywords", "old_description", "old_rating"])

    return files.mapInArrow(of, SIDECARS)


def with_old(results: DataFrame, listed: DataFrame, style: str) -> DataFrame:
    """results with old_keywords, old_description and old_rating of the sidecar that each frame has (``listed``: rows of ``read``), and for xmp the xmp_path that it has or will have.

    An on1 file is named for the stem and knows the frame by its name; without one the old fields are empty. Where two files name a frame the first row by path holds.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  sources spell local paths unlike
    results = results.withColumn("_told", F.col("filepath")).withColumn("filepath", plain("filepath"))
    listed = listed.withColumn("path", plain("path"))
    stem = F.regexp_replace("filepath", r"\.[^./]+$", "")
    if style == "xmp":
        results = metadata.sidecar_path(results, listed.select("path").distinct())
        on, old = F.col("xmp_path") == F.col("_path"), listed
    else:
        on, old = (F.concat(stem, F.lit(".on1")) == F.col("_path")) & (F.col("filename") == F.col("_name")), listed.where("name is not null")
    old = old.groupBy(F.col("path").alias("_path"), F.col("name").alias("_name")).agg(F.min(F.struct("old_keywords", "old_description", "old_rating")).alias("_old"))
    out = results.join(old, on, "left").withColumns({"old_keywords": F.coalesce("_old.old_keywords", F.array().cast("array<string>")), "old_description": F.coalesce("_old.old_description", F.lit("")), "old_rating": F.coalesce("_old.old_rating", F.lit(""))})
    return out.withColumn("filepath", F.col("_told")).drop("_path", "_name", "_old", "_told")


def save(spark: SparkSession, results: DataFrame, folder: str, style: str, date: str, options: metadata.WriteOptions = metadata.WriteOptions()) -> DataFrame:
    """Writes a sidecar for each decided frame, with what its old one says taken into account; (filepath, outcome) as ``write`` gives it."""
    d = with_old(results, read(spark, folder, style), style)
    d = (metadata.xmp_fields if style == "xmp" else metadata.on1_fields)(d, options)
    block = metadata.analysis_block() if options.analysis else F.lit(None).cast("map<string,string>")
    d = d.withColumns({"analysis": block, "summary": metadata.analysis_summary() if options.analysis else F.lit(None).cast("string")})
    return write(d, style, date, options.override)


def merge_on1(text: str, name: str, keywords: list[str] | None, description: str | None, rating: int | None, analysis: dict | None, date: str, override: bool = False, tool: str = S.TOOL) -> str | None:
    """The JSON sidecar with one photograph's fields set; None where there is no such entry. Everything else in the file stays."""
    try:
        data = json.loads(text)
        entry = next((e for e in data.get("photos", {}).values() if e.get("name") == name), None)
    except (ValueError, AttributeError):
        return None
    if entry is None:
        return None
    classes = entry.get("ml_classes")
    if override and classes:
        classes["classifications"] = [c for c in classes.get("classifications", []) if c.get("type") not in REGENERATING]
    fields = {"Keywords": keywords, "Description": description, "Rating": rating, f"{tool}Analysis": analysis}
    m = entry.setdefault("metadata", {})
    m.update({k: v for k, v in fields.items() if v is not None})
    m["MetadataDate"] = date
    m.setdefault("MetadataDateOffset", 0)
    return json.dumps(data, separators=(",", ":"))


def compose_xmp(title: str, keywords: list[str], description: str, rating: str | None, analysis: dict | None, summary: str | None, date: str, tool: str = S.TOOL) -> str:
    """A whole XMP file; the library that builds the tree quotes every value."""
    for prefix, uri in _NS.items():
        ET.register_namespace(prefix, uri)
    root = ET.Element(_q("x", "xmpmeta"), {_q("x", "xmptk"): tool})
    node = ET.SubElement(ET.SubElement(root, _q("rdf", "RDF")), _q("rdf", "Description"), {_q("rdf", "about"): "", _q("xmp", "ModifyDate"): date, _q("xmp", "CreatorTool"): tool})
    if rating:
        node.set(_q("xmp", "Rating"), rating)
    for k, v in (analysis or {}).items():
        node.set(_q("framesift", k), str(v))
    bag = ET.SubElement(ET.SubElement(node, _q("dc", "subject")), _q("rdf", "Bag"))
    for k in keywords:
        ET.SubElement(bag, _q("rdf", "li")).text = k
    for tag, value in (("title", title), ("description", description)):
        alt = ET.SubElement(ET.SubElement(node, _q("dc", tag)), _q("rdf", "Alt"))
        ET.SubElement(alt, _q("rdf", "li"), {"{http://www.w3.org/XML/1998/namespace}lang": "x-default"}).text = value
    if summary is not None:
        ET.SubElement(node, _q("photoshop", "Instructions")).text = summary
    ET.indent(root)
    return ET.tostring(root, encoding="unicode", xml_declaration=True)


def _put(path: str, text: str) -> None:
    """Replaces a sidecar as a whole; a task that runs twice writes the same again."""
    path = path.removeprefix("file:")
    if os.path.splitext(path)[1].lower() not in S.SIDECAR_EXTENSIONS:
        raise ValueError(f"not a sidecar: {path}")
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(part, path)


def write(rows: DataFrame, style: str, date: str, override: bool = False, tool: str = S.TOOL) -> DataFrame:
    """(filepath, outcome) of writing a sidecar for each row: written, missing (no on1 file that names the photograph) or failed.

    rows has filepath, filename, decision, out_keywords, out_description, out_rating, analysis (map or null), summary and, for xmp, xmp_path.
    Failed frames get no sidecar. The folder must be mounted on the executors. Writing happens as the result is read.
    """
    if style not in ("on1", "xmp"):
        raise ValueError(f"unknown sidecar style {style!r}")
    target = F.col("xmp_path") if style == "xmp" else F.concat(F.regexp_replace("filepath", r"\.[^./]+$", ""), F.lit(".on1"))
    block = metadata.analysis_attributes(F.col("analysis")) if style == "xmp" else F.col("analysis")
    rows = rows.where("decision <> 'Failed'").select("filepath", "filename", target.alias("target"), F.struct("out_keywords", "out_description", F.col("out_rating").cast("string").alias("out_rating"), F.map_entries(block).alias("analysis"), "summary").alias("x"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = []
            for name, target, x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                block = None if x["analysis"] is None else {e["key"]: e["value"] for e in x["analysis"]}
                try:
                    if style == "xmp":
                        _put(target, compose_xmp(os.path.splitext(name)[0], x["out_keywords"], x["out_description"] or "", x["out_rating"], block, x["summary"], date, tool))
                        said.append("written")
                        continue
                    with open(target.removeprefix("file:"), encoding="utf-8") as f:
                        text = merge_on1(f.read(), name, x["out_keywords"], x["out_description"], x["out_rating"] and int(x["out_rating"]), block, date, override, tool)
                    if text is not None:
                        _put(target, text)
                    said.append("missing" if text is None else "written")
                except FileNotFoundError:
                    said.append("missing")
                except OSError:
                    said.append("failed")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string())], ["filepath", "outcome"])

    return rows.mapInArrow(of, "filepath string, outcome string")
