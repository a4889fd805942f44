"""The similarity mode of the near-duplicate operator: SimHash fingerprints met in grids of segment popcounts, exact verification on whole sets.

A document is a node by its lower-cased words; its set holds the 64-bit hashes of its distinct shingles. First the operator's own steps: majority
fingerprints, embedded as segment popcounts, range-joined in grids, verified. At 0.8 two fingerprints differ in ten bits on average, beyond any grid's reach, so a second
pass completes them over what is still apart: ``BANDS`` buckets of ``ROWS`` minima each propose pairs, of which two sets of similarity s
share none with probability (1 - s^ROWS)^BANDS, 5e-7 at 0.8 and less above. Every proposed pair is decided on the whole sets, unless links already
found put both ends in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, connected_components, pick, released, unused, written
from .simhash import _LOWER, SHINGLE, SIMILARITY, STEP, _signed, links as fingerprint_links

BANDS, ROWS = 48, 6
CHUNK = 512
_draw = np.random.default_rng(42)
_XOR = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_MUL = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_MIX = _draw.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(text: str, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """The hash of the text's lower-cased words and the hashes of its shingles, repeats included; one shingle for a shorter text, none without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    norm = b" ".join(words)
    of = xxhash.xxh64_intdigest
    node = _signed(of(norm, 7))
    if not words:
        return node, np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return node, np.array([of(norm, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    begins = (ends - sizes + 1)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    return node, np.fromiter((of(norm[a:b], 42) for a, b in zip(begins, ends)), np.uint64, len(begins))


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes with repeats: what ``simhash.fingerprint`` makes of the text that they come from."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), STEP):
        ones += np.unpackbits(h[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def buckets(s: np.ndarray) -> np.ndarray:
    """The keys of the ``BANDS`` buckets that a set lies in."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), CHUNK):
        np.minimum(low, ((x[None, i : i + CHUNK] ^ _XOR) * _MUL).min(axis=1), out=low)
    m, key = low.reshape(BANDS, ROWS).astype(np.uint64), np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ m[:, r]) * _MIX[r]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, node, n, fp, keys) for every row: n is the size of its set, fp its fingerprint, keys are its buckets."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                nodes, sizes, fps, keys = [], [], [], []
                for t in part.column(2).to_pylist():
                    node, h = hashes(t or "", shingle)
                    s = np.unique(h)
                    nodes.append(node)
                    sizes.append(len(s))
                    fps.append(majority(h))
                    keys.append(buckets(s) if len(s) else np.zeros(0, np.int64))
                columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "text_hash", "node", "n", "fp", "keys"])

    return _rows(docs).mapInArrow(lambda it: released(of(it)), "doc_id long, text_hash long, node long, n int, fp long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, s): the sets of the nodes of ``wanted``, each from the row that is its first."""
    w = wanted.select(F.coalesce("first.id", F.lit(0)).alias("i"), F.col("first.none").alias("no"), F.col("first.text_hash").alias("h"), "node").distinct()
    d = _rows(docs).withColumns({"i": F.coalesce("doc_id", F.lit(0)), "no": F.col("doc_id").isNull()}).withColumnRenamed("text_hash", "h")
    found = d.join(w, ["i", "no", "h"]).select("node", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = pa.array([np.unique(hashes(t or "", shingle)[1]).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["node", "s"])

    return found.mapInArrow(lambda it: released(of(it)), "node long, s array<long>")


def _alike(na: Column, nb: Column, both: Column, similarity: float) -> Column:
    """Whether ``both`` common elements are enough, in thousandths to be exact; as longs, since sets may have millions of elements."""
    k = F.lit(round(similarity * 1000)).cast("long")
    return F.lit(1000).cast("long") * both >= k * (na + nb - both)


def _within_reach(na: Column, ea: Column, nb: Column, eb: Column, similarity: float) -> Column:
    """Whether sets of these sizes, of which so many elements are in no other set, can be similar: what they share is none of those."""
    return _alike(na, nb, F.least(na - ea, nb - eb), similarity)


def met(nodes: DataFrame) -> DataFrame:
    """(a, b): each node with the first one of its own fingerprint, and the first one of each fingerprint with that of the least other within reach, as the grids find them.

    That is a pair a node and a pair a fingerprint however many are alike: a group of near copies is not written in all its pairs, and what this leaves apart the buckets join.
    """
    fps = nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("lead"))
    own = nodes.where("n > 0").select("node", "fp").join(fps, "fp").select("node", F.col("lead").alias("other"))
    near = fingerprint_links(fps.select("fp"))
    least = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("to"))
    across = least.join(fps, "fp").select(F.col("lead").alias("node"), "to").join(fps.select(F.col("fp").alias("to"), F.col("lead").alias("other")), "to").select("node", "other")
    both = own.unionByName(across).where("node != other")
    return both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, scratch: Scratch, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): verified pairs of the nodes (node, n, first, fp, keys) whose components are those of all proposed pairs of ``similarity`` or more.

    What the grids of the fingerprints bring together is verified first; buckets whose members that joins already are done. What a group of copies
    has in common is in many of its sets; what one of them has alone is counted, and bounds its similarity to any other. Each bucket that is left
    first compares its members with the one that has the least of its own, which is near the middle of its group: that joins nearly all that can be joined, by one pair a member.
    Of the buckets that still hold several components, those members that the bound leaves a partner in another one meet once more, and
    the join gives only the pairs that pass on their whole sets: no pair of a group is written but such as are links.
    """
    cell = nodes.select("node", F.explode("keys").alias("key"))
    shared = cell.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("last")).where("rep != last").select("key")
    members = scratch.written(cell.join(shared, "key"), "members")
    close = scratch.written(met(nodes), "met")
    wanted = members.select("node").unionByName(close.select(F.col("a").alias("node"))).unionByName(close.select(F.col("b").alias("node"))).distinct()
    # rows that repeat wholly give a set more than once
    sets = scratch.written(_sets(docs, nodes.join(wanted, "node", "left_semi"), shingle).dropDuplicates(["node"]), "sets")
    a, b = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    same = _alike(F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb")), similarity)
    verified = lambda pairs: scratch.written(pairs.join(a, "a").join(b, "b").where(same).select("a", "b"), "links")
    near = verified(close)
    joined = scratch.written(connected_components(near, into=scratch), "parts")
    placed = members.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    apart = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    placed = placed.join(apart, "key", "left_semi")

    own = sets.select("node", F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("e"))
    sized = sets.select("node", F.size("s").cast("long").alias("n")).join(own, "node", "left").select("node", "n", F.coalesce("e", F.lit(0)).alias("e"))
    k = round(similarity * 1000)
    of = scratch.written(placed.join(sized.where(1000 * (F.col("n") - F.col("e")) >= k * F.col("n")), "node").select("key", "node", "n", "e", "comp"), "near")
    lead = of.groupBy("key").agg(F.min(F.struct(F.col("e") / F.col("n"), "node", "n", "e", "comp")).alias("r")).select("key", F.col("r.node").alias("a"), F.col("r.n").alias("na"), F.col("r.e").alias("ea"), F.col("r.comp").alias("ca"))
    pairs = of.join(lead, "key").where((F.col("ca") != F.col("comp")) & _within_reach(F.col("na"), F.col("ea"), F.col("n"), F.col("e"), similarity))
    pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    found = near.unionByName(verified(pairs))

    comp = scratch.written(connected_components(found, into=scratch), "parts")
    of = of.drop("comp").join(comp, "node", "left").select("key", "node", "n", "e", F.coalesce("component", "node").alias("comp"))
    several = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    of = scratch.written(of.join(several, "key", "left_semi"), "open")
    x, y = of.alias("x"), of.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & _within_reach(F.col("x.n"), F.col("x.e"), F.col("y.n"), F.col("y.e"), similarity)
    late = scratch.written(x.join(y, apart, "left_semi").select("node").distinct(), "late")
    rest = scratch.written(of.join(late, "node", "left_semi").join(sets, "node"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    alike = _alike(F.col("x.n"), F.col("y.n"), F.size(F.array_intersect("x.s", "y.s")), similarity)
    more = x.join(y, apart & (F.col("x.node") < F.col("y.node")) & alike).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return found.unionByName(scratch.written(more, "links"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of documents that links of ``similarity`` or more reach: that with the smallest id, null ids last.

    Texts without words are one component. Where an id repeats, its text tells its rows apart, and one of wholly equal rows stays.
    """
    scratch = Scratch(docs.sparkSession)
    each = scratch.written(sketches(docs, shingle), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "text_hash")
    nodes = scratch.written(each.groupBy("node").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    comp = connected_components(links(docs, nodes, scratch, shingle, similarity), into=scratch)
    labelled = nodes.join(comp, "node", "left").select("first", F.coalesce("component", "node").alias("comp"))
    keep = labelled.groupBy("comp").agg(F.min("first").alias("f")).select(F.coalesce("f.id", F.lit(0)).alias("_i"), F.col("f.none").alias("_no"), F.col("f.text_hash").alias("_h"))
    keep = written(keep, "kept")
    scratch.clear()
    i, no, h = names = unused(docs, "_i", "_no", "_h")
    named = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), no: F.col("doc_id").isNull(), h: F.xxhash64("text")})
    return named.join(keep.toDF(*names), names, "left_semi").dropDuplicates(names).drop(*names)
