"""SimHash near-duplicates: a segment-popcount embedding, a grid range-join, exact verification.

A fingerprint's 32 segments of two bits are mapped to their bit counts, its coordinates, held in unary: the Manhattan
distance of two embeddings is then the bit count of their difference, and never above the Hamming distance of
the fingerprints. The range join is over projections: the coordinates form blocks, and of two points within a Manhattan
distance of three, all blocks but three lie in the same cell of width one, so each choice of all blocks but three is a grid whose cells are joined, no neighbouring
cell being needed; what the other coordinates add up to is tested by the lower bound, then the bits themselves. More points get more and finer blocks,
so that chance meetings in a cell stay as rare per point. A pair is made in the first grid only where it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, connected_components, pick, written

SHINGLE = 5
SIMILARITY = 0.8
DISTANCE = 3
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = 0x5555555555555555
SEGMENTS = 32
#: Two random bits pairs have the same count so often.
_SAME = 0.375
STEP = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, shingle: int) -> int:
    """64 majority bits over the text's shingles, repeats included; 0 for a text without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(norm, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    begins = (ends - sizes + 1)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    n, ones = len(begins), np.zeros(64, np.int64)
    for i in range(0, n, STEP):
        h = np.array([of(norm[a:b], 42) for a, b in zip(begins[i : i + STEP], ends[i : i + STEP])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > n)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; a null text has no words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = []
            for i in range(0, b.num_rows, 256):
                fp += [_signed(fingerprint(t or "", shingle)) for t in b.column(1).slice(i, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(of, "doc_id long, fp long")


def _embed(x: Column) -> Column:
    """Each two-bit segment's bit count in unary: 00, 01 or 11."""
    high = F.shiftrightunsigned(x, 1)
    both = x.bitwiseAND(high).bitwiseAND(F.lit(_ODD))
    return F.shiftleft(both, 1).bitwiseOR(x.bitwiseOR(high).bitwiseAND(F.lit(_ODD)))


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The number of blocks for n points: that which makes the fewest rows, one a grid and point and one a chance meeting in a cell."""
    rows = lambda m: comb(m, distance) * (1 + n * _SAME ** (SEGMENTS * (m - distance) / m))
    return min(range(distance + 2, SEGMENTS + 1), key=rows)


def grids(blocks: int, distance: int = DISTANCE) -> list[tuple[int, list[int]]]:
    """(bits of the blocks that agree, bits of each earlier block that does not) of each choice of all blocks but ``distance``."""
    cuts = [2 * (i * SEGMENTS // blocks) for i in range(blocks + 1)]
    mask = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [(sum(mask[i] for i in keep), [mask[i] for i in range(keep[-1]) if i not in keep]) for keep in combinations(range(blocks), blocks - distance)]


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """(a, b): the pairs a < b of the distinct fingerprints fp that differ in 1 to ``distance`` bits. The number of blocks changes the cost alone."""
    if not 0 <= distance <= 3:
        raise ValueError("the grids are made for distances up to 3")
    reach = max(distance, 1)
    each = grids(blocks or blocks_for(fps.count(), reach), reach)
    cells = F.array(*[F.struct(F.lit(c).alias("grid"), F.col("u").bitwiseAND(F.lit(_signed(mask))).alias("cell")) for c, (mask, _) in enumerate(each)])
    cell = fps.select("fp", _embed(F.col("fp")).alias("u")).select("fp", "u", F.explode(cells).alias("c")).select("fp", "u", "c.grid", "c.cell")
    a, b = cell.alias("a"), cell.alias("b")
    diff = F.col("a.u").bitwiseXOR(F.col("b.u"))
    # in the first grid where a pair meets, every earlier block left out differs
    unlike = F.array(*[F.array(*[F.lit(_signed(m)) for m in skipped]) if skipped else F.array().cast("array<bigint>") for _, skipped in each])
    first = F.forall(F.element_at(unlike, F.col("a.grid") + 1), lambda m: diff.bitwiseAND(m) != 0)
    near = (F.bit_count(diff) <= distance) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
    on = (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & near & first
    return a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id that links of ``distance`` differing bits reach. Documents with the same fingerprint are one node of the graph,
    whose first doc_id is taken by a map-side minimum, so a group of copies costs one row a task however large. Texts without words
    have the fingerprint 0 and are linked like any other. Null ids come last: their component is null only if it holds no other.
    Repeated rows give repeated results; no rows give none.
    """
    scratch = Scratch(docs.sparkSession)
    each = written(fingerprints(docs, shingle), "fingerprints")
    nodes = scratch.written(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    comp = connected_components(links(nodes.select("fp"), distance), into=scratch)
    labelled = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("comp"))
    least = labelled.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_fp = written(labelled.join(least, "comp").select("fp", "component_id"), "components")
    scratch.clear()
    return each.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of documents that links of ``similarity`` or more between their sets of shingles reach: that with the smallest id, null ids last.

    No distance of 64 majority bits that the grids can serve holds all pairs at 0.8 (they differ in ten bits on average, up to twenty), so here the
    fingerprint's segments are minima instead of majorities, a cell is a choice of segments that agree, and the exact test is on the
    whole sets: see ``similar``. Texts without words are one group. Where an id repeats, its text tells its rows apart, and one of wholly equal rows stays;
    rows with null ids are judged like others; no rows give none; columns may have any names.
    """
    from . import similar

    return similar.keep_first(docs, shingle, similarity)

# The primes of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _sql(shingle: int = 3, seed: int = 42, distance: int = DISTANCE) -> str:
    """The query of three-word shingles for DuckDB: XXH64 by its definition over lists of bytes, in integers of 128 bits, then bits, links and reach."""
    p1, p2, p3, p4, p5 = _PRIMES
    word = "18446744073709551616::UHUGEINT"
    u = lambda n: f"{n % (1 << 64)}::UHUGEINT"
    mul = lambda x, p: f"(({x}) * {u(p)} % {word})"
    rot = lambda x, r: f"(({x}) * {u(1 << r)} % {word} + ({x}) // {u(1 << 64 - r)})"
    xor = lambda a, b: f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"
    plus = lambda x, p: f"((({x}) + {u(p)}) % {word})"
    turn = lambda acc, lane: mul(rot(f"(({acc}) + {mul(lane, p2)}) % {word}", 31), p1)
    number = lambda at, n: " + ".join(f"bs[{at} + {k}] * {u(1 << 8 * (k - 1))}" for k in range(1, n + 1))
    start = "[" + ", ".join(u(x) for x in (seed + p1 + p2, seed + p2, seed, seed - p1)) + "]"
    digit = lambda at: f"instr('0123456789ABCDEF', substr(hx, {at}, 1))"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, array_to_string(w[i : i + {shingle - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
c AS MATERIALIZED (SELECT s, hex(encode(s)) AS hx, strlen(s) AS n FROM (SELECT DISTINCT s FROM g)),
raw AS (SELECT s, n, list_transform(range(1, n + 1), lambda i: (({digit('2 * i - 1')} - 1) * 16 + {digit('2 * i')} - 1)::UHUGEINT) AS bs FROM c),
lanes AS (SELECT s, n, bs, list_transform(range(0, n // 8), lambda i: {number('8 * i', 8)}) AS la FROM raw),
stripes AS (SELECT s, n, bs, la, CASE WHEN n >= 32 THEN list_reduce(list_prepend({start}, list_transform(range(0, n // 32), lambda i: la[4 * i + 1 : 4 * i + 4])),
  lambda a, x: [{', '.join(turn(f'a[{k}]', f'x[{k}]') for k in (1, 2, 3, 4))}]) END AS v FROM lanes),
h0 AS (SELECT s, n, bs, la, CASE WHEN v IS NULL THEN {u(seed + p5)} ELSE list_reduce([({rot('v[1]', 1)} + {rot('v[2]', 7)} + {rot('v[3]', 12)} + {rot('v[4]', 18)}) % {word}, v[1], v[2], v[3], v[4]],
  lambda a, x: {plus(mul(xor('a', turn('0::UHUGEINT', 'x')), p1), p4)}) END AS h FROM stripes),
h1 AS (SELECT s, n, bs, n // 8 * 8 AS o, list_reduce(list_prepend((h + n::UHUGEINT) % {word}, la[n // 32 * 4 + 1 :]), lambda a, x: {plus(mul(rot(xor('a', turn('0::UHUGEINT', 'x')), 27), p1), p4)}) AS h FROM h0),
h2 AS (SELECT s, bs, CASE WHEN n - o >= 4 THEN o + 4 ELSE o END AS o, CASE WHEN n - o >= 4 THEN {plus(mul(rot(xor('h', mul(number('o', 4), p1)), 23), p2), p3)} ELSE h END AS h FROM h1),
h3 AS (SELECT s, list_reduce(list_prepend(h, bs[o + 1 :]), lambda a, x: {mul(rot(xor('a', mul('x', p5)), 11), p1)}) AS h FROM h2),
h4 AS (SELECT s, {mul(xor('h', f'h // {u(1 << 33)}'), p2)} AS h FROM h3),
h5 AS (SELECT s, {mul(xor('h', f'h // {u(1 << 29)}'), p3)} AS h FROM h4),
x AS MATERIALIZED (SELECT s, {xor('h', f'h // {u(1 << 32)}')}::UBIGINT AS h FROM h5),
bits AS (SELECT r, b, sum((h >> b) & 1) * 2 > count(*) AS one FROM g JOIN x USING (s), (SELECT unnest(range(0, 64))::UBIGINT AS b) GROUP BY r, b),
f AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0) AS fp FROM d LEFT JOIN (SELECT r, bit_or(CASE WHEN one THEN 1::UBIGINT << b ELSE 0 END) AS fp FROM bits GROUP BY r) USING (r)),
n AS MATERIALIZED (SELECT fp, min(doc_id) AS first FROM f GROUP BY fp),
e AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM n a JOIN n b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {distance}),
reach AS (SELECT fp, first FROM n UNION SELECT e.b, reach.first FROM reach JOIN e ON e.a = reach.fp)
SELECT f.doc_id, lower(lpad(hex(f.fp), 16, '0')) AS fingerprint, least_.first AS component_id FROM f JOIN (SELECT fp, min(first) AS first FROM reach GROUP BY fp) least_ USING (fp)"""


SQL = _sql()
