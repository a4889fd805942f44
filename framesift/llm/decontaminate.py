"""Benchmark decontamination with one Aho-Corasick automaton over windows of normalised items."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pick, unused, written

WINDOW = 13
#: Items go to one automaton while their texts take at most so many bytes: at six bytes a word some 18 million nodes of 40 bytes; beyond, to several, one scan each.
SHARD_BYTES = 2 << 20
PERCENT_INVERSE = 20
#: Bytes to bytes: A-Z lower-cased, what is no word byte to a space. UTF-8 bytes above 127 belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
#: A word of the benchmark is so many symbols of 64: the first from one alphabet, the others from another, so that only whole words match.
_SYMBOLS = 4
_UNKNOWN = "\0" * _SYMBOLS
_built: dict[str, tuple] = {}


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


def windows(text: str | None, size: int = WINDOW) -> list[list[bytes]]:
    """All windows of ``size`` words; one of all words where there are fewer; none without words."""
    w = _bytes(text).split()
    if not w:
        return []
    return [w[i : i + size] for i in range(max(1, len(w) - size + 1))]


class _Codes(dict):
    def __missing__(self, word: bytes) -> str:
        k = len(self)
        self[word] = code = chr(0x40 + (k & 63)) + "".join(chr(0xC0 + (k >> 6 * i & 63)) for i in range(1, _SYMBOLS))
        return code


def build(items: list[tuple[str, str]], size: int = WINDOW):
    """(automaton, items by pattern, codes of words): a pattern is a window's codes, its value its number and its words."""
    import ahocorasick

    auto, number, owners, codes = ahocorasick.Automaton(), {}, [], _Codes()
    for item, text in items:
        for w in windows(text, size):
            s = "".join([codes[x] for x in w])
            k = number.setdefault(s, len(owners))
            if k == len(owners):
                owners.append(set())
                auto.add_word(s, (k, len(w)))
            owners[k].add(item)
    if owners:
        auto.make_automaton()
    return (auto if owners else None), owners, codes


def find(text: str | None, built, size: int = WINDOW) -> tuple[int, list[int], set[str], bool]:
    """(words, sorted places of the hit words, items found, whether a window of ``size`` words is among them) of one text, scanned once."""
    auto, owners, codes = built
    words = _bytes(text).split()
    hit, items, whole = set(), set(), False
    if not words or auto is None:
        return len(words), [], items, whole
    code = codes.get
    for e, (k, n) in auto.iter("".join([code(w, _UNKNOWN) for w in words])):
        last = e // _SYMBOLS
        hit.update(range(last - n + 1, last + 1))
        items |= owners[k]
        whole |= n >= size
    return len(words), sorted(hit), items, whole


def spans(text: str, hit: list[int]) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) characters of the text as it was."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    out: list[list[int]] = []
    for i in hit:
        if out and out[-1][2] == i - 1:
            out[-1][1:] = at[i][1], i
        else:
            out.append([*at[i], i])
    chars = lambda n: len(raw[:n].decode("utf-8", "surrogatepass"))
    return [(chars(a), chars(b)) for a, b, _ in out]


def _shards(benchmark: DataFrame, shard_bytes: int) -> Iterator[list[tuple[str, str]]]:
    b = pick(benchmark, "item_id", "text").where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = b.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    n = max(1, math.ceil(total / shard_bytes))  # one scan at least, which counts the words
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.toLocalIterator()]


_FOUND = "struct<n:int,hit:array<int>,items:array<string>,whole:boolean>"
_FOUND_ARROW = pa.struct([("n", pa.int32()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("whole", pa.bool_())])


def _hits(docs: DataFrame, benchmark: DataFrame, size: int, shard_bytes: int) -> tuple[DataFrame, str]:
    """(docs with one more column, its name): n words, places of hit words, items found, and whether a whole window is among them.

    Nothing is shuffled. The driver measures the benchmark before it sends an automaton's items: beyond ``shard_bytes`` it is dealt to several automata by hash, and
    the documents, with what they have collected, are written between the scans, so no executor holds two.
    """
    spark = docs.sparkSession
    (name,) = unused(docs, "found")
    cur = docs.withColumn(name, F.lit(None).cast(_FOUND))
    at, width, more = docs.columns.index("text"), len(docs.columns), False
    for items in _shards(benchmark, shard_bytes):
        if more:
            cur = written(cur, "scanned")
        sent = spark.sparkContext.broadcast(items)

        def step(batches: Iterator[pa.RecordBatch], sent=sent, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            if key not in _built:
                _built.clear()
                _built[key] = build(sent.value, size)
            built = _built[key]
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    part, out = b.slice(i, 256), []
                    for text, old in zip(part.column(at).to_pylist(), part.column(width).to_pylist()):
                        n, h, s, whole = find(text, built, size)
                        if old:
                            h, s, whole = sorted({*h, *old["hit"]}), {*s, *old["items"]}, whole or old["whole"]
                        out.append({"n": n, "hit": h, "items": sorted(s), "whole": whole})
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(out, _FOUND_ARROW)], part.schema.names)

        cur = cur.mapInArrow(step, cur.schema)
        more = True
    return cur, name


def _contaminated(found: str):
    n = F.size(f"`{found}`.hit")
    return (n > 0) & (PERCENT_INVERSE * n.cast("long") >= F.col(f"`{found}`.n"))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted) and spans (character offsets of hit runs).

    Every occurrence of every window counts. A null text has no words, an empty benchmark hits nothing; items with a null id
    or text are left out, repeated items are one; repeated rows give repeated results; no rows give none.
    """
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cur, name = _hits(d, benchmark, size, shard_bytes)
    cur = cur.withColumn("contaminated", _contaminated(name))

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                cols = {n: part.column(k) for k, n in enumerate(part.schema.names)}
                at = [[{"start": x, "end": y} for x, y in spans(t, f["hit"])] if f["hit"] else [] for t, f in zip(cols["text"].to_pylist(), cols[name].to_pylist())]
                yield pa.RecordBatch.from_arrays([*(cols[c] for c in ("doc_id", name, "contaminated")), pa.array(at, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                                                 ["doc_id", name, "contaminated", "spans"])

    out = cur.mapInArrow(where, f"doc_id long, {name} {_FOUND}, contaminated boolean, spans array<struct<start:int,end:int>>")
    items = F.col(f"{name}.items")
    return out.select("doc_id", F.col(f"{name}.n").cast("long").alias("n_words"), F.size(f"{name}.hit").cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated", items.alias("items"), "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of docs, all columns, that hold no window of ``size`` words of the benchmark, and of whose words under a twentieth, or none, lies in items shorter than that.

    A passage of ``size`` words counts however long the text around it is; a short item may stand in a text by chance, so it counts by its share alone.
    Null and empty texts stay, as do all rows where the benchmark is empty; rows with null ids and repeated rows are judged by their texts; no rows give none;
    columns may have any names.
    """
    cur, name = _hits(docs, benchmark, size, shard_bytes)
    return cur.where(~(F.col(f"`{name}`.whole") | _contaminated(name))).drop(name)


_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = rf"""

WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_RE}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_RE}') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS MATERIALIZED (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, s)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND {PERCENT_INVERSE} * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
"""
