"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pick, released

BITS = 20
#: The bound on the labelled rows of each class that training looks at, lowest hash of the id first.
ROWS_PER_CLASS = 2000
THRESHOLD = 0.7
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 15.0, 1.0, 4
#: Toxic rows weigh so much more that both classes weigh the same, up to this factor.
MAX_BOOST = 10.0
CACHE = 300_000
#: Words count by their first letters too, so that an inflected form is known by its stem; a word that is no longer than a stem is itself, not the stem.
STEMS = (3, 4, 5, 6, 7)
_WORD = re.compile(r"[^\W_]+")
#: Odd factors for the second word of a pair, by its distance: 1 a bigram, 2 and 3 skip-grams.
_MIX = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F, 3: 0x165667B19E3779F9}
_SHARED = 0x632BE59BD9B4E019 >> 3
_FIRST, _LAST = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x2545F4914F6CDD1D)


class _Words(dict):
    """The row of each word in a table of hashes: of itself, then of its truncated stems."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((CACHE + 1, 1 + len(STEMS)), np.uint64)

    def __missing__(self, w: str) -> int:
        self[w] = k = len(self)
        for i, form in enumerate((w, *(f"{w[:n]}*" if len(w) > n else w for n in STEMS))):
            b = form.encode("utf-8", "surrogatepass")
            self.table[k, i] = zlib.crc32(b) << 32 | zlib.crc32(b, 0x5BD1E995)
        return k


_words = _Words()


def _hashes(words: list[str]) -> np.ndarray:
    """The hashes of a text's words, a row each; a full table is begun anew, a part of the text at a time."""
    parts = []
    for i in range(0, len(words), CACHE // 2):
        if len(_words) > CACHE // 2:
            _words.clear()
        rows = np.fromiter(map(_words.__getitem__, words[i : i + CACHE // 2]), np.int64)
        parts.append(_words.table[rows])
    return np.concatenate(parts) if parts else np.zeros((0, 1 + len(STEMS)), np.uint64)


def _buckets(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    x = np.concatenate(hashes)
    x ^= x >> np.uint64(29)
    x *= _LAST
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _grams(forms: np.ndarray) -> list[np.ndarray]:
    h = forms[:, 0]
    parts = [(forms * _FIRST).ravel()]
    for gap, mix in _MIX.items():
        if len(h) > gap:
            parts.append(h[:-gap] * _FIRST ^ (h[gap:] * np.uint64(mix) + np.uint64(gap)))
    return parts


def features(text: str, bits: int = BITS) -> np.ndarray:
    """A bucket for each word and stem, neighbouring pair and pair that skips one or two words, repeats included."""
    return _buckets(_grams(_hashes(_WORD.findall(text.lower()))), bits)


def marks(text: str, bits: int = BITS, weights: np.ndarray | None = None) -> np.ndarray:
    """What the model looks at: the features, and the stems that several different words of the text begin with, by how many (2 and more, 4 and more), each bucket once.

    With weights only the buckets that have one are told.
    """
    forms = _hashes(_WORD.findall(text.lower()))
    parts = _grams(forms)
    _, first = np.unique(forms[:, 0], return_index=True)
    once = forms[first]
    stems, n = np.unique(once[:, 1:][once[:, 1:] != once[:, :1]], return_counts=True)
    parts += [stems[n >= k] * _FIRST ^ np.uint64(k * _SHARED) for k in (2, 4)]
    x = _buckets(parts, bits)
    return np.unique(x if weights is None else x[weights[x] != 0])


def fit(rows: list[tuple[float, np.ndarray]], bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, buckets, weights) from (label, distinct buckets); weights within l1 of nothing stay exactly zero."""
    rare = sum(y for y, _ in rows)
    boost = min(MAX_BOOST, max(1.0, (len(rows) - rare) / rare)) if rare else 1.0
    n, z, w = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)
    n0 = z0 = b = 0.0
    for _ in range(epochs):
        for y, f in rows:
            p = 1 / (1 + np.exp(-np.clip(b + w[f].sum(), -35, 35)))
            g = (p - y) * (boost if y else 1.0)
            # per-coordinate rates: each bucket's own sum of squared gradients
            new = n[f] + g * g
            z[f] += g - (np.sqrt(new) - np.sqrt(n[f])) / alpha * w[f]
            n[f] = new
            zf = z[f]
            w[f] = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(new)) / alpha + l2))
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / alpha * b
            n0 += g * g
            b = -z0 / ((beta + np.sqrt(n0)) / alpha)
    at = np.flatnonzero(w)
    return float(b), at, w[at]


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, bits: int = BITS) -> tuple[float, np.ndarray, np.ndarray]:
    """The sparse model from a bounded sample of labelled rows.

    Only ids with crc32(id as text) mod 3 other than 1 and a label of 0 or 1 take part. The sample
    is chosen before any text is read, by a top-k for each class; at most 2 * rows_per_class ids are
    broadcast and as many rows of buckets reach the one training task. Repeated labels count once; ids with both labels count as both.
    """
    lab = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    lab = lab.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    some = [lab.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for y in (0, 1)]
    text = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [marks(b.column(2)[k].as_py() or "", bits).astype("<i4").tobytes() for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary())], ["doc_id", "toxic", "f"])

    rows = text.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("doc_id", "toxic", "text")
    rows = rows.mapInArrow(distinct, "doc_id long, toxic int, f binary")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {(d, y, f) for b in batches for d, y, f in zip(*(c.to_pylist() for c in b.columns))}
        # an order that depends on the ids alone, not on how rows were dealt
        got = sorted(got, key=lambda r: (zlib.crc32(str(r[0]).encode(), 7), r))
        b, at, w = fit([(float(y), np.frombuffer(f, "<i4").astype(np.int64)) for _, y, f in got], bits)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([b, *w.tolist()], pa.float64())], ["at", "w"])

    model = sorted(rows.repartition(1).mapInArrow(learn, "at long, w double").collect())  # non-zero weights: at most 1 << bits
    return (model[0]["w"] if model else 0.0, np.array([r["at"] for r in model[1:]], np.int64), np.array([r["w"] for r in model[1:]], np.float64))


def _scores(texts: Iterator[str | None], model: tuple[float, np.ndarray, np.ndarray], dense: np.ndarray, bits: int) -> list[float]:
    out = []
    for t in texts:
        f = marks(t or "", bits, dense)
        out.append(float(1 / (1 + np.exp(-np.clip(model[0] + dense[f].sum(dtype=np.float64), -35, 35)))))
    return out


def _dense(model: tuple[float, np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, np.float32)
    out[model[1]] = model[2]
    return out


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text.

    A feature counts once however often it occurs. Null and empty texts, and texts without any weighted feature, get the score of the intercept.
    Null ids are held in. Repeated rows are scored alike; no rows give none. The weights are broadcast: no more than 1 << bits of them, few after L1.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _dense(sent.value, bits)
        for b in batches:
            out = [x for i in range(0, b.num_rows, 256) for x in _scores(b.column(1).slice(i, 256).to_pylist(), sent.value, dense, bits)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return d.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """The rows of docs, all columns, whose text scores below ``threshold``; nothing is shuffled.

    Null and empty texts, and texts without any weighted feature, get the score of the intercept, as in ``score``; very long texts are read whole, repeated rows stay
    or go alike, ids are not looked at; no rows give none; columns may have any names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _dense(sent.value, bits)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield part.filter(pa.array([x < threshold for x in _scores(part.column(at).to_pylist(), sent.value, dense, bits)]))

    return docs.mapInArrow(lambda it: released(of(it)), docs.schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
