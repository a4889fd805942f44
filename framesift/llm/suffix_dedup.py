"""Removal of repeated byte strings by suffix arrays of collections, built column by column.

All windows of 100 bytes that hold the same minimal 24-byte gram are neighbours in a text and form a run; equal
windows have equal grams, so only runs that share a gram can hold a repeated window. Runs that are equal as a whole
are settled by their first one. What is left, the distinct runs of a gram that has several, goes to collections whose
Burrows-Wheeler transform and common prefixes are built by inserting one symbol of every string a round; windows
whose suffixes share 100 symbols are the repeated ones.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, free_shuffles, pick, release, released, unused, written

WIDTH = 100
GRAM = 24
#: Strings in a collection, on average, and the most of one gram; a gram with more distinct runs is split by the bytes around it.
COLLECTION = HOT = 8_000
#: Windows whose gram lies so many bytes further on or less are kept together where a gram is split: they share all but as many bytes.
STEP = 11
_CHUNK = 1 << 18
_RUNS = 400_000
#: Rows that a round writes to its files at once.
_BLOCK = 1 << 18
_LOW = np.uint64(0xFFF)
_U = np.uint64
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1


def _power(n: int) -> np.uint64:
    return _U(pow(_BASE, n, 1 << 64))


def _grams(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the GRAM bytes from each place on."""
    h1 = _BYTE[data]
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    x = h16[:-8] * _power(8) + h8[16:]
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _slide(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n values in a row."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def runs(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, gram, tie) of the runs of the texts, in order.

    The gram is the upper 52 bits of its hash; among equal ones in a window the place's low bits decide.
    tie: some window of the run holds its gram twice, so that windows of one run may be equal.
    """
    n = width - GRAM + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    if len(data) < width:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(bool)
    g = _grams(data) & ~_LOW
    place = np.arange(len(g), dtype=np.uint64) * _U(2654435769) & _LOW
    m = _slide(g | place, n)
    other = _slide(g | (_LOW - place), n)
    tie = ((m & _LOW) + (other & _LOW)) != _LOW
    valid = np.ones(len(data), bool)
    for e, s in zip(ends.tolist(), sizes.tolist()):
        valid[max(e - width + 1, e - s) : e] = False
    at = np.flatnonzero(valid[: len(m)])
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(bool)
    v = m[at]
    new = np.ones(len(at), bool)
    new[1:] = (v[1:] != v[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    a, b = at[first], at[last]
    text = np.searchsorted(ends, a, "right")
    begin = (ends - sizes)[text]
    return text, a - begin, b - begin, (v[first] >> _U(12)).astype(np.int64), np.logical_or.reduceat(tie[at], first)


def _pending(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, sig, doc, al). A run: its gram, the hash of its bytes, al = part | first window | windows less one | tie.

    Of equal runs in one stretch of a task only the first goes on; the others are removed whatever else there is,
    and leave as finished spans: h negative, sig the span's end.
    """
    import xxhash

    of = xxhash.xxh3_64_intdigest
    held: list[tuple] = []
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        h, sig, doc, al = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((al, doc))
        h, sig, doc, al = h[order], sig[order], doc[order], al[order]
        key = h * np.int64(0x2545F4914F6CDD1D) ^ sig
        by = np.argsort(key, kind="stable")
        lead = np.ones(len(by), bool)
        lead[1:] = key[by[1:]] != key[by[:-1]]
        top = by[np.maximum.accumulate(np.where(lead, np.arange(len(by)), 0))]
        again = np.zeros(len(by), bool)
        again[by] = (h[top] == h[by]) & (sig[top] == sig[by]) & ((doc[top] != doc[by]) | (al[top] != al[by]))  # a repeated row is no later run
        keep = ~again
        d, x = doc[again], al[again]
        part, a = x >> 40, x >> 8 & 0xFFFFFFFF
        e = a + (x >> 1 & 0x7F) + width
        if len(d):
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (part[1:] != part[:-1]) | (a[1:] > e[:-1])
            i = np.flatnonzero(new)
            j = np.append(i[1:], len(d)) - 1
            d, x, a, e = d[i], x[i], a[i], e[j]
            spread = -1 - ((d * np.int64(0x5851F42D4C957F2D) ^ a) >> 12 & 0xFFFFFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(e), pa.array(d), pa.array(x)], ["h", "sig", "doc", "al"])
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (h, sig, doc, al)], ["h", "sig", "doc", "al"])

    def add(docs: list[tuple[int, int]], texts: list[bytes]) -> None:
        nonlocal count
        t, a, b, h, tie = runs(texts, width)
        if not len(t):
            return
        sig = np.array([of(texts[i][x : y + width]) for i, x, y in zip(t.tolist(), a.tolist(), b.tolist())], np.uint64).astype(np.int64)
        ids = np.array(docs, np.int64)[t]
        held.append((h, sig, ids[:, 0], ids[:, 1] << 40 | a << 8 | (b - a) << 1 | tie))
        count += len(t)

    for batch in batches:
        docs, texts, size = [], [], 0
        for i in range(0, batch.num_rows, 256):
            for doc, part, text in zip(*(c.slice(i, 256).to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "surrogatepass")
                docs.append((doc, part))
                texts.append(raw)
                size += len(raw)
                if size >= _CHUNK:
                    add(docs, texts)
                    docs, texts, size = [], [], 0
                if count >= _RUNS:
                    yield from flush()
                    held, count = [], 0
        if texts:
            add(docs, texts)
    if held:
        yield from flush()


class _Rows:
    """One round's rows as files, a column each, written and read from front to back; no round has fewer rows than one before it."""

    KINDS = {"bwt": np.uint16, "lcp": np.uint8, "owner": np.int32, "length": np.uint8, "fresh": np.bool_}

    def __init__(self, folder: str, name: str, wide: bool):
        self.kinds = self.KINDS | {"bwt": np.uint32} if wide else self.KINDS
        self.files = {c: open(f"{folder}/{name}.{c}", "w+b", buffering=0) for c in self.KINDS}

    def write(self, **columns: np.ndarray) -> None:
        for c, x in columns.items():
            self.files[c].seek(0)
            for i in range(0, len(x), _BLOCK):
                self.files[c].write(x[i : i + _BLOCK].data)

    def read(self, column: str) -> np.ndarray:
        self.files[column].seek(0)
        return np.fromfile(self.files[column], self.kinds[column])

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def collection(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bwt, lcp, string, length) of all suffixes of the strings of symbols in their order; 0 in bwt: a string's start.

    Round j inserts the suffix of length j of each string that has one. A round reads the files of the round before from front to back
    and writes its own, the new rows between the old: what comes before a row's suffix, ranked stably, is the place
    of the suffix that is one longer. A common prefix changes only where a row or its
    predecessor is new: one more than the least prefix between the rows that the two suffixes came from. A string's end is less than any symbol.
    Suffixes equal to their ends stay in the strings' order, and count as sharing all their symbols.
    """
    m = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, m)
    width = int(sizes.max(initial=0))
    flat = np.concatenate(strings) if m else np.zeros(0, np.uint16)
    wide = flat.dtype.itemsize > 2
    ends = np.cumsum(sizes)
    last = np.flatnonzero(sizes > 0)
    first = np.zeros(m, flat.dtype)
    first[last] = flat[ends[last] - 1]
    with tempfile.TemporaryDirectory() as folder:
        old, new = _Rows(folder, "a", wide), _Rows(folder, "b", wide)
        # the rows of empty suffixes, one a string, in the strings' order
        old.write(bwt=first, lcp=np.zeros(m, np.uint8), owner=np.arange(m, dtype=np.int32), length=np.zeros(m, np.uint8), fresh=np.ones(m, bool))
        for j in range(1, width + 1):
            bwt, fresh, lcp, owner = (old.read(c) for c in ("bwt", "fresh", "lcp", "owner"))
            order = np.argsort(bwt, kind="stable")
            order = order[np.count_nonzero(bwt == 0) :]  # rows at a string's start lead nowhere
            # a row's image is new if the row itself came last
            came = fresh[order]
            where = np.flatnonzero(came)
            stay = np.flatnonzero(~came) + m
            where_m = where + m
            source = order[where]
            own = owner[source]
            n = m + len(order)
            # the symbol before each new suffix, 0 at its string's start
            before = ends[own] - 1 - j
            more = before >= (ends - sizes)[own]
            symbol = np.zeros(len(own), flat.dtype)
            symbol[more] = flat[before[more]]
            out = np.empty(n, flat.dtype)
            out[:m], out[stay], out[where_m] = bwt[:m], bwt[m:], symbol
            new.write(bwt=out)
            out = np.zeros(n, np.uint8)
            out[stay] = lcp[m:]
            k = np.sort(np.concatenate([where, where + 1]))
            k = k[(np.diff(k, prepend=-1) > 0) & (k < len(order))]
            out[k + m] = 0
            k = k[k > 0]
            k = k[bwt[order[k]] == bwt[order[k - 1]]]
            if len(k):
                out[k + m] = 1 + _least(lcp, order[k - 1] + 1, order[k])
            new.write(lcp=out)
            out = np.empty(n, np.int32)
            out[:m], out[stay], out[where_m] = owner[:m], owner[m:], own
            new.write(owner=out)
            out = np.zeros(n, np.uint8)
            out[stay], out[where_m] = old.read("length")[m:], j
            new.write(length=out)
            out = np.zeros(n, bool)
            out[where_m] = True
            new.write(fresh=out)
            old, new = new, old
        found = tuple(old.read(c) for c in ("bwt", "lcp", "owner", "length"))
        old.close()
        new.close()
    return found


def _least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The minimum of x from lo to hi, both included, for each pair; two overlapping powers of two cover a range."""
    out = np.empty(len(lo), x.dtype)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    table, size = x, 1
    for k in range(int(level.max()) + 1):
        sel = np.flatnonzero(level == k)
        if len(sel):
            out[sel] = np.minimum(table[lo[sel]], table[hi[sel] - size + 1])
        if len(table) > size:
            table = np.minimum(table[:-size], table[size:])
        size *= 2
    return out


def repeated(strings: list[np.ndarray], order: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of all windows of ``width`` symbols but the first of equal ones; ``order`` has a row (rank of its text, place in it) for each string."""
    _, lcp, owner, length = collection(strings)
    rows = np.flatnonzero(length >= width)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.cumsum(lcp < width)[rows]
    own = owner[rows].astype(np.int64)
    start = np.fromiter(map(len, strings), np.int64, len(strings))[own] - length[rows]
    by = np.lexsort((order[own, 1] + start, order[own, 0], group))
    g = group[by]
    later = np.zeros(len(by), bool)
    later[1:] = g[1:] == g[:-1]
    return own[by][later], start[by][later]


def _symbols(strings: list[bytes], grams: np.ndarray, width: int) -> tuple[list[np.ndarray | None], np.ndarray, np.ndarray]:
    """(strings of symbols, raw, out): the strings with their gram, which all their windows hold, as one symbol of its own.

    raw: strings of a gram that some string holds twice; they keep their bytes as symbols, since equal windows may be aligned unlike.
    out: strings that cannot share a window with another. A shared window reaches ``half`` bytes
    from the gram on one side at least, so two strings that share it agree there.
    """
    import xxhash

    m = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, m)
    data = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(m), sizes)[: len(data) - GRAM + 1]
    place = np.flatnonzero((_grams(data) >> _U(12)).astype(np.int64) == grams[owner])
    own = owner[place]
    inside = place - begin[own] <= sizes[own] - GRAM
    place, own = place[inside], own[inside]
    raw = np.bincount(own, minlength=m) != 1
    raw = np.isin(grams, grams[raw])
    at = np.zeros(m, np.int64)
    at[own] = place - begin[own]
    half, of = -(-(width - GRAM) // 2), xxhash.xxh3_64_intdigest
    keys = np.zeros((2, m), np.uint64)
    seen: dict[bytes, int] = {}
    number = np.zeros(m, np.int64)
    for i in np.flatnonzero(~raw).tolist():
        s, p = strings[i], int(at[i])
        gram = s[p : p + GRAM]
        number[i] = k = seen.setdefault(gram, len(seen))
        if half and p >= half:
            keys[0, i] = of(s[p - half : p], k)
        if half and len(s) - p - GRAM >= half:
            keys[1, i] = of(s[p + GRAM : p + GRAM + half], k)
    alone = np.ones(m, bool)
    for key in keys:
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        alone &= (n[back] == 1) | (key == 0)
    out = ~raw & alone & bool(half)
    kind = np.uint16 if len(seen) + 257 < 1 << 16 else np.uint32
    flat = data.astype(kind) + kind(1)
    made: list[np.ndarray | None] = []
    for i, (b, n) in enumerate(zip(begin.tolist(), sizes.tolist())):
        if raw[i]:
            made.append(flat[b : b + n])
        elif out[i]:
            made.append(None)
        else:
            p = b + int(at[i])
            flat[p] = 257 + number[i]
            made.append(np.concatenate([flat[b : p + 1], flat[p + GRAM : b + n]]))
    return made, raw, out


def settled(strings: list[bytes], grams: np.ndarray, order: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """What ``repeated`` finds, in (string, start) order, for strings all of whose windows hold the string's gram."""
    made, raw, out = _symbols(strings, grams, width)
    found = []
    for part, size in ((np.flatnonzero(~raw & ~out), width - GRAM + 1), (np.flatnonzero(raw), width)):
        if len(part):
            own, start = repeated([made[i] for i in part.tolist()], order[part], size)
            found.append((part[own], start))
    own, start = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    by = np.lexsort((start, own))
    return own[by], start[by]


def _merge(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, as maximal ones that neither touch nor overlap."""
    if not len(start):
        return []
    by = np.argsort(start, kind="stable")
    s, e = start[by], np.maximum.accumulate(end[by])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    i = np.flatnonzero(new)
    return list(zip(s[i].tolist(), e[np.append(i[1:], len(s)) - 1].tolist()))


def _split(run: bytes, gram: int, width: int) -> list[tuple[int, int, bytes]]:
    """(key, start, string) of a run's windows, by where their first gram lies and by the bytes that all windows with it there share.

    Equal windows have their first gram at one place and the same bytes around it, so they get one key.
    """
    import xxhash

    data = np.frombuffer(run, np.uint8)
    places = np.flatnonzero((_grams(data) >> _U(12)).astype(np.int64) == gram)
    starts = np.arange(len(run) - width + 1)
    at = places[np.searchsorted(places, starts)]
    lot = (at - starts) // STEP
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (lot[1:] != lot[:-1])]))
    out = []
    for i, j in zip(first.tolist(), np.append(first[1:], len(starts)).tolist()):
        g, k = int(at[i]), int(lot[i])
        around = run[g - k * STEP : g - min(k * STEP + STEP - 1, width - GRAM) + width]
        out.append((xxhash.xxh3_64_intdigest(around, k) >> 1, i, run[i : j - 1 + width]))
    return out


_STRINGS = "key long, h long, doc long, part long, a long, s binary, split boolean"


def _strings(cut: DataFrame, width: int) -> DataFrame:
    """The strings of the runs asked for: whole under their gram (what 1), or split (what 2)."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, 64):
                out: list[tuple] = []
                for doc, part, text, asked in zip(*(c.slice(i, 64).to_pylist() for c in b.columns)):
                    raw = text.encode("utf-8", "surrogatepass")
                    for r in asked:
                        run = raw[r["a"] : r["e"]]
                        if r["what"] == 1:
                            out.append((r["h"], r["h"], doc, part, r["a"], run, False))
                        else:
                            out += [(key, r["h"], doc, part, r["a"] + x, s, True) for key, x, s in _split(run, r["h"], width)]
                if out:
                    kinds = (*[pa.int64()] * 5, pa.binary(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["key", "h", "doc", "part", "a", "s", "split"])

    return cut.mapInArrow(lambda it: released(of(it)), _STRINGS)


def _windows(strings: DataFrame, width: int) -> DataFrame:
    """(doc, part, a, s) of every window of the strings, s a hash of 128 bits: what is left where more strings than a collection takes share all but a few bytes."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in it:
            for i in range(0, b.num_rows, 1024):
                out = [(doc, part, a + x, xxhash.xxh3_128_digest(s[x : x + width])) for doc, part, a, s in zip(*(c.slice(i, 1024).to_pylist() for c in b.columns)) for x in range(len(s) - width + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc", "part", "a", "s"])

    return strings.select("doc", "part", "a", "s").mapInArrow(lambda it: released(of(it)), "doc long, part long, a long, s binary")


def _settle(t: pa.Table, width: int) -> pa.Table:
    """(doc, part, a, e) of the repeated windows of one collection's strings (h, doc, part, a, s)."""
    try:
        return _settled(t, width)
    finally:
        release()


def _settled(t: pa.Table, width: int) -> pa.Table:
    # rows that repeat an id and a text bring the same strings: once is enough
    t = t.group_by(["h", "doc", "part", "a", "s"]).aggregate([])
    s = t.column("s").to_pylist()
    doc, part, a = (t.column(c).to_numpy() for c in ("doc", "part", "a"))
    by = np.lexsort((part, doc))
    rank = np.empty(len(by), np.int64)
    new = np.ones(len(by), bool)
    new[1:] = (doc[by][1:] != doc[by][:-1]) | (part[by][1:] != part[by][:-1])
    rank[by] = np.cumsum(new)
    own, start = settled(s, t.column("h").to_numpy(), np.stack([rank, a], 1), width)
    if not len(own):
        return pa.table({c: pa.array([], pa.int64()) for c in ("doc", "part", "a", "e")})
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (start[1:] > start[:-1] + width)
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(own)) - 1
    o = own[i]
    return pa.table({"doc": doc[o], "part": part[o], "a": a[o] + start[i], "e": a[o] + start[j] + width})


def removed_spans(docs: DataFrame, width: int = WIDTH, hot: int = HOT, size: int = COLLECTION) -> DataFrame:
    """(doc, part, a, e): spans of bytes, possibly overlapping, that cover what is to be removed.

    doc is doc_id, the largest long where it is null; part tells rows with one id and different texts apart. A gram with more than ``hot`` distinct runs
    is split by the bytes around it; where these too have more distinct strings, their windows, which differ in fewer bytes than ``STEP``, are settled one by one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = _keyed(docs)
    pend = d.mapInArrow(lambda it: released(_pending(it, width)), "h long, sig long, doc long, al long").repartition("h")
    same, gram = Window.partitionBy("h", "sig").orderBy("doc", "al"), Window.partitionBy("h")
    seen = pend.withColumn("n", F.dense_rank().over(same))
    seen = seen.withColumn("kinds", F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).over(gram)).withColumn("tie", F.max(F.col("al").bitwiseAND(F.lit(1))).over(gram))
    unclear = (F.col("n") == 1) & ((F.col("kinds") > 1) | (F.col("tie") == 1))
    rows = seen.where((F.col("h") < 0) | (F.col("n") > 1) | unclear)
    a, e = F.shiftright("al", 8).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("al", 1).bitwiseAND(F.lit(0x7F))
    kept = rows.select("h", "doc", F.shiftright("al", 40).alias("part"), a.alias("a"), F.when(F.col("h") < 0, F.col("sig")).otherwise(a + e + width).alias("e"),
                       (F.when(F.col("h") < 0, 0).when(F.col("n") > 1, 0).when(F.col("kinds") > hot, 2).otherwise(1)).alias("what"))
    kept = written(kept, "runs")
    free_shuffles(spark)
    done = kept.where("what = 0").select("doc", "part", "a", "e")
    n = {r["what"]: r["n"] for r in kept.where("what > 0").groupBy("what").agg(F.count("*").alias("n")).collect()}
    if not n:
        return done

    asked = kept.where("what > 0").groupBy("doc", "part").agg(F.collect_list(F.struct("h", "a", "e", "what")).alias("runs"))
    cut = d.withColumnRenamed("doc", "_d").withColumnRenamed("part", "_p").join(asked, (F.col("_d") == F.col("doc")) & (F.col("_p") == F.col("part"))).select("doc", "part", "text", "runs")
    found, total, late = _strings(cut, width), n.get(1, 0), None
    if n.get(2):
        found = scratch.written(found, "strings")
        split = found.where("split")
        total += split.count()
        large = split.groupBy("key", F.xxhash64("s").alias("x")).agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key")
        large = scratch.written(large, "large")
        w = _windows(split.join(large, "key", "left_semi"), width).distinct()
        first = w.groupBy("s").agg(F.min(F.struct("doc", "part", "a")).alias("first"), F.count("*").alias("n")).where("n > 1")
        late = w.join(first, "s").where(F.struct("doc", "part", "a") != F.col("first")).select("doc", "part", "a", (F.col("a") + width).alias("e"))
        found = found.where("not split").unionByName(split.join(large, "key", "left_anti"))
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // size)))).alias("bucket")
    spans = found.select("h", "doc", "part", "a", "s", bucket).groupBy("bucket").applyInArrow(lambda t: _settle(t.select(["h", "doc", "part", "a", "s"]), width), "doc long, part long, a long, e long")
    spans = written(spans if late is None else spans.unionByName(late), "spans")
    scratch.clear()
    free_shuffles(spark)
    return done.unionByName(spans)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).bitwiseAND(F.lit((1 << 23) - 1)).alias("part"), text.alias("text"))


def dedup(docs: DataFrame, width: int = WIDTH, hot: int = HOT, size: int = COLLECTION, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and, if asked for, kept (binary) of every row of docs.

    A byte goes if a string of ``width`` bytes over it starts earlier in another document with a smaller id or in
    its own. Null texts are empty; texts shorter than ``width`` lose nothing. Null ids count as one largest id. Rows that
    repeat an id and its text are one document, and get the same result; rows with one id and different
    texts are documents in the order of a 23-bit hash of the text. No rows give none.
    """
    if not GRAM <= width <= 127:
        raise ValueError(f"width must be {GRAM} to 127")
    spans = removed_spans(docs, width, hot, size).groupBy("doc", "part").agg(F.collect_list(F.struct("a", "e")).alias("spans"))
    d = _keyed(docs)
    rows = d.withColumnRenamed("doc", "_d").withColumnRenamed("part", "_p").join(spans, (F.col("_d") == F.col("doc")) & (F.col("_p") == F.col("part")), "left").select("_d", "text", "spans")

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, 256):
                out: list[tuple] = []
                for doc, t, found in zip(*(c.slice(i, 256).to_pylist() for c in b.columns)):
                    raw = t.encode("utf-8", "surrogatepass")
                    x = _merge(np.array([s["a"] for s in found], np.int64), np.array([s["e"] for s in found], np.int64)) if found else []
                    at, keep = 0, []
                    for s, e in x:
                        keep.append(raw[at:s])
                        at = e
                    kept = b"".join([*keep, raw[at:]])
                    row = (None if doc == _LAST else doc, len(raw), len(raw) - len(kept), len(x), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in x])
                    out.append((*row, kept) if text else row)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))] + [pa.binary()] * text
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * text
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(lambda it: released(of(it)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>" + ", kept binary" * text)


def cleaned(docs: DataFrame, width: int = WIDTH, hot: int = HOT, size: int = COLLECTION) -> DataFrame:
    """docs, all columns, with the repeated bytes gone from text and n_chars, where there is one, counted anew.

    A character of which some bytes go goes wholly. A document that loses all its text stays, with an empty one. Null texts stay null, null ids count
    as one largest id, rows that repeat an id and a text are one document and get the same result; no rows give none; columns may have any names.
    """
    doc, part, d, p, found = unused(docs, "doc", "part", "of_doc", "of_part", "spans")
    spans = removed_spans(docs, width, hot, size).groupBy(F.col("doc").alias(d), F.col("part").alias(p)).agg(F.collect_list(F.struct("a", "e")).alias(found))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), part: F.xxhash64(text).bitwiseAND(F.lit((1 << 23) - 1))})
    rows = keyed.join(spans, (F.col(doc) == F.col(d)) & (F.col(part) == F.col(p)), "left").drop(doc, part, d, p)
    at, schema = docs.columns.index("text"), docs.schema
    n_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                cols, texts = part.columns[:-1], []
                for t, found in zip(cols[at].to_pylist(), part.columns[-1].to_pylist()):
                    if t is not None and found:
                        raw, pos, keep = t.encode("utf-8", "surrogatepass"), 0, []
                        for s, e in _merge(np.array([x["a"] for x in found], np.int64), np.array([x["e"] for x in found], np.int64)):
                            keep.append(raw[pos:s].decode("utf-8", "ignore"))
                            pos = e
                        t = "".join([*keep, raw[pos:].decode("utf-8", "ignore")])
                    texts.append(t)
                cols[at] = pa.array(texts, cols[at].type)
                if n_at is not None:
                    cols[n_at] = pa.array([None if t is None else len(t) for t in texts], cols[n_at].type)
                yield pa.RecordBatch.from_arrays(cols, part.schema.names[:-1])

    return rows.mapInArrow(lambda it: released(of(it)), schema)


#: The query for DuckDB: every window of every text, in blocks of 512 places, grouped by its bytes.
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, doc_id, o, substr(h, 2 * o + 1, 2 * (512 + {WIDTH} - 1)) AS p FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2, 512)) AS o FROM d)),
w AS MATERIALIZED (SELECT r, doc_id, o + i AS pos, substr(p, 2 * i + 1, 2 * {WIDTH}) AS s FROM (SELECT *, unnest(range(0, least(512, len(p) // 2 - {WIDTH} + 1))) AS i FROM b WHERE len(p) >= 2 * {WIDTH})),
f AS (SELECT s, min(struct_pack(a := doc_id, b := pos)) AS f FROM w GROUP BY s HAVING count(*) > 1),
x AS (SELECT DISTINCT r, pos FROM w JOIN f USING (s) WHERE (doc_id, pos) <> (f.f.a, f.f.b)),
n AS (SELECT r, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) <= {WIDTH} THEN 0 ELSE 1 END AS new FROM x),
g AS (SELECT r, pos, sum(new) OVER (PARTITION BY r ORDER BY pos) AS g FROM n),
sp AS MATERIALIZED (SELECT r, min(pos) AS a, max(pos) + {WIDTH} AS e FROM g GROUP BY r, g),
k AS (SELECT r, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS kept
  FROM (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM sp) JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""
