import random
import re

import numpy as np
import pytest
import xxhash

from framesift.llm import queries, simhash
from framesift.llm.common import connected_components


def fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, distance=3):
    fp = np.array(fps, np.uint64)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= distance) + i + 1:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


def test_query_equals_brute_force(spark, sf, texts):
    fps = [fingerprint(t) for _, t in texts]
    ids = [d for d, _ in texts]
    want = sorted((d, f"{f:016x}", c) for d, f, c in zip(ids, fps, groups(ids, fps)))
    assert sorted(tuple(r) for r in queries.QUERIES["op10_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()) == want


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_lose_nothing(spark, distance):
    r = random.Random(distance)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for b in r.sample(range(64), r.randrange(0, 3)):
                x ^= 1 << b
    fps = sorted(fps)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    want = {tuple(sorted((signed[a], signed[b]))) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= distance}
    got = [tuple(x) for x in simhash.links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), distance).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200 + r.randrange(60), 200 + r.randrange(60)) for _ in range(50)] + [(7, 7), (500, 499)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {i: root(i) for i in parent}


def test_odd_texts(docs_of, odd):
    rows = list(enumerate(odd)) + [(0, None), (50, "A"), (51, "a"), (None, "something else entirely here")]
    got = sorted((r["doc_id"] or -1, r["fp"] % (1 << 64), r["component_id"]) for r in simhash.components(docs_of(rows), shingle=3).collect() if r["doc_id"] is not None)
    some = [(d, t) for d, t in rows if d is not None]
    fps = [fingerprint(t) for _, t in some]
    want = sorted((d or -1, f, c) for (d, _), f, c in zip(some, fps, groups([d for d, _ in some], fps)))
    assert got == want


def test_keep_first_and_empty(spark, docs_of):
    t, u = "the quick brown fox jumps over the lazy dog and runs away from the farm today", "another text of some words that is wholly unlike"
    out = simhash.keep_first(docs_of([(1, t), (2, t), (2, t), (2, u), (None, t), (None, "c")]))
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in out.collect()) == [(0, "c"), (1, t), (2, u)]
    assert simhash.components(docs_of([])).count() == 0 and simhash.keep_first(docs_of([])).count() == 0
    clash = spark.createDataFrame([(1, "a b c", 5, 7)], "doc_id long, text string, fp long, component_id long")
    assert simhash.components(clash).count() == 1 and simhash.keep_first(clash).columns == clash.columns


def test_query_equals_sql(compare, sf):
    compare(queries.QUERIES["op10_simhash"], queries.ORACLES["op10_simhash"], sf)
