import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from framesift.llm import simhash, similar
from framesift.llm.common import Scratch


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept(rows):
    """The first of each component, by counting what every pair of sets shares."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, common = {}, Counter()
    for i, a in enumerate(sets):
        for h in a or {None}:
            for j in holders.setdefault(h, []):
                common[j, i] += 1
            holders[h].append(i)
    for (i, j), n in common.items():
        if 5 * n >= 4 * (max(1, len(sets[i])) + max(1, len(sets[j])) - n):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted(least.values())


def near_copies(seed, n=8):
    """Bases with copies whose similarity lies on both sides of 0.8, and chains of copies."""
    r, out = random.Random(seed), []
    for _ in range(n):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([6, 30, 120]))]
        out.append(" ".join(base))
        for _ in range(10):
            c = list(base)
            for _ in range(r.choice([1, 1, 2, 3])):
                c[r.randrange(len(c))] = f"x{r.randrange(10**6)}"
            out.append(" ".join(c).upper())
            if r.random() < 0.3:
                base = c
    r.shuffle(out)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stage_finds_all_pairs_of_the_table(spark, docs_of, texts):
    want = kept(texts)
    assert len(want) == 922  # the fingerprints' rule of three bits kept 927
    assert ids(corpus_pipeline.drop_near_copies(spark, docs_of(texts), None)) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs_of, odd, seed):
    rows = list(enumerate(near_copies(seed) + odd))
    assert ids(similar.keep_first(docs_of(rows))) == kept(rows)


def test_large_group_around_the_bound(docs_of):
    """A group whose members are on both sides of the bound, to their first and to each other, so that several rounds are needed."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        c = list(base)
        for j in r.sample(range(0, 200, 5), r.choice([2, 4, 5, 7])):
            c[j] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    assert ids(similar.keep_first(docs_of(rows))) == kept(rows)


def test_buckets_propose_what_reaches_the_bound():
    r = np.random.default_rng(3)
    for n in (9, 90, 900):
        for _ in range(300):
            x = r.integers(0, 1 << 63, n + n // 9, np.uint64)
            a, b = x[:n], x[n // 9 :]
            assert set(similar.buckets(a)) & set(similar.buckets(b))


def test_repeated_and_null_ids(docs_of):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (0, a), (None, b), (None, c), (None, c + " d"), (None, c + " d")]
    got = [(r["doc_id"], r["text"]) for r in similar.keep_first(docs_of(rows)).collect()]
    assert len(got) == 3 and (0, a) in got and (1, b) in got and got[[x[0] for x in got].index(None)][1].startswith(c)


def test_sets_of_millions_do_not_overflow(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(3_000_000, 3_000_000, 2_700_000), (3_000_000, 3_000_000, 2_600_000)], "a int, b int, both int")
    assert [r[0] for r in df.select(similar._alike(F.col("a"), F.col("b"), F.col("both"), 0.8)).collect()] == [True, False]


def test_fingerprint_is_the_operators(odd):
    for t in [*odd, *near_copies(4, 3)]:
        for k in (3, 5):
            assert similar.majority(similar.hashes(t or "", k)[1]) == simhash._signed(simhash.fingerprint(t or "", k))


def test_grids_of_fingerprints_link_without_minima(docs_of):
    """The operator's own steps: without any bucket of minima, what is within three bits meets, and what passes on whole sets is joined."""
    from pyspark.sql import functions as F

    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base)] + [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(399, 360, -1)] + [f"{i} {r.random()} b c d e" for i in range(9)]
    docs = docs_of(list(enumerate(texts)))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "text_hash").alias("first")
    nodes = similar.sketches(docs).select("node", "n", first, "fp", F.array().cast("array<bigint>").alias("keys"))
    fp, sets = {}, {}
    for t in texts:
        node = similar.hashes(t)[0]
        fp[node], sets[node] = simhash.fingerprint(t, 5), shingle_set(t)
    close = {(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3}
    met = {tuple(x) for x in similar.met(nodes).collect()}
    assert met <= close and {n for p in met for n in p} == {n for p in close for n in p} and len(met) > 20
    got = {tuple(x) for x in similar.links(docs, nodes, Scratch(docs.sparkSession)).collect()}
    assert got == {(a, b) for a, b in met if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])} and len(got) > 20
