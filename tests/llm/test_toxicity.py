import zlib

import numpy as np
import pytest

from framesift.llm import queries, toxicity


@pytest.fixture(scope="module")
def judged(spark):
    """The query's result at the largest of the small sizes, with the true labels."""
    d = "/root/testdata/sf0.1"
    out = queries.QUERIES["op2_toxicity"](spark, d)
    return [r.asDict() for r in out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").collect()], spark.read.parquet(f"{d}/documents.parquet").count()


def test_held_out_accuracy(judged):
    rows, n = judged
    assert len(rows) == n and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    test = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    tp, fn = sum(r["predicted"] for r in test if r["toxic"]), sum(1 - r["predicted"] for r in test if r["toxic"])
    fp, tn = sum(r["predicted"] for r in test if not r["toxic"]), sum(1 - r["predicted"] for r in test if not r["toxic"])
    s = sorted((r["score"], r["toxic"]) for r in test)
    auc = sum(i for i, (_, y) in enumerate(s, 1) if y) - (tp + fn) * (tp + fn + 1) / 2
    auc /= (tp + fn) * (tn + fp)
    print(f"recall {tp / (tp + fn):.3f}, false positives {fp / (fp + tn):.4f}, area {auc:.4f}")
    assert auc > 0.97 and tp / (tp + fn) > 0.9 and fp / (fp + tn) < 0.02


def test_weights_are_sparse_and_labels_held_out_do_not_matter(spark, docs_of):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    b, at, w = toxicity.train(docs, labels)
    assert 0 < len(at) < 5000 and np.all(w != 0)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    b2, at2, w2 = toxicity.train(docs.repartition(5), flipped)
    assert b == b2 and np.array_equal(at, at2) and np.array_equal(w, w2)


def test_fit_follows_the_formula():
    """The vectorised fit against the update written out for each coordinate."""
    r = np.random.default_rng(1)
    rows = [(float(r.random() < 0.3), np.unique(r.integers(0, 64, 12))) for _ in range(80)]
    a, b, l1, l2 = 0.5, 1.0, 0.4, 1.0
    got = dict(zip(*[x.tolist() for x in toxicity.fit(rows, 6, a, b, l1, l2, 2)[1:]]))
    rare = sum(y for y, _ in rows)
    boost = min(10.0, max(1.0, (len(rows) - rare) / rare))
    n, z, w, n0, z0, w0 = [0.0] * 64, [0.0] * 64, [0.0] * 64, 0.0, 0.0, 0.0
    for _ in range(2):
        for y, f in rows:
            p = 1 / (1 + np.exp(-(w0 + sum(w[i] for i in f))))
            g = (p - y) * (boost if y else 1)
            for i in f:
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / a * w[i]
                n[i] += g * g
                w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((b + np.sqrt(n[i])) / a + l2)
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / a * w0
            n0 += g * g
            w0 = -z0 / ((b + np.sqrt(n0)) / a)
    assert got.keys() == {i for i in range(64) if w[i]} and all(abs(got[i] - w[i]) < 1e-9 for i in got)


def test_odd_texts_no_labels_and_empty(spark, docs_of, odd):
    model = (0.5, np.array([3, 9]), np.array([1.0, -1.0]))
    rows = list(enumerate(odd)) + [(0, None), (None, "x")]
    out = toxicity.score(docs_of(rows), model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["held_out"] for r in out if r["doc_id"] is None} == {False}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.judge(docs_of(rows), none).collect()} == {0}
    assert toxicity.judge(docs_of([]), none).count() == 0 and toxicity.drop_toxic(docs_of([]), model).count() == 0
    odd_labels = spark.createDataFrame([(None, 1, 1), (1, 0, None), (2, 1, 0), (2, 1, 1), (2, 1, 1), (3, 1, 7)], "doc_id long, quality int, toxic int")
    assert toxicity.judge(docs_of(rows), odd_labels).count() == len(rows)
    clash = spark.createDataFrame([(1, "a", 0.5, True)], "doc_id long, text string, score double, toxic boolean")
    assert toxicity.score(clash, model).count() == 1 and toxicity.drop_toxic(clash, model).columns == clash.columns


def test_very_long_text_equals_its_words():
    long = " ".join(f"w{i}" for i in range(300_000))
    assert len(toxicity.features(long)) == 300_000 * 9 - 6
    small = toxicity.features("w0 w1 w2 w3")
    assert set(small.tolist()) <= set(toxicity.features(long).tolist())


def brute_marks(text):
    """The buckets of a text, each hash and mix written out with plain integers."""
    import re

    m64 = (1 << 64) - 1
    a, c, skips = 0xFF51AFD7ED558CCD, 0x2545F4914F6CDD1D, {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F, 3: 0x165667B19E3779F9}
    of = lambda s: zlib.crc32(s.encode()) << 32 | zlib.crc32(s.encode(), 0x5BD1E995)

    def bucket(x):
        x = (x ^ x >> 29) * c & m64
        return x >> 44

    words = re.findall(r"[^\W_]+", (text or "").lower())
    out, starts = set(), {}
    for w in words:
        out.add(bucket(of(w) * a & m64))
        for n in (3, 4, 5, 6, 7):
            if len(w) > n:
                out.add(bucket(of(w[:n] + "*") * a & m64))
                starts.setdefault(w[:n] + "*", set()).add(w)
    for gap, mix in skips.items():
        for x, y in zip(words, words[gap:]):
            out.add(bucket((of(x) * a & m64) ^ (of(y) * mix + gap & m64)))
    for stem, ws in starts.items():
        for k in (2, 4):
            if len(ws) >= k:
                out.add(bucket((of(stem) * a & m64) ^ (k * (0x632BE59BD9B4E019 >> 3))))
    return out


def test_query_equals_a_model_by_hand(spark):
    """Features, sample, training and scores written out for the smallest tables, on which the bound on the sample does not bind."""
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    marks = {i: sorted(brute_marks(t)) for i, t in docs.items()}
    rows = sorted(((i, y) for i, y in labels if i in docs), key=lambda r: (zlib.crc32(str(r[0]).encode(), 7), r))
    rare = sum(y for _, y in rows)
    boost = min(toxicity.MAX_BOOST, max(1.0, (len(rows) - rare) / rare))
    n, z, w, n0, z0, b = {}, {}, {}, 0.0, 0.0, 0.0
    for _ in range(toxicity.EPOCHS):
        for i, y in rows:
            p = 1 / (1 + np.exp(-min(35, max(-35, b + sum(w.get(k, 0.0) for k in marks[i])))))
            g = (p - y) * (boost if y else 1.0)
            for k in marks[i]:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / toxicity.ALPHA * w.get(k, 0.0)
                n[k] = old + g * g
                w[k] = 0.0 if abs(z[k]) <= toxicity.L1 else -(z[k] - np.sign(z[k]) * toxicity.L1) / ((toxicity.BETA + np.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / toxicity.ALPHA * b
            n0 += g * g
            b = -z0 / ((toxicity.BETA + np.sqrt(n0)) / toxicity.ALPHA)
    want = {i: 1 / (1 + np.exp(-min(35, max(-35, b + sum(w.get(k, 0.0) for k in marks[i]))))) for i in docs}
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in queries.QUERIES["op2_toxicity"](spark, d).collect()}
    assert got.keys() == want.keys() and any(w.values())
    assert all(abs(got[i][0] - want[i]) < 1e-5 and got[i][1] == (got[i][0] >= 0.7) for i in want)
