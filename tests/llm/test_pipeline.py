"""Every stage against a brute-force version of itself, on the rows it was given."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from framesift.llm import toxicity
from framesift.llm.common import table

from . import test_decontaminate as dc, test_similar as si, test_suffix_dedup as sd


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    out, docs = {}, table(spark, sf, "documents")
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        f(spark, docs, sf).write.parquet(path)
        out[name] = (docs, docs := spark.read.parquet(path))
    return out


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_columns_stay(steps, spark, sf):
    cols = table(spark, sf, "documents").columns
    assert all(out.columns == cols for _, out in list(steps.values())[:-1])


def test_toxicity(steps, spark, sf):
    docs, out = steps["toxicity"]
    score = {r["doc_id"]: r["score"] for r in toxicity.judge(docs, table(spark, sf, "labels")).collect()}
    assert rows(out) == [r for r in rows(docs) if score[r[0]] < 0.7] and 0 < out.count() < docs.count()


def test_simhash(steps):
    docs, out = steps["simhash"]
    given = rows(docs)
    keep = set(si.kept(given))
    assert rows(out) == [r for r in given if r[0] in keep] and 0 < out.count() < docs.count()


def test_suffix_array(steps):
    docs, out = steps["suffix_array"]
    spans, want = sd.brute([(d, t or "") for d, t in rows(docs)]), []
    for d, t in rows(docs):
        raw, at, kept = (t or "").encode(), 0, ""
        for s, e in spans[d, t or ""]:
            kept, at = kept + raw[at:s].decode("utf-8", "ignore"), e
        want.append((d, kept + raw[at:].decode("utf-8", "ignore")))
    assert rows(out) == want and want != rows(docs)


def test_decontaminate(steps, spark, sf):
    docs, out = steps["decontaminate"]
    # no item of this table is shorter than a window, so a text goes if it has any thirteen words of one in a row
    items = [dc.words(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    assert min(map(len, items)) >= 13
    grams = {tuple(w[i : i + 13]) for w in items for i in range(len(w) - 12)}
    clean = [(d, t) for d, t in rows(docs) if grams.isdisjoint(zip(*(dc.words(t)[i:] for i in range(13))))]
    assert rows(out) == clean and 0 < len(clean) < docs.count()


def test_bpe_and_run(steps, spark, sf):
    docs, out = steps["bpe"]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, text in rows(docs):
        ids = library.encode_ordinary(text or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in out.collect()) == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_odd_rows_pass_all_stages(spark, odd, tmp_path):
    """Null ids and texts, repeats, empty and very long texts, and columns that might clash with the operators' own."""
    good = " ".join(f"word{i}" for i in range(60))
    rows = [*((i, t) for i, t in enumerate(odd)), (None, good), (None, None), (None, "a text of its own, with some words"), (7, odd[7]), (7, odd[7]), (50, good), (51, good + " more"), (52, "other " + good[:200])]
    names = ["doc", "part", "of_doc", "spans", "found", "_found", "_i", "_no", "_h", "score", "fp", "keys", "Node"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    spark.createDataFrame([(d, t, None, *range(len(names))) for d, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(50, 0, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("a", "the quick brown fox"), (None, None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        if name == "bpe":
            assert out.count() == docs.count() and {r["n_tokens"] for r in out.collect()} >= {0}
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() >= 8 and [r["text"] for r in docs.where("doc_id is null").collect()] == ["a text of its own, with some words"] and corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_empty_tables_pass_all_stages(spark, sf, tmp_path):
    for n in ("documents", "labels", "benchmark"):
        table(spark, sf, n).limit(0).write.parquet(str(tmp_path / f"{n}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
