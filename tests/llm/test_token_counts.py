import random

import public_tokenizers
import pytest
import sentencepiece

from framesift.llm import queries, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_query_equals_library(spark, sf, texts, library):
    want = sorted((d, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for d, t in texts)
    got = sorted(tuple(r) for r in queries.QUERIES["op6_token_counts"](spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    assert got == want


def test_odd_texts(docs_of, odd, library):
    rows = list(enumerate(odd)) + [(0, None), (None, "null id"), (4, "a")]
    out = {(r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs_of(rows), MODEL).collect()}
    assert out == {(d, len(library.encode(t or ""))) for d, t in rows}


def test_random_texts_in_tiny_chunks(library):
    r, t = random.Random(3), token_counts.compiled(MODEL)
    alphabet = ["a", "the", " ", "  ", "   ", "\n", "é", "🙂", "1", ".", "ing", "\t", "▁", "ll", "st", "e", "　", "ff", "Ω", "\x00"]
    for _ in range(1500):
        s = "".join(r.choices(alphabet, k=r.randrange(60)))
        n = len(library.encode(s))
        assert t.count(s) == n, repr(s)
        assert t.count(s, chunk=r.randrange(1, 9)) == n, repr(s)


def test_one_long_word(library):
    r, t = random.Random(4), token_counts.compiled(MODEL)
    for s in ["".join(r.choices("abcdeilnorst", k=5000)), "=" * 3000, "日本語" * 500, " " * 2000, "a" * 4001]:
        assert t.count(s) == len(library.encode(s))
        assert t.count(s, chunk=97) == len(library.encode(s))


def test_empty_and_clashing_names(spark, docs_of):
    assert token_counts.count_tokens(docs_of([]), MODEL).count() == 0
    df = spark.createDataFrame([(1, "hello", 5)], "doc_id long, text string, n_tokens long")
    assert token_counts.count_tokens(df, MODEL).count() == 1
