import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from framesift.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(b):
    return hashlib.sha256(b).hexdigest()


def test_query_equals_library(spark, sf, texts, library):
    want = sorted((d, len(i := library.encode_ordinary(t or "")), digest(" ".join(map(str, i)).encode()), digest((t or "").encode())) for d, t in texts)
    got = sorted(tuple(r) for r in queries.QUERIES["op3_byte_bpe"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want


def test_odd_texts_and_round_trip(spark, docs_of, odd, library):
    rows = list(enumerate(odd)) + [(0, None), (4, "a"), (None, "null id")]
    out = bpe.encode(docs_of(rows), PATH, PATTERN, ids=True)
    got = {(r["doc_id"], tuple(r["ids"])) for r in out.collect()}
    assert got == {(d, tuple(library.encode_ordinary(t or ""))) for d, t in rows} and out.count() == len(rows)
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(out, PATH, PATTERN).collect()}
    assert back == {(d, t or "") for d, t in rows}


@pytest.mark.parametrize("leaf,piece,window", [(8, 4, 1), (16, 8, 2), (64, 16, 4)])
def test_tree_with_tiny_leaves(library, leaf, piece, window):
    r = random.Random(leaf)
    t = bpe.TreeBpe(library._mergeable_ranks, PATTERN, leaf, piece, window)
    alphabet = ["a", "the", " ", "  ", "\n", "'s", "é", "🙂", "1", ".", "\r", "ing", "\t", " ", "\x1c", " ", "\x85"]
    for _ in range(400):
        s = "".join(r.choices(alphabet, k=r.randrange(120)))
        assert t.encode(s) == library.encode_ordinary(s)
        assert t.decode(t.encode(s)) == s.encode()


def test_long_matches_are_halved(library):
    r = random.Random(1)
    t = bpe.TreeBpe(library._mergeable_ranks, PATTERN, leaf=64, piece=16)
    for s in ["".join(r.choices("abehilnoprst", k=3000)), "=" * 999 + "-" * 500, "ab" * 2000, "\n" * 700 + "x", "日本" * 400]:
        assert t.encode(s) == library.encode_ordinary(s)


def test_empty_and_clashing_names(spark, docs_of):
    assert bpe.encode(docs_of([]), PATH, PATTERN).count() == 0
    df = spark.createDataFrame([(1, "hello", 5, "x")], "doc_id long, text string, n_tokens long, TEXT string")
    assert [r["n_tokens"] for r in bpe.encode(df, PATH, PATTERN).collect()] == [1]
