import hashlib
import random

import numpy as np
import pytest

from framesift.llm import queries, suffix_dedup as sd


def brute(rows, width=100):
    """{(doc, text): removed spans}: a byte goes if a string over it starts earlier."""
    seen, out = set(), {}
    for d, t in sorted(set(rows)):
        raw, spans = t.encode(), []
        mine = []
        for i in range(len(raw) - width + 1):
            s = raw[i : i + width]
            if s in seen:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + width
                else:
                    spans.append([i, i + width])
            seen.add(s)
            mine.append(s)
        out[d, t] = [tuple(x) for x in spans]
    return out


def digest_rows(rows, width=100):
    b, out = brute([(d, t or "") for d, t in rows], width), []
    for d, t in rows:
        raw, at, kept = (t or "").encode(), 0, b""
        for s, e in b[d, t or ""]:
            kept += raw[at:s]
            at = e
        kept += raw[at:]
        out.append((d, len(raw), len(raw) - len(kept), len(b[d, t or ""]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_query_equals_brute_force(spark, sf, texts):
    assert got(queries.QUERIES["op4_suffix_dedup"](spark, sf)) == digest_rows(texts)


def planted(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(r.randrange(15, 60))) for _ in range(6)] + ["ab" * 150, "x" * 400, "é" * 90]
    rows = []
    for d in range(n):
        parts = [" ".join(word() for _ in range(r.randrange(0, 40))) for _ in range(r.randrange(1, 4))]
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            parts.insert(r.randrange(len(parts) + 1), p[r.randrange(0, 30) : len(p) - r.randrange(0, 30)])
        rows.append((d, "".join(parts)))
    return rows + [(n + i, rows[i][1]) for i in range(10)]


@pytest.mark.parametrize("hot,size", [(20_000, 20_000), (2, 20_000), (20_000, 7), (1, 3)])
def test_planted_passages(docs_of, hot, size):
    rows = planted(hot + size)
    assert got(sd.dedup(docs_of(rows), hot=hot, size=size)) == digest_rows(rows)


@pytest.mark.parametrize("width", [24, 30, 127])
def test_other_widths(docs_of, width):
    rows = planted(width, 40)
    assert got(sd.dedup(docs_of(rows), width=width)) == digest_rows(rows, width)


def test_collection_is_the_transform():
    r = random.Random(5)
    strings = [bytes(r.choices(b"ab", k=r.randrange(1, 40))) for _ in range(60)]
    bwt, lcp, owner, length = sd.collection([np.frombuffer(s, np.uint8).astype(np.uint16) + np.uint16(1) for s in strings])
    rows = sorted(((strings[i][len(strings[i]) - n :], i, n) for i in range(60) for n in range(len(strings[i]) + 1)), key=lambda x: (x[0], x[1]))
    assert [(int(o), int(n)) for o, n in zip(owner, length)] == [(i, n) for _, i, n in rows]
    assert [int(b) for b in bwt] == [strings[i][-n - 1] + 1 if n < len(strings[i]) else 0 for _, i, n in rows]
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert [int(x) for x in lcp[1:]] == [common(a[0], b[0]) for a, b in zip(rows, rows[1:])]


def test_odd_texts_nulls_ties_and_repeats(docs_of, odd):
    rows = list(enumerate(odd)) + [(100 + i, t) for i, t in enumerate(odd)]
    assert got(sd.dedup(docs_of(rows))) == digest_rows(rows)
    long = "".join(random.Random(9).choices("abcdefghij ", k=300))
    out = sd.dedup(docs_of([(1, long), (1, long), (None, long)]))
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out.collect()) == [(0, 300), (1, 0), (1, 0)]


def test_cleaned_keeps_columns_and_whole_characters(docs_of):
    long = "é" * 10 + "".join(random.Random(8).choices("abcdefghij", k=200))
    out = {r["doc_id"]: r for r in sd.cleaned(docs_of([(1, long), (2, "start " + long + " end"), (3, None), (4, "")])).collect()}
    assert out[1]["text"] == long and out[2]["text"] == "start  end" and out[2]["n_chars"] == 10
    assert out[3]["text"] is None and out[4]["text"] == "" and out[2].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_empty_and_clashing_names(spark, docs_of):
    assert sd.dedup(docs_of([])).count() == 0 and sd.cleaned(docs_of([])).count() == 0
    df = spark.createDataFrame([(1, "q" * 300, 5, 6, 7)], "doc_id long, text string, doc long, part long, a long")
    assert got(sd.dedup(df)) == digest_rows([(1, "q" * 300)])
    assert sd.cleaned(df).columns == df.columns and sd.cleaned(df).count() == 1


def test_runs_share_a_gram_where_windows_are_equal():
    r = np.random.default_rng(0)
    t = bytes(r.integers(97, 100, 5000, np.uint8))
    of = {}
    text, a, b, h, _ = sd.runs([t, t[1000:2000]])
    for k, x, y, g in zip(text, a, b, h):
        for i in range(x, y + 1):
            of.setdefault((t if k == 0 else t[1000:2000])[i : i + 100], set()).add(int(g))
    assert all(len(g) == 1 for g in of.values()) and len(of) == 4901


def test_splits_keep_equal_windows_together():
    r = np.random.default_rng(3)
    for kinds in ("abcdefgh", "ab"):
        t = "".join(r.choice(list(kinds), 3000)).encode()
        texts = [t, t[500:1500] + t[:700], t[1200:]]
        of = {}
        text, a, b, h, _ = sd.runs(texts)
        for k, x, y, g in zip(text.tolist(), a.tolist(), b.tolist(), h.tolist()):
            run = texts[k][x : y + 100]
            got = sd._split(run, g, 100)
            assert [i + j for _, i, s in got for j in range(len(s) - 99)] == list(range(y - x + 1)) and all(run[i : i + len(s)] == s for _, i, s in got)
            for key, i, s in got:
                for j in range(len(s) - 99):
                    of.setdefault(s[j : j + 100], set()).add(key)
        assert all(len(keys) == 1 for keys in of.values())


def test_one_gram_with_many_contexts(docs_of):
    """A common phrase whose surroundings are now the same, now not: split by context, and the largest groups window by window."""
    r = random.Random(12)
    word = lambda n: "".join(r.choices("abcdefghijklmnop", k=n))
    phrase, left, right = "!" * 3 + "the phrase that all hold" + "?" * 3, [word(80) for _ in range(6)], [word(80) for _ in range(6)]
    rows = [(i, word(5) + r.choice(left)[r.randrange(0, 40) :] + phrase + r.choice(right)[: r.randrange(30, 80)] + word(r.randrange(0, 9))) for i in range(250)]
    want = digest_rows(rows)
    for hot in (100, 12, 3):
        assert got(sd.dedup(docs_of(rows), hot=hot, size=50)) == want


def test_query_equals_sql(compare, sf):
    compare(queries.QUERIES["op4_suffix_dedup"], queries.ORACLES["op4_suffix_dedup"], sf)
