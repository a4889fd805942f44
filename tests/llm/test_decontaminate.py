import hashlib
import random
import re

import pytest

from framesift.llm import decontaminate as dc, queries

RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id string, text string"


def words(t):
    return RE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out, windows = [], {}
    for item, t in items:
        w = words(t)
        if item is not None and w:
            for i in range(max(1, len(w) - 12)):
                windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_query_equals_sql(compare, sf):
    compare(queries.QUERIES["op7_decontaminate"], queries.ORACLES["op7_decontaminate"], sf)


@pytest.mark.parametrize("shard", [1 << 25, 400])
def test_planted_windows(spark, docs_of, shard):
    r = random.Random(6)
    word = lambda: r.choice(["Alpha", "beta", "Γamma", "d1", "é", "42", "x"])
    items = [(f"i{k}", " ".join(word() for _ in range(r.choice([1, 3, 12, 13, 14, 40])))) for k in range(30)] + [("none", "?! -"), (None, "lost item"), ("null", None), ("i0", "again another text")]
    docs = []
    for d in range(80):
        parts = [word() for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):
            p = r.randrange(len(parts) + 1)
            parts[p:p] = (r.choice(items)[1] or "").split()
        docs.append((d, r.choice([" ", ", ", "\n", " -- "]).join(parts)))
    docs += [(3, docs[3][1]), (None, docs[4][1]), (900, None), (901, "")]
    assert got(dc.scan(docs_of(docs), spark.createDataFrame(items, ITEMS), shard_bytes=shard)) == brute(docs, items)


def test_spans_are_offsets_of_the_original(spark, docs_of):
    t = "Ünï — start!  The QUICK, brown fox;\n jumps over the end 🙂"
    out = dc.scan(docs_of([(1, t)]), spark.createDataFrame([("a", "the quick brown fox jumps")], ITEMS)).first()
    assert [t[s["start"] : s["end"]] for s in out["spans"]] == ["The QUICK, brown fox;\n jumps"] and out["items"] == ["a"]


def test_odd_empty_and_clashing(spark, docs_of, odd):
    rows, items = list(enumerate(odd)), [("w", "word"), ("x", "日本語")]
    assert got(dc.scan(docs_of(rows), spark.createDataFrame(items, ITEMS))) == brute(rows, items)
    none = spark.createDataFrame([], ITEMS)
    assert got(dc.scan(docs_of(rows), none)) == brute(rows, [])
    assert dc.scan(docs_of([]), none).count() == 0 and dc.drop_contaminated(docs_of(rows), none).count() == len(rows)
    clash = spark.createDataFrame([(1, "a word", "z", 4)], "doc_id long, text string, item_id string, contaminated long")
    both = spark.createDataFrame([("w", "word", "e")], "item_id string, text string, TEXT2 string")
    assert dc.scan(clash, both).first()["contaminated"] is True
    assert dc.drop_contaminated(clash, both).columns == clash.columns and dc.drop_contaminated(clash, both).count() == 0
    same = spark.createDataFrame([(1, "a word", 1, 2, 3, 4, 5)], "doc_id long, text string, _n int, _hit int, _items int, Found int, _found int")
    assert dc.drop_contaminated(same, none).collect() == same.collect() and dc.drop_contaminated(same, both).count() == 0


def test_whole_windows_count_in_long_texts(spark, docs_of):
    item = " ".join(f"q{i}" for i in range(20))
    pad = " ".join(f"p{i}" for i in range(2000))
    rows = [(1, f"{pad} {' '.join(item.split()[4:17])} {pad}"), (2, f"{pad} {' '.join(item.split()[4:16])} {pad}"), (3, f"{pad} yes {pad}"), (4, "yes"), (5, None), (None, pad), (7, item)]
    items = spark.createDataFrame([("a", item), ("b", "Yes")], ITEMS)
    for shard in (1 << 20, 30):
        assert sorted(str(r["doc_id"]) for r in dc.drop_contaminated(docs_of(rows), items, shard_bytes=shard).collect()) == ["2", "3", "5", "None"]
