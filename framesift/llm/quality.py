"""Host-level quality rules: failures by domain, shrunk by an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, pick, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_LIMIT = 0.5
POS_BITS = 24


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _covered(places: Column) -> Column:
    """Words covered by three-word windows that start at the sorted places."""
    start = F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def _repeat_by_hash(w: Column) -> Column:
    """Words in windows seen twice or more; null where two unlike windows share a hash.

    Each window becomes one long, its hash above its place, so one primitive sort brings
    equal windows together; neighbours are compared word for word.
    """
    low = (1 << POS_BITS) - 1
    key = lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))
    keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), key))
    same = lambda x, y: F.shiftright(x, POS_BITS) == F.shiftright(y, POS_BITS)
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")

    def count(k: Column) -> Column:
        near = lambda x, y: F.coalesce(same(x, y), F.lit(False))
        hit = F.filter(k, lambda x, j: near(x, F.get(k, j - 1)) | near(x, F.get(k, j + 1)))

        def checked(h: Column) -> Column:
            unlike = lambda x, y: F.coalesce(same(x, y), F.lit(False)) & (
                (w[place(x)] != w[place(y)]) | (w[place(x) + 1] != w[place(y) + 1]) | (w[place(x) + 2] != w[place(y) + 2]))
            bad = F.exists(F.filter(h, lambda x, j: unlike(x, F.get(h, j + 1))), lambda x: F.lit(True))
            return F.when(~bad, _covered(F.sort_array(F.transform(h, lambda x: x.bitwiseAND(F.lit(low))))))

        return let(hit, checked)

    return let(keys, count)


def _repeat_by_text(w: Column) -> Column:
    """The same count from a sort of the windows themselves; slower, never undecided."""
    win = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                      lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("s"), i.cast("long").alias("i")))
    near = lambda x, y: F.coalesce(x["s"] == y["s"], F.lit(False))

    def count(k: Column) -> Column:
        hit = F.filter(k, lambda x, j: near(x, F.get(k, j - 1)) | near(x, F.get(k, j + 1)))
        return _covered(F.sort_array(F.transform(hit, lambda x: x["i"])))

    return let(F.array_sort(win), count)


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of each whole text. A null text has no words."""

    def stats(w: Column, text: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        repeat = F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(F.coalesce(
            F.when(F.size(w) < (1 << POS_BITS), _repeat_by_hash(w)), _repeat_by_text(w)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeat.alias("n_repeat_words"))

    text = F.coalesce(F.col("text"), F.lit(""))
    return pick(docs, "doc_id", "source", "text").select(
        "doc_id", "source", let(text, lambda t: let(_words(t), lambda w: stats(w, t))).alias("s")).select("doc_id", "source", "s.*")


def host_rates(judged: DataFrame) -> DataFrame:
    """(source, n_docs, n_failed, rate): rate is the mean of the beta posterior.

    judged has source and base_failed. The prior's mean is the mean of all rows, and its strength, in documents, comes from how much more
    the hosts' rates scatter than draws of their sizes from one rate would (moments, hosts weighted by their rows): small hosts scatter by chance,
    which must not pass for a weak prior. No more scatter than chance makes the prior as strong as all rows; one host alone, or rates that are all
    0 or 1, make it count as one document. Rows without a source are no host.
    """
    hosts = judged.where("source is not null").groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    s = hosts.agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"), F.sum(n * n).alias("nn")).first()  # five numbers
    mean, strength = prior(s["k"], s["n"] or 0.0, s["f"] or 0.0, s["ff"] or 0.0, s["nn"] or 0.0)
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength)))


def prior(k: int, n: float, f: float, ff: float, nn: float) -> tuple[float, float]:
    """(mean, strength) from the hosts' number and the sums of n, f, f*f/n and n*n over them."""
    mean = f / n if n else 0.0
    spread = mean * (1 - mean)
    room = spread * (n - nn / n - (k - 1)) if n else 0.0
    if room <= 0:
        return mean, 1.0
    within = (ff - f * f / n - spread * (k - 1)) / room  # the correlation of two rows of one host: 1 / (strength + 1)
    return mean, n if within <= 0 else min(n, max(1.0, 1 / within - 1))


def judge(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document with its counts, base_failed and kept.

    The base rule fails a text of under 50 words or with over half its words in repeated
    windows. A host whose shrunk rate of failures is over ``limit`` is dropped with all its documents; a document
    without a source stands for itself. Null and empty texts have no words and fail. Repeated rows
    give repeated results. No rows give none.

    Counts are written once to the shared folder; hosts are aggregated with map-side sums, and the verdict
    join leaves to Spark whether the host table is small enough to send to all.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    each = written(text_stats(docs).withColumn("base_failed", base), "quality")
    bad = host_rates(each).where(F.col("rate") > limit).select("source", F.lit(True).alias("host_failed"))
    out = each.join(bad, "source", "left")
    failed = F.coalesce("host_failed", F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & ~failed).alias("kept"), failed.alias("host_failed"))


SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win),
cov AS (SELECT r, sum(least(3, i - coalesce(before, -9))) AS n_repeat
        FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM rep WHERE n > 1) GROUP BY r),
li AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
b AS (SELECT t.doc_id, t.source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
      FROM t JOIN w USING (r) JOIN li USING (r) LEFT JOIN cov USING (r)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::BIGINT) AS f FROM j WHERE source IS NOT NULL GROUP BY source),
g AS (SELECT count(*) AS k, sum(n::DOUBLE) AS n, sum(f::DOUBLE) AS f, sum(f::DOUBLE * f / n) AS ff, sum(n::DOUBLE * n) AS nn FROM h),
m AS (SELECT *, f / n AS mean, f / n * (1 - f / n) * (n - nn / n - (k - 1)) AS room, ff - f * f / n - f / n * (1 - f / n) * (k - 1) AS more FROM g),
p AS (SELECT mean, CASE WHEN room <= 0 THEN 1.0 WHEN more <= 0 THEN n ELSE least(n, greatest(1.0, room / more - 1)) END AS k FROM m),
bad AS (SELECT source FROM h, p WHERE (f + mean * k) / (n + k) > {HOST_LIMIT})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND source IS NULL OR NOT base_failed AND source NOT IN (SELECT source FROM bad) AS kept,
  source IS NOT NULL AND source IN (SELECT source FROM bad) AS host_failed
FROM j
"""
