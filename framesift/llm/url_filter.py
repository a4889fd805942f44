"""URL filters: allow and block rules first, then logistic regression on hashed n-grams.

Everything runs in DataFrame expressions. Training is full-batch gradient descent on a small
labelled table, in its dual form: one row holds the matrix of shared n-grams, a fold
over the epochs moves one coefficient per labelled URL, and the weights are read off at
the end, rounded to integers so that a score is an exact sum in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import pick

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BUCKETS = 8192
GRAM = 4
EPOCHS = 60
RATE = 0.02
DECAY = 0.01
SCALE = 10000

#: The most labelled URLs that training takes: the fold's cost is their square.
MOST = 512
#: The labelled URLs (1: block), written for this: none is of a table that is judged.
TRAINING = tuple([(f"http://{h}", 1) for h in (
    "lucky-casino.example/bonus/spins", "www.casino-jackpot.example/slots/play", "royal-poker.example/texas/bonus", "poker-room.example/free-chips", "sportsbet-odds.example/bet/now", "bet-bonus.example/betting/live",
    "pharma-pills.example/buy/viagra", "discount-viagra.example/cheap/pills", "no-prescription.example/pills/cialis", "cheap-cialis.example/order/online", "weight-loss-pills.example/buy-now", "replica-watches.example/cheap/luxury",
    "xxx-videos.example/adult/free", "adult-cams.example/xxx/live", "free-porn.example/tube/xxx", "hot-escorts.example/adult/girls", "payday-loans.example/cash/fast", "instant-loan.example/payday/approved",
    "win-prize.example/claim/winner", "free-gift-cards.example/claim/prize", "earn-money-fast.example/work/home", "crypto-doubler.example/invest/bonus", "ads.banner-server.example/click/track", "adserver.example/banner/popup",
    "click-tracker.example/redirect/ads", "cracked-software.example/keygen/warez", "warez-torrents.example/crack/serial", "link-farm.example/spam/links", "seo-backlinks.example/buy/links", "spam-mailer.example/bulk/email",
)] + [(f"http://{h}", 0) for h in (
    "city-library.example/catalogue/books", "www.state-university.example/faculty/physics", "daily-news.example/world/article/2019", "national-museum.example/exhibitions/history", "garden-society.example/plants/roses", "kitchen-recipes.example/soup/tomato",
    "weather-service.example/forecast/today", "science-journal.example/volume/12/paper", "history-archive.example/documents/letters", "town-council.example/meetings/minutes", "school-district.example/calendar/term", "health-clinic.example/advice/children",
    "music-school.example/lessons/piano", "travel-guide.example/cities/museums", "football-club.example/fixtures/results", "open-maps.example/data/rivers", "programming-notes.example/python/tutorial", "docs.software-project.example/manual/install",
    "wiki.local-history.example/village/church", "blog.photographer.example/landscapes/spring", "economics-review.example/essays/trade", "film-festival.example/programme/directors", "animal-shelter.example/adopt/dogs", "astronomy-club.example/observations/moon",
    "language-institute.example/courses/french", "public-radio.example/podcasts/interviews", "cycling-routes.example/coast/map", "bookshop.example/authors/novels", "research-institute.example/publications/climate", "parish-news.example/events/concert",
)])


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty where url is null or has no ``://``."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`_u`"))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column, size: int = GRAM, buckets: int = BUCKETS) -> Column:
    """The distinct hashed n-grams of ^host$ and of path, each kind with its own offset; int array."""

    def hashed(s: Column, salt: int) -> Column:
        codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))

        def of(c: Column) -> Column:
            value = lambda i: sum((F.get(c, i + k) * 31 ** (size - 1 - k) for k in range(1, size)), F.get(c, i) * 31 ** (size - 1))
            return F.when(F.size(c) >= size, F.transform(F.sequence(F.lit(0), F.size(c) - size), lambda i: (value(i).cast("long") + salt) % buckets)).otherwise(F.array().cast("array<bigint>"))

        return F.element_at(F.transform(F.array(codes), of), 1)

    return F.array_distinct(F.concat(hashed(F.concat(F.lit("^"), host, F.lit("$")), 0), hashed(path, 17)))


def _parsed(df: DataFrame) -> DataFrame:
    host, path = host_path(F.col("_u"))
    return df.withColumn("host", host).withColumn("path", path)


def train(spark: SparkSession, labelled: DataFrame | None = None, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> dict[int, int]:
    """Weights by bucket, as integers of 1/SCALE; bucket -1 is the intercept.

    labelled has url and label (0/1) and is small by contract: what returns to the driver is bounded
    by its n-grams; more than ``MOST`` rows raise. A null label or a repeated (url, label) row is left out.
    """
    if labelled is None:
        labelled = spark.createDataFrame(list(TRAINING), "url string, label int")
    elif (n := labelled.limit(MOST + 1).count()) > MOST:
        raise ValueError(f"more than {MOST} labelled URLs: {n} or more")
    rows = _parsed(pick(labelled, "url", "label").where("label is not null").distinct().withColumnRenamed("url", "_u"))
    one = rows.select(F.struct("_u", F.col("label").cast("double").alias("y"), grams(F.col("host"), F.col("path")).alias("f")).alias("x"))
    one = one.coalesce(1).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    one = one.select("xs", F.transform("xs", lambda a: F.transform("xs", lambda b: (F.size(F.array_intersect(a["f"], b["f"])) + 1).cast("double"))).alias("k"))
    dot = lambda row, a: F.aggregate(F.zip_with(row, a, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    step = lambda a, _: F.transform("k", lambda row, i: F.get(a, i) * (1 - rate * decay) + rate * (F.get(F.col("xs"), i)["y"] - 1 / (1 + F.exp(-dot(row, a)))))
    start = F.transform("xs", lambda _: F.lit(0.0))
    fit = one.select("xs", F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), start, step).alias("alpha"))
    each = fit.select(F.posexplode("xs").alias("i", "x"), "alpha").select("i", F.get("alpha", F.col("i")).alias("a"), F.explode(F.concat(F.array(F.lit(-1).cast("long")), F.col("x.f"))).alias("d"))
    weights = each.groupBy("d").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("i", "a"))), F.lit(0.0), lambda s, x: s + x["a"]).alias("w"))
    return {r["d"]: r["w"] for r in weights.select("d", F.round(F.col("w") * SCALE).cast("long").alias("w")).collect() if r["w"]}


def judge(pages: DataFrame, weights: dict[int, int], rules=RULES, buckets: int = BUCKETS) -> DataFrame:
    """page_id, host, path, rule, verdict and score for every row of pages.

    The longest rule (host and path together) that fits wins; equal lengths go to a block. Without one the
    model blocks where its score is over 0. Null, empty and malformed URLs have an empty host and path and
    are judged by the intercept; repeated rows are judged alike; no rows give none. Long URLs are judged whole.
    """
    df = _parsed(pick(pages, "page_id", "url").select("page_id", F.col("url").alias("_u")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    flat = ",".join(str(weights.get(i, 0)) for i in range(buckets))
    # a foldable literal: split once when the plan is made, then a constant array of fixed size
    w = F.split(F.lit(flat), ",").cast("array<bigint>")
    scored = df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_v"), F.aggregate(
        F.transform(grams(F.col("host"), F.col("path"), buckets=buckets), lambda d: F.get(w, d.cast("int"))), F.lit(weights.get(-1, 0)).cast("long"), lambda s, x: s + x).alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    return judge(pages, train(pages.sparkSession, labelled), rules)


def _sql() -> str:
    """The same training and scoring for DuckDB."""
    values = ", ".join(f"('{u}', {y})" for u, y in TRAINING)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    hp = f"{low.format(f'''regexp_extract({rest}, '^([^/?#]*)', 1)''')} AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"
    poly = " + ".join(f"c[i + {k}] * {31 ** (GRAM - 1 - k)}" for k in range(GRAM))
    hashed = lambda s, salt: f"(SELECT coalesce(list(({poly} + {salt}) % {BUCKETS}), []) FROM (SELECT list_transform(string_split({s}, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS c), unnest(range(1, len({s}) - {GRAM - 2})) AS u(i))"
    feats = f"list_sort(list_distinct(list_concat({hashed(chr(39) + '^' + chr(39) + ' || host || ' + chr(39) + '$' + chr(39), 0)}, {hashed('path', 17)})))"
    w = [f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))]
    rs = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    chain = lambda f, last: "".join(f"{a}{f(r)} ELSE " for a, r in zip(w, rs)) + last + " END" * len(rs)
    return f"""
WITH RECURSIVE tr AS MATERIALIZED (SELECT row_number() OVER (ORDER BY url, y) AS i, y, {feats} AS f
  FROM (SELECT url, CAST(y AS DOUBLE) AS y, {hp} FROM (VALUES {values}) v(url, y))),
k AS MATERIALIZED (SELECT a.i, a.y, list(CAST(len(list_intersect(a.f, b.f)) + 1 AS DOUBLE) ORDER BY b.i) AS ks FROM tr a, tr b GROUP BY a.i, a.y),
gd AS (SELECT 0 AS t, list(CAST(0 AS DOUBLE)) AS al FROM tr
  UNION ALL SELECT any_value(t) + 1, list(al[i] * (1 - {RATE} * {DECAY}) + {RATE} * (y - 1 / (1 + exp(-list_reduce(list_transform(list_zip(ks, al), lambda p: p[1] * p[2]), lambda s, q: s + q)))) ORDER BY i)
  FROM gd, k WHERE t < {EPOCHS} HAVING count(*) > 0),
wt AS MATERIALIZED (SELECT d, CAST(round(list_reduce(list(al[i] ORDER BY i), lambda s, q: s + q) * {SCALE}) AS BIGINT) AS w
  FROM (SELECT i, unnest(list_concat([CAST(-1 AS BIGINT)], f)) AS d FROM tr), (SELECT al FROM gd WHERE t = {EPOCHS}) GROUP BY d),
pg AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, {hp} FROM pages),
sc AS (SELECT r, sum(w) AS s FROM (SELECT r, unnest({feats}) AS d FROM pg) JOIN wt USING (d) GROUP BY r)
SELECT page_id, host, path, {chain(lambda r: f"'{r[1]}{r[2]}'", 'NULL')} AS rule,
  {chain(lambda r: f"'{r[0]}'", f"CASE WHEN coalesce(s, 0) + (SELECT w FROM wt WHERE d = -1) > 0 THEN 'block' ELSE 'allow' END")} AS verdict,
  CAST(coalesce(s, 0) + (SELECT w FROM wt WHERE d = -1) AS BIGINT) AS score
FROM pg LEFT JOIN sc USING (r)"""


SQL = _sql()
