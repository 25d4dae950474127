"""URL filter: rules by host and path first, and for the rest a logistic regression on hashed character n-grams.

The regression is fitted on a small table of labelled URLs. Its features are the distinct n-grams of `^host$path`, hashed into a
fixed number of buckets and scaled to unit length, so neither the model nor a row grows with the number of pages.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
PENALTY = 1e-4
ROUNDS = 200

# The rules of the registered query, in the order given. (verdict, host, start of the path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Invented sites, labelled by hand: what a filter for training text keeps out, and ordinary ones.
BLOCKED = """
royal-casino casino-bonus casino-play lucky-slots online-poker poker-room sports-bets best-betting bet-now freebet free-spins
big-jackpot win-roulette win-money buy-pills online-pills diet-pills cheap-meds cheap-viagra discount-pharmacy generic-meds
adult-video adult-chat free-adult xxx-tube x-rated sex-chat sex-cams hot-escorts porn-pics hot-singles banner-ads click-ads
ads-server ad-tracker pop-ads tracking-pixel click-track track-stats spam-links spam-site link-farm content-farm seo-spam
free-backlinks buy-links keygen-crack free-warez cracked-apps free-torrents payday-loans easy-cash fast-loans get-rich
crypto-doubler replica-watches fake-bags cheap-replica free-prize free-giftcards verify-login paypa1-login weight-loss
miracle-cure buy-followers cheap-followers free-ringtones cheap-tickets-win
"""
ALLOWED = """
daily-herald citynews encyclopedia university library museum python-guide gardening recipes weather-report health-advice
history-society railway school-lessons maps-hiking science-journal woodworking translation travel-notes orchestra poetry
townhall developer open-data bookshop birdwatching astronomy film-reviews parliament hospital football-club cooking
linguistics philosophy theatre farmers-market software-manual chess-club mathematics botanic-garden photography
nature-reserve radio-stories archive economics engineering music-theory needlework ethics island-ferry weaving
stamp-collecting stationery swimming-baths record-office lighthouse handwriting windmills debating-society town-library
"""
#: Pages of one ordinary site, by what they are about.
BLOCKED_PATHS = "/casino/bonus /buy/cheap-pills /adult/videos /free-bets/today /poker/play /ads/click /spam/links /xxx/watch /payday-loans/apply /win/jackpot"
ALLOWED_PATHS = "/history/letters /garden/spring-herbs /theatre/autumn /weather/today /music/lesson /science/stars /letters/editor /books/fiction /school/timetable /walks/coast"
#: Both classes get these in turn, so that they tell nothing.
SUBDOMAINS = ["", "www.", "blog.", "m."]
PLACES = ["/", "/en/12", "/de/8.html", "/fr/25", "/es/7/", "/news/2021", "/index.html"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The hand-labelled table as (url, label): 1 what is to be kept out."""
    rows = []
    for sites, paths, label in ((BLOCKED, BLOCKED_PATHS, 1), (ALLOWED, ALLOWED_PATHS, 0)):
        rows += [(f"https://{SUBDOMAINS[i % 4]}{site}.test{PLACES[i % 7]}", label) for i, site in enumerate(sites.split())]
        rows += [(f"https://{SUBDOMAINS[i % 4]}portal.test{path}", label) for i, path in enumerate(paths.split())]
    return spark.createDataFrame(rows, "url string, label int").coalesce(1)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return lowered(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does. A rule fits its host and all subdomains if the path starts with
    its own. Length counts host and path; of equally long ones that fit, the one with the longer path. Rules are a list in the
    program's hands: each is a comparison for each row."""
    ruled, told = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[2]))):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        ruled, told = F.when(fits, of + start).otherwise(ruled), F.when(fits, verdict).otherwise(told)
    return ruled, told


def featured(pages: DataFrame, host: Column, path: Column, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """`pages` with the column `__features`: hashed distinct n-grams of `^host$path`, at unit length, empty ones all zeros. Numbers in paths are
    all the same number to it: they tell pages of a site apart, not sites."""
    signs = F.split(F.concat(F.lit("^"), host, F.lit("$"), F.regexp_replace(lowered(path), "[0-9]+", "0")), "")
    found = pages.withColumn("__signs", F.when((host == "") & (path == ""), F.array().cast("array<string>")).otherwise(signs))
    for n in orders:
        found = NGram(n=n, inputCol="__signs", outputCol=f"__{n}").transform(found)
    found = found.withColumn("__grams", F.concat(*[f"__{n}" for n in orders])).drop("__signs", *[f"__{n}" for n in orders])
    found = HashingTF(numFeatures=buckets, binary=True, inputCol="__grams", outputCol="__counts").transform(found)
    return Normalizer(inputCol="__counts", outputCol="__features").transform(found).drop("__grams", "__counts")


def learn(labelled: DataFrame, url_col: str = "url", label_col: str = "label", penalty: float = PENALTY, rounds: int = ROUNDS, buckets: int = BUCKETS) -> LogisticRegressionModel | None:
    """The regression of `labelled` (url, label 0 or 1), both classes with the same weight in all. Rows of other labels and of null
    urls are left out. None without rows of both."""
    rows = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0) & F.col("url").isNotNull())
    of = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(of) < 2:
        return None
    weight = F.when(F.col("label") == 1, 0.5 / of[1.0]).otherwise(0.5 / of[0.0])
    ready = featured(rows, url_host(F.col("url")), url_path(F.col("url")), buckets=buckets).select("label", "__features", weight.alias("__weight"))
    fitted = LogisticRegression(featuresCol="__features", labelCol="label", weightCol="__weight", regParam=penalty, maxIter=rounds, standardization=False)
    return fitted.fit(ready)


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", buckets: int = BUCKETS) -> DataFrame:
    """Every row of `pages` as (page_id, host, path, rule, verdict, score).

    `rule` is the longest one that fits, host and path joined, else null; `verdict` is its own, else `block` where the
    regression's `score`, the probability of label 1, is 0.5 or more, else `allow`. A null url or one without `://` has an empty
    host and path: no rule fits, and the score is the intercept's. Rules hold whatever the score. If `labelled` lacks a
    class, nothing is learned: scores are null and what no rule decides is allowed. Ids may be null or repeat; rows stand alone, other columns
    are left behind, an empty table gives no rows.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    ruled, told = first_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": ruled, "__told": told})
    model = learn(labelled, buckets=buckets)
    if model is None:
        scored = parts.withColumn("score", F.lit(None).cast("double"))
    else:
        model.setFeaturesCol("__features").setProbabilityCol("__p").setPredictionCol("").setRawPredictionCol("")
        scored = model.transform(featured(parts, F.col("host"), F.col("path"), buckets=buckets)).withColumn("score", vector_to_array("__p")[1])
    verdict = F.coalesce("__told", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
