"""URL filters: block and allow rules, and logistic regression on hashed character n-grams.

A rule is a host and a path start; it covers the host and its subdomains. Where several rules fit, the longest
decides. Other URLs are judged by a model over n-grams of host and path, hashed to `SLOTS` weights and
trained by full-batch gradient steps. Each step is one aggregation over the small labelled table; between
steps only the weights (bounded by `SLOTS`) are on the driver. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 4096
GRAMS = (3, 4)
STEPS, RATE, MOMENTUM, RIDGE = 40, 4.0, 0.9, 1e-4
THRESHOLD = 0.5  # block from this probability on

# The rules of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Labelled URLs, written by hand: 1 block, 0 allow.
LABELLED = (
    ("http://spam-farm.example.org/en/728", 1), ("https://www.spam-links.example.com/fr/12", 1),
    ("http://seo-spam.example.com/es/5", 1), ("https://m.link-farm.example.org/en/77.html", 1),
    ("http://cheap-pills.example.com/en/450", 1), ("https://www.buy-pills.example.org/de/9", 1),
    ("http://cheap-watches.example.com/en/31?ref=x", 1), ("https://pills-online.example.com/en/660/", 1),
    ("https://casino-win.example.org/en/14", 1), ("http://www.best-casino.example.com/es/81#top", 1),
    ("http://win-jackpot.example.com/en/204", 1), ("https://blog.casino-slots.example.org/de/6", 1),
    ("http://m.free-bets.example.com/de/963", 1), ("https://sport-bets.example.org/en/18.html", 1),
    ("http://www.free-money.example.com/fr/40", 1), ("https://free-prizes.example.com/en/3/", 1),
    ("https://ads-track.example.org/en/584", 1), ("http://click-ads.example.com/en/7?utm_source=feed", 1),
    ("http://blog.track-pixel.example.com/de/55", 1), ("https://ads-popup.example.org/fr/901", 1),
    ("http://adult-x.example.com/en/66", 1), ("https://www.adult-cams.example.org/en/8", 1),
    ("http://xxx-adult.example.com/es/120.html", 1), ("https://m.x-videos.example.com/en/2", 1),
    ("http://payday-loans.example.com/en/47", 1), ("https://www.warez-crack.example.org/en/90", 1),
    ("http://ththre.example.com/fr/825?page=2", 0), ("https://thther.example.org/en/685", 0),
    ("http://therha.example.com/en/676", 0), ("https://blog.tiontion.example.com/en/853/", 0),
    ("https://m.therou.example.com/en/474.html", 0), ("https://ththin.example.com/en/671", 0),
    ("https://www.ththen.example.com/en/148.html", 0), ("https://blog.thertion.example.org/es/978", 0),
    ("http://ththed.example.org/en/453#top", 0), ("https://blog.ththly.example.org/en/777", 0),
    ("http://www.therti.example.org/en/654", 0), ("http://blog.theres.example.com/es/575", 0),
    ("http://thering.example.com/en/328/", 0), ("https://ththnt.example.com/de/252.html", 0),
    ("http://www.therer.example.com/fr/144.html", 0), ("https://news.example.org/en/2024", 0),
    ("https://www.library.example.com/en/10", 0), ("http://garden-notes.example.org/en/88", 0),
    ("https://blog.kitchen.example.com/de/31", 0), ("http://m.history-today.example.org/fr/7", 0),
    ("https://city-council.example.com/es/409", 0), ("http://open-source.example.org/en/512.html", 0),
    ("https://www.physics.example.com/en/33?ref=x", 0), ("http://music-school.example.org/de/61/", 0),
    ("https://tionble.example.com/en/5", 0), ("http://ththhe.example.com/fr/19#top", 0),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for text without ``://``."""
    known = F.coalesce(url.cast("string"), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return (F.translate(F.regexp_extract(known, parts, 1), UPPER, LOWER), F.regexp_extract(known, parts, 2))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest fitting rule as ``struct<size, rule, verdict>``, or null."""
    best = F.array_max(F.array_compact(F.array(*[
        F.when(
            ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start)),
            F.struct(F.lit(len(own + start)).alias("size"), F.lit(own + start).alias("rule"),
                     F.lit(verdict).alias("verdict")),
        ) for own, start, verdict in rules
    ])))
    return best


def grams_of(host: Column, path: Column) -> Column:
    """Slots of all n-grams of the host (with its ends marked) and of the path's form (digits as 0)."""
    form = F.regexp_replace(path, "[0-9]+", "0")
    return F.concat(*[_slots(mark, size, text)
                      for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", form))
                      for size in GRAMS])


def _slots(mark: str, size: int, text: Column) -> Column:
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    slots = F.transform(starts, lambda at: F.pmod(
        F.xxhash64(F.concat(F.lit(f"{mark}{size}:"), F.substring(text, at, F.lit(size)))), F.lit(SLOTS)).cast("int"))
    return F.coalesce(slots, F.array().cast("array<int>"))


def margin_of(grams: Column, weights: Column) -> Column:
    """Mean weight of the slots, scaled by the root of their number as their vector has length 1."""
    total = F.aggregate(grams, F.lit(0.0), lambda sum_, slot: sum_ + F.element_at(weights, slot + 1))
    return total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))


def labelled_table(spark: SparkSession, rows: tuple[tuple[str, int], ...] = LABELLED) -> DataFrame:
    """The labelled URLs as ``url, label`` in one partition."""
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*[
        F.struct(F.lit(url).alias("url"), F.lit(label).alias("label")) for url, label in rows
    ])))


def _constant(weights: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")


def train(labelled: DataFrame, steps: int = STEPS) -> list[float]:
    """Weights by gradient steps with momentum on the logistic loss; the last one is the intercept."""
    host, path = url_parts(F.col("url"))
    rows = labelled.where("label IS NOT NULL").select(
        grams_of(host, path).alias("grams"), F.col("label").cast("double").alias("label")).persist()
    count = rows.count()
    weights = [0.0] * (SLOTS + 1)
    speed = [0.0] * (SLOTS + 1)
    for _ in range(steps if count else 0):
        ahead = [w + MOMENTUM * v for w, v in zip(weights, speed)]
        margin = margin_of(F.col("grams"), _constant(ahead)) + ahead[SLOTS]
        error = (1 / (1 + F.exp(-margin)) - F.col("label"))
        pushed = rows.select(
            (error / F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double"))).alias("push"),
            error.alias("error"), "grams")
        slopes = pushed.select("push", "error", F.posexplode(
            F.concat(F.array(F.lit(SLOTS)), "grams")).alias("place", "slot"))
        slope = [RIDGE * w for w in ahead]
        for slot, total in slopes.groupBy("slot").agg(F.sum(
            F.when(F.col("place") == 0, F.col("error")).otherwise(F.col("push"))
        )).collect():  # at most SLOTS + 1 rows
            slope[slot] += total / count
        speed = [MOMENTUM * v - RATE * g for v, g in zip(speed, slope)]
        weights = [w + v for w, v in zip(weights, speed)]
    rows.unpersist()
    return [round(w, 6) for w in weights]


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``<id_col>, host, path, rule, verdict, probability`` for every row.

    Defined cases: a null URL, or one without ``://``, has empty host and path and gets the verdict of the
    model's intercept; equal URLs get equal verdicts; without labelled rows the model allows everything; an empty
    table gives an empty result; other columns are ignored.
    """
    weights = train(labelled)
    host, path = url_parts(F.col(url_col))
    margin = margin_of(grams_of(F.col("host"), F.col("path")), _constant(weights[:SLOTS])) + weights[SLOTS]
    trained = any(weights)
    probability = F.round(1 / (1 + F.exp(-margin)), 9) if trained else F.lit(0.0)
    return (
        pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
        .withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
        .withColumn("probability", probability)
        .select(id_col, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(
            F.col("fit.verdict"), F.when(F.col("probability") >= THRESHOLD, "block").otherwise("allow")
        ).alias("verdict"), "probability")
    )
