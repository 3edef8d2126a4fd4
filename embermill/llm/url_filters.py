"""URL filters: host and path rules, then logistic regression on hashed character n-grams.  DataFrame functions only.

The model is trained from a small labelled table in the dual: with N labelled URLs, one array expression runs all gradient
steps on N coefficients over their N x N kernel, and the weights of the DIM buckets follow by one aggregation.  They are
the only thing that reaches the driver, and go into the scoring expression as one constant array; no row is joined,
exploded or shuffled to be scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets, lengths of n-grams, characters of a piece, gradient steps, step size and ridge penalty.
DIM, SIZES, PIECE, STEPS, RATE, RIDGE = 1 << 13, (3, 4, 5), 256, 600, 0.05, 0.002
#: Host, path and verdict of each rule.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The labelled URLs (1: block), written for this purpose; none of the hosts is one of the tables'.
LABELLED = (
    ("http://spam-barn.example.org/win-money-now", 1), ("https://www.spam-links.example.net/buy", 1), ("http://bargain-pills.example.com/order?ref=1", 1),
    ("https://blog.cheap-meds.example.org/viagra-sale", 1), ("http://online-casino.example.com/bonus/free-spins", 1), ("https://m.casino-royal.example.net/slots", 1),
    ("http://free-porn.example.org/videos/xxx", 1), ("https://adult-dating.example.com/hot-girls", 1), ("http://xxx-cams.example.net/live", 1),
    ("https://fast-loans.example.org/payday-loan", 1), ("http://get-rich-quick.example.com/crypto-profit", 1), ("https://poker-bets.example.net/bet/jackpot", 1),
    ("http://replica-watches.example.org/cheap-rolex", 1), ("https://www.seo-backlinks.example.com/buy-links", 1), ("http://click-bait.example.net/you-wont-believe", 1),
    ("https://torrent-warez.example.org/crack-keygen", 1), ("http://phishing-login.example.com/verify-account", 1), ("https://malware-download.example.net/free.exe", 1),
    ("http://weight-loss-pills.example.org/buy-cheap", 1), ("https://lottery-winner.example.com/claim-prize", 1), ("http://link-farm.example.net/spam", 1),
    ("https://escort-girls.example.org/sexy", 1), ("http://bitcoin-doubler.example.com/free-money", 1), ("https://essay-mill.example.net/cheap-essays", 1),
    ("http://pills.example.org/cheap/sale", 1), ("https://spam.example.com/promo/offer", 1), ("http://casino.example.net/win", 1), ("https://www.budget-pills.example.org/de/12", 1),
    ("http://spam-depot.example.net/fr/7?page=2", 1), ("https://m.spam-ring.example.com/en/33.html", 1),
    ("http://m.ad-tracker.example.com/fr/3310", 1), ("https://ads-banner.example.org/en/track", 1), ("http://free-bets.example.org/de/9021/", 1),
    ("https://www.sports-bets.example.com/en/17.html", 1), ("http://m.casino-games.example.com/fr/5120", 1), ("https://free-money.example.net/de/77#top", 1),
    ("https://www.university.example.org/research/papers", 0), ("http://blog.gardening.example.com/en/roses.html", 0), ("https://news.example.net/2024/05/economy", 0),
    ("https://docs.library.example.org/en/manual/", 0), ("http://museum.example.com/exhibitions?page=2", 0), ("https://en.encyclopedia.example.org/wiki/Physics", 0),
    ("http://cooking.example.net/recipes/bread.html", 0), ("https://www.weather.example.com/forecast/today", 0), ("http://m.sports.example.org/results#top", 0),
    ("https://science-journal.example.net/articles/118", 0), ("http://history.example.com/de/rome", 0), ("https://blog.astronomy.example.org/es/telescopes", 0),
    ("http://travel.example.net/fr/paris/?utm_source=feed", 0), ("https://school.example.com/classes/maths", 0), ("http://www.theatre.example.org/en/471", 0),
    ("https://books.example.net/en/853/", 0), ("http://harbour.example.com/en/676", 0), ("https://m.meadow.example.org/de/25#top", 0),
    ("http://www.lantern.example.net/es/118", 0), ("https://blog.orchard.example.com/fr/960", 0), ("http://riverside.example.org/en/204?ref=x", 0), ("https://cathedral.example.net/en/39.html", 0),
    ("http://www.northwind.example.com/en/22/", 0), ("https://mariner.example.org/de/701", 0), ("http://m.thistle.example.net/fr/88", 0), ("https://hospital.example.com/patients/info", 0),
    ("http://m.heather.example.com/fr/6071/", 0), ("https://www.observatory.example.net/de/5544", 0), ("http://m.pathway.example.net/en/9170.html", 0),
    ("https://www.station.example.net/fr/4402?page=2", 0), ("http://blog.nation.example.com/de/8125", 0), ("https://m.weather-house.example.net/de/3019", 0),
    ("http://www.reading.example.org/es/6250#top", 0), ("https://m.thunder.example.com/es/71", 0), ("http://www.leather.example.com/fr/953", 0),
    ("http://www.parliament.example.org/debates/12", 0), ("https://music.example.net/concerts/mozart", 0), ("http://blog.painting.example.com/en/oil", 0), ("https://code.example.org/python/tutorial", 0),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def buckets(host: Column, path: Column) -> Column:
    """The buckets of all n-grams of the bordered host and path; hosts' and paths' are hashed apart."""

    def grams(kind: str, text: Column, n: int) -> Column:
        bordered = F.concat(F.lit("^"), text, F.lit("$"))
        # characters are found by counting from the front: in pieces, so that a very long path is not gone through for each
        last = F.greatest(F.floor((F.length(bordered) - n) / PIECE), F.lit(0)).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), last), lambda p: F.substring(bordered, p * PIECE + 1, F.lit(PIECE + n - 1)))

        def hashes(piece: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.length(piece) - (n - 1), F.lit(1)))
            return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(piece, i, F.lit(n))), F.lit(DIM)).cast("int"))

        return F.flatten(F.transform(pieces, hashes))

    def of(kind: str, text: Column) -> list[Column]:
        return [grams(kind, text, n) for n in SIZES]

    return F.concat(*of("host", host), *of("path", path))


def labelled(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("label")) for u, y in LABELLED))
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def trained(urls: DataFrame) -> list[float]:
    """The DIM weights and, last, the bias, from a small table (url, label)."""
    host, path = host_and_path(F.col("url"))
    rows = urls.select("url", "label", buckets(host, path).alias("b")).groupBy("url").agg(F.max("label").alias("y"), F.first("b").alias("b"))
    grams = rows.select("url", "y", F.size("b").alias("n"), F.explode("b").alias("bucket")).groupBy("url", "y", "n", "bucket").agg((F.count("*") / F.sqrt("n")).alias("x"))
    kernel = grams.select(F.col("url").alias("i"), "bucket", F.col("x").alias("xi"), "y").join(grams.select(F.col("url").alias("j"), "bucket", F.col("x").alias("xj")), "bucket").groupBy("i", "j", "y").agg(F.sum(F.col("xi") * F.col("xj")).alias("k"))
    lines = kernel.groupBy("i", "y").agg(F.collect_list(F.struct("j", "k")).alias("line"))
    whole = lines.agg(F.array_sort(F.collect_list(F.struct("i", "y", F.array_sort("line").alias("line")))).alias("all"))
    # every two URLs share the border n-gram buckets of some length; a missing pair counts as zero
    ids = whole.select("all", F.col("all.i").alias("ids"), F.col("all.y").alias("y"))
    dense = ids.select("ids", "y", F.transform("all", lambda r: F.transform("ids", lambda j: F.coalesce(F.element_at(F.map_from_entries(r["line"]), j), F.lit(0.0)) + 1.0)).alias("k"))
    zero = F.transform("y", lambda _: F.lit(0.0))

    def step(a: Column, _: Column) -> Column:
        def margin(line: Column) -> Column:
            return F.aggregate(F.zip_with(line, a, lambda k, x: k * x), F.lit(0.0), lambda s, x: s + x)

        return F.zip_with(F.zip_with(a, F.col("y"), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.col("k"), lambda p, line: p["x"] * (1 - RATE * RIDGE) + RATE * (p["y"] - 1 / (1 + F.exp(-margin(line)))))

    alpha = dense.select(F.explode(F.arrays_zip(F.col("ids").alias("ids"), F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step).alias("a"))).alias("p")).select(F.col("p.ids").alias("url"), F.col("p.a").alias("a"))
    weights = grams.join(alpha, "url").groupBy("bucket").agg(F.sum(F.col("a") * F.col("x")).alias("w"))
    found = weights.unionByName(alpha.agg(F.lit(DIM).alias("bucket"), F.sum("a").alias("w"))).collect()  # DIM + 1 rows at most
    out = [0.0] * (DIM + 1)
    for r in found:
        out[r["bucket"]] = r["w"] or 0.0
    return out


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """The model's probability that a URL is to be blocked."""
    w = F.split(F.lit(",".join(f"{x:.9g}" for x in weights)), ",").cast("array<double>")
    b = buckets(host, path)
    total = F.aggregate(b, F.lit(0.0), lambda s, i: s + F.get(w, i))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.size(b)) + weights[-1])))


def judge(pages: DataFrame, rules: tuple = RULES, urls: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page.

    Of the rules that fit (their host or a subdomain of it, and the start of the path) the longest decides; where none
    fits, the model blocks from a probability of 0.5.  A null url, or one without `://`, has empty host and path and goes
    to the model.  Repeated rows are judged alike; other columns are ignored.
    """
    weights = trained(urls if urls is not None else labelled(pages.sparkSession))
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    fits = [F.when(((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    longest = F.greatest(*fits) if len(fits) > 1 else fits[0]
    judged = parts.withColumn("fit", longest).withColumn("score", score(F.col("host"), F.col("path"), weights))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
