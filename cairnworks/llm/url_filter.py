"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams.

The regression is trained by Spark ML from a small labelled URL table (`labelled` by default, which is made of general
words and holds no host of any table here; a caller's own table is a parameter of `train`) and judges every URL that
no rule fits. Everything runs as DataFrame expressions; no Python touches a row.

Edge cases: a null URL, or one without '://', has an empty host and path, no n-grams of its own, and gets the
regression's verdict for its intercept alone; repeated rows are judged alike; an empty table gives an empty
result; extra columns of the input are ignored, and one with a name used here ('rule', 'verdict') does no harm.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnworks.llm.common import read

#: (host, path, verdict): a rule fits its host and all subdomains if the URL's path starts with the rule's path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Hash space of the n-grams, a parameter of the model.
FEATURES = 1 << 18
SIZES = (3, 4, 5)
#: Stems and modifiers of the default labelled table: what unwanted and ordinary sites in general are called.
UNWANTED_STEMS = (
    "casino", "poker", "slot", "roulette", "betting", "bet", "jackpot", "lottery", "pill", "med", "viagra", "pharmacy", "adult", "porn", "xxx", "sex", "cam", "escort",
    "ad", "adserver", "banner", "tracker", "tracking", "clicktrack", "popup", "spam", "linkfarm", "seofarm", "backlink", "payday", "replica", "crypto-double",
)
UNWANTED_MODIFIERS = ("free", "cheap", "online", "best", "prize", "buy", "hot", "live", "fast", "easy", "super", "mega", "bonus", "cash", "deal", "now", "4u", "24", "pro", "zone")
ORDINARY_STEMS = (
    "news", "library", "weather", "university", "museum", "garden", "recipe", "travel", "history", "science", "music", "sport", "wiki", "archive", "school", "health",
    "book", "map", "journal", "theatre", "machine", "harbour", "forest", "mountain", "council", "railway", "station", "kitchen", "language", "astronomy", "chemistry", "village",
    "nation", "education", "information", "translation", "collection", "election", "tradition", "weekend", "northern", "theory", "letter", "reading", "winter",
)
ORDINARY_MODIFIERS = ("city", "open", "old", "daily", "state", "night", "river", "home", "north", "green", "new", "our", "royal", "little", "the", "my", "public", "land", "world", "house")
_ONSETS, _VOWELS, _CODAS = ("b", "br", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "st", "t", "th", "w", "sh", "ch", "v"), ("a", "e", "i", "o", "u", "ea", "ou", "io"), ("", "n", "r", "s", "t", "l", "nd", "ng")


def labelled_hosts(seed: int = 17, names: int = 1200) -> list[tuple[str, float]]:
    """(host stem, label) of the default table: every stem with some modifiers, and ordinary names made of syllables."""
    draw = random.Random(seed)
    out = []
    for label, stems, modifiers in ((1.0, UNWANTED_STEMS, UNWANTED_MODIFIERS), (0.0, ORDINARY_STEMS, ORDINARY_MODIFIERS)):
        for stem in stems:
            for modifier in draw.sample(modifiers, 12):
                mark = draw.choice(("-", "-", ""))
                out.append((draw.choice((f"{modifier}{mark}{stem}", f"{stem}{mark}{modifier}")), label))
            out.append((stem, label))
    out += [("".join(draw.choice(_ONSETS) + draw.choice(_VOWELS) + draw.choice(_CODAS) for _ in range(draw.randint(1, 3))), 0.0) for _ in range(names)]
    return sorted(set(out))


def labelled(spark: SparkSession, hosts: list[tuple[str, float]] | None = None) -> DataFrame:
    """The default labelled URL table: url, label (1: unwanted). Addresses have the same shapes for both labels, so only names tell them apart."""
    prefixes, ends, folders, tails = ("", "www.", "m.", "blog."), (".com", ".net", ".org", ".info", ".co.uk", ".example.net"), ("", "en/", "a/b/", "2024/05/"), ("", "index.html", "17", "4711.html", "?page=2", "item#top")
    draw, rows = random.Random(23), []
    for host, label in hosts or labelled_hosts():
        for _ in range(2):
            rows.append((f"http{draw.choice(('', 's'))}://{draw.choice(prefixes)}{host}{draw.choice(ends)}/{draw.choice(folders)}{draw.choice(tails)}", label))
    return spark.createDataFrame(rows, "url string, label double").coalesce(1)


def url_parts(url) -> tuple:
    """(host, path) columns of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _grams(part, mark: str):
    """Marked n-grams of a string column; shorter strings give none."""
    held = F.concat(F.lit("^"), part, F.lit("$"))
    of = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(held) - n + 1, F.lit(1))), lambda i, n=n: F.concat(F.lit(mark), F.substr(held, i, F.lit(n)))) for n in SIZES]
    return F.when(F.length(part) > 0, F.concat(*of)).otherwise(F.array().cast("array<string>"))


def _hashing() -> HashingTF:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="features")


def _with_features(urls: DataFrame) -> DataFrame:
    return _hashing().transform(urls.withColumn("_grams", F.concat(_grams(F.col("host"), "h:"), _grams(F.col("path"), "p:"))))


def train(table: DataFrame) -> LogisticRegressionModel:
    """Fit on a small labelled table (url, label 1 for unwanted); both labels weigh alike, however many rows they have."""
    host, path = url_parts(table["url"])
    # A small table by contract: one partition makes each step of the fit one small task.
    rows = _with_features(table.select(host.alias("host"), path.alias("path"), "label"))
    share = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    weight = F.when(F.col("label") == 1, 0.5 / share.get(1.0, 1)).otherwise(0.5 / share.get(0.0, 1)) * sum(share.values())
    rows = rows.select("features", "label", weight.alias("weight")).coalesce(1).persist()
    try:
        return LogisticRegression(regParam=0.00001, maxIter=30, standardization=False, weightCol="weight").fit(rows)
    finally:
        rows.unpersist()


def fitting_rule(host, path, rules=RULES):
    """The longest rule that fits, as 'host/path' (null if none does), and its verdict."""
    by_length = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = verdict = None
    for h, p, v in by_length:
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rules else (F.lit(None).cast("string"),) * 2


def judge(urls: DataFrame, key: str, model: LogisticRegressionModel, rules=RULES) -> DataFrame:
    """urls(key, url) -> key, host, path, rule, verdict, unwanted (the regression's probability)."""
    from pyspark.ml.functions import vector_to_array

    host, path = url_parts(urls["url"])
    rows = _with_features(urls.select(urls[key], host.alias("host"), path.alias("path")))
    rows = model.transform(rows).withColumn("unwanted", vector_to_array("probability")[1])
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return rows.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("unwanted") > 0.5, "block").otherwise("allow")).alias("verdict"), "unwanted")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), "page_id", train(labelled(spark)))
