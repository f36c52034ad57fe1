"""URL filter: allow and block rules first, else logistic regression on hashed
character n-grams of host and path.

The classifier is trained here with Spark's own logistic regression on the small
labelled table below (a fixed bound: its rows), and applied by the same JVM pipeline
to every URL, without a shuffle. Host and path n-grams are hashed into separate spaces.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there to ``?``, ``#`` or the end. A null URL, or one without
``://``, has both empty. A rule fits its host and all subdomains if the path starts with
the rule's; the longest fitting rule (host and path together) wins; of equally long ones
the alphabetically first. A URL without features gets the verdict of the intercept.
Repeated rows are judged each on their own; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

#: Slots of each hashed feature space, n-gram lengths and regularisation.
SLOTS, LENGTHS, REGULARISATION = 1 << 14, (3, 4, 5), 0.005

#: The labelled URL table (fixed values): sites that are spam, adult, gambling or
#: advertising farms, and ordinary sites.
BLOCKED = [
    ("www.cheap-pills.example", "/en/12"), ("cheap-pills.example", "/buy/now"), ("m.pills-online.example", "/order"),
    ("casino-win.example", "/en/30"), ("blog.casino-win.example", "/fr/7"), ("best-casino.example", "/play"),
    ("free-bets.example", "/en/44"), ("www.free-bets.example", "/odds"), ("sport-bets.example", "/win"),
    ("adult-x.example", "/en/9"), ("m.adult-x.example", "/video/3"), ("xxx-adult.example", "/cams"),
    ("spam-farm.example", "/en/101"), ("www.spam-farm.example", "/es/5"), ("link-farm.example", "/links"),
    ("ads-track.example", "/en/77"), ("m.ads-track.example", "/click"), ("track-ads.example", "/banner"),
    ("poker-win.example", "/bonus"), ("win-big-casino.example", "/bonus"), ("viagra-pills.example", "/cheap"),
    ("cheap-loans.example", "/apply"), ("free-porn.example", "/watch"), ("click-track.example", "/ad"),
]
ALLOWED = [
    ("www.library.example", "/en/12"), ("library.example", "/catalogue"), ("news.example", "/en/30"),
    ("blog.garden.example", "/fr/7"), ("m.weather.example", "/en/9"), ("www.museum.example", "/de/101"),
    ("school.example", "/es/5"), ("university.example", "/en/77"), ("www.history.example", "/en/44"),
    ("blog.cooking.example", "/recipe/3"), ("science.example", "/article/8"), ("m.travel.example", "/guide"),
    ("theatre.example", "/en/61"), ("www.nature.example", "/de/14"), ("the-station.example", "/en/20"),
    ("blog.thread.example", "/en/85"), ("other.example", "/fr/55"), ("nation.example", "/es/78"),
    ("www.shire.example", "/en/47"), ("m.rivers.example", "/index.html"), ("thistle.example", "/en/66"),
    ("handbook.example", "/en/73"), ("then-and-now.example", "/en/19"), ("blog.winter.example", "/en/15"),
]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (verdict, host, path); null if none fits."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _features() -> list:
    out, columns = [], []
    for part in ("_host", "_path"):
        out.append(RegexTokenizer(inputCol=part, outputCol=part + "_c", pattern="(?s).", gaps=False, toLowercase=True))
        for n in LENGTHS:
            out.append(NGram(n=n, inputCol=part + "_c", outputCol=f"{part}_{n}"))
            out.append(HashingTF(numFeatures=SLOTS, inputCol=f"{part}_{n}", outputCol=f"{part}_{n}f", binary=True))
            columns.append(f"{part}_{n}f")
    return [*out, VectorAssembler(inputCols=columns, outputCol="_features")]


def _padded(df: DataFrame) -> DataFrame:
    """Borders let n-grams tell a host's start and end."""
    return df.withColumn("_host", F.concat(F.lit("^"), "_host", F.lit("$"))).withColumn("_path", F.concat(F.lit("^"), "_path"))


def train(spark: SparkSession, labelled: DataFrame | None = None) -> PipelineModel:
    """Fit on a labelled table (_host, _path, _label: 1 = block), by default the one above."""
    if labelled is None:
        rows = [(h, p, 1.0) for h, p in BLOCKED] + [(h, p, 0.0) for h, p in ALLOWED]
        labelled = spark.createDataFrame(rows, "_host string, _path string, _label double").coalesce(1)
    fit = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=30, regParam=REGULARISATION,
                             standardization=False, rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_block")
    return Pipeline(stages=[*_features(), fit]).fit(_padded(labelled))


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
                model: PipelineModel | None = None) -> DataFrame:
    """(``id_col``, host, path, rule, verdict, block_probability) for every row."""
    from pyspark.ml.functions import vector_to_array
    spark = prepare(df.sparkSession)
    model = model or train(spark)
    host, path = host_path(F.col("_url"))
    x = df.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    x = x.select("_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    x = x.withColumn("rule", rule).withColumn("_rule_verdict", verdict) \
         .withColumn("_host", F.col("host")).withColumn("_path", F.col("path"))
    judged = model.transform(_padded(x))
    return judged.select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("_rule_verdict", F.when(F.col("_block") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.round(vector_to_array("_p")[1], 6).alias("block_probability"))
