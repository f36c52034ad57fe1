import datetime as dt
import hashlib

from pyspark.sql import functions as F

from logweave.functions.text import concept_id, template
from logweave.operators import concepts as C

from .conftest import rows


def tmpl(spark, s):
    return spark.createDataFrame([(s,)], "m string").select(template(F.col("m"))).first()[0]


def test_template_variables(spark):
    assert tmpl(spark, "Timeout connecting to 10.0.0.1:6379 after 30ms") == "Timeout connecting to <*> after <*>"
    assert tmpl(spark, "user 123e4567-e89b-12d3-a456-426614174000 id 5 7 ok") == "user <*> id <*> ok"
    assert tmpl(spark, "hash " + "ab" * 16 + " at https://x.io/a?b=1") == "hash <*> at <*>"
    assert tmpl(spark, "\x1b[31mred\x1b[0m  5.5mb 5.5MB 12MS -3") == "red <*> 5.5MB 12MS -3"  # units are lower-case
    assert tmpl(spark, "a <*> 5 6 x") == "a <*> x"


def test_concept_id_matches_sha256(spark):
    r = spark.createDataFrame([("svc", "a <*>")], "s string, t string").select(concept_id(F.col("s"), F.col("t"))).first()[0]
    assert r == hashlib.sha256(b"svc:a <*>").hexdigest()[:32]


def _hist(spark, counts):
    base = dt.datetime(2024, 1, 1)
    data = [("c", base + dt.timedelta(hours=i), n) for i, n in enumerate(counts)]
    return spark.createDataFrame(data, "concept_id string, bucket timestamp, n long")


def test_trend_thresholds(spark):
    def tr(counts):
        return rows(C.trend(C.trim_histogram(_hist(spark, counts), 24)), "trend")[0][0]
    assert tr([10, 10, 10, 15, 15, 16]) == "rising"      # 46 / 30 = 1.53
    assert tr([10, 10, 10, 15, 15, 15]) == "stable"      # 45 / 30 = 1.5
    assert tr([10, 10, 10, 7, 6, 7]) == "falling"        # 20 / 30 = 0.667 < 0.67
    assert tr([10, 10, 10, 7, 7, 7]) == "stable"         # 21 / 30 = 0.7
    assert tr([5]) == "unknown"
    assert tr([1, 2]) == "rising"                        # older sum 0 -> 1
    # only the newest 24 existing buckets count
    assert rows(C.trim_histogram(_hist(spark, list(range(1, 31))), 24).agg(F.min("n")), )[0][0] == 7


def test_rollup_severity_earliest_wins(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [(1, t0, "s", "INFO", "m 1"), (2, t0 + dt.timedelta(minutes=1), "s", "ERROR", "m 2"),
            (3, t0 + dt.timedelta(minutes=2), "s", "FATAL", "m 3"), (4, t0 + dt.timedelta(minutes=3), "s", "CRITICAL", "m 4"),
            (5, t0, "s", "TRACE", "other")]
    df = spark.createDataFrame(data, "log_id long, ts timestamp, service_name string, level string, message string")
    r = {x["template"]: x for x in C.rollup_concepts(C.with_templates(df)).collect()}
    assert r["m <*>"]["severity"] == "FATAL" and r["m <*>"]["total_occurrences"] == 4
    assert r["other"]["severity"] == "TRACE" and r["other"]["trend"] == "unknown"
