"""Exact percentiles by buckets, and counts after deployments, against plain statements."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from logweave.operators import analytics as A


def test_percentiles_equal_the_built_in_ones(spark):
    rng = random.Random(2)
    data = [("hot", rng.choice([0.0, -0.0, 1.5, 1.5000001, rng.lognormvariate(5, 3), -rng.random()])) for _ in range(4000)]
    data += [(None, float(i)) for i in range(10)] + [("one", 7.25), ("two", -3.0), ("two", 4.0), ("null", None), ("same", 5.0), ("same", 5.0)]
    data += [("odd", v) for v in (float("nan"), float("inf"), float("-inf"), 1e300, 2.0)]
    df = spark.createDataFrame(data, "service string, duration_ms double")
    points = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["service"]: list(r)[1:] for r in A.exact_percentiles(df, "service", "duration_ms", points).collect()}
    want = {r[0]: list(r)[1:] for r in df.filter("duration_ms is not null").groupBy("service").agg(
        *[F.percentile("duration_ms", p) for p in points.values()]).collect()}
    assert got.keys() == want.keys() and "null" not in got
    for k in want:
        assert np.array_equal(np.array(got[k]), np.array(want[k]), equal_nan=True), k


def test_latency_counts_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2000.0), ("a", None), (None, None)], "service string, duration_ms double")
    got = {r["service"]: tuple(r)[1:] for r in A.trace_latency(df).collect()}
    assert got == {"a": (3, 1000.5, 1900.05, 1), None: (1, None, None, 0)}
    assert A.trace_latency(df.limit(0)).count() == 0


def test_errors_after_overlapping_deployments(spark):
    t0 = dt.datetime(2024, 1, 1, 10)
    rng = random.Random(3)
    logs = [(rng.choice(["a", "b", None]), None if rng.random() < 0.03 else t0 + dt.timedelta(seconds=rng.randrange(0, 20000, 50)),
             rng.choice(["ERROR", "fatal", "INFO", None])) for _ in range(1500)]
    deploys = [(i, rng.choice(["a", "b", "c"]), t0 + dt.timedelta(seconds=rng.randrange(0, 20000, 50))) for i in range(60)]
    deploys += [(60, "a", None), (61, None, t0), deploys[0], deploys[0]]
    ld = spark.createDataFrame(logs, "service_name string, ts timestamp, level string")
    dd = spark.createDataFrame(deploys, "d int, service_name string, ts timestamp")
    for hours in (1, 3):
        want = sorted((i, sum(1 for s, ts, lv in logs if s == svc and ts is not None and t is not None and t < ts <= t + dt.timedelta(hours=hours)
                              and (lv or "").upper() in A.ERROR_WORDS)) for i, svc, t in deploys)
        got = sorted(tuple(r) for r in A.deployment_errors(dd, ld, hours).select("d", "errors_after").collect())
        assert got == want
