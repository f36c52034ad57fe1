import datetime as dt

from logweave.operators import logfilter as L

from .conftest import rows


def logs(spark, data):
    return spark.createDataFrame(data, "log_id long, ts timestamp, service_name string, level string, message string")


def test_dedup_last_kept_rule(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, t0 + dt.timedelta(seconds=s), "svc", "ERROR", "same") for i, s in enumerate([0, 59, 60, 119, 121])]
    kept = L.dedup_window(logs(spark, data), ["service_name", "message"], "ts", 60, "log_id")
    assert sorted(r[0] for r in rows(kept, "log_id")) == [0, 2, 4]  # 0, 60, 121 s


def test_dedup_equal_times_and_keys(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [(1, t0, "a", "E", "m"), (2, t0, "a", "E", "m"), (3, t0, "b", "E", "m"), (4, t0, "a", "E", "n")]
    kept = L.dedup_window(logs(spark, data), ["service_name", "message"], "ts", 60, "log_id")
    assert sorted(r[0] for r in rows(kept, "log_id")) == [1, 3, 4]


def test_rate_limit_and_gates(spark):
    t0 = dt.datetime(2024, 1, 1, 10)
    data = [(i, t0 + dt.timedelta(minutes=i), "svc", "ERROR", f"m{i}") for i in range(130)]
    kept = L.rate_limit(logs(spark, data), "service_name", "ts", 50, "log_id")
    ids = sorted(r[0] for r in rows(kept, "log_id"))
    assert ids == list(range(50)) + list(range(60, 110)) + list(range(120, 130))
    g = logs(spark, [(1, t0, "s", "DEBUG", "x"), (2, t0, "s", None, "x"), (3, t0, "s", "bogus", "x"),
                     (4, t0, "s", "WARNING", "x"), (5, t0, "s", "info", "x")])
    assert sorted(r[0] for r in rows(L.severity_gate(g, "WARN"), "log_id")) == [2, 3, 4]
    assert sorted(r[0] for r in rows(L.severity_gate(g, "nonsense"), "log_id")) == [2, 3, 4]
    a = logs(spark, [(1, t0, "Pay", "E", "x"), (2, t0, "auth", "E", "x"), (3, t0, None, "E", "x")])
    assert sorted(r[0] for r in rows(L.allow_services(a, " pay , "), "log_id")) == [1]
    assert sorted(r[0] for r in rows(L.allow_services(a, ""), "log_id")) == [1, 2, 3]


def test_waterfall_reasons(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [(1, t0, "s", "DEBUG", "a"), (2, t0, "s", "ERROR", "b"), (3, t0 + dt.timedelta(seconds=1), "s", "ERROR", "b"),
            (4, t0, "s", "ERROR", "x" * 2500)]
    kept, reasons = L.filter_logs(logs(spark, data))
    got = dict(rows(reasons, "reason", "n"))
    assert got == {"below_severity": 1, "duplicate": 1, "truncated": 1}
    long_msg = [r[0] for r in rows(kept.filter("log_id = 4"), "message")][0]
    assert long_msg.endswith("… [truncated]") and len(long_msg) == 2000 + len("… [truncated]")


def test_streaming_fold_matches_brute_force(spark):
    import random
    random.seed(5)
    t0 = dt.datetime(2024, 1, 1)
    data, t = [], 0.0
    for i in range(3000):
        t += random.choice([0.5, 3, 10, 20, 59, 61, 200])
        data.append((i, t0 + dt.timedelta(seconds=t), random.choice(["a", "b"]), "E", random.choice(["m", "n", None])))
    df = logs(spark, data)
    want = sorted(r[0] for r in rows(L.dedup_window(df.repartition(7), ["service_name", "message"], "ts", 60, "log_id"),
                                     "log_id"))
    assert 0 < len(want) < 3000
    # brute force
    last, keep = {}, []
    for i, ts, svc, _, msg in sorted(data, key=lambda r: (r[1], r[0])):
        k = (svc, msg)
        if k not in last or (ts - last[k]).total_seconds() >= 60:
            last[k] = ts
            keep.append(i)
    assert sorted(keep) == want


def test_dedup_rows_without_time_are_kept(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [(1, None, "s", "E", "m"), (2, t0, "s", "E", "m"), (3, None, "s", "E", "m"),
            (4, t0 + dt.timedelta(seconds=10), "s", "E", "m"), (5, t0 + dt.timedelta(seconds=70), "s", "E", "m")]
    kept = L.dedup_window(logs(spark, data), ["service_name", "message"], "ts", 60, "log_id")
    assert sorted(r[0] for r in rows(kept, "log_id")) == [1, 2, 3, 5]


def test_waterfall_conserves_rows(spark):
    """Null times and services, repeats, a full hour and long messages: every input
    row is either kept or dropped for one reason."""
    t0 = dt.datetime(2024, 1, 1, 10)
    sec = lambda s: t0 + dt.timedelta(seconds=s)
    data = [("s", "ERROR", None, "no time"), ("s", "ERROR", None, "no time"), (None, "ERROR", None, "no service"),
            ("s", "DEBUG", None, "low"), ("s", "INFO", sec(5), "low"), (None, "ERROR", sec(1), "x"), (None, "ERROR", sec(2), "x"),
            ("s", "ERROR", sec(3), "y" * 2500)]
    data += [("busy", "ERROR", sec(i), f"m{i}") for i in range(600)]
    data += [("busy", "ERROR", sec(i + 1), f"m{i}") for i in range(20)]
    df = logs(spark, [(i, t, svc, lv, m) for i, (svc, lv, t, m) in enumerate(data)])
    kept, reasons = L.filter_logs(df)
    got = dict(rows(reasons, "reason", "n"))
    assert got == {"below_severity": 2, "duplicate": 21, "rate_limited": 100, "truncated": 1}
    assert kept.count() + sum(n for r, n in got.items() if r != "truncated") == len(data)
    ids = {r[0] for r in rows(kept, "log_id")}
    assert {0, 1, 2, 5, 7} <= ids  # without a time: kept, and counted for no hour
    assert kept.columns == [*df.columns, "truncated"]


def test_running_sums_keep_null_keys(spark):
    from pyspark.sql import functions as F

    from logweave.operators.ordering import chunked_lag, running_sums
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 5), (None, 1, 7), (None, None, 1)], "k string, t int, v int")
    out = running_sums(df, ["k"], ["t"], F.col("t"), {"total": F.col("v")})
    assert sorted(rows(out, "v", "total")) == [(1, 1), (5, 15), (7, 8), (10, 10)]
    lag = chunked_lag(df, ["k"], ["t"], F.col("t"), ["v"])
    assert sorted(rows(lag, "v", "prev_v"), key=str) == sorted([(10, None), (5, 10), (1, None), (7, 1)], key=str)
