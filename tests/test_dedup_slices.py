"""Duplicate suppression over slices of a key: equal to the sequential rule."""

import datetime as dt
import random

import pytest

from logweave.operators import logfilter as L

SCHEMA = "log_id long, ts timestamp, service_name string, message string, _k int, kept string"
T0 = dt.datetime(2024, 1, 1)


def sequential(rows, seconds, last=None):
    """The rule as stated, one row after another; rows are (id, seconds or None, service, message)."""
    last, kept = dict(last or {}), set()
    for i, s, svc, msg in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        if s is None:
            kept.add(i)
        elif (svc, msg) not in last or s - last[svc, msg] >= seconds:
            kept.add(i)
            last[svc, msg] = s
    return kept, last


def table(spark, rows):
    return spark.createDataFrame([(i, None if s is None else T0 + dt.timedelta(seconds=s), a, b, 1, "x") for i, s, a, b in rows], SCHEMA)


def kept(df):
    return {r["log_id"] for r in df.filter("kept").collect()}


def random_rows(rng, n, hot=0.4):
    rows = []
    for i in range(n):
        key = ("hot", "m") if rng.random() < hot else (rng.choice([None, "a", "b"]), rng.choice(["m", "1:m", "", None]))
        rows.append((i, None if rng.random() < 0.05 else round(rng.choice([rng.uniform(0, 900), rng.randrange(0, 900, 10)]), 3), *key))
    return rows


@pytest.mark.parametrize("seconds, seed", [(60, 1), (10, 2), (0.5, 3), (700, 4)])
def test_equals_the_sequential_rule(spark, seconds, seed):
    rows = random_rows(random.Random(seed), 900)
    df = table(spark, rows)
    got = L.dedup_flag(df, ["service_name", "message"], "ts", seconds, "log_id", out="kept")
    assert got.count() == len(rows) and sorted(got.columns) == sorted(df.columns)
    assert kept(got) == sequential(rows, seconds)[0]


def test_ties_dense_slices_and_exact_window_borders(spark):
    rows = [(i, (i * 7 % 600) / 10, "hot", "m") for i in range(1800)] + [(2000 + i, 10.0 * i, "edge", "m") for i in range(40)]
    assert kept(L.dedup_flag(table(spark, rows), ["service_name", "message"], "ts", 10, "log_id")) == sequential(rows, 10)[0]


@pytest.mark.parametrize("seconds", [10, 60])
def test_carried_times(spark, seconds):
    rng = random.Random(9)
    rows = sorted(random_rows(rng, 800), key=lambda r: r[1] or 0)
    cuts = [0, 200, 390, 600, 800]
    carried, got, want = None, set(), set()
    last = {}
    for a, b in zip(cuts, cuts[1:]):
        part = table(spark, rows[a:b])
        flagged = L.dedup_flag(part, ["service_name", "message"], "ts", seconds, "log_id", last_kept=carried)
        got |= kept(flagged)
        w, last = sequential(rows[a:b], seconds, last)
        want |= w
        state = [(L_key(k), int(round(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6 + s * 1e6))) for k, s in last.items()]
        carried = spark.createDataFrame(state, "_k string, _us long")
    assert got == want == sequential(rows, seconds)[0]


def L_key(key):
    return "".join(f"{-1 if v is None else len(v)}:{v or ''}" for v in key)


def test_a_hot_key_is_many_tasks_work(spark):
    """A third of all rows have one key: the slices deal them out evenly."""
    rows = [(i, i * 0.5, "hot" if i % 3 == 0 else f"s{i % 997}", "m") for i in range(30_000)]
    x = table(spark, rows)
    slices = x.filter("service_name = 'hot'").selectExpr(f"floor(unix_micros(ts) / {L.SLICE_WINDOWS * 10_000_000}) as s").groupBy("s").count()
    assert slices.count() > 300 and slices.agg({"count": "max"}).first()[0] <= 30
    assert kept(L.dedup_flag(table(spark, rows), ["service_name", "message"], "ts", 10, "log_id")) == sequential(rows, 10)[0]


def test_empty_and_switched_off(spark):
    assert L.dedup_flag(table(spark, []), ["message"], "ts", 5, "log_id").collect() == []
    rows = [(1, 0.0, "a", "m"), (2, 0.0, "a", "m")]
    assert kept(L.dedup_flag(table(spark, rows), ["message"], "ts", 0, "log_id")) == {1, 2}
