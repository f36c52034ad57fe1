import datetime as dt

from logweave.operators import logfilter as L
from logweave.streaming import streams as ST


def test_stream_dedup_across_batches_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, t0 + dt.timedelta(seconds=s), "svc", "E", "same") for i, s in enumerate([0, 59, 60, 119, 121, 400, 430])]
    schema = "log_id long, ts timestamp, service_name string, level string, message string"
    df = spark.createDataFrame(data, schema)
    for k, part in enumerate([data[:3], data[3:5], data[5:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    out, q, _ = ST.run_available(ST.stream_dedup(src, 60, watermark="1 hour"), "t-dedup")
    want = sorted(r[0] for r in L.dedup_window(df, ["service_name", "message"], "ts", 60, "log_id").select("log_id").collect())
    assert sorted(r[0] for r in out.select("log_id").collect()) == want == [0, 2, 4, 5]
    assert ST.late_rows(q) == 0


def test_stream_rate_limit_across_batches_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 10)
    data = [(i, t0 + dt.timedelta(minutes=i * 7), "svc" if i % 3 else "other", "E", f"m{i}") for i in range(60)]
    schema = "log_id long, ts timestamp, service_name string, level string, message string"
    df = spark.createDataFrame(data, schema)
    for k in range(3):
        spark.createDataFrame(data[k * 20:(k + 1) * 20], schema).coalesce(1).write.parquet(str(tmp_path / f"r{k}"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r*"))
    out, _, _ = ST.run_available(ST.stream_rate_limit(src, 3, watermark="3 hours"), "t-rate")
    want = sorted(r[0] for r in L.rate_limit(df, "service_name", "ts", 3, "log_id").select("log_id").collect())
    assert sorted(r[0] for r in out.select("log_id").collect()) == want


def _pairs(spark, seed, n=400, bare=True):
    import random
    r = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    data = [(f"a{r.randrange(3)}", f"b{r.randrange(4)}", None if bare and r.random() < 0.05 else r.uniform(-9, 8),
             t0 + dt.timedelta(seconds=r.randrange(10_000))) for _ in range(n)]
    data += [("plain", f"b{i % 2}", float(i), t0 + dt.timedelta(seconds=r.randrange(10_000))) for i in range(n // 2)]
    return spark.createDataFrame(data, "source_entity string, target_entity string, lag_ms double, ts timestamp")


def test_merged_edges_equal_one_rollup_and_read_a_batch_once(spark, tmp_path):
    from pyspark.sql import functions as F
    from logweave.operators import graph as G
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x
    parts = [_pairs(spark, 1), _pairs(spark, 2, bare=False), _pairs(spark, 3, 6)]  # negative lags, none, and few rows
    merge = ST.merge_edges(str(tmp_path / "state"))
    for k, part in enumerate(parts):
        merge(part.withColumn("source_entity", seen.asNondeterministic()("source_entity")), k)
        want = parts[0]
        for other in parts[1:k + 1]:
            want = want.unionByName(other)
        got = ST.edge_table(spark, str(tmp_path / "state"), k)
        assert sorted(map(str, got.collect())) == sorted(map(str, G.rollup_edges(want).select(*got.columns).collect()))
    assert read.value == sum(p.count() for p in parts)


def test_first_median_not_below_zero_against_plain_python(spark):
    from statistics import median, stdev
    from logweave.operators import graph as G
    pairs = _pairs(spark, 5, 900, bare=False)
    got = {(r["source_entity"], r["target_entity"]): r for r in G.rollup_edges(pairs).collect()}
    rows = {}
    for r in sorted(pairs.collect(), key=lambda r: (r["ts"], r["lag_ms"])):
        rows.setdefault((r["source_entity"], r["target_entity"]), []).append(r["lag_ms"])
    for key, lags in rows.items():
        first = next((i for i in range(len(lags)) if median(lags[max(0, i - 49):i + 1]) >= 0), None)
        r = got[key]
        if first is None or first >= 3:
            assert r["temporal_precedence_ms"] is None
        else:
            assert abs(r["temporal_precedence_ms"] - median(lags[:first + 1])) < 0.006
            assert abs(r["temporal_std_ms"] - (stdev(lags[:first + 1]) if first else 0)) < 0.006


def test_pairs_of_many_keys_share_calls_of_the_worker(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, t0 + dt.timedelta(seconds=i), None if i % 50 == 7 else i % 50, f"e{i % 3}" if i % 11 else None) for i in range(1, 2000)]
    schema = "event_id long, ts timestamp, user_id long, entity string"
    for k in range(2):
        spark.createDataFrame(data[k * 1000:(k + 1) * 1000], schema).coalesce(1).write.parquet(str(tmp_path / f"e{k}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e*"))
    st = ST.stream_edges(src, window_s=3600, watermark="2 hours")
    out, q, _ = ST.run_available(st, "t-many")
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in (x for x in q.recentProgress)) <= ST.PAIR_GROUPS
    want, last = [], {}
    for _, t, u, e in data:
        if u in last and last[u][0] and e and last[u][0] != e:
            want.append((last[u][0], e, (t - last[u][1]).total_seconds() * 1000, t))
        last[u] = (e, t)
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted(want) and want
