"""State over micro-batches: parts equal the whole; streams equal the batch on shuffled input in small chunks."""

import datetime as dt
import random

import pytest

from logweave.operators import logfilter as L
from logweave.streaming import ingest as IN
from logweave.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1, 9, 50)
SCHEMA = "log_id long, ts timestamp, service_name string, level string, message string"


def logs(n=1200, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ts = None if rng.random() < 0.05 else T0 + dt.timedelta(seconds=i * 6 + rng.random())
        out.append((i, ts, rng.choice(["Pay", "pay", "auth", None]), rng.choice(["ERROR", "WARN", "INFO", None]), rng.choice(["a", "b", "c" * 30, None])))
    return out


def test_parts_with_carried_state_equal_the_whole(spark):
    data = logs()
    cfg = L.FilterConfig(dedup_seconds=40, rate_limit=25, max_message_length=20)
    whole = {r["log_id"]: r["_reason"] for r in L.filter_reasons(spark.createDataFrame(data, SCHEMA), cfg).collect()}
    assert {None, "duplicate", "rate_limited", "below_severity"} == set(whole.values())
    state, got = L.FilterState(), {}
    for a in range(0, len(data), 300):
        tagged = L.filter_reasons(spark.createDataFrame(data[a:a + 300], SCHEMA), cfg, state=state)
        got |= {r["log_id"]: r["_reason"] for r in tagged.collect()}
        after = L.next_state(tagged, cfg, state, lateness=60)
        keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
        state = L.FilterState(keep(after.last_kept), keep(after.used))
    assert got == whole
    assert state.used.count() < 6  # hours long past are gone


def test_ingest_batches_retried_and_missing_state(spark, tmp_path):
    lines = [(d, n, f'{{"timestamp": "{T0 + dt.timedelta(seconds=40 * (d * 5 + n)):%Y-%m-%dT%H:%M:%S}", "level": "ERROR", "message": "step {n % 2} failed"}}', f"svc-{d % 2}", "file")
             for d in range(40) for n in range(5)]
    schema = "doc_id long, line_no long, line string, service_name string, source string"
    cfg = L.FilterConfig(dedup_seconds=100, rate_limit=20)

    def run(name, cuts, retry=False):
        state = str(tmp_path / name)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for _ in range(2 if retry else 1):
                IN.ingest_batch(state, cfg)(spark.createDataFrame([x for x in lines if a <= x[0] < b], schema), k)
        table = sorted(map(str, IN.concept_table(spark, state).collect()))
        return table, sorted(map(tuple, IN.reason_counts(spark, state).collect()))
    want = run("whole", [0, 40])
    assert dict(want[1]).keys() == {"duplicate", "rate_limited"}
    assert run("parts", [0, 11, 12, 30, 40]) == want
    assert run("again", [0, 20, 40], retry=True) == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        IN.ingest_batch(str(tmp_path / "lost"), cfg)(spark.createDataFrame(lines[:5], schema), 3)


@pytest.fixture
def small_chunks(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def shuffled_stream(spark, tmp_path, data, schema, parts=4):
    """Time-ordered parts, one micro-batch each, whose rows come in any order."""
    rng = random.Random(8)
    size = -(-len(data) // parts)
    for k in range(parts):
        part = data[k * size:(k + 1) * size]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    return spark.readStream.schema(spark.createDataFrame(data[:1], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))


def test_streams_equal_batch_on_shuffled_input_in_small_chunks(spark, tmp_path, small_chunks):
    data = [r for r in logs(400, 5) if r[1] is not None]
    df = spark.createDataFrame(data, SCHEMA)
    src = shuffled_stream(spark, tmp_path / "a", list(data), SCHEMA)
    out, _, _ = ST.run_available(ST.stream_dedup(src, 50, watermark="1 hour"), "t-chunk-dedup")
    want = L.dedup_window(df, L._dedup_keys("service_name", "message"), "ts", 50, "log_id")
    assert sorted(r["log_id"] for r in out.collect()) == sorted(r["log_id"] for r in want.collect())
    out, _, _ = ST.run_available(ST.stream_rate_limit(src, 30, watermark="3 hours"), "t-chunk-rate")
    want = L.rate_limit(df, "service_name", "ts", 30, "log_id")
    assert sorted(r["log_id"] for r in out.collect()) == sorted(r["log_id"] for r in want.collect())


def test_stream_edges_in_small_chunks(spark, tmp_path, small_chunks):
    rng = random.Random(6)
    data = [(i, T0 + dt.timedelta(seconds=i * 5), i % 3, rng.choice("abc")) for i in range(240)]
    schema = "event_id long, ts timestamp, user_id int, entity string"
    src = shuffled_stream(spark, tmp_path / "e", list(data), schema)
    out, _, _ = ST.run_available(ST.stream_edges(src, window_s=600, watermark="1 hour"), "t-chunk-edges")
    last, want = {}, []
    for i, ts, user, ent in data:
        if user in last and last[user][1] != ent:
            want.append((last[user][1], ent, (ts - last[user][0]).total_seconds() * 1000.0))
        last[user] = (ts, ent)
    assert sorted((r["source_entity"], r["target_entity"], r["lag_ms"]) for r in out.collect()) == sorted(want)
