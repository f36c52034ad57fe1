from logweave.sinks import merge as M
from logweave.sources.code import read_code_files
from logweave.sources.logs import parse_log_lines, read_log_text

from .conftest import rows


def test_read_log_text_keeps_line_order(spark, tmp_path):
    lines = [f"2024-01-01 00:00:{i:02d} ERROR step {i}" if i % 3 == 0 else f"  at frame {i}" for i in range(60)]
    (tmp_path / "pay.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "auth.log").write_text('{"level": "info", "msg": "hi"}\n{"level": "error", "msg": "x"}\n')
    df = read_log_text(spark, str(tmp_path))
    got = {r["service_name"]: r for r in df.groupBy("service_name").agg({"line_no": "max"}).collect()}
    assert set(got) == {"pay", "auth"}
    pay = [r[0] for r in rows(df.filter("service_name = 'pay'").orderBy("line_no"), "line")]
    assert pay == lines
    e = parse_log_lines(df)
    assert e.filter("service_name = 'pay'").count() == 20 and e.filter("service_name = 'auth'").count() == 2


def test_read_code_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def a():\n    return 1\n")
    (tmp_path / "src" / "b.bin").write_text("xx")
    (tmp_path / "empty.md").write_text("   \n")
    df = read_code_files(spark, str(tmp_path), repo="demo")
    assert rows(df, "repo", "file_path") == [("demo", "src/a.py")]


def test_code_file_bytes_names_and_sizes(spark, tmp_path):
    broken = [b"x = 1 \xff\xe2\x82A\xc3\xa9", b"\xed\xa0\x80y\xf0\x9f\x98\x80", b"z \xef\xbf\xbd \xc3", b"\xf4\x90\x80\x80q\xe0\x80\x80"]
    for i, raw in enumerate(broken):
        (tmp_path / f"f {i}+%41.PY").write_bytes(raw)
    (tmp_path / "at.py").write_bytes(b"a" * 1_000_000)
    (tmp_path / "over.py").write_bytes(b"a" * 1_000_001)
    (tmp_path / ".py").write_text("x = 1")
    df = read_code_files(spark, str(tmp_path))
    got = dict(rows(df, "file_path", "content"))
    assert got.pop("at.py") == "a" * 1_000_000
    assert got == {f"f {i}+%41.PY": raw.decode("utf-8", errors="ignore") for i, raw in enumerate(broken)}
    assert "LessThanOrEqual(length,1000000)" in df._jdf.queryExecution().executedPlan().toString()


def test_merges(spark):
    t = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0)], "k long, name string, v double")
    b = spark.createDataFrame([(2, None, 25.0), (3, "c", None), (3, "c2", 1.0)], "k long, name string, v double")
    assert sorted(rows(M.insert_new(t, b, ["k"]), "k")) == [(1,), (2,), (3,)]
    co = {r[0]: (r[1], r[2]) for r in rows(M.merge_coalesce(t, b.dropDuplicates(["k"]), ["k"]))}
    assert co[2] == ("b", 25.0) and co[1] == ("a", 10.0)
    st = spark.createDataFrame([("r1", "running", 1), ("r1", "failed", 2)], "repo_id string, state string, o int")
    rep = M.merge_replace(spark.createDataFrame([("r1", "idle", 0), ("r2", "idle", 0)], "repo_id string, state string, o int"),
                          st, ["repo_id"], order=["o"])
    assert dict(rows(rep, "repo_id", "state")) == {"r1": "failed", "r2": "idle"}
    mc = M.merge_counts(None, spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, o int"), ["k"], order="o")
    assert dict(rows(mc, "k", "call_count")) == {"x": 2, "y": 1}
    ch = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, None)], "id long, repo_id string")
    ids = spark.createDataFrame([("r1",)], "repo_id string")
    assert sorted(rows(M.cascade_delete(ch, ids), "id")) == [(2,), (3,)]
    assert sorted(rows(M.cascade_delete(ch, ids, set_null=True), "id", "repo_id")) == [(1, None), (2, "r2"), (3, None)]


def test_line_numbers_across_many_splits(spark, tmp_path):
    lines = [f"line {i:05d} " + "x" * (i % 37) for i in range(6000)]
    (tmp_path / "big.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "small.log").write_text("a\nb\nc\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = read_log_text(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        got = {r[0]: r[1] for r in rows(df.filter("service_name = 'big'"), "line_no", "line")}
        assert got == dict(enumerate(lines))
        assert sorted(rows(df.filter("service_name = 'small'"), "line_no", "line")) == [(0, "a"), (1, "b"), (2, "c")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_stream_otlp_whole_files(spark, tmp_path):
    import json
    from logweave.streaming import streams as ST
    for k in range(2):
        payload = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": f"s{k}"}}]},
                                     "scopeLogs": [{"logRecords": [{"body": {"stringValue": f"m{j} ERROR"}}
                                                                   for j in range(3)]}]}]}
        (tmp_path / f"p{k}.json").write_text(json.dumps(payload, indent=2))
    out, _, _ = ST.run_available(ST.stream_otlp(spark, str(tmp_path), wholetext=True)
                                 .select("service_name", "message", "level"), "t-otlp")
    got = sorted(rows(out))
    assert len(got) == 6 and got[0] == ("s0", "m0 ERROR", "ERROR")
