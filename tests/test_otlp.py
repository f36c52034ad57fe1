import json

from pyspark.sql import functions as F

from logweave.sources import otlp as O


def test_any_value_nested(spark):
    v = {"kvlistValue": {"values": [{"key": "a", "value": {"intValue": "1"}},
                                    {"key": "b", "value": {"arrayValue": {"values": [{"boolValue": True},
                                                                                      {"doubleValue": 1.5}]}}}]}}
    df = spark.createDataFrame([(json.dumps(v),)], "j string")
    assert df.select(O.any_value(F.col("j"))).first()[0] == "{a=1, b=[True, 1.5]}"


def test_level_ids_and_nanos(spark):
    df = spark.createDataFrame([("warning", "17", "0" * 32, "1700000000123456789"), (None, "21", "AAAAAAAAAAAAAAAAAAAAAA==", "0"),
                                ("", "0", " ab ", None), (None, "13", "", "x")], "t string, n string, i string, ns string")
    r = df.select(O.otlp_level(F.col("t"), F.col("n")).alias("l"), O.clean_id(F.col("i")).alias("i"),
                  O.nanos_to_ts(F.col("ns")).alias("ts")).collect()
    assert [x["l"] for x in r] == ["WARN", "FATAL", None, "WARN"]
    assert [x["i"] for x in r] == [None, None, "ab", None]
    assert r[0]["ts"].replace(tzinfo=None).isoformat() == "2023-11-14T22:13:20.123457"
    assert r[1]["ts"] is None and r[3]["ts"] is None


def test_flatten_both_spellings(spark):
    camel = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "pay"}}]},
                               "scopeLogs": [{"scope": {"name": "s1"}, "logRecords": [
                                   {"timeUnixNano": "1700000000000000000", "severityNumber": 17,
                                    "body": {"kvlistValue": {"values": [{"key": "k", "value": {"stringValue": "v"}}]}},
                                    "attributes": [{"key": "exception.type", "value": {"stringValue": "IOError"}},
                                                   {"key": "exception.message", "value": {"stringValue": "disk"}},
                                                   {"key": "code.filepath", "value": {"stringValue": "a.py"}},
                                                   {"key": "code.lineno", "value": {"intValue": "9"}},
                                                   {"key": "x", "value": {"stringValue": "1"}},
                                                   {"key": "x", "value": {"stringValue": "2"}}]}]}]}]}
    snake = {"resource_logs": [{"resource": {"attributes": []}, "scope_logs": [{"log_records": [
        {"time_unix_nano": "1700000000000000000", "body": {"stringValue": "hello WARN"}}]}]}]}
    df = spark.createDataFrame([(1, json.dumps(camel)), (2, json.dumps(snake))], "request_id long, payload string")
    e = O.otlp_entries(O.flatten_otlp(df)).orderBy("request_id").collect()
    assert e[0]["service_name"] == "pay" and e[0]["level"] == "ERROR" and e[0]["message"] == "k=v"
    assert e[0]["parsed_error"] == "IOError: disk" and (e[0]["file_reference"], e[0]["line_reference"]) == ("a.py", 9)
    assert e[0]["metadata_json"]["x"] == "2" and e[0]["metadata_json"]["scope"] == "s1"
    assert e[1]["service_name"] == "unknown-service" and e[1]["level"] == "WARN"


def test_record_numbers_of_large_scopes_and_arrival_time(spark):
    rec = [{"body": {"stringValue": "x"}}] * 1500 + [{"timeUnixNano": "1700000000000000000"}]
    p = {"resourceLogs": [{"scopeLogs": [{"logRecords": rec}, {"logRecords": rec[-1:]}]}, {"scopeLogs": [{"logRecords": rec[:2]}]}]}
    df = spark.createDataFrame([(1, json.dumps(p), "2024-01-01 10:00:00")], "request_id int, payload string, received_at string") \
        .withColumn("received_at", F.to_timestamp("received_at"))
    flat = O.flatten_otlp(df, received_at="received_at")
    assert flat.select("record_no").distinct().count() == 1504
    e = O.otlp_entries(flat).groupBy(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("t")).count().collect()
    assert {r["t"]: r["count"] for r in e} == {"2024-01-01 10:00": 1502, "2023-11-14 22:13": 2}
    first = O.flatten_otlp(df).orderBy("record_no").limit(1).collect()[0]
    assert first["record_no"] == 0 and first["observed_time"] is None


def test_counts_of_any_level_and_reason(spark):
    rows = [("a", "CRITICAL", None, 1), ("a", None, None, 1), ("a", "INFO", "below_severity", 2), ("b", "INFO", "duplicate", 2), (None, "X", None, 3)]
    df = spark.createDataFrame(rows, "service_name string, level string, _reason string, request_id int")
    got = {tuple(r) for r in O.decision_counts(df).collect()}
    assert {("a", "received", "", 3), ("a", "ingested", "", 2), ("a", "dropped", "", 1), ("a", "by_level", "CRITICAL", 1),
            ("a", "by_level", "UNKNOWN", 1), ("a", "drop_reasons", "below_severity", 1), ("b", "ingested", "", 0), (None, "by_level", "X", 1)} <= got
    assert not any(r[3] == 0 and r[1] in ("by_level", "drop_reasons") for r in got)
    t = O.receiver_totals(df.withColumn("received_at", F.lit(1))).first()
    assert tuple(t)[:4] == (3, 5, 3, 2) and {tuple(r) for r in O.services_seen(df).collect()} == {("a", 2), ("b", 1), (None, 1)}


def test_nested_values_and_missing_members(spark):
    v, want = {"stringValue": "x"}, "x"
    for i in range(O.ANY_VALUE_DEPTH):
        v, want = ({"arrayValue": {"values": [v, {"intValue": i}]}}, f"[{want}, {i}]") if i % 2 else \
            ({"kvlistValue": {"values": [{"key": "k", "value": v}, {"key": "n", "value": {"boolValue": False}}]}}, f"{{k={want}, n=False}}")
    odd = {"arrayValue": {"values": [None, {"kvlistValue": {"values": [{"key": "k"}, {"value": {"stringValue": "y"}}]}}, {"arrayValue": {"values": []}}]}}
    df = spark.createDataFrame([(json.dumps(v),), (json.dumps(odd),), (None,)], "j string")
    assert [r[0] for r in df.select(O.any_value(F.col("j"))).collect()] == [want, "[None, {k={}, =y}, []]", None]


def test_severity_numbers_are_whole_numbers(spark):
    numbers = [17, "17", 17.0, 13.5, None, 0, 25, [17], {"a": 1}, 1]
    p = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"severityNumber": n, "body": {"stringValue": str(i)}} for i, n in enumerate(numbers)]
                                          + [{"body": {"stringValue": "none"}}]}]}]}
    df = spark.createDataFrame([(1, json.dumps(p))], "request_id int, payload string")
    got = [r.level for r in O.flatten_otlp(df).orderBy("record_no").collect()]
    assert got == ["ERROR", None, None, None, None, None, None, None, None, "TRACE", None]


def test_an_entrys_time_and_attributes_are_taken_once(spark):
    import json

    def rec(ns, *attrs):
        return {"timeUnixNano": str(ns), "severityNumber": 9, "body": {"stringValue": "m"},
                "attributes": [{"key": k, "value": {"stringValue": v}} for k, v in attrs]}
    recs = [rec(1_700_000_000_123_456_000, ("a", "1"), ("a", "2"), ("b", "3")),
            rec(1_700_000_000_000_000_000, ("timestamp", "2020-01-02T03:04:05+00:00"), ("code.filepath", "f.py")),
            rec(0, ("time", "2020-01-02T03:04:05+00:00"))]
    df = spark.createDataFrame([(1, json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": recs}]}]}))], "request_id int, payload string")
    e = O.otlp_entries(O.flatten_otlp(df))
    got = [(str(r["ts"]), r["file_reference"], r["metadata_json"].get("a"), r["metadata_json"].get("b")) for r in
           e.orderBy("record_no").withColumn("ts", e["ts"].cast("string")).collect()]
    assert got == [("2023-11-14 22:13:20.123456", None, "2", "3"), ("2020-01-02 03:04:05", "f.py", None, None), ("None", None, None, None)]
    plan = e.select("message", "metadata_json")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("IN (code.filepath,") == 1   # not once more for each key of the entry
