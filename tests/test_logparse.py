import datetime as dt

from pyspark.sql import functions as F

from logweave.functions import logparse as P
from logweave.sources import logs as S

UTC = dt.timezone.utc


def one(spark, expr, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(expr(F.col("t")).alias("x")).first()["x"]


def naive(v):
    return v.replace(tzinfo=None) if v is not None else None


def test_timestamp_formats(spark):
    ts = lambda s: naive(one(spark, P.parse_ts, s))
    assert ts("2024-03-01T12:34:56Z") == dt.datetime(2024, 3, 1, 12, 34, 56)
    assert ts("at 2024-03-01T12:34:56.123Z boom") == dt.datetime(2024, 3, 1, 12, 34, 56, 123000)
    assert ts("2024-03-01 12:34:56 x") == dt.datetime(2024, 3, 1, 12, 34, 56)
    assert ts("2024-03-01T12:34:56") == dt.datetime(2024, 3, 1, 12, 34, 56)
    # T-form with a fraction and no zone parses with no format -> null
    assert ts("2024-03-01T12:34:56.123") is None
    # space form with a fraction: the plain pattern still finds the seconds part
    assert ts("2024-03-01 12:34:56.789") == dt.datetime(2024, 3, 1, 12, 34, 56)
    # comma milliseconds (demo logs)
    assert ts("2025-11-14 09:31:02,456 ERROR x") == dt.datetime(2025, 11, 14, 9, 31, 2)
    # more than 6 fraction digits -> null
    assert ts("2024-03-01T12:34:56.1234567Z") is None
    assert ts("no time here") is None
    assert ts("2024-13-01T00:00:00Z") is None


def test_offset_is_dropped_in_compat_mode(spark):
    df = spark.createDataFrame([("2024-03-01T12:00:00+02:00",)], "t string")
    r = df.select(P.parse_ts(F.col("t")).alias("a"), P.parse_ts(F.col("t"), compat=False).alias("b")).first()
    assert naive(r["a"]) == dt.datetime(2024, 3, 1, 12, 0, 0)
    assert naive(r["b"]) == dt.datetime(2024, 3, 1, 10, 0, 0)


def test_level(spark):
    lv = lambda s: one(spark, P.parse_level, s)
    assert lv("2024 warning: disk") == "WARN"
    assert lv("x Error y") == "ERROR"
    assert lv("CRITICAL and ERROR") == "CRITICAL"
    assert lv("informational") is None
    assert lv("errors happen") is None


def test_file_reference(spark):
    fr = lambda s: tuple(one(spark, P.parse_file_ref, s))
    assert fr('  File "app/pay.py", line 87, in f') == ("app/pay.py", 87)
    assert fr("at com.foo.Bar.run(Bar.java:123)") == ("Bar.java", 123)
    assert fr("see handler.go:42 now") == ("handler.go", 42)
    assert fr("no reference") == (None, None)


def test_error_phrase(spark):
    er = lambda s: one(spark, P.parse_error, s)
    assert er("x: InsufficientFundsError: balance 0\nnext") == "InsufficientFundsError: balance 0"
    assert er("kernel panic now") == "panic now"
    assert er("all good") is None


DEMO = """2025-11-14 09:31:02,456 ERROR payment_processor: InsufficientFundsError: balance 0 < amount 5000 for account acc_9912
  File "app/services/payment_processor.py", line 87, in process_payment
    raise InsufficientFundsError(...)
2025-11-14 09:31:45,123 ERROR ledger: LedgerError: currency mismatch GBP != USD for transfer txn_4421
2025-11-14 09:32:01,000 WARN  fraud_detector: High-risk score 0.91 for account acc_0033
2025-11-14 09:33:12,301 INFO  payment_processor: Payment txn_5512 completed in 142ms
2025-11-14 09:34:00,000 ERROR payment_processor: Timeout waiting for bank ACK after 30s — txn_5513
"""


def test_demo_blocks(spark):
    df = spark.createDataFrame([(1, DEMO, "payment-service", "raw")], "doc_id long, text string, service_name string, source string")
    e = S.parse_log_lines(S.split_text(df)).orderBy("entry_no")
    r = e.collect()
    assert len(r) == 5
    assert r[0]["level"] == "ERROR" and r[0]["file_reference"] == "app/services/payment_processor.py"
    assert r[0]["line_reference"] == 87 and r[0]["message"].count("\n") == 2
    assert r[2]["level"] == "WARN" and r[3]["level"] == "INFO"
    # case-insensitive: the level word ERROR is the first match (reference behaviour)
    assert r[0]["parsed_error"].startswith("ERROR payment_processor: InsufficientFundsError")


def test_json_lines(spark):
    text = "\n".join([
        '{"level": "warning", "msg": "disk 91% full", "host": "a1"}',
        '{"message": null, "severity": "x"}',
        '{"message": "Boom at handler.py:12", "file": "", "line": ""}',
        'not json ERROR here',
        '{"message": "ok", "file": "m.py", "line": 3, "timestamp": "2024-01-02T03:04:05Z", "error": "E"}',
    ])
    df = spark.createDataFrame([(7, text, "svc", "raw")], "doc_id long, text string, service_name string, source string")
    r = S.parse_log_lines(S.split_text(df)).orderBy("entry_no").collect()
    assert [x["level"] for x in r] == ["WARNING", "X", None, "ERROR", None]  # JSON levels are upper-cased only
    assert r[0]["message"] == "disk 91% full" and r[0]["metadata_json"] == {"host": "a1"}
    assert r[1]["message"] == '{"message": null, "severity": "x"}'  # null message -> raw line
    assert (r[2]["file_reference"], r[2]["line_reference"]) == ("handler.py", 12)
    assert r[3]["message"] == "not json ERROR here" and r[3]["metadata_json"] is None
    assert (r[4]["file_reference"], r[4]["line_reference"], r[4]["parsed_error"]) == ("m.py", 3, "E")
    assert naive(r[4]["ts"]) == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_blocks_across_line_chunks(spark):
    n = 140_000   # spans three 65 536-line chunks
    lines = [f"2024-01-01 00:00:00 INFO step {i}" if i % 7 == 0 or i in (65_535, 65_536) else f"  frame {i}"
             for i in range(n)]
    df = spark.createDataFrame([(1, "\n".join(lines), "svc", "raw")], "doc_id long, text string, service_name string, source string")
    e = S.parse_log_lines(S.split_text(df))
    got = {r[0]: r[1] for r in e.select("entry_no", F.size(F.split("message", "\n"))).collect()}
    starts = [i for i, l in enumerate(lines) if not l.startswith("  ")]
    want = {s: (starts[k + 1] if k + 1 < len(starts) else n) - s for k, s in enumerate(starts)}
    assert got == want
