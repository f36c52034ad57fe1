"""Queries over OTLP: payloads are built from ``events`` by Spark (ten events per
request, both key spellings) and decoded back; oracles compute the expected
entries directly from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logparse as P
from ..sources import otlp as O
from ..sources.logs import metadata_text
from ..sources.tables import table
from .catalog_logs import _waterfall_sql
from .registry import ntz, register
from .views import duck_view_sql, view


def _any(kind: str, v):
    return F.struct(v.alias(kind))


def events_as_otlp(events):
    """One OTLP export request per ten consecutive events; resources per service."""
    e = events.select(
        "event_id", "user_id", "event_type", "ts",
        (F.col("event_id") / 10).cast("bigint").alias("request_id"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("svc"),
        F.get_json_object("props", "$.k").alias("k"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("ns"),
        F.floor("value").cast("bigint").alias("v"))
    kv = "struct<key:string,value:struct<stringValue:string,intValue:string,boolValue:boolean," \
         "arrayValue:struct<values:array<struct<stringValue:string,intValue:string>>>>>"
    is_err = F.col("event_type") == "error"

    def attr(k, **vals):
        fields = {"stringValue": None, "intValue": None, "boolValue": None, "arrayValue": None}
        fields.update(vals)
        return F.struct(F.lit(k).alias("key"), F.struct(*[
            (v if v is not None else F.lit(None)).alias(n) for n, v in fields.items()]).alias("value")).cast(kv)

    attrs = F.filter(F.array(
        attr("user", intValue=F.col("user_id").cast("string")),
        attr("event", intValue=F.col("event_id").cast("string")),
        F.when(is_err, attr("exception.type", stringValue=F.lit("TimeoutError"))),
        F.when(is_err, attr("exception.message", stringValue=F.lit("no reply"))),
        F.when(is_err, attr("exception.stacktrace", stringValue=F.concat(
            F.lit('File "app/h'), (F.col("event_id") % 5).cast("string"), F.lit('.py", line '),
            (10 + F.col("event_id") % 7).cast("string")))),
        F.when(is_err, attr("code.filepath", stringValue=F.concat(
            F.lit("handler_"), (F.col("event_id") % 5).cast("string"), F.lit(".py")))),
        F.when(is_err, attr("code.lineno", intValue=(10 + F.col("event_id") % 7).cast("string"))),
        F.when(F.col("event_type") == "click", attr("tags", arrayValue=F.struct(F.array(
            F.struct(F.lit("a").alias("stringValue"), F.lit(None).cast("string").alias("intValue")),
            F.struct(F.lit(None).cast("string").alias("stringValue"), F.lit("1").alias("intValue"))).alias("values"))))),
        lambda x: x.isNotNull())
    body = F.when(F.col("event_type") == "purchase", F.struct(
        F.lit(None).cast("string").alias("stringValue"),
        F.struct(F.array(attr("k", intValue=F.col("k")), attr("ok", boolValue=F.lit(True))).alias("values"))
        .alias("kvlistValue"))).otherwise(F.struct(
            F.concat_ws(" ", "event_type", F.lit("took"), F.concat(F.col("v").cast("string"), F.lit("ms")))
            .alias("stringValue"),
            F.lit(None).cast(f"struct<values:array<{kv}>>").alias("kvlistValue")))
    trace = F.when(is_err, F.lpad(F.hex("event_id"), 32, "0")) \
             .when(F.col("event_type") == "view", F.lit("0" * 32))
    rec = F.struct(
        F.when(F.col("event_type") != "view", F.col("ns")).alias("timeUnixNano"),
        F.col("ns").alias("observedTimeUnixNano"),
        (F.col("user_id") % 26).cast("int").alias("severityNumber"),
        F.when(F.col("event_type") == "purchase", F.lit("warning")).alias("severityText"),
        body.alias("body"), attrs.alias("attributes"), trace.alias("traceId"))
    recs = e.groupBy("request_id", "svc").agg(F.array_sort(F.collect_list(F.struct("event_id", rec.alias("r")))).alias("rs"))
    svc_key = F.when(F.col("svc") == "svc-7", F.lit("service_name")).otherwise(F.lit("service.name"))
    res = F.struct(
        F.struct(F.array(F.struct(svc_key.alias("key"), F.struct(F.col("svc").alias("stringValue")).alias("value")))
                 .alias("attributes")).alias("resource"),
        F.array(F.struct(F.struct(F.lit("app").alias("name")).alias("scope"),
                         F.transform("rs", lambda x: x["r"]).alias("logRecords"))).alias("scopeLogs"))
    reqs = recs.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("svc", res.alias("x")))).alias("xs"))
    camel = F.to_json(F.struct(F.transform("xs", lambda x: x["x"]).alias("resourceLogs")))
    # odd requests use the snake_case spelling: rename the quoted keys of the JSON text
    snake = camel
    for a, b in [("resourceLogs", "resource_logs"), ("scopeLogs", "scope_logs"), ("logRecords", "log_records"),
                 ("observedTimeUnixNano", "observed_time_unix_nano"), ("timeUnixNano", "time_unix_nano"),
                 ("severityNumber", "severity_number"), ("severityText", "severity_text"), ("traceId", "trace_id")]:
        snake = F.replace(snake, F.lit(f'"{a}":'), F.lit(f'"{b}":'))
    return reqs.select("request_id", F.when(F.col("request_id") % 2 == 0, camel).otherwise(snake).alias("payload"))


def _otlp_entries(spark, sf):
    flat = O.flatten_otlp(events_as_otlp(table(spark, sf, "events")))
    return O.otlp_entries(flat)


_MSG = """(CASE WHEN event_type = 'purchase' THEN 'k=' || json_extract_string(props, '$.k') || ' ok=True'
     ELSE event_type || ' took ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'ms' END
  || CASE WHEN event_type = 'error' THEN chr(10) || 'File "app/h' || CAST(event_id % 5 AS VARCHAR) || '.py", line '
          || CAST(10 + event_id % 7 AS VARCHAR) ELSE '' END)"""
_BAND = """(CASE WHEN user_id % 26 BETWEEN 1 AND 24
     THEN ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'][CAST(floor((user_id % 26 - 1) / 4) AS INTEGER) + 1] END)"""
_MF, _ML = P.parse_file_sql("message")


@register("otlp_entries", f"""
WITH m AS (SELECT *, {_MSG} AS message,
             CASE WHEN (event_id // 10) % 2 = 1 THEN NULL  -- severity is read from camelCase keys only
                  WHEN event_type = 'purchase' THEN 'WARN' ELSE {_BAND} END AS lvl0 FROM events)
SELECT event_id, event_id // 10 AS request_id, 'svc-' || CAST(user_id % 8 AS VARCHAR) AS service_name,
       ts, coalesce(lvl0, {P.parse_level_sql('message')}) AS level, message,
       CASE WHEN event_type = 'error' THEN 'TimeoutError: no reply' ELSE {P.parse_error_sql('message')} END AS parsed_error,
       CASE WHEN event_type = 'error' THEN 'handler_' || CAST(event_id % 5 AS VARCHAR) || '.py' ELSE {_MF} END AS file_reference,
       CASE WHEN event_type = 'error' THEN CAST(10 + event_id % 7 AS INTEGER) ELSE {_ML} END AS line_reference,
       'event=' || CAST(event_id AS VARCHAR) || ';ingestSource=otel;scope=app;service=svc-' || CAST(user_id % 8 AS VARCHAR)
         || CASE WHEN event_type = 'click' THEN ';tags=[a, 1]' ELSE '' END
         || CASE WHEN event_type = 'error' AND event_id <> 0 THEN ';traceId=' || lpad(upper(to_hex(event_id)), 32, '0') ELSE '' END
         || ';user=' || CAST(user_id AS VARCHAR) AS metadata
FROM m""")
def otlp_entries(spark, sf):
    """SR3 + OT1-OT8: decode export payloads (both spellings) into log entries."""
    e = _otlp_entries(spark, sf)
    return e.select(e["metadata_json"]["event"].cast("bigint").alias("event_id"), "request_id", "service_name",
                    ntz("ts").alias("ts"), "level", "message", "parsed_error", "file_reference", "line_reference",
                    metadata_text(F.col("metadata_json")).alias("metadata"))


@register("otlp_level", """
SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'WARN' WHEN event_type = 'signup' THEN 'INFO'
  ELSE (CASE WHEN user_id % 26 BETWEEN 1 AND 24
     THEN ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'][CAST(floor((user_id % 26 - 1) / 4) AS INTEGER) + 1] END) END AS level
FROM events""")
def otlp_level(spark, sf):
    """OT1: severity text first (WARNING -> WARN), else the number band."""
    ev = table(spark, sf, "events")
    text = F.when(F.col("event_type") == "purchase", F.lit("warning")) \
            .when(F.col("event_type") == "signup", F.lit("info")).when(F.col("event_type") == "view", F.lit(""))
    return ev.select("event_id", O.otlp_level(text, (F.col("user_id") % 26).cast("string")).alias("level"))


@register("nanos_to_ts", """
SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE ts END AS ts FROM events""")
def nanos_to_ts(spark, sf):
    """OT2: epoch nanoseconds -> timestamp (round trip of events.ts); zero -> null."""
    ev = table(spark, sf, "events")
    ns = F.when(F.col("event_type") == "view", F.lit("0")) \
          .otherwise((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string"))
    return ev.select("event_id", ntz(O.nanos_to_ts(ns)).alias("ts"))


@register("otlp_batch_stats", _waterfall_sql() + """,
rec AS (SELECT service_name, count(*) AS received FROM v_logs GROUP BY 1),
ing AS (SELECT service_name, count(*) AS ingested,
   count(*) FILTER (WHERE coalesce(level, 'UNKNOWN') = 'TRACE') AS n_trace,
   count(*) FILTER (WHERE coalesce(level, 'UNKNOWN') = 'DEBUG') AS n_debug,
   count(*) FILTER (WHERE coalesce(level, 'UNKNOWN') = 'INFO') AS n_info,
   count(*) FILTER (WHERE coalesce(level, 'UNKNOWN') = 'WARN') AS n_warn,
   count(*) FILTER (WHERE coalesce(level, 'UNKNOWN') = 'ERROR') AS n_error,
   count(*) FILTER (WHERE coalesce(level, 'UNKNOWN') = 'FATAL') AS n_fatal,
   count(*) FILTER (WHERE coalesce(level, 'UNKNOWN') = 'UNKNOWN') AS n_unknown FROM kept GROUP BY 1)
SELECT rec.service_name, received, coalesce(ingested, 0) AS ingested, coalesce(n_trace, 0) AS n_trace,
       coalesce(n_debug, 0) AS n_debug, coalesce(n_info, 0) AS n_info, coalesce(n_warn, 0) AS n_warn,
       coalesce(n_error, 0) AS n_error, coalesce(n_fatal, 0) AS n_fatal, coalesce(n_unknown, 0) AS n_unknown,
       received - coalesce(ingested, 0) AS dropped
FROM rec LEFT JOIN ing USING (service_name)""")
def otlp_batch_stats(spark, sf):
    """OT9: per service received / ingested / dropped and kept levels."""
    from ..operators.logfilter import filter_logs
    lg = view(spark, sf, "v_logs")
    kept, reasons = filter_logs(lg)
    return O.otlp_batch_stats(lg, kept, reasons)


@register("receiver_stats", f"""
SELECT count(DISTINCT date_trunc('hour', ts)) AS total_requests_received, count(*) AS total_log_records_received,
       max(ts) AS last_received_at FROM ({duck_view_sql('v_logs')})""")
def receiver_stats(spark, sf):
    """OT10: receiver totals (a request = one clock hour of logs)."""
    lg = view(spark, sf, "v_logs").withColumn("request_id", F.date_trunc("hour", "ts"))
    return O.receiver_stats(lg, received_at="ts").withColumn("last_received_at", ntz("last_received_at"))


_DECIDED_SQL = _waterfall_sql() + """,
tagged AS (SELECT v.log_id, v.service_name, v.level, v.ts, CASE WHEN s.log_id IS NULL THEN 'below_severity' WHEN NOT d._kept THEN 'duplicate'
                  WHEN NOT r._ok THEN 'rate_limited' END AS reason
           FROM v_logs v LEFT JOIN s12 s USING (log_id) LEFT JOIN dd d USING (log_id) LEFT JOIN rl r USING (log_id))"""


def _decided(spark, sf):
    from ..operators.logfilter import filter_reasons
    return filter_reasons(view(spark, sf, "v_logs")).withColumn("request_id", F.date_trunc("hour", "ts"))


@register("decision_counts", _DECIDED_SQL + """,
m AS (SELECT service_name, 'received' AS metric, '' AS key, count(*) AS n FROM tagged GROUP BY ALL
      UNION ALL SELECT service_name, 'ingested', '', count(*) FILTER (WHERE reason IS NULL) FROM tagged GROUP BY ALL
      UNION ALL SELECT service_name, 'dropped', '', count(*) FILTER (WHERE reason IS NOT NULL) FROM tagged GROUP BY ALL
      UNION ALL SELECT service_name, 'by_level', coalesce(level, 'UNKNOWN'), count(*) FROM tagged WHERE reason IS NULL GROUP BY ALL
      UNION ALL SELECT service_name, 'drop_reasons', reason, count(*) FROM tagged WHERE reason IS NOT NULL GROUP BY ALL)
SELECT service_name, metric, key, CAST(n AS BIGINT) AS n FROM m""")
def decision_counts(spark, sf):
    """OT9: per service totals, levels and drop reasons of the waterfall, in long form."""
    return O.decision_counts(_decided(spark, sf))


@register("receiver_totals", _DECIDED_SQL + """
SELECT count(DISTINCT date_trunc('hour', ts)) AS total_requests_received, count(*) AS total_log_records_received,
       count(*) FILTER (WHERE reason IS NULL) AS total_entries_ingested, count(*) FILTER (WHERE reason IS NOT NULL) AS total_dropped,
       max(ts) AS last_received_at FROM tagged""")
def receiver_totals(spark, sf):
    """OT10: receiver totals with ingested and dropped records (a request = one clock hour of logs)."""
    return O.receiver_totals(_decided(spark, sf), received_at="ts").withColumn("last_received_at", ntz("last_received_at"))


@register("services_seen", f"""SELECT service_name, count(DISTINCT date_trunc('hour', ts)) AS n FROM ({duck_view_sql('v_logs')}) GROUP BY 1""")
def services_seen(spark, sf):
    """OT10: requests in which each service had records."""
    return O.services_seen(view(spark, sf, "v_logs").withColumn("request_id", F.date_trunc("hour", "ts")))
