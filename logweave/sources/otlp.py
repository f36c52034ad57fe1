"""OTLP/HTTP JSON log export payloads -> log records -> log entries.

Payloads are decoded with an explicit schema (both camelCase and snake_case
spellings); AnyValue objects are kept as JSON text and rendered by
:func:`any_value`, nested up to a fixed depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logparse import parse_level  # noqa: F401  (re-exported for callers)
from .logs import entry_from_map

# Fixed values (must equal the reference): severity number bands and the
# attribute keys that are mapped onto entry fields.
SEVERITY_BANDS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
EXCEPTION_KEYS = ["code.filepath", "code.lineno", "exception.type", "exception.message", "exception.stacktrace"]
ZERO_ID_B64 = "AAAAAAAAAAAAAAAAAAAAAA=="
#: Levels of nesting that are rendered; a value below them stays JSON text.
ANY_VALUE_DEPTH = 8

# An AnyValue decoded one level deep; nested values stay JSON text.
_AV = ("struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string,"
       "arrayValue:struct<values:array<string>>,kvlistValue:struct<values:array<struct<key:string,value:string>>>>")
_KV = f"array<struct<key:string,value:{_AV}>>"
_RECORD = ("struct<timeUnixNano:string,time_unix_nano:string,observedTimeUnixNano:string,"
           "observed_time_unix_nano:string,severityNumber:variant,severity_number:string,severityText:string,"
           f"severity_text:string,body:string,attributes:{_KV},traceId:string,trace_id:string,spanId:string,"
           "span_id:string>")
_SCOPE = f"struct<scope:struct<name:string>,logRecords:array<{_RECORD}>,log_records:array<{_RECORD}>>"
_RESOURCE = f"struct<resource:struct<attributes:{_KV}>,scopeLogs:array<{_SCOPE}>,scope_logs:array<{_SCOPE}>>"
OTLP_SCHEMA = f"struct<resourceLogs:array<{_RESOURCE}>,resource_logs:array<{_RESOURCE}>>"


def _nonempty_array(a: Column, b: Column) -> Column:
    """``x.get(a) or x.get(b) or []``."""
    return F.coalesce(F.when(F.size(a) > 0, a), F.when(F.size(b) > 0, b), F.array())


def _bool_text(j: Column) -> Column:
    return F.when(j == "true", F.lit("True")).when(j == "false", F.lit("False")).otherwise(j)


def _let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and hand it to ``fn`` (a one-element transform)."""
    return F.element_at(F.transform(F.array(expr), fn), 1)


def _parts(v: Column, depth: int) -> tuple[Column, Column]:
    """(whether an AnyValue is a list, texts of its members): arrays and key-value lists are
    brought to one form first, so the expression grows by one decoding a level, not by two."""
    arr, kvs = v["arrayValue"]["values"], v["kvlistValue"]["values"]
    members = F.coalesce(
        F.transform(arr, lambda x: F.struct(F.lit("").alias("name"), F.lit("None").alias("none"), x.alias("value"))),
        F.transform(kvs, lambda kv: F.struct(F.concat(F.coalesce(kv["key"], F.lit("")), F.lit("=")).alias("name"),
                                             F.lit("{}").alias("none"), kv["value"].alias("value"))))
    return arr.isNotNull(), F.transform(members, lambda m: F.concat(m["name"], F.coalesce(any_value(m["value"], depth - 1), m["none"])))


def render_any(v: Column, depth: int = ANY_VALUE_DEPTH) -> Column:
    """OT4 on a decoded AnyValue: scalars as text (booleans as True/False),
    arrays ``[a, b]``, kvlists ``{k=v, ...}``, nested up to ``depth`` levels;
    anything else as JSON. A null member of an array is ``None``, a key without value ``k={}``."""
    out = F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"], _bool_text(v["boolValue"]))
    if depth > 0:
        is_list, parts = _parts(v, depth)
        out = F.coalesce(out, F.concat(F.when(is_list, "[").otherwise("{"), F.array_join(parts, ", "), F.when(is_list, "]").otherwise("}")))
    return F.coalesce(out, F.to_json(v))


def any_value(j: Column, depth: int = ANY_VALUE_DEPTH) -> Column:
    """OT4 on AnyValue JSON text (decoded once)."""
    return _let(F.from_json(j, _AV), lambda v: F.coalesce(render_any(v, depth), j))


def otlp_body(j: Column) -> Column:
    """OT3: stringValue; kvlist -> ``k=v k=v``; other object -> its JSON; missing -> ''."""
    def body(v):
        kvs = v["kvlistValue"]["values"]
        kv_text = F.array_join(F.transform(kvs, lambda kv: F.concat(
            F.coalesce(kv["key"], F.lit("")), F.lit("="), any_value(kv["value"]))), " ")
        return F.when(v["stringValue"].isNotNull(), v["stringValue"]).when(kvs.isNotNull(), kv_text).otherwise(j)
    return F.when(j.isNull(), F.lit("")).otherwise(_let(F.from_json(j, _AV), body))


def attributes_map(kvs: Column) -> Column:
    """OT5: decoded KeyValue list -> map, the last occurrence of a key wins."""
    keys = F.transform(kvs, lambda x: x["key"])
    last = F.when(F.size(F.array_distinct(keys)) == F.size(kvs), kvs).otherwise(
        F.filter(kvs, lambda x, i: ~F.exists(F.slice(kvs, i + 2, F.greatest(F.size(kvs), F.lit(1))),
                                             lambda y: y["key"] == x["key"])))
    return F.coalesce(F.map_from_entries(F.transform(last, lambda kv: F.struct(
        F.coalesce(kv["key"], F.lit("")).alias("key"), render_any(kv["value"]).alias("value")))),
        F.create_map().cast("map<string,string>"))


def otlp_level(text: Column, num: Column) -> Column:
    """OT1: severity text upper-cased (WARNING -> WARN), else number 1-24 in bands of four."""
    t = F.upper(text)
    n = num.try_cast("int")
    band = F.when((n >= 1) & (n <= 24), F.element_at(F.array(*[F.lit(x) for x in SEVERITY_BANDS]),
                                                      F.floor((n - 1) / 4).cast("int") + 1))
    return F.when(t.isNotNull() & (t != ""), F.when(t == "WARNING", F.lit("WARN")).otherwise(t)).otherwise(band)


def whole_number(v: Column) -> Column:
    """A JSON value that is a whole number, else null: text such as "17" and 17.0 are none."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def nanos_to_ts(ns: Column) -> Column:
    """OT2: epoch nanoseconds (text or number) -> timestamp; empty, 0 or invalid -> null.

    Seconds are formed in double precision and the fraction rounded half-even to
    microseconds, as a float conversion of ``ns / 1e9`` does."""
    d = ns.try_cast("double") / F.lit(1e9)
    sec = F.floor(d)
    us = sec * F.lit(1_000_000) + F.bround((d - sec) * F.lit(1e6), 0).cast("bigint")
    return F.when(d.isNotNull() & (d != 0), F.timestamp_micros(us.cast("bigint")))


def clean_id(c: Column) -> Column:
    """OT6: trace / span id, trimmed; empty, all zeros or the base64 zero id -> null."""
    s = F.trim(c)
    return F.when(s.isNull() | (s == "") | (s == ZERO_ID_B64) | s.rlike("^0+$"), F.lit(None).cast("string")).otherwise(s)


#: Places of a resource, a scope and a record are digits of ``record_no`` to this base: no
#: text of 2 GB, the longest there is, holds so many of them.
_PLACES = 1 << 31


def flatten_otlp(df: DataFrame, payload: str = "payload", request: str = "request_id", received_at: str | None = None) -> DataFrame:
    """OT7 / SR3: one row per log record with service, scope, times, severity,
    body, attributes and ids. ``record_no`` is unique and ascending in a payload. A record
    with neither time takes that of ``received_at``, if a column is named."""
    got = [F.col(received_at).cast("timestamp").alias("_got")] if received_at else [F.lit(None).cast("timestamp").alias("_got")]
    p = df.select(F.col(request).alias(request), *got, F.from_json(F.col(payload), OTLP_SCHEMA).alias("_p"))
    rl = p.select(request, "_got", F.posexplode(_nonempty_array(F.col("_p.resourceLogs"), F.col("_p.resource_logs")))
                  .alias("_ri", "_r"))
    rl = rl.select(request, "_got", "_ri", "_r", attributes_map(F.coalesce(F.col("_r.resource.attributes"), F.array()))
                   .alias("_ra"))
    svc = F.coalesce(F.when(F.col("_ra")["service.name"] != "", F.col("_ra")["service.name"]),
                     F.when(F.col("_ra")["service_name"] != "", F.col("_ra")["service_name"]),
                     F.lit("unknown-service"))
    sl = rl.select(request, "_got", "_ri", svc.alias("service_name"),
                   F.posexplode(_nonempty_array(F.col("_r.scopeLogs"), F.col("_r.scope_logs"))).alias("_si", "_s"))
    lr = sl.select(request, "_got", "_ri", "_si", "service_name", F.coalesce(F.col("_s.scope.name"), F.lit("")).alias("scope"),
                   F.posexplode(_nonempty_array(F.col("_s.logRecords"), F.col("_s.log_records"))).alias("_li", "_l"))

    def pick(a, b):
        return F.coalesce(F.when(F.col(f"_l.{a}") != "", F.col(f"_l.{a}")), F.col(f"_l.{b}"))

    return lr.select(
        request, ((F.col("_ri").cast("decimal(10,0)") * F.lit(_PLACES).cast("decimal(10,0)") + F.col("_si")) * F.lit(_PLACES).cast("decimal(10,0)")
                  + F.col("_li")).cast("decimal(38,0)").alias("record_no"),
        "service_name", "scope",
        nanos_to_ts(pick("timeUnixNano", "time_unix_nano")).alias("time"),
        F.coalesce(nanos_to_ts(pick("observedTimeUnixNano", "observed_time_unix_nano")), "_got").alias("observed_time"),
        otlp_level(F.col("_l.severityText"), whole_number(F.col("_l.severityNumber"))).alias("level"),
        otlp_body(F.col("_l.body")).alias("body"),
        attributes_map(F.coalesce(F.col("_l.attributes"), F.array())).alias("attributes"),
        clean_id(pick("traceId", "trace_id")).alias("trace_id"),
        clean_id(pick("spanId", "span_id")).alias("span_id"))


def merge_exception_attrs(flat: DataFrame) -> DataFrame:
    """OT8: record -> the entry object handed to the JSON-lines parser, as a map:
    exception type/message -> ``error``, stacktrace appended to the message,
    ``code.filepath`` / ``code.lineno`` -> file / line, other attributes merged in
    (an attribute overrides an entry key of the same name)."""
    # a column of its own: the filter of the entry's keys below asks for it once for each key
    flat = flat.withColumn("_extra", F.map_filter("attributes", lambda k, v: ~k.isin(EXCEPTION_KEYS)))
    a, extra = F.col("attributes"), F.col("_extra")
    et, em, st = a["exception.type"], a["exception.message"], a["exception.stacktrace"]
    err = F.when(em.isNotNull(), F.regexp_replace(F.concat(F.coalesce(et, F.lit("")), F.lit(": "), em),
                                                  r"^[: ]+|[: ]+$", "")).otherwise(et)
    msg = F.when(st.isNotNull(), F.concat(F.col("body"), F.lit("\n"), st)).otherwise(F.col("body"))
    ts_txt = F.date_format(F.coalesce(F.col("time"), F.col("observed_time")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    base = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("timestamp", "level", "message", "service", "ingestSource", "traceId",
                                     "spanId", "scope", "file", "line", "error")]),
        F.array(ts_txt, F.col("level"), msg, F.col("service_name"), F.lit("otel"), F.col("trace_id"),
                F.col("span_id"), F.when(F.col("scope") != "", F.col("scope")), a["code.filepath"],
                a["code.lineno"], err))
    present = F.map_filter(base, lambda k, v: v.isNotNull() | k.isin("timestamp", "level", "message", "service",
                                                                        "ingestSource"))
    merged = F.map_concat(F.map_filter(present, lambda k, v: ~F.array_contains(F.map_keys(extra), k)), extra)
    return flat.withColumn("entry", merged).drop("_extra")


def otlp_entries(flat: DataFrame, request: str = "request_id") -> DataFrame:
    """SR3 end to end: records -> log entries (source ``otel``)."""
    e = merge_exception_attrs(flat)
    ts, *fields = entry_from_map(F.col("entry"), F.lit(None).cast("string"))
    # the entry's time is the text of the record's own, unless an attribute overrides it
    at = F.coalesce(F.col("time"), F.col("observed_time"))
    own = ~F.map_contains_key("attributes", "timestamp") & (at.isNull() | F.year(at).between(1000, 9999))
    return e.select(request, "record_no", F.col("entry")["service"].alias("service_name"),
                    F.lit("otel").alias("source"), F.when(own, at).otherwise(ts).alias("ts"), *fields)


def otlp_batch_stats(entries: DataFrame, kept: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """OT9: per service: records received, ingested, dropped and kept count per level."""
    rec = entries.groupBy("service_name").agg(F.count(F.lit(1)).alias("received"))
    ing = kept.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("ingested"),
        *[F.count_if(F.coalesce(F.col("level"), F.lit("UNKNOWN")) == lv).alias(f"n_{lv.lower()}")
          for lv in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN")])
    out = rec.join(ing, "service_name", "left").na.fill(0)
    return out.withColumn("dropped", F.col("received") - F.col("ingested"))


def receiver_stats(entries: DataFrame, request: str = "request_id", received_at: str = "received_at") -> DataFrame:
    """OT10: requests, records and last receive time over all requests."""
    return entries.agg(F.count_distinct(request).alias("total_requests_received"),
                       F.count(F.lit(1)).alias("total_log_records_received"),
                       F.max(received_at).alias("last_received_at"))


def decision_counts(tagged: DataFrame, level: str = "level", reason: str = "_reason") -> DataFrame:
    """OT9, long form: (service_name, metric, key, n) of records with the reason that dropped
    them (null: ingested): per service ``received``, ``ingested`` and ``dropped`` (key ''), then
    ``by_level`` of the ingested (any level there is; null is UNKNOWN) and ``drop_reasons``."""
    in_, out = F.col(reason).isNull(), F.col(reason).isNotNull()
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), k.alias("key"), c.cast("int").alias("n")) for m, k, c in (
        ("received", F.lit(""), F.lit(True)), ("ingested", F.lit(""), in_), ("dropped", F.lit(""), out),
        ("by_level", F.coalesce(F.col(level), F.lit("UNKNOWN")), in_), ("drop_reasons", F.coalesce(F.col(reason), F.lit("")), out))])
    x = tagged.groupBy("service_name", F.coalesce(F.col(level), F.lit("UNKNOWN")).alias(level), reason).agg(F.count(F.lit(1)).alias("_n"))
    x = x.select("service_name", F.explode(metrics).alias("_m"), "_n").groupBy("service_name", F.col("_m.metric").alias("metric"), F.col("_m.key").alias("key")) \
         .agg(F.sum(F.col("_n") * F.col("_m.n")).alias("n"))
    return x.filter((F.col("n") > 0) | F.col("metric").isin("received", "ingested", "dropped"))


def receiver_totals(tagged: DataFrame, request: str = "request_id", received_at: str = "received_at", reason: str = "_reason") -> DataFrame:
    """OT10: requests, records, ingested, dropped and last receive time over all requests."""
    return tagged.agg(F.count_distinct(request).alias("total_requests_received"), F.count(F.lit(1)).alias("total_log_records_received"),
                      F.count_if(F.col(reason).isNull()).alias("total_entries_ingested"), F.count_if(F.col(reason).isNotNull()).alias("total_dropped"),
                      F.max(received_at).alias("last_received_at"))


def services_seen(entries: DataFrame, request: str = "request_id") -> DataFrame:
    """OT10: (service_name, n): the requests in which each service had records."""
    return entries.groupBy("service_name").agg(F.count_distinct(request).alias("n"))
