"""Documented integrations: Loki query results, Prometheus range results and
Tempo traces (JSON bodies) -> log / trace rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOKI = "struct<data:struct<result:array<struct<stream:map<string,string>,values:array<array<string>>>>>>"
_PROM = "struct<data:struct<result:array<struct<metric:map<string,string>,values:array<array<string>>>>>>"
_TEMPO = ("struct<batches:array<struct<resource:struct<attributes:array<struct<key:string,"
          "value:struct<stringValue:string>>>>,spans:array<struct<name:string,startTimeUnixNano:string,"
          "endTimeUnixNano:string>>>>>")


def from_loki(df: DataFrame, body: str = "body") -> DataFrame:
    """SR7: Loki query_range JSON -> (service, ts, level, message). Level by
    substring of the upper-cased line: ERROR -> error, else WARN -> warning,
    else info; service = label ``job`` (default unknown); ns epoch -> time."""
    r = df.select(F.explode(F.from_json(F.col(body), _LOKI)["data"]["result"]).alias("s"))
    v = r.select(F.coalesce(F.col("s.stream")["job"], F.lit("unknown")).alias("service"),
                 F.explode("s.values").alias("e"))
    line = F.col("e")[1]
    up = F.upper(line)
    lvl = F.when(up.contains("ERROR"), "error").when(up.contains("WARN"), "warning").otherwise("info")
    ts = F.timestamp_micros((F.col("e")[0].cast("decimal(38,0)") / 1000).cast("bigint"))
    return v.select("service", ts.alias("ts"), lvl.alias("level"), line.alias("message"))


def from_prometheus(df: DataFrame, body: str = "body") -> DataFrame:
    """SR8: Prometheus range result -> trace rows: ``trace_id = job_ts``,
    ``duration_ms = value * 1000``, operation = metric name."""
    r = df.select(F.explode(F.from_json(F.col(body), _PROM)["data"]["result"]).alias("s"))
    v = r.select(F.col("s.metric").alias("m"), F.explode("s.values").alias("e"))
    job = F.col("m")["job"]
    return v.select(F.concat_ws("_", job, F.col("e")[0]).alias("trace_id"),
                    F.coalesce(job, F.lit("unknown")).alias("service"),
                    F.coalesce(F.col("m")["__name__"], F.lit("unknown")).alias("operation"),
                    (F.col("e")[1].cast("double") * 1000).alias("duration_ms"),
                    F.timestamp_seconds(F.col("e")[0].cast("double")).alias("ts"))


def from_tempo(df: DataFrame, body: str = "body", trace: str = "trace_id") -> DataFrame:
    """SR9: Tempo trace JSON -> span rows: service = first resource attribute's
    string value, ``duration_ms = (end - start) / 1e6``."""
    b = df.select(trace, F.explode(F.from_json(F.col(body), _TEMPO)["batches"]).alias("b"))
    s = b.select(trace, F.coalesce(F.col("b.resource.attributes")[0]["value"]["stringValue"], F.lit("unknown")).alias("service"),
                 F.explode("b.spans").alias("sp"))
    start = F.coalesce(F.col("sp.startTimeUnixNano").cast("decimal(38,0)"), F.lit(0))
    end = F.coalesce(F.col("sp.endTimeUnixNano").cast("decimal(38,0)"), F.lit(0))
    return s.select(trace, "service", F.coalesce(F.col("sp.name"), F.lit("unknown")).alias("operation"),
                    ((end - start) / 1_000_000).cast("double").alias("duration_ms"),
                    F.timestamp_micros((start / 1000).cast("bigint")).alias("ts"))
