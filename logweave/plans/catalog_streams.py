"""Streaming forms run over the whole input with ``availableNow``; results are
compared with the batch oracles (stream = batch)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import graph as G
from ..streaming import streams as ST
from ..sources.tables import table
from .catalog_graph import _edge_out
from .catalog_logs import _CONCEPT_COLS, _CONCEPT_SQL, _concept_cols, _dedup_sql, _gate_sql, _rate_sql
from .catalog_otlp import _BAND, _MSG, events_as_otlp
from .catalog_parse import _PARSE_SQL
from .registry import ORACLES, ntz, register
from .views import VIEW_SQL, duck_view_sql


#: Micro-batches of the queries that stream in parts, and files of each.
INGEST_BATCHES, INGEST_FILES = 4, 4


def _events_stream(spark, sf):
    path = os.path.join(sf, "events.parquet")
    # the table is one file; a glob path lets the file source accept it
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")


def _logs_stream(spark, sf):
    ev = _events_stream(spark, sf)
    sql = VIEW_SQL["v_logs"].replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}")
    return spark.sql(sql, events=ev)


@register("stream_dedup", "WITH RECURSIVE lg AS (" + duck_view_sql("v_logs") + "),"
          + _dedup_sql("lg", "service_name", "level", 3600, "dd") + """
SELECT log_id, service_name, level FROM dd WHERE _kept""")
def stream_dedup(spark, sf):
    """SS2: streaming dedup (per service and level, one hour) equals the batch form."""
    s = ST.stream_dedup(_logs_stream(spark, sf), 3600, keys=["service_name", "level"], watermark="2 hours")
    out, _, _ = ST.run_available(s.select("log_id", "service_name", "level"), "dedup")
    return out


@register("stream_rate_limit", f"SELECT log_id, service_name FROM ({_rate_sql('(' + duck_view_sql('v_logs') + ')', 1)}) WHERE _ok")
def stream_rate_limit(spark, sf):
    """SS3: streaming hourly rate limit (1 per service and hour) equals the batch form."""
    s = ST.stream_rate_limit(_logs_stream(spark, sf), 1, watermark="2 hours")
    out, _, _ = ST.run_available(s.select("log_id", "service_name"), "rate")
    return out


def _latest_batches(batch, batch_id, out):
    batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out + "/data")


@register("stream_concept_counts", f"""WITH kept AS ({duck_view_sql('v_logs')})""" + _CONCEPT_SQL
          + "SELECT concept_id, bucket, n FROM hist")
def stream_concept_counts(spark, sf):
    """SS4: hourly concept counts from a stream (update mode, last version per key)."""
    s = ST.stream_concepts(_logs_stream(spark, sf))
    _, q, out = ST.run_available(s, "concepts", mode="update", foreach_batch=_latest_batches)
    df = spark.read.parquet(out + "/data")
    from pyspark.sql import Window
    w = Window.partitionBy("concept_id", "bucket").orderBy(F.col("_batch").desc())
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1") \
             .select("concept_id", ntz("bucket").alias("bucket"), "n")


@register("stream_otlp_entries", f"""
WITH m AS (SELECT *, {_MSG} AS message,
             CASE WHEN (event_id // 10) % 2 = 1 THEN NULL
                  WHEN event_type = 'purchase' THEN 'WARN' ELSE {_BAND} END AS lvl0 FROM events)
SELECT event_id, 'svc-' || CAST(user_id % 8 AS VARCHAR) AS service_name, ts, message FROM m""")
def stream_otlp_entries(spark, sf):
    """SS1: OTLP payloads (built from events, one per line) streamed into entries."""
    src = ST.scratch(spark, "otlp-in")
    events_as_otlp(table(spark, sf, "events")).select("payload").write.text(src)
    s = ST.stream_otlp(spark, src)
    s = s.select(F.col("metadata_json")["event"].cast("bigint").alias("event_id"), "service_name", "ts", "message")
    out, _, _ = ST.run_available(s, "otlp")
    return out.withColumn("ts", ntz("ts"))


@register("stream_edges", ORACLES.get("pair_events"))
def stream_edges(spark, sf):
    """SS6: co-occurrence pairs from a stream (state = previous event per user)
    equal the batch pairing."""
    ev = _events_stream(spark, sf).withColumn(
        "entity", F.concat_ws("-", "event_type", (F.col("event_id") % 6).cast("string"))) \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    s = ST.stream_edges(ev, window_s=86400, watermark="2 days")
    out, _, _ = ST.run_available(s, "edges")
    return out.withColumn("ts", ntz("ts"))


@register("stream_edge_table", ORACLES.get("edge_rollup"))
def stream_edge_table(spark, sf):
    """SS6 + CG1: edges merged batch by batch from a stream of events in four parts equal the batch rollup."""
    src, state = ST.scratch(spark, "edges-in"), ST.scratch(spark, "edges-state")
    ev = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
                                           F.concat_ws("-", "event_type", (F.col("event_id") % 6).cast("string")).alias("entity"))
    end = ev.agg(F.max("event_id")).first()[0]
    for k in range(INGEST_BATCHES):
        ev.filter(F.floor(F.col("event_id") * INGEST_BATCHES / F.lit((end or 0) + 1)) == k).repartition(INGEST_FILES).write.parquet(os.path.join(src, f"part{k}"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", INGEST_FILES).parquet(os.path.join(src, "part*"))
    pairs = ST.stream_edges(stream, window_s=100 * 365 * 86400, watermark="2 days")
    _, q, _ = ST.run_available(pairs, "edge-table", foreach_batch=lambda b, i, out: ST.merge_edges(state)(b, i))
    return _edge_out(G.lag_stats(ST.edge_table(spark, state, ST.last_batch(q))))


@register("stream_drain")
def stream_drain(spark, sf):
    """SS5: Drain clusters maintained across micro-batches (foreachBatch + state table)."""
    state = ST.scratch(spark, "drain-state")
    logs = _logs_stream(spark, sf)
    _, q, out = ST.run_available(logs, "drain", foreach_batch=ST.stream_drain(logs, state))
    return spark.read.parquet(os.path.join(out, "clusters"))


@register("stream_late_rows")
def stream_late_rows(spark, sf):
    """SS7: rows dropped past the watermark, read from the query progress."""
    s = ST.stream_concepts(_logs_stream(spark, sf))
    _, q, _ = ST.run_available(s, "late", mode="update", foreach_batch=_latest_batches)
    return spark.createDataFrame([(ST.late_rows(q),)], "dropped_by_watermark long")


#: Entries of the log documents, through the waterfall in one go. Entries without a time are
#: neither duplicates nor limited.
_INGEST_SQL = f"""WITH RECURSIVE
lines AS (SELECT doc_id * 1000000 + entry_no AS log_id, ts, 'svc-' || CAST(doc_id % 8 AS VARCHAR) AS service_name, level, message FROM ({_PARSE_SQL})),
s12 AS ({_gate_sql('lines')}),
s12k AS (SELECT *, lower(service_name) AS svc_l, coalesce(message, '') AS msg_k FROM s12 WHERE ts IS NOT NULL),
""" + _dedup_sql("s12k", "svc_l", "msg_k", 60, "dd") + f""",
rl AS ({_rate_sql("(SELECT * FROM dd WHERE _kept)", 500)}),
pass AS (SELECT log_id, ts, service_name, level, message FROM rl WHERE _ok UNION ALL SELECT * FROM s12 WHERE ts IS NULL),
kept AS (SELECT * EXCLUDE (message), CASE WHEN length(message) > 2000 THEN substr(message, 1, 2000) || '… [truncated]' ELSE message END AS message FROM pass)
""" + _CONCEPT_SQL + f"SELECT {_CONCEPT_COLS} FROM concepts"

@register("ingest_loop", _INGEST_SQL)
def ingest_loop(spark, sf):
    """SK8: log documents streamed in four micro-batches, in time order, through
    parse -> filter -> concepts; filter state goes from batch to batch, so the concepts are
    those of all documents in one go."""
    from ..streaming import ingest as IN
    from .views import view
    src = ST.scratch(spark, "ingest-in")
    lines = view(spark, sf, "v_log_lines").withColumn(
        "service_name", F.concat(F.lit("svc-"), (F.col("doc_id") % 8).cast("string"))).withColumn("source", F.lit("file"))
    end = lines.agg(F.max("doc_id")).first()[0]
    for k in range(INGEST_BATCHES):  # folder after folder: the file source takes files by their age
        lines.filter(F.floor(F.col("doc_id") * INGEST_BATCHES / F.lit((end or 0) + 1)) == k) \
             .repartition(INGEST_FILES).write.parquet(os.path.join(src, f"part{k}"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", INGEST_FILES).parquet(os.path.join(src, "part*"))
    state = ST.scratch(spark, "ingest-state")
    ST.run_available(stream, "ingest", foreach_batch=lambda b, i, out: IN.ingest_batch(state)(b, i))
    return _concept_cols(IN.concept_table(spark, state))


@register("stream_dedup_approx")
def stream_dedup_approx(spark, sf):
    """SS2 (approximate): dropDuplicatesWithinWatermark per (service, level)."""
    s = ST.stream_dedup_approx(_logs_stream(spark, sf), ["service_name", "level"], watermark="1 hour")
    out, _, _ = ST.run_available(s.select("log_id", "service_name", "level"), "dedup-approx")
    return out
