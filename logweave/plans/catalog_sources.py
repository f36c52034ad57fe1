"""Queries over the documented integrations and the table-maintenance sinks;
JSON bodies are built from ``events`` in pages of ten events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks import merge as M
from ..sources import integrations as I
from ..sources.tables import table
from .registry import ntz, r4, register
from .views import duck_view_sql, view


def _ev(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "event_type", "value", (F.col("event_id") / 10).cast("bigint").alias("page"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("svc"),
        F.col("ts").cast("timestamp").alias("ts"))


@register("from_loki", """
SELECT 'svc-' || CAST(user_id % 8 AS VARCHAR) AS service, ts,
  CASE WHEN contains(upper(event_type || ' event ' || CAST(event_id AS VARCHAR)), 'ERROR') THEN 'error'
       WHEN contains(upper(event_type || ' event ' || CAST(event_id AS VARCHAR)), 'WARN') THEN 'warning' ELSE 'info' END AS level,
  event_type || ' event ' || CAST(event_id AS VARCHAR) AS message FROM events""")
def from_loki(spark, sf):
    """SR7: Loki query results (built per page and job) decoded to log rows."""
    e = _ev(spark, sf)
    ns = (F.unix_micros("ts") * 1000).cast("string")
    line = F.concat_ws(" ", "event_type", F.lit("event"), F.col("event_id").cast("string"))
    st = e.groupBy("page", "svc").agg(F.array_sort(F.collect_list(F.struct("event_id", F.array(ns, line).alias("v")))).alias("vs"))
    res = st.groupBy("page").agg(F.collect_list(F.struct(F.create_map(F.lit("job"), F.col("svc")).alias("stream"),
                                                         F.transform("vs", lambda x: x["v"]).alias("values"))).alias("r"))
    body = res.select(F.to_json(F.struct(F.struct(F.col("r").alias("result")).alias("data"))).alias("body"))
    return I.from_loki(body).withColumn("ts", ntz("ts"))


@register("from_prometheus", """
SELECT 'svc-' || CAST(user_id % 8 AS VARCHAR) || '_' || CAST(event_id AS VARCHAR) AS trace_id,
  'svc-' || CAST(user_id % 8 AS VARCHAR) AS service, event_type AS operation, round(value * 1000, 4) AS duration_ms,
  make_timestamp(event_id * 1000000) AS ts FROM events""")
def from_prometheus(spark, sf):
    """SR8: Prometheus range results (sample time = event id seconds) -> trace rows."""
    e = _ev(spark, sf)
    st = e.groupBy("page", "svc", "event_type").agg(F.collect_list(F.array(
        F.col("event_id").cast("string"), F.col("value").cast("string"))).alias("vs"))
    res = st.groupBy("page").agg(F.collect_list(F.struct(
        F.create_map(F.lit("job"), F.col("svc"), F.lit("__name__"), F.col("event_type")).alias("metric"),
        F.col("vs").alias("values"))).alias("r"))
    body = res.select(F.to_json(F.struct(F.struct(F.col("r").alias("result")).alias("data"))).alias("body"))
    p = I.from_prometheus(body)
    return p.select("trace_id", "service", "operation", r4("duration_ms").alias("duration_ms"), ntz("ts").alias("ts"))


@register("from_tempo", """
SELECT event_id // 10 AS trace_id, 'svc-' || CAST(user_id % 8 AS VARCHAR) AS service, event_type AS operation,
  round(CAST(CAST(floor(value * 1000) AS BIGINT) AS DOUBLE) / 1000, 4) AS duration_ms, ts FROM events""")
def from_tempo(spark, sf):
    """SR9: Tempo traces (ten spans per trace, batches per service) -> span rows."""
    e = _ev(spark, sf)
    start = F.unix_micros("ts") * 1000
    span = F.struct(F.col("event_type").alias("name"), start.cast("string").alias("startTimeUnixNano"),
                    (start + F.floor(F.col("value") * 1000).cast("bigint") * 1000).cast("string").alias("endTimeUnixNano"))
    b = e.groupBy("page", "svc").agg(F.collect_list(span).alias("spans"))
    t = b.groupBy("page").agg(F.collect_list(F.struct(
        F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("svc").alias("stringValue")).alias("value")))
                 .alias("attributes")).alias("resource"), "spans")).alias("batches"))
    body = t.select(F.col("page").alias("trace_id"), F.to_json(F.struct("batches")).alias("body"))
    out = I.from_tempo(body)
    return out.select("trace_id", "service", "operation", r4("duration_ms").alias("duration_ms"), ntz("ts").alias("ts"))


# ------------------------------------------------------------------ sinks

@register("insert_new", """
WITH t AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'),
b AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01')
SELECT o_orderkey, o_orderstatus FROM t UNION ALL
SELECT o_orderkey, o_orderstatus FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)""")
def insert_new(spark, sf):
    """SK1: a later batch of orders inserted where the key is new (overlapping year skipped)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    t = o.filter(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")).drop("o_orderdate")
    b = o.filter(F.col("o_orderdate") >= F.lit("1994-01-01").cast("timestamp")).drop("o_orderdate")
    return M.insert_new(t, b, ["o_orderkey"])


@register("merge_counts", f"""WITH v AS ({duck_view_sql('v_deps')})
SELECT source_repo, target_repo, dependency_type, source_file, count(*) AS call_count FROM v GROUP BY ALL""")
def merge_counts(spark, sf):
    """SK2: dependency matches upserted with a counter (two batches merged)."""
    v = view(spark, sf, "v_deps").withColumn("_b", F.monotonically_increasing_id() % 2)
    keys = ["source_repo", "target_repo", "dependency_type", "source_file"]
    first = M.merge_counts(None, v.filter("_b = 0").drop("_b"), keys)
    return M.merge_counts(first, v.filter("_b = 1").drop("_b"), keys).select(*keys, "call_count")


@register("merge_coalesce", """
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name || '-v2' END, c_name) AS c_name,
       coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END, c_acctbal) AS c_acctbal, c_mktsegment FROM customer""")
def merge_coalesce(spark, sf):
    """SK3: customer updates that supply only some fields overwrite just those."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    upd = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("-v2"))).alias("c_name"),
                   F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return M.merge_coalesce(c, upd, ["c_custkey"])


@register("cascade_delete", f"""WITH l AS ({duck_view_sql('v_logs')}), c AS ({duck_view_sql('v_chunks')})
SELECT 'chunks' AS tbl, count(*) AS n FROM c WHERE repo_id NOT IN ('repo3', 'repo7')
UNION ALL SELECT 'logs_null_repo', count(*) FROM l WHERE 'repo' || CAST(log_id % 10 AS VARCHAR) IN ('repo3', 'repo7')""")
def cascade_delete(spark, sf):
    """SK5: deleting two repositories removes their chunks and nulls the repo of their logs."""
    ids = spark.createDataFrame([("repo3",), ("repo7",)], "repo_id string")
    ch = M.cascade_delete(view(spark, sf, "v_chunks"), ids)
    lg = view(spark, sf, "v_logs").withColumn("repo_id", F.concat(F.lit("repo"), (F.col("log_id") % 10).cast("string")))
    lg = M.cascade_delete(lg, ids, set_null=True)
    return ch.agg(F.count(F.lit(1)).alias("n")).withColumn("tbl", F.lit("chunks")).unionByName(
        lg.filter(F.col("repo_id").isNull()).agg(F.count(F.lit(1)).alias("n")).withColumn("tbl", F.lit("logs_null_repo")))


@register("snapshot_roundtrip", f"""WITH l AS ({duck_view_sql('v_logs')})
SELECT service_name, count(*) AS n FROM l GROUP BY 1""")
def snapshot_roundtrip(spark, sf):
    """SK6: replace-all snapshot written to a fresh version and read back."""
    from ..streaming.streams import scratch
    base = scratch(spark, "snapshot")
    s = view(spark, sf, "v_logs").groupBy("service_name").agg(F.count(F.lit(1)).alias("n"))
    M.write_snapshot(s, base)
    return M.read_snapshot(spark, base)


@register("ndjson_lines", """
SELECT vec_id, '{"type":"source","data":{"vec_id":' || CAST(vec_id AS VARCHAR) || ',"label":' || CAST(label AS VARCHAR) || '}}' AS value
FROM embeddings""")
def ndjson_lines(spark, sf):
    """SK7: one {"type","data"} JSON line per result row."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return M.to_ndjson(e, "source").withColumn("vec_id", F.get_json_object("value", "$.data.vec_id").cast("bigint"))
