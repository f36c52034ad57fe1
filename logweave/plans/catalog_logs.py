"""Queries over logs: filters, templates, concepts (the minimum slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.levels import concept_rank_sql, ingest_rank_sql
from ..functions.text import duck_concept_id_sql, duck_template_sql
from ..operators import concepts as C
from ..operators import logfilter as L
from .registry import ntz, register
from .views import duck_view_sql, view
from ..sources.tables import table

# ---------------------------------------------------------------- helpers (SQL)


def _dedup_sql(src: str, k1: str, k2: str, seconds: float, out: str) -> str:
    """Recursive walk per key: keep when the last kept row is >= W older."""
    w = int(seconds * 1_000_000)
    return f"""
{out}_b AS (SELECT *, {k1} AS _k1, {k2} AS _k2, epoch_us(ts) AS _us,
            row_number() OVER (PARTITION BY {k1}, {k2} ORDER BY ts, log_id) AS _rn FROM {src}),
{out}_w(_k1, _k2, _rn, _last, _kept) AS (
  SELECT _k1, _k2, _rn, _us, true FROM {out}_b WHERE _rn = 1
  UNION ALL
  SELECT b._k1, b._k2, b._rn, CASE WHEN b._us - w._last >= {w} THEN b._us ELSE w._last END, b._us - w._last >= {w}
  FROM {out}_w w JOIN {out}_b b ON b._k1 IS NOT DISTINCT FROM w._k1 AND b._k2 IS NOT DISTINCT FROM w._k2
       AND b._rn = w._rn + 1),
{out} AS (SELECT b.* EXCLUDE (_k1, _k2, _us, _rn), w._kept FROM {out}_b b JOIN {out}_w w
       ON b._k1 IS NOT DISTINCT FROM w._k1 AND b._k2 IS NOT DISTINCT FROM w._k2 AND b._rn = w._rn)"""


def _gate_sql(src: str, floor_rank: int = 3) -> str:
    r = ingest_rank_sql("level")
    return f"SELECT * FROM {src} WHERE NOT ({r} >= 0 AND {r} < {floor_rank})"


def _rate_sql(src: str, n: int) -> str:
    return f"""SELECT * EXCLUDE (_rk), _rk <= {n} AS _ok FROM (SELECT *, row_number() OVER (
    PARTITION BY lower(service_name), date_trunc('hour', ts) ORDER BY ts, log_id) AS _rk FROM {src})"""


def _waterfall_sql() -> str:
    """CTEs s12 (gated), dd (dedup flags), rl (rate flags), kept (truncated)."""
    return (f"""WITH RECURSIVE
v_logs AS ({duck_view_sql('v_logs')}),
s12 AS ({_gate_sql('v_logs')}),
s12k AS (SELECT *, lower(service_name) AS svc_l, coalesce(message, '') AS msg_k FROM s12),"""
            + _dedup_sql("s12k", "svc_l", "msg_k", 60, "dd") + f""",
rl AS ({_rate_sql("(SELECT * FROM dd WHERE _kept)", 500)}),
kept AS (SELECT * EXCLUDE (message, _kept, _ok, svc_l, msg_k),
         CASE WHEN length(message) > 2000 THEN substr(message, 1, 2000) || '… [truncated]' ELSE message END AS message,
         coalesce(length(message) > 2000, false) AS truncated
         FROM rl WHERE _ok)
""")


def _logs(spark, sf):
    return view(spark, sf, "v_logs")


def _kept_logs(spark, sf):
    kept, _ = L.filter_logs(_logs(spark, sf))
    return kept


def _concepts(spark, sf):
    return C.rollup_concepts(C.with_templates(_kept_logs(spark, sf)))


_CONCEPT_SQL = """,
tk AS (SELECT *, {tmpl} AS template FROM kept),
tc AS (SELECT *, {cid} AS concept_id FROM tk),
hist AS (SELECT concept_id, date_trunc('hour', ts) AS bucket, count(*) AS n FROM tc GROUP BY 1, 2),
trim AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY bucket DESC) AS rn FROM hist
         QUALIFY rn <= 24),
tr AS (SELECT concept_id, count(*) AS n_buckets,
              sum(CASE WHEN rn <= 3 THEN n ELSE 0 END) AS recent,
              sum(CASE WHEN rn > 3 AND rn <= 6 THEN n ELSE 0 END) AS older FROM trim GROUP BY 1),
trd AS (SELECT concept_id, n_buckets,
          CASE WHEN n_buckets < 2 THEN 'unknown'
               WHEN recent / (CASE WHEN older = 0 THEN 1 ELSE older END) > 1.5 THEN 'rising'
               WHEN recent / (CASE WHEN older = 0 THEN 1 ELSE older END) < 0.67 THEN 'falling'
               ELSE 'stable' END AS trend FROM tr),
base AS (SELECT concept_id, any_value(service_name) AS service_name, any_value(template) AS template,
           count(*) AS total_occurrences,
           arg_max(level, ({crank}, -epoch_us(ts), -log_id)) AS severity,
           min(ts) AS first_seen_at, max(ts) AS last_seen_at
         FROM tc GROUP BY 1),
concepts AS (SELECT * FROM base JOIN trd USING (concept_id))
""".format(tmpl=duck_template_sql("message"), cid=duck_concept_id_sql("service_name", "template"),
           crank=concept_rank_sql("level"))

_CONCEPT_COLS = ("concept_id, service_name, template, severity, total_occurrences, "
                 "first_seen_at, last_seen_at, n_buckets, trend")


def _concept_cols(df, *extra):
    return df.select("concept_id", "service_name", "template", "severity", "total_occurrences",
                     ntz("first_seen_at").alias("first_seen_at"), ntz("last_seen_at").alias("last_seen_at"),
                     "n_buckets", "trend", *extra)


# ------------------------------------------------------------------ queries


def _rank_cols(df):
    return _concept_cols(df, "rank")


@register("rising_log_patterns", _waterfall_sql() + _CONCEPT_SQL + f"""
SELECT {_CONCEPT_COLS}, rank FROM (SELECT *, row_number() OVER (ORDER BY total_occurrences DESC, concept_id) AS rank
FROM concepts WHERE trend = 'rising') WHERE rank <= 20""")
def rising_log_patterns(spark, sf):
    """Minimum slice: logs -> filter waterfall -> templates -> rollup -> trend -> top rising."""
    return _rank_cols(C.rising_concepts(_concepts(spark, sf), 20))


@register("concept_rollup", _waterfall_sql() + _CONCEPT_SQL + f"SELECT {_CONCEPT_COLS} FROM concepts")
def concept_rollup(spark, sf):
    """LC7/LC9 over the kept logs: every concept with counts, severity, trend."""
    return _concept_cols(_concepts(spark, sf))


@register("concepts_for_service", _waterfall_sql() + _CONCEPT_SQL + f"""
SELECT {_CONCEPT_COLS}, rank FROM (SELECT *, row_number() OVER (ORDER BY total_occurrences DESC, concept_id) AS rank
FROM concepts WHERE service_name = 'svc-3' AND severity = 'ERROR') WHERE rank <= 50""")
def concepts_for_service(spark, sf):
    """LC10: concepts of one service at one severity, top 50 by occurrences."""
    return _rank_cols(C.concepts_for_service(_concepts(spark, sf), "svc-3", "error", 50))


_ALL_CONCEPTS_SQL = f"""WITH kept AS ({duck_view_sql('v_logs')})""" + _CONCEPT_SQL


def _all_tc(spark, sf):
    return C.with_templates(_logs(spark, sf))


@register("concept_histogram", _ALL_CONCEPTS_SQL + "SELECT concept_id, bucket, n, rn FROM trim")
def concept_histogram(spark, sf):
    """LC8: newest 24 existing hour buckets per concept (all logs, unfiltered)."""
    h = C.trim_histogram(C.hourly_counts(_all_tc(spark, sf)), 24)
    return h.select("concept_id", ntz("bucket").alias("bucket"), "n", "rn")


@register("concept_daily", _ALL_CONCEPTS_SQL + """,
days AS (SELECT concept_id, date_trunc('day', ts) AS bucket, count(*) AS n FROM tc GROUP BY 1, 2)
SELECT concept_id, bucket, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY bucket DESC) AS rn
FROM days) WHERE rn <= 7""")
def concept_daily(spark, sf):
    """LC8 (days): newest 7 existing day buckets per concept."""
    h = C.trim_histogram(C.daily_counts(_all_tc(spark, sf)), 7)
    return h.select("concept_id", ntz("bucket").alias("bucket"), "n", "rn")


@register("concept_trend_all", _ALL_CONCEPTS_SQL + f"SELECT {_CONCEPT_COLS} FROM concepts")
def concept_trend_all(spark, sf):
    """LC7 + LC9 over all logs (no filter)."""
    return _concept_cols(C.rollup_concepts(_all_tc(spark, sf)))


@register("concept_batch_stats", _ALL_CONCEPTS_SQL + """,
old AS (SELECT DISTINCT concept_id FROM tc WHERE ts < TIMESTAMP '2024-01-16'),
new AS (SELECT DISTINCT concept_id FROM tc WHERE ts >= TIMESTAMP '2024-01-16')
SELECT count(*) FILTER (WHERE o.concept_id IS NULL) AS concepts_created,
       count(*) FILTER (WHERE o.concept_id IS NOT NULL) AS concepts_updated,
       count(*) AS concepts_total
FROM new n LEFT JOIN old o USING (concept_id)""")
def concept_batch_stats(spark, sf):
    """LC12: concepts of the second half of the period split into created / updated."""
    tc = _all_tc(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp")
    return C.concept_batch_stats(tc.filter(F.col("ts") >= cut), tc.filter(F.col("ts") < cut))


@register("log_templates", f"""
SELECT doc_id, {duck_template_sql('text')} AS template,
       {duck_concept_id_sql('source', duck_template_sql('text'))} AS concept_id FROM documents""")
def log_templates(spark, sf):
    """LC1-LC4 over whole documents: template and concept id per text."""

    d = table(spark, sf, "documents")
    return C.with_templates(d, message="text", service="source").select("doc_id", "template", "concept_id")


@register("severity_gate", f"SELECT log_id, level FROM ({_gate_sql('(' + duck_view_sql('v_logs') + ')')})")
def severity_gate(spark, sf):
    """FL1: drop entries below WARN; unknown levels pass."""
    return L.severity_gate(_logs(spark, sf)).select("log_id", "level")


@register("allow_services", f"""SELECT log_id, service_name FROM ({duck_view_sql('v_logs')})
WHERE lower(service_name) IN ('svc-1', 'svc-2', 'svc-3')""")
def allow_services(spark, sf):
    """FL2: comma list, trimmed and case-insensitive."""
    return L.allow_services(_logs(spark, sf), " svc-1, SVC-2 ,svc-3,").select("log_id", "service_name")


@register("dedup_window", "WITH RECURSIVE lg AS (" + duck_view_sql("v_logs") + "),"
          + _dedup_sql("lg", "service_name", "level", 3600, "dd") + """
SELECT log_id, service_name, level FROM dd WHERE _kept""")
def dedup_window(spark, sf):
    """FL3: per (service, level), a row within an hour of the last kept one is dropped."""
    lg = _logs(spark, sf)
    return L.dedup_window(lg, ["service_name", "level"], "ts", 3600, "log_id").select("log_id", "service_name", "level")


@register("rate_limit", f"SELECT log_id, service_name FROM ({_rate_sql('(' + duck_view_sql('v_logs') + ')', 1)}) WHERE _ok")
def rate_limit(spark, sf):
    """FL4: first entry per service and clock hour."""
    return L.rate_limit(_logs(spark, sf), "service_name", "ts", 1, "log_id").select("log_id", "service_name")


@register("truncate_messages", """
SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '… [truncated]' ELSE text END AS message,
       coalesce(length(text) > 2000, false) AS truncated FROM documents""")
def truncate_messages(spark, sf):
    """FL5: messages over 2000 characters are clipped and marked."""

    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("message"))
    return L.truncate_messages(d, 2000)


@register("filter_logs_kept", _waterfall_sql() + "SELECT log_id, service_name, level, message, truncated FROM kept")
def filter_logs_kept(spark, sf):
    """FL6: entries surviving the ordered waterfall."""
    return _kept_logs(spark, sf).select("log_id", "service_name", "level", "message", "truncated")


_REASONS_SQL = _waterfall_sql() + f""",
rs AS (SELECT 'below_severity' AS reason FROM v_logs WHERE NOT (log_id IN (SELECT log_id FROM s12))
       UNION ALL SELECT 'duplicate' FROM dd WHERE NOT _kept
       UNION ALL SELECT 'rate_limited' FROM rl WHERE NOT _ok
       UNION ALL SELECT 'truncated' FROM kept WHERE truncated)
"""


@register("filter_logs_reasons", _REASONS_SQL + "SELECT reason, count(*) AS n FROM rs GROUP BY reason")
def filter_logs_reasons(spark, sf):
    """FL6: drop counts by first reason (truncation counted, not dropped)."""
    _, reasons = L.filter_logs(_logs(spark, sf))
    return reasons


@register("ingest_summary", _REASONS_SQL + """
SELECT 'by_level' AS metric, coalesce(level, 'UNKNOWN') AS key, count(*) AS n FROM kept GROUP BY 2
UNION ALL SELECT 'ingested', '', count(*) FROM kept
UNION ALL SELECT 'dropped', '', count(*) FROM rs WHERE reason <> 'truncated'""")
def ingest_summary(spark, sf):
    """FL7: kept / dropped totals and kept count per level."""
    kept, reasons = L.filter_logs(_logs(spark, sf))
    return L.ingest_summary(kept, reasons)
