"""Queries over the documented-only analytics (logs, traces, commits, events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..sources.tables import table
from .registry import ntz, r4, register
from .views import duck_view_sql, view

_LV = "upper(coalesce(level, ''))"


@register("log_health", f"""WITH l AS ({duck_view_sql('v_logs')})
SELECT service_name, count(*) AS log_count, count(*) FILTER (WHERE {_LV} IN ('ERROR', 'CRITICAL', 'FATAL')) AS error_count,
       count(*) FILTER (WHERE {_LV} IN ('WARN', 'WARNING')) AS warning_count,
       round(count(*) FILTER (WHERE {_LV} IN ('ERROR', 'CRITICAL', 'FATAL')) / count(*), 4) AS error_rate
FROM l GROUP BY 1""")
def log_health(spark, sf):
    """DA1: log, error, warning counts and error rate per service."""
    h = A.log_health(view(spark, sf, "v_logs"))
    return h.withColumn("error_rate", r4("error_rate"))


@register("log_anomalies", f"""WITH l AS ({duck_view_sql('v_logs')}),
h AS (SELECT service_name, date_trunc('hour', ts) AS hour, count(*) AS total_count,
             count(*) FILTER (WHERE {_LV} IN ('ERROR', 'CRITICAL', 'FATAL')) AS error_count FROM l GROUP BY 1, 2),
w AS (SELECT *, error_count / total_count AS error_rate,
        coalesce(sum(error_count) OVER r, 0) / 24.0 AS m,
        coalesce(sum(error_count * error_count) OVER r, 0) / 24.0 AS s2 FROM h
      WINDOW r AS (PARTITION BY service_name ORDER BY epoch(hour) / 3600 RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT service_name, hour, 'high_error_rate' AS type, CASE WHEN error_rate >= 0.5 THEN 'critical' ELSE 'warning' END AS severity,
       printf('Error rate is %.1f%% (threshold: 30%%)', error_rate * 100) AS message, error_count, total_count,
       round(error_rate, 4) AS error_rate,
       round(CASE WHEN s2 - m * m > 1e-12 THEN (error_count - m) / sqrt(s2 - m * m) END, 4) AS spike_score
FROM w WHERE error_rate >= 0.3""")
def log_anomalies(spark, sf):
    """DA2: hourly high-error-rate anomalies with a trailing-24h spike score."""
    a = A.log_anomalies(view(spark, sf, "v_logs"))
    return a.select("service_name", ntz("hour").alias("hour"), "type", "severity", "message", "error_count",
                    "total_count", r4("error_rate").alias("error_rate"), r4("spike_score").alias("spike_score"))


@register("trace_latency", f"""WITH t AS ({duck_view_sql('v_traces')})
SELECT service, count(*) AS trace_count, round(quantile_cont(duration_ms, 0.5), 4) AS p50_latency,
       round(quantile_cont(duration_ms, 0.95), 4) AS p95_latency, count(*) FILTER (WHERE duration_ms > 500) AS slow_count
FROM t GROUP BY 1""")
def trace_latency(spark, sf):
    """DA3: trace count, exact p50 / p95 and slow traces (> 500 ms) per service."""
    t = A.trace_latency(view(spark, sf, "v_traces"), slow_ms=500)
    return t.withColumn("p50_latency", r4("p50_latency")).withColumn("p95_latency", r4("p95_latency"))


@register("slow_traces", f"""WITH t AS ({duck_view_sql('v_traces')})
SELECT trace_id, service, operation, round(duration_ms, 4) AS duration_ms FROM t WHERE duration_ms > 500""")
def slow_traces(spark, sf):
    """DA3: traces slower than 500 ms."""
    s = A.slow_traces(view(spark, sf, "v_traces"), 500)
    return s.select("trace_id", "service", "operation", r4("duration_ms").alias("duration_ms"))


@register("bottlenecks", f"""WITH t AS ({duck_view_sql('v_traces')})
SELECT operation, round(avg(duration_ms), 4) AS avg_duration_ms, count(*) AS count FROM t GROUP BY 1
HAVING avg(duration_ms) > 200""")
def bottlenecks(spark, sf):
    """DA4: operations averaging above 200 ms."""
    return A.bottlenecks(view(spark, sf, "v_traces"), 200).withColumn("avg_duration_ms", r4("avg_duration_ms"))


_COMMIT_SQL = f"""WITH c AS ({duck_view_sql('v_commits')}), cf AS ({duck_view_sql('v_commit_files')}),
f AS (SELECT sha, count(*) AS changed_files, sum(additions) AS lines_added, sum(deletions) AS lines_deleted,
        count(DISTINCT regexp_extract(file_path, '^(.*)/[^/]*$', 1)) AS blast_radius,
        avg(CASE WHEN regexp_matches(file_path, '{A.TEST_FILE_RE}') THEN 1.0 ELSE 0.0 END) AS test_ratio FROM cf GROUP BY 1),
x AS (SELECT c.sha, c.author_email, c.committed_at, coalesce(changed_files, 0) AS changed_files,
        coalesce(lines_added, 0) AS lines_added, coalesce(lines_deleted, 0) AS lines_deleted,
        coalesce(blast_radius, 0) AS blast_radius, coalesce(test_ratio, 0.0) AS test_ratio,
        CASE {' '.join(f"WHEN regexp_matches(coalesce(message, ''), '{rx}') THEN '{n}'" for n, rx in A.COMMIT_TYPES)}
             ELSE 'other' END AS commit_type,
        dayofweek(committed_at) IN (0, 6) AS weekend, hour(committed_at) < 6 OR hour(committed_at) >= 22 AS night
      FROM c LEFT JOIN f USING (sha))"""


@register("commit_risk", _COMMIT_SQL + """
SELECT sha, changed_files, lines_added, lines_deleted, blast_radius, round(test_ratio, 4) AS test_ratio, commit_type,
       weekend, night, round(least(10.0, changed_files * 0.3 + (lines_added + lines_deleted) * 0.002 + (1 - test_ratio) * 3.0
       + CAST(weekend AS INTEGER) * 1.5 + CAST(night AS INTEGER) * 1.5), 2) AS risk_score FROM x""")
def commit_risk(spark, sf):
    """DA5: commit risk features and score."""
    r = A.commit_risk(view(spark, sf, "v_commits"), view(spark, sf, "v_commit_files"))
    return r.select("sha", "changed_files", "lines_added", "lines_deleted", "blast_radius", r4("test_ratio").alias("test_ratio"),
                    "commit_type", "weekend", "night", "risk_score")


@register("author_90d", f"""WITH c AS ({duck_view_sql('v_commits')}), cf AS ({duck_view_sql('v_commit_files')}),
n AS (SELECT sha, count(*) AS n_files FROM cf GROUP BY 1),
x AS (SELECT c.*, coalesce(n.n_files, 0) AS n_files FROM c LEFT JOIN n USING (sha))
SELECT sha, count(*) OVER w AS author_commits_90d, round(avg(n_files) OVER w, 4) AS author_avg_files FROM x
WINDOW w AS (PARTITION BY author_email ORDER BY epoch(committed_at) RANGE BETWEEN 7776000 PRECEDING AND CURRENT ROW)""")
def author_90d(spark, sf):
    """DA6: author's commits and mean files per commit over the trailing 90 days."""
    a = A.author_90d(view(spark, sf, "v_commits"), view(spark, sf, "v_commit_files"))
    return a.select("sha", "author_commits_90d", r4("author_avg_files").alias("author_avg_files"))


@register("deployment_errors", f"""WITH l AS ({duck_view_sql('v_logs')}),
d AS (SELECT event_id AS deploy_id, 'svc-' || CAST(user_id % 8 AS VARCHAR) AS service_name, ts FROM events
      WHERE event_type = 'signup')
SELECT deploy_id, d.service_name, count(l.log_id) AS errors_after FROM d LEFT JOIN l
  ON l.service_name = d.service_name AND l.ts > d.ts AND l.ts <= d.ts + INTERVAL 1 HOUR
  AND upper(coalesce(l.level, '')) IN ('ERROR', 'CRITICAL', 'FATAL')
GROUP BY 1, 2""")
def deployment_errors(spark, sf):
    """DA7: errors of the service in the hour after each deployment (signup events
    stand for deployments)."""
    ev = table(spark, sf, "events").filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("deploy_id"), F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("service_name"),
        F.col("ts").cast("timestamp").alias("ts"))
    out = A.deployment_errors(ev, view(spark, sf, "v_logs"))
    return out.select("deploy_id", "service_name", "errors_after")


@register("incident_patterns", f"""WITH c AS ({duck_view_sql('v_commits')}), cf AS ({duck_view_sql('v_commit_files')}),
i AS (SELECT DISTINCT sha FROM c WHERE message = '1-URGENT'),
p AS (SELECT DISTINCT c.sha, cf.file_path AS pattern FROM c JOIN cf USING (sha))
SELECT pattern, count(*) AS commits, count(i.sha) AS incidents, round(count(i.sha) / count(*), 4) AS incident_rate
FROM p LEFT JOIN i USING (sha) GROUP BY 1""")
def incident_patterns(spark, sf):
    """DA8: incident rate per changed file (urgent commits stand for incidents)."""
    c = view(spark, sf, "v_commits")
    inc = c.filter(F.col("message") == "1-URGENT")
    p = A.incident_patterns(inc, c, view(spark, sf, "v_commit_files"), level="file")
    return p.select("pattern", "commits", F.col("incidents").cast("bigint").alias("incidents"),
                    r4("incident_rate").alias("incident_rate"))


@register("recommendations", f"""WITH t AS ({duck_view_sql('v_traces')}), l AS ({duck_view_sql('v_logs')}),
b AS (SELECT operation, avg(duration_ms) AS a FROM t GROUP BY 1 HAVING avg(duration_ms) > 200),
h AS (SELECT service_name, count(*) FILTER (WHERE {_LV} IN ('ERROR', 'CRITICAL', 'FATAL')) / count(*) AS r FROM l GROUP BY 1),
p AS (SELECT service, quantile_cont(duration_ms, 0.95) AS p95 FROM t GROUP BY 1)
SELECT 'performance' AS type, CASE WHEN a > 1000 THEN 'high' ELSE 'medium' END AS severity,
       'Performance bottleneck in ' || operation AS title, printf('Average latency: %.0fms', a) AS description FROM b
UNION ALL SELECT 'reliability', 'high', 'High error rate in ' || service_name, printf('Error rate: %.1f%%', r * 100) FROM h WHERE r >= 0.3
UNION ALL SELECT 'latency', 'medium', 'Slow p95 in ' || service, printf('p95 latency: %.0fms', p95) FROM p WHERE p95 > 400""")
def recommendations(spark, sf):
    """DA9: recommendations from bottleneck, error-rate and latency rules."""
    t = view(spark, sf, "v_traces")
    r = A.recommend(A.bottlenecks(t, 200), A.log_health(view(spark, sf, "v_logs")), A.trace_latency(t), p95_limit=400)
    return r.select("type", "severity", "title", "description")


@register("error_rate_5m", """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors,
       round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_rate,
       count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.05 AS alert FROM events GROUP BY 1""")
def error_rate_5m(spark, sf):
    """DA10: error rate per 5-minute window with the 0.05 alert limit."""
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = A.error_rate_5m(ev, 0.05, F.col("event_type") == "error")
    return e.select(ntz("window_start").alias("window_start"), "total", "errors", r4("error_rate").alias("error_rate"), "alert")


@register("trace_latency_approx")
def trace_latency_approx(spark, sf):
    """DA3 (approximate): p50 / p95 per service with percentile_approx."""
    t = A.trace_latency_approx(view(spark, sf, "v_traces"))
    return t.select("service", F.col("p")[0].alias("p50_latency"), F.col("p")[1].alias("p95_latency"))
