"""Documented-only analytics (no code in the reference): log health and
anomalies, trace latency and bottlenecks, commit risk features, author
history, deployment watch, incident patterns, recommendations, 5-minute error
rate. Thresholds the documentation leaves open are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR_WORDS = ["ERROR", "CRITICAL", "FATAL"]
WARN_WORDS = ["WARN", "WARNING"]


def _is_error(level: Column) -> Column:
    return F.upper(F.coalesce(level, F.lit(""))).isin(ERROR_WORDS)


def log_health(logs: DataFrame, start=None, end=None, group: str = "service_name") -> DataFrame:
    """DA1: log, error and warning counts and the error rate (optional time range)."""
    x = logs
    if start is not None:
        x = x.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        x = x.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    lv = F.upper(F.coalesce(F.col("level"), F.lit("")))
    return x.groupBy(group).agg(F.count(F.lit(1)).alias("log_count"), F.count_if(lv.isin(ERROR_WORDS)).alias("error_count"),
                                F.count_if(lv.isin(WARN_WORDS)).alias("warning_count")) \
            .withColumn("error_rate", F.col("error_count") / F.col("log_count"))


def log_anomalies(logs: DataFrame, threshold: float = 0.3, critical: float = 0.5, window_hours: int = 24,
                  group: str = "service_name") -> DataFrame:
    """DA2: per service and clock hour, error rate and a spike score: z-score of
    the hour's error count against the trailing ``window_hours`` hours (missing
    hours count as zero). An hour with rate >= ``threshold`` is a
    ``high_error_rate`` anomaly (critical from ``critical``)."""
    h = logs.groupBy(group, F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(_is_error(F.col("level"))).alias("error_count"))
    hi = F.unix_seconds(F.col("hour")) / 3600
    w = Window.partitionBy(group).orderBy(hi).rangeBetween(-window_hours, -1)
    s1, s2 = F.coalesce(F.sum("error_count").over(w), F.lit(0)), F.coalesce(F.sum(F.col("error_count") ** 2).over(w), F.lit(0))
    mean = s1 / window_hours
    var = s2 / window_hours - mean * mean
    h = h.withColumn("error_rate", F.col("error_count") / F.col("total_count")) \
         .withColumn("spike_score", F.when(var > 1e-12, (F.col("error_count") - mean) / F.sqrt(var)))
    a = h.filter(F.col("error_rate") >= threshold)
    return a.select(group, "hour", F.lit("high_error_rate").alias("type"),
                    F.when(F.col("error_rate") >= critical, "critical").otherwise("warning").alias("severity"),
                    F.format_string(f"Error rate is %.1f%% (threshold: {threshold * 100:.0f}%%)", F.col("error_rate") * 100)
                    .alias("message"), "error_count", "total_count", "error_rate", "spike_score")


#: Steps of the value buckets of :func:`exact_percentiles`: so many for each factor of e.
BUCKET_STEPS = 4096


def exact_percentiles(df: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """(``group``, a column for each ``name: part`` of ``points``): percentiles with linear
    interpolation, exact, without a group's values in one place.

    Values fall into buckets by a monotone function; counts of (group, bucket) are
    small and tell which bucket holds a wanted rank. Only the values of those buckets are
    counted one by one, and running counts in a bucket find the rank. Null values do not
    count; a group without values has no row; NaN is the largest value."""
    v = F.col("_v")
    # log1p rises with its argument, so buckets ascend with the values
    step = F.when(F.isnan(v), F.lit((1 << 62) + 1)).when(v == float("inf"), F.lit(1 << 62)).when(v == float("-inf"), F.lit(-(1 << 62))) \
            .otherwise((F.signum(v) * F.floor(F.log1p(F.abs(v)) * BUCKET_STEPS)).cast("bigint"))
    x = df.select(F.struct(F.col(group).alias("g")).alias("_g"), F.col(value).cast("double").alias("_v")).filter(v.isNotNull()) \
          .withColumn("_b", step)
    counts = x.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))) \
                   .withColumn("_all", F.sum("_n").over(Window.partitionBy("_g")))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(part) * (F.col("_all") - 1)).alias("pos"), fn(F.lit(part) * (F.col("_all") - 1)).alias("rank"))
                       for name, part in points.items() for fn in (F.floor, F.ceil)])
    ranks = counts.withColumn("_w", F.explode(wanted)).filter((F.col("_w.rank") >= F.col("_before")) & (F.col("_w.rank") < F.col("_before") + F.col("_n"))) \
                  .select("_g", "_b", F.col("_w.name").alias("name"), F.col("_w.pos").alias("pos"), (F.col("_w.rank") - F.col("_before")).alias("rank"),
                          F.col("_w.rank").alias("whole"))
    hit = x.join(ranks.select("_g", "_b").distinct(), ["_g", "_b"], "left_semi").groupBy("_g", "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    wv = Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    hit = hit.withColumn("_before", F.coalesce(F.sum("_n").over(wv), F.lit(0)))
    found = ranks.join(hit, ["_g", "_b"]).filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n")))
    ends = found.groupBy("_g", "name").agg(F.min_by("_v", "whole").alias("low"), F.max_by("_v", "whole").alias("high"),
                                           F.min("whole").alias("a"), F.max("whole").alias("b"), F.first("pos").alias("pos"))
    at = F.when(F.col("a") == F.col("b"), F.col("low")).otherwise((F.col("b") - F.col("pos")) * F.col("low") + (F.col("pos") - F.col("a")) * F.col("high"))
    out = ends.groupBy("_g").agg(*[F.max(F.when(F.col("name") == name, at)).alias(name) for name in points])
    return out.select(F.col("_g.g").alias(group), *points)


def trace_latency(traces: DataFrame, service: str | None = None, slow_ms: float = 1000.0,
                  group: str = "service") -> DataFrame:
    """DA3: per service trace count, exact p50 / p95 latency and slow trace count."""
    from .ordering import join_null_safe
    t = traces if service is None else traces.filter(F.col(group) == service)
    base = t.groupBy(group).agg(F.count(F.lit(1)).alias("trace_count"), F.count_if(F.col("duration_ms") > slow_ms).alias("slow_count"))
    at = exact_percentiles(t, group, "duration_ms", {"p50_latency": 0.5, "p95_latency": 0.95})
    return join_null_safe(base, at, [group], "left").select(group, "trace_count", "p50_latency", "p95_latency", "slow_count")


def trace_latency_approx(traces: DataFrame, group: str = "service", accuracy: int = 10000) -> DataFrame:
    """DA3 (approximate): percentile_approx for very large groups."""
    return traces.groupBy(group).agg(F.percentile_approx("duration_ms", [0.5, 0.95], accuracy).alias("p"))


def slow_traces(traces: DataFrame, slow_ms: float = 1000.0) -> DataFrame:
    """DA3: the traces above the slow limit."""
    return traces.filter(F.col("duration_ms") > slow_ms)


def bottlenecks(traces: DataFrame, ms: float = 500.0) -> DataFrame:
    """DA4: operations whose average duration exceeds ``ms``."""
    return traces.groupBy("operation").agg(F.avg("duration_ms").alias("avg_duration_ms"), F.count(F.lit(1)).alias("count")) \
                 .filter(F.col("avg_duration_ms") > ms)


# commit type rules in priority order (documented categories)
COMMIT_TYPES = [("bugfix", r"(?i)\b(fix|patch|hotfix|bug)"), ("feature", r"(?i)\b(feat|add|new|implement)"),
                ("refactor", r"(?i)\b(refactor|clean|improve)"), ("test", r"(?i)\btest"),
                ("documentation", r"(?i)\b(doc|readme)")]
TEST_FILE_RE = r"(?i)(^|/)(test_[^/]*|[^/]*_test\.[a-z]+|tests?/.*)$"


def commit_risk(commits: DataFrame, files: DataFrame, w_files: float = 0.3, w_churn: float = 0.002,
                w_untested: float = 3.0, w_weekend: float = 1.5, w_night: float = 1.5) -> DataFrame:
    """DA5: per commit: changed files, lines added / deleted, distinct directories
    (blast radius), test ratio, type, weekend / night flags and a 0-10 score
    (weights are parameters; the documentation names only the inputs)."""
    f = files.groupBy("sha").agg(
        F.count(F.lit(1)).alias("changed_files"), F.sum("additions").alias("lines_added"),
        F.sum("deletions").alias("lines_deleted"),
        F.count_distinct(F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)).alias("blast_radius"),
        F.avg(F.col("file_path").rlike(TEST_FILE_RE).cast("double")).alias("test_ratio"))
    c = commits.join(f, "sha", "left").na.fill(0, ["changed_files", "lines_added", "lines_deleted", "blast_radius"]) \
               .na.fill(0.0, ["test_ratio"])
    ctype = None
    for name, rx in COMMIT_TYPES:
        cond = F.coalesce(F.col("message"), F.lit("")).rlike(rx)
        ctype = F.when(cond, F.lit(name)) if ctype is None else ctype.when(cond, F.lit(name))
    dow = F.dayofweek("committed_at")
    hour = F.hour("committed_at")
    c = c.withColumn("commit_type", ctype.otherwise("other")) \
         .withColumn("weekend", dow.isin(1, 7)).withColumn("night", (hour < 6) | (hour >= 22))
    score = (F.col("changed_files") * w_files + (F.col("lines_added") + F.col("lines_deleted")) * w_churn
             + (1 - F.col("test_ratio")) * w_untested + F.col("weekend").cast("double") * w_weekend
             + F.col("night").cast("double") * w_night)
    return c.withColumn("risk_score", F.round(F.least(F.lit(10.0), score), 2))


def author_90d(commits: DataFrame, files: DataFrame | None = None, days: int = 90) -> DataFrame:
    """DA6: per commit, the author's commits and mean changed files over the
    ``days`` days up to and including it.

    Exact without a per-author window: every commit also emits a probe at
    ``t - days``; chunked running sums (per author and day) over commits and
    probes give, at a commit, the totals up to it and, at its probe, the totals
    strictly before the window, so a prolific author is spread over tasks."""
    from .ordering import running_sums
    c = commits
    if files is not None:
        n = files.groupBy("sha").agg(F.count(F.lit(1)).alias("n_files"))
        c = c.join(n, "sha", "left").na.fill(0, ["n_files"])
    sec = F.unix_seconds(F.col("committed_at"))
    real = c.select("author_email", "sha", sec.alias("_t"), F.lit(1).alias("_kind"), F.col("n_files").cast("long").alias("_f"))
    probe = c.select("author_email", "sha", (sec - days * 86400).alias("_t"), F.lit(0).alias("_kind"),
                     F.lit(0).cast("long").alias("_f"))
    # a probe sorts before commits at the same second: commits exactly at the window start count
    u = real.unionByName(probe)
    u = running_sums(u, ["author_email"], ["_t", "_kind", "sha"], (F.col("_t") / 86400).cast("bigint"),
                     {"_rc": F.col("_kind"), "_rf": F.col("_f")})
    # a range frame includes every commit of the same second (its peers): take the last peer's totals
    real_u = u.filter("_kind = 1")
    peers = real_u.groupBy("author_email", "_t").agg(F.max("_rc").alias("_rc"), F.max("_rf").alias("_rf"))
    at = real_u.select("author_email", "_t", "sha").join(peers, ["author_email", "_t"]).select("sha", "_rc", "_rf")
    before = u.filter("_kind = 0").select("sha", F.col("_rc").alias("_bc"), F.col("_rf").alias("_bf"))
    w = at.join(before, "sha").select("sha", (F.col("_rc") - F.col("_bc")).alias("author_commits_90d"),
                                      ((F.col("_rf") - F.col("_bf")) / (F.col("_rc") - F.col("_bc"))).alias("author_avg_files"))
    return c.join(w, "sha")


def deployment_errors(deploys: DataFrame, logs: DataFrame, hours: int = 1) -> DataFrame:
    """DA7: error entries of the deployed service in the ``hours`` after each deployment.

    No pair of a deployment and an entry is made: entries and the two ends of each
    deployment's window stand in one time line of a service, a running count (chunked by
    hour) gives the entries up to each end, and the difference of the two is the answer. A
    deployment without a time has no errors after it; repeated deployments are rows of their own."""
    from .ordering import join_null_safe, running_sums
    errors = logs.filter(_is_error(F.col("level")) & F.col("ts").isNotNull()).select(
        F.col("service_name").alias("_svc"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"), F.lit(0).alias("_kind"), F.lit(1).alias("_one"))
    span = hours * 3_600_000_000
    begin = deploys.filter(F.col("ts").isNotNull()).select(F.col("service_name").alias("_svc"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_d")).distinct()
    # at the same time, entries come before the ends (kind 1): the window is open below, closed above
    ends = begin.select("_svc", F.explode(F.array("_d", F.col("_d") + span)).alias("_t")).distinct() \
                .withColumn("_kind", F.lit(1)).withColumn("_one", F.lit(0))
    line = running_sums(errors.unionByName(ends), ["_svc"], ["_t", "_kind"], F.floor(F.col("_t") / 3_600_000_000),
                        {"_upto": F.col("_one")}).filter("_kind = 1").select("_svc", "_t", "_upto")
    first, last = (line.select("_svc", (F.col("_t") - back).alias("_d"), F.col("_upto").alias(name)) for back, name in ((0, "_a"), (span, "_z")))
    n = join_null_safe(join_null_safe(begin, first, ["_svc", "_d"]), last, ["_svc", "_d"]) \
        .select(F.col("_svc").alias("service_name"), F.col("_d"), (F.col("_z") - F.col("_a")).alias("errors_after"))
    out = join_null_safe(deploys.withColumn("_d", F.unix_micros(F.col("ts").cast("timestamp"))), n, ["service_name", "_d"], "left")
    return out.select(*deploys.columns, F.coalesce("errors_after", F.lit(0)).cast("long").alias("errors_after"))


def incident_patterns(incidents: DataFrame, commits: DataFrame, files: DataFrame, level: str = "directory") -> DataFrame:
    """DA8: per changed pattern (directory, or file with ``level='file'``):
    commits touching it, those with an incident, and the incident rate."""
    # one row a commit with its flag: files are joined once, and not sorted again for the incidents
    known = commits.select("sha", F.lit(1).alias("_com"), F.lit(0).alias("_inc")) \
        .unionByName(incidents.select("sha", F.lit(0).alias("_com"), F.lit(1).alias("_inc"))) \
        .groupBy("sha").agg(F.max("_com").alias("_com"), F.max("_inc").alias("_inc")).filter("_com = 1").drop("_com")
    pat = F.col("file_path") if level == "file" else F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    j = known.join(files.select("sha", "file_path"), "sha").withColumn("pattern", pat).select("sha", "pattern", "_inc").distinct()
    return j.groupBy("pattern").agg(F.count(F.lit(1)).alias("commits"), F.sum("_inc").alias("incidents")) \
            .withColumn("incident_rate", F.col("incidents") / F.col("commits"))


def recommend(bottleneck: DataFrame | None = None, health: DataFrame | None = None, latency: DataFrame | None = None,
              error_threshold: float = 0.3, p95_limit: float = 1000.0) -> DataFrame:
    """DA9: recommendations from rules over DA4 / DA1 / DA3 results, one typed list."""
    parts = []
    if bottleneck is not None:
        parts.append(bottleneck.select(
            F.lit("performance").alias("type"),
            F.when(F.col("avg_duration_ms") > 1000, "high").otherwise("medium").alias("severity"),
            F.concat(F.lit("Performance bottleneck in "), F.col("operation")).alias("title"),
            F.format_string("Average latency: %.0fms", F.col("avg_duration_ms")).alias("description"),
            F.lit("Reduce latency by 40%").alias("impact"), F.lit(True).alias("auto_fixable"),
            F.lit("Add caching layer or optimize queries").alias("implementation")))
    if health is not None:
        parts.append(health.filter(F.col("error_rate") >= error_threshold).select(
            F.lit("reliability").alias("type"), F.lit("high").alias("severity"),
            F.concat(F.lit("High error rate in "), F.col("service_name")).alias("title"),
            F.format_string("Error rate: %.1f%%", F.col("error_rate") * 100).alias("description"),
            F.lit("Fewer failed requests").alias("impact"), F.lit(False).alias("auto_fixable"),
            F.lit("Investigate the most frequent error patterns").alias("implementation")))
    if latency is not None:
        parts.append(latency.filter(F.col("p95_latency") > p95_limit).select(
            F.lit("latency").alias("type"), F.lit("medium").alias("severity"),
            F.concat(F.lit("Slow p95 in "), F.col("service")).alias("title"),
            F.format_string("p95 latency: %.0fms", F.col("p95_latency")).alias("description"),
            F.lit("Faster responses").alias("impact"), F.lit(False).alias("auto_fixable"),
            F.lit("Profile the slowest operations").alias("implementation")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def error_rate_5m(events: DataFrame, limit: float = 0.05, is_error: Column | None = None) -> DataFrame:
    """DA10: error rate per 5-minute tumbling window; ``alert`` above ``limit``."""
    err = is_error if is_error is not None else _is_error(F.col("level"))
    g = events.groupBy(F.window("ts", "5 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(err).alias("errors"))
    return g.select(F.col("w.start").alias("window_start"), "total", "errors",
                    (F.col("errors") / F.col("total")).alias("error_rate")) \
            .withColumn("alert", F.col("error_rate") > limit)
