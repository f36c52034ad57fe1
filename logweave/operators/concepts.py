"""Log concepts: template mining, per-concept rollup, histograms and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import concept_rank
from ..functions.text import concept_id, template

# Fixed values (reference defaults).
HISTOGRAM_HOURS = 24
HISTOGRAM_DAYS = 7
RISING, FALLING = 1.5, 0.67


def with_templates(df: DataFrame, message: str = "message", service: str = "service_name") -> DataFrame:
    """LC3 + LC4: regex template and the concept id of (service, template)."""
    return (df.withColumn("template", template(F.col(message)))
              .withColumn("concept_id", concept_id(F.col(service), F.col("template"))))


def route_tiers(df: DataFrame, metadata: str | None = "metadata_json", source: str = "source",
                drain_available: bool = False) -> DataFrame:
    """LC5: tier1 = structured (has metadata or came from OTLP) -> regex template;
    tier2 = Drain (when a Drain pass is run); else tier3 whose fallback is the
    regex template."""
    structured = F.col(source) == "otel"
    if metadata and metadata in df.columns:
        structured = F.col(metadata).isNotNull() | structured
    other = F.lit("tier2" if drain_available else "tier3")
    return df.withColumn("tier", F.when(F.coalesce(structured, F.lit(False)), F.lit("tier1")).otherwise(other))


def tier_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def hourly_counts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(concept_id, bucket, n) per clock hour; partial aggregation keeps the shuffle small."""
    return df.groupBy("concept_id", F.date_trunc("hour", F.col(ts)).alias("bucket")) \
             .agg(F.count(F.lit(1)).alias("n"))


def daily_counts(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy("concept_id", F.date_trunc("day", F.col(ts)).alias("bucket")) \
             .agg(F.count(F.lit(1)).alias("n"))


def trim_histogram(hist: DataFrame, n: int) -> DataFrame:
    """LC8: newest ``n`` buckets that exist, per concept (with rank ``rn``, 1 = newest)."""
    w = Window.partitionBy("concept_id").orderBy(F.col("bucket").desc())
    return hist.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def trend(trimmed: DataFrame) -> DataFrame:
    """LC9: last 3 buckets vs the 3 before (0 -> 1); fewer than 2 buckets -> unknown."""
    g = trimmed.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("n_buckets"),
        F.sum(F.when(F.col("rn") <= 3, F.col("n")).otherwise(0)).alias("recent"),
        F.sum(F.when((F.col("rn") > 3) & (F.col("rn") <= 6), F.col("n")).otherwise(0)).alias("older"))
    ratio = F.col("recent") / F.when(F.col("older") == 0, F.lit(1)).otherwise(F.col("older"))
    return g.withColumn("trend", F.when(F.col("n_buckets") < 2, F.lit("unknown"))
                        .when(ratio > RISING, F.lit("rising"))
                        .when(ratio < FALLING, F.lit("falling"))
                        .otherwise(F.lit("stable")))


def _trend_of(sums: Column, n_buckets: Column) -> Column:
    recent, older = sums["recent"], sums["older"]
    ratio = recent / F.when(older == 0, F.lit(1)).otherwise(older)
    return F.when(n_buckets < 2, F.lit("unknown")).when(ratio > RISING, F.lit("rising")) \
            .when(ratio < FALLING, F.lit("falling")).otherwise(F.lit("stable"))


def rollup_concepts(df: DataFrame, ts: str = "ts", level: str = "level", service: str = "service_name",
                    order: str = "log_id", hours: int = HISTOGRAM_HOURS) -> DataFrame:
    """LC7 + LC8 + LC9: one row per concept: occurrences, highest severity
    (earliest wins ties), first and last seen, number of kept hour buckets and
    trend.

    One pass over the entries builds (concept, hour) partials (count, first,
    last, best severity); a second aggregation folds them per concept, keeping
    the newest ``hours`` buckets (a list bounded by the time span, not by the
    number of entries) for the trend. No branch re-reads the entries.
    Input: entries with ``concept_id`` and ``template``.
    """
    sev_key = F.struct(concept_rank(F.col(level)).alias("r"), (-F.unix_micros(F.col(ts))).alias("t"),
                       (-F.col(order)).alias("o"))
    hourly = df.groupBy("concept_id", F.date_trunc("hour", F.col(ts)).alias("bucket")).agg(
        F.first(service).alias("service_name"), F.first("template").alias("template"),
        F.count(F.lit(1)).alias("n"), F.max_by(F.col(level), sev_key).alias("_sev"), F.max(sev_key).alias("_key"),
        F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    g = hourly.groupBy("concept_id").agg(
        F.first("service_name").alias("service_name"), F.first("template").alias("template"),
        F.sum("n").alias("total_occurrences"), F.max_by("_sev", "_key").alias("severity"),
        F.min("_first").alias("first_seen_at"), F.max("_last").alias("last_seen_at"),
        F.collect_list(F.struct(F.col("bucket"), F.col("n"))).alias("_h"))
    newest = F.slice(F.sort_array(F.col("_h"), asc=False), 1, hours)
    sums = F.aggregate(newest, F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("recent"),
                                        F.lit(0).cast("bigint").alias("older")),
                       lambda acc, b: F.struct((acc["i"] + 1).alias("i"),
                                               (acc["recent"] + F.when(acc["i"] < 3, b["n"]).otherwise(0)).alias("recent"),
                                               (acc["older"] + F.when((acc["i"] >= 3) & (acc["i"] < 6), b["n"])
                                                .otherwise(0)).alias("older")))
    return g.withColumn("n_buckets", F.size(newest).cast("bigint")).withColumn("trend", _trend_of(sums, F.col("n_buckets"))) \
            .drop("_h")


def concepts_for_service(concepts: DataFrame, service: str, severity: str | None = None, n: int = 50) -> DataFrame:
    """LC10: concepts of one service (optionally one severity), most frequent first."""
    c = concepts.filter(F.col("service_name") == service)
    if severity:
        c = c.filter(F.col("severity") == severity.upper())
    from .ordering import top_n
    return top_n(c, [F.col("total_occurrences").desc(), F.col("concept_id")], n)


def rising_concepts(concepts: DataFrame, n: int = 20) -> DataFrame:
    """LC11: rising concepts over all services, most frequent first (top ``n``)."""
    from .ordering import top_n
    return top_n(concepts.filter(F.col("trend") == "rising"), [F.col("total_occurrences").desc(), F.col("concept_id")], n)


def concept_batch_stats(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """LC12: distinct concepts of a batch, split into created (new id) and updated."""
    ids = batch.select("concept_id").distinct()
    known = existing.select("concept_id").distinct().withColumn("_known", F.lit(True))
    j = ids.join(known, "concept_id", "left")
    return j.agg(F.count_if(F.col("_known").isNull()).alias("concepts_created"),
                 F.count_if(F.col("_known").isNotNull()).alias("concepts_updated"),
                 F.count(F.lit(1)).alias("concepts_total"))
