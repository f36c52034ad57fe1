"""Error triage: recent errors -> nearest code -> blast radius -> confidence and
trust ladder -> pending fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import deps as D
from . import vectors as V

# Fixed values (reference configuration).
ERROR_LEVELS = ["ERROR", "CRITICAL", "FATAL", "WARN"]
RECENT_ERRORS = 10
AUTO_APPLY_MIN_CONFIDENCE = 0.80
MESSAGE_CHARS = 200
CODE_FENCE = "```"


def recent_errors(logs: DataFrame, n: int = RECENT_ERRORS, service: str | None = None, per_service: bool = False,
                  ts: str = "ts", order: str = "log_id") -> DataFrame:
    """ET1: the ``n`` most recent ERROR / CRITICAL / FATAL / WARN entries
    (optionally of one service, or ``n`` per service)."""
    e = logs.filter(F.col("level").isin(ERROR_LEVELS))
    if service:
        e = e.filter(F.col("service_name") == service)
    order_by = [F.col(ts).desc(), F.col(order).desc()]
    if not per_service:
        from .ordering import top_n
        return top_n(e, order_by, n, "recency_rank")
    w = Window.partitionBy("service_name").orderBy(*order_by)
    return e.withColumn("recency_rank", F.row_number().over(w)).filter(F.col("recency_rank") <= n)


def confidence(sim: Column, n_related: Column, text: Column) -> Column:
    """ET2: round(min(1, .5 min(sim, 1) + .2 min(n / 5, 1) + .3 ((code ? 1 : .5) + min(len / 500, 1)) / 2), 3)."""
    t = F.coalesce(text, F.lit(""))
    has_code = F.when(F.instr(t, CODE_FENCE) > 0, F.lit(1.0)).otherwise(F.lit(0.5))
    length = F.least(F.length(t) / 500.0, F.lit(1.0))
    c = F.least(sim, F.lit(1.0)) * 0.5 + F.least(n_related / 5.0, F.lit(1.0)) * 0.2 + ((has_code + length) / 2.0) * 0.3
    return F.bround(F.least(c, F.lit(1.0)), 3)


def trust_ladder(conf: Column, blast_level: Column) -> Column:
    """ET3: struct(requires_approval, auto_apply_eligible): high blast -> approval;
    confidence >= .80 and low blast -> auto-apply; everything else -> approval."""
    auto = (blast_level != "high") & (conf >= AUTO_APPLY_MIN_CONFIDENCE) & (blast_level == "low")
    return F.struct((~auto).alias("requires_approval"), auto.alias("auto_apply_eligible"))


def code_blocks(text: Column) -> Column:
    """ET4: fenced code blocks of a text joined by a blank line ('' when none)."""
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?sU)```(?:\w*)\n(.*?)```"), 1)
    from ..functions.logparse import strip_ws
    return strip_ws(F.array_join(blocks, "\n\n"))


def section(text: Column, heading: str) -> Column:
    """ET5: a named section: after the (optionally bold) heading and ':' or
    whitespace, up to a blank line followed by a capital (any letter, the match
    is case-insensitive) or the end. '' when absent."""
    from ..functions.logparse import strip_ws
    rx = r"(?isU)\*{0,2}\Q" + heading + r"\E\*{0,2}[:\s]+(.*?)(?=\n\n\*{0,2}[A-Z]|\z)"
    return strip_ws(F.regexp_extract(F.coalesce(text, F.lit("")), rx, 1))


def triage(logs: DataFrame, chunks: DataFrame, deps: DataFrame, diagnoses: DataFrame, n: int = RECENT_ERRORS,
           k: int = 5, t: float = V.HEAL_MIN_SIMILARITY) -> DataFrame:
    """ET6: recent errors -> 5 nearest chunks (kept when the best reaches ``t``) ->
    blast radius of the log's service -> confidence, trust ladder -> fix rows.

    ``logs`` carries (log_id, ts, service_name, level, message, file_reference,
    embedding); ``chunks`` (item_id, embedding, file_path, start_line, end_line,
    chunk_content); ``diagnoses`` (log_id, diagnosis) is the text-model output."""
    recent = recent_errors(logs, n).filter(F.col("embedding").isNotNull())
    hits = V.nearest_code(recent.select(F.col("log_id").alias("query_id"), "embedding"), chunks, k, t)
    top = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_related"),
        F.max_by(F.struct("item_id", "similarity"), F.struct("similarity", -F.col("item_id"))).alias("top"))
    top = V.attach(top.select(F.col("top.item_id").alias("item_id"), "query_id", "n_related",
                              F.col("top.similarity").alias("top_similarity")),
                   chunks, cols=["file_path", "start_line", "end_line", "chunk_content"])
    services = recent.select("service_name").distinct()
    blast = D.blast_radius(deps, services)
    x = recent.join(top, recent["log_id"] == top["query_id"]).join(blast, "service_name", "left") \
              .join(diagnoses, "log_id", "left")
    conf = confidence(F.col("top_similarity"), F.col("n_related"), F.col("diagnosis"))
    x = x.withColumn("confidence_score", conf).withColumn("_t", trust_ladder(conf, F.col("blast_radius_level")))
    rollback = section(F.col("diagnosis"), "Rollback Plan")
    return x.select(
        F.col("log_id").alias("fix_id"), F.col("level").alias("error_level"),
        F.substring("message", 1, MESSAGE_CHARS).alias("error_message"), F.col("service_name").alias("error_service"),
        "file_reference", F.col("file_path").alias("related_file"),
        F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("related_lines"),
        F.bround("top_similarity", 4).alias("similarity_score"), "diagnosis",
        code_blocks(F.col("diagnosis")).alias("suggested_code"), F.col("chunk_content").alias("original_code"),
        "confidence_score", "blast_radius", "blast_radius_level", "_t.requires_approval", "_t.auto_apply_eligible",
        F.when(rollback != "", rollback).alias("rollback_plan"), F.col("ts").alias("created_at"))


def pending(fixes: DataFrame, fix_id=None) -> DataFrame:
    """ET7: pending fixes newest first (rank), or the one with ``fix_id``."""
    if fix_id is not None:
        return fixes.filter(F.col("fix_id") == fix_id)
    from .ordering import global_rank
    return global_rank(fixes, [F.col("created_at").desc(), F.col("fix_id").desc()])
