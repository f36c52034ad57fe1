"""SK8: the micro-batch ingest loop: parse -> filter -> mine -> merge.

Each micro-batch of raw log lines is parsed into entries, filtered by the
waterfall, mapped to concepts, and its hourly concept counts are written to a
folder named by the batch id. The filters go on from where the batch before left them:
its last kept time of each message and its counts of each service and hour are tables
of their own below ``state_dir``, a folder for each batch, so a retried batch reads the same
state again and overwrites only its own output. The state holds keys of the last
``LATENESS`` before the newest entry and the windows they need.

Batches must come in time order, but for that lateness: entries that come later are
held against the state as it is (at or before a message's last kept time they are duplicates).
A document's lines must be in one batch. The concept table is the aggregate of all deltas.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import concept_rank
from ..operators import concepts as C
from ..operators.logfilter import FilterConfig, FilterState, filter_reasons, next_state, split_reasons
from ..sources.logs import parse_log_lines

#: Seconds that an entry may be behind the newest one of the batches before.
LATENESS = 3600


def _folder(state_dir: str, name: str, batch_id: int) -> str:
    return os.path.join(state_dir, name, f"batch={batch_id}")


def read_state(spark: SparkSession, state_dir: str, batch_id: int) -> FilterState:
    """The state that batch ``batch_id`` starts from; a missing one is an error, not a fresh start."""
    if batch_id == 0:
        return FilterState()
    return FilterState(*(spark.read.parquet(_folder(state_dir, name, batch_id - 1)) for name in ("last_kept", "used")))


def ingest_batch(state_dir: str, cfg: FilterConfig = FilterConfig(), lateness: float = LATENESS):
    """``foreachBatch`` function for a stream of (doc_id, line_no, line, service_name, source)."""
    def handle(batch: DataFrame, batch_id: int, out: str | None = None) -> None:
        spark = batch.sparkSession
        e = parse_log_lines(batch).withColumn("log_id", F.struct("doc_id", "entry_no"))
        state = read_state(spark, state_dir, batch_id)
        path = _folder(state_dir, "entries", batch_id)
        # every output below reads the same decisions
        filter_reasons(e, cfg, state=state).drop("metadata_json").write.mode("overwrite").parquet(path)
        tagged = spark.read.parquet(path)
        kept, reasons = split_reasons(tagged, cfg)
        worst = F.struct((-concept_rank(F.col("level"))).alias("r"), F.unix_micros("ts").alias("us"), "log_id", "level")
        delta = C.with_templates(kept).groupBy("concept_id", "service_name", "template", F.date_trunc("hour", "ts").alias("bucket")) \
            .agg(F.count(F.lit(1)).alias("n"), F.min(worst).alias("worst"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
        delta.write.mode("overwrite").parquet(_folder(state_dir, "deltas", batch_id))
        reasons.write.mode("overwrite").parquet(_folder(state_dir, "reasons", batch_id))
        after = next_state(tagged, cfg, state, lateness)
        after.last_kept.write.mode("overwrite").parquet(_folder(state_dir, "last_kept", batch_id))
        after.used.write.mode("overwrite").parquet(_folder(state_dir, "used", batch_id))
    return handle


def concept_table(spark: SparkSession, state_dir: str) -> DataFrame:
    """Concepts from all batch deltas: occurrences, severity, first and last seen, hours with data, trend."""
    d = spark.read.parquet(os.path.join(state_dir, "deltas"))
    h = d.groupBy("concept_id", "bucket").agg(F.sum("n").alias("n"))
    base = d.groupBy("concept_id").agg(
        F.min("service_name").alias("service_name"), F.min("template").alias("template"), F.sum("n").alias("total_occurrences"),
        F.min("worst").alias("_worst"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    base = base.withColumn("severity", F.col("_worst.level")).drop("_worst")
    tr = C.trend(C.trim_histogram(h, C.HISTOGRAM_HOURS))
    return base.join(tr.select("concept_id", "n_buckets", "trend"), "concept_id")


def reason_counts(spark: SparkSession, state_dir: str) -> DataFrame:
    """(reason, n) over all batches."""
    return spark.read.parquet(os.path.join(state_dir, "reasons")).groupBy("reason").agg(F.sum("n").alias("n"))
