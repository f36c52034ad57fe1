"""Structured Streaming forms of the log, concept and edge operators.

Sources are file streams; stateful steps keep exact per-key state with
``applyInPandasWithState`` and evict it by event-time timeout; sinks write
Parquet under a folder below ``spark.checkpoint.dir`` (shared on a cluster).
``run_available`` drives a query with ``availableNow`` so batch and stream
results can be compared.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import concepts as C
from ..operators import drain as D
from ..operators import graph as G
from ..session import ensure_checkpoint_dir
from ..sources import otlp as O


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def run_available(df: DataFrame, name: str, mode: str = "append", foreach_batch=None):
    """Run a streaming DataFrame over all available input (``availableNow``) into a
    Parquet folder (or a ``foreachBatch`` function ``f(batch, id, out_dir)``);
    returns (result or None, query, out_dir)."""
    spark = df.sparkSession
    out = scratch(spark, name)
    w = df.writeStream.option("checkpointLocation", out + "/_checkpoint").trigger(availableNow=True).outputMode(mode)
    if foreach_batch is not None:
        q = w.foreachBatch(lambda b, i: foreach_batch(b, i, out)).start()
    else:
        q = w.format("parquet").option("path", out + "/data").start()
    q.awaitTermination()
    if foreach_batch is not None:
        return None, q, out
    return spark.read.schema(df.schema).parquet(out + "/data"), q, out


def stream_otlp(spark: SparkSession, path: str, max_files: int | None = None, wholetext: bool = False) -> DataFrame:
    """SS1: OTLP JSON payloads -> log entries (stateless). Default input is one
    payload per line (splittable files); ``wholetext`` reads one payload per file."""
    r = spark.readStream
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    raw = r.text(path, wholetext=wholetext).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("request_id"))
    return O.otlp_entries(O.flatten_otlp(raw))


def _in_order(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A key's rows of this micro-batch in time order. Spark hands them over in Arrow
    chunks in any order, so they are sorted together; the source's options (files or bytes
    for each trigger) bound what one micro-batch holds."""
    parts = list(pdfs)
    if parts:
        yield (pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]).sort_values(["_us", "_o"], kind="stable")


def _dedup_state(w_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for pdf in _in_order(pdfs):
            keep = []
            for us in pdf["_us"].to_numpy():
                if pd.isna(us):          # no time: kept, state unchanged (as the batch form)
                    keep.append(True)
                    continue
                ok = last is None or us - last >= w_us
                keep.append(ok)
                if ok:
                    last = int(us)
            out = pdf[keep]
            if len(out):
                yield out.drop(columns=["_k1", "_k2"])
        if last is not None:
            state.update((int(last),))
            state.setTimeoutTimestamp(int(last // 1000 + w_us // 1000 + 1))
    return fn


def stream_dedup(df: DataFrame, seconds: float = 60.0, keys: list | None = None, ts: str = "ts",
                 order: str = "log_id", watermark: str = "10 minutes") -> DataFrame:
    """SS2: exact last-kept duplicate suppression per key (default: lower-cased
    service and message): the state is the last kept time; it is evicted once
    the watermark passes the end of its window (a later row then starts fresh,
    as the batch form does)."""
    w_us = int(seconds * 1_000_000)
    k1, k2 = keys or [F.coalesce(F.lower("service_name"), F.lit("")), F.coalesce(F.col("message"), F.lit(""))]
    k1 = F.col(k1) if isinstance(k1, str) else k1
    k2 = F.col(k2) if isinstance(k2, str) else k2
    x = df.withWatermark(ts, watermark).withColumn("_k1", k1.cast("string")).withColumn("_k2", k2.cast("string")) \
          .withColumn("_us", F.unix_micros(F.col(ts))).withColumn("_o", F.col(order).cast("bigint"))
    out_schema = x.drop("_k1", "_k2").schema
    return x.groupBy("_k1", "_k2").applyInPandasWithState(
        _dedup_state(w_us), out_schema, "last_us long", "append", GroupStateTimeout.EventTimeTimeout) \
        .drop("_us", "_o")


def _rate_state(n: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        for pdf in _in_order(pdfs):
            room = max(0, n - used)
            out = pdf.iloc[:room]
            used += len(out)
            if len(out):
                yield out.drop(columns=["_svc", "_hour"])
        state.update((int(used),))
        hour_ms = int(key[1].timestamp() * 1000) if hasattr(key[1], "timestamp") else int(key[1])
        state.setTimeoutTimestamp(hour_ms + 3_600_000 + 1)
    return fn


def stream_rate_limit(df: DataFrame, n: int = 500, service: str = "service_name", ts: str = "ts",
                      order: str = "log_id", watermark: str = "10 minutes") -> DataFrame:
    """SS3: first ``n`` rows per service and clock hour; the state is the
    hour's count, dropped when the watermark passes the hour."""
    x = df.withWatermark(ts, watermark).withColumn("_svc", F.coalesce(F.lower(service), F.lit(""))) \
          .withColumn("_hour", F.date_trunc("hour", F.col(ts))) \
          .withColumn("_us", F.unix_micros(F.col(ts))).withColumn("_o", F.col(order).cast("bigint"))
    out_schema = x.drop("_svc", "_hour").schema
    return x.groupBy("_svc", "_hour").applyInPandasWithState(
        _rate_state(n), out_schema, "used long", "append", GroupStateTimeout.EventTimeTimeout).drop("_us", "_o")


def stream_concepts(df: DataFrame, ts: str = "ts", watermark: str = "2 hours") -> DataFrame:
    """SS4: hourly concept counts with a watermark (append mode emits an hour
    once it is complete)."""
    t = C.with_templates(df)
    return t.withWatermark(ts, watermark).groupBy("concept_id", F.window(ts, "1 hour").alias("w")) \
            .agg(F.count(F.lit(1)).alias("n")).select("concept_id", F.col("w.start").alias("bucket"), "n")


def stream_drain(df: DataFrame, state_dir: str):
    """SS5: a ``foreachBatch`` function keeping Drain clusters across batches.

    The cluster state is the ordered list of distinct templates per service (it
    grows with template variety only), stored as a versioned table under
    ``state_dir``; each batch appends its new templates and re-derives the
    clusters, so the result equals the batch form over all data so far."""
    def handle(batch: DataFrame, batch_id: int, out: str) -> None:
        spark = batch.sparkSession
        t = C.with_templates(batch).groupBy("service_name", "template").agg(
            F.min(F.struct(F.col("ts").alias("t"), F.col("log_id").alias("o"))).alias("_f")) \
            .select("service_name", "template", F.col("_f.t").alias("ts"), F.col("_f.o").alias("log_id"))
        known_path = os.path.join(state_dir, "templates")
        hpath = spark._jvm.org.apache.hadoop.fs.Path(known_path)
        if hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
            known = spark.read.parquet(known_path)
            allt = known.unionByName(t).groupBy("service_name", "template").agg(
                F.min(F.struct("ts", "log_id")).alias("_f")) \
                .select("service_name", "template", F.col("_f.ts").alias("ts"), F.col("_f.log_id").alias("log_id"))
        else:  # first batch
            allt = t
        allt = allt.checkpoint(eager=True)  # cut lineage before rewriting the state table
        allt.write.mode("overwrite").parquet(known_path)
        D.drain_templates(spark.read.parquet(known_path)).write.mode("overwrite").parquet(os.path.join(out, "clusters"))
    return handle


#: Groups that the partition keys of the pairing are dealt into: a group is one call of the
#: Python worker and one row of state for all of its keys.
PAIR_GROUPS = 1024


def _pair_state(window_us: int):
    """Pairs of one group of keys; its state is the last event of each of its keys."""
    def live(keys, entities, times, watermark_ms, state):
        ends = [t // 1000 + window_us // 1000 + 1 for t in times]
        kept = [i for i, end in enumerate(ends) if end > watermark_ms]
        if not kept:
            if state.exists:
                state.remove()
            return
        state.update(([keys[i] for i in kept], [entities[i] for i in kept], [times[i] for i in kept]))
        state.setTimeoutTimestamp(min(ends[i] for i in kept))

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, entities, times = (list(x) for x in state.get) if state.exists else ([], [], [])
        if state.hasTimedOut:
            live(keys, entities, times, state.getCurrentWatermarkMs(), state)
            return
        new = pd.concat(list(pdfs), ignore_index=True)
        n = len(keys)
        of, names = pd.factorize(np.concatenate([np.array(keys, object), new["_p"].to_numpy(object)]), use_na_sentinel=False)
        ent = np.concatenate([np.array(entities, object), new["entity"].to_numpy(object)])
        us = np.concatenate([np.array(times, np.int64), new["_us"].to_numpy(np.int64)])
        # a key's last event before this micro-batch comes first, whatever its time
        order = np.lexsort((np.arange(len(us)), np.r_[np.zeros(n, np.int64), new["_o"].fillna(0).to_numpy(np.int64)], us, np.arange(len(us)) >= n, of))
        kind = pd.factorize(ent)[0]
        prev, here = order[:-1], order[1:]
        pair = (of[prev] == of[here]) & (kind[prev] >= 0) & (kind[here] >= 0) & (kind[prev] != kind[here]) & (us[here] - us[prev] <= window_us)
        prev, here = prev[pair], here[pair]
        if len(here):
            yield pd.DataFrame({"source_entity": ent[prev], "target_entity": ent[here], "lag_ms": (us[here] - us[prev]) / 1000.0,
                                "ts": new["ts"].to_numpy()[here - n]})
        last = order[np.r_[of[order][1:] != of[order][:-1], True]]
        live([None if pd.isna(x) else x for x in names[of[last]]], [None if pd.isna(x) else x for x in ent[last]], us[last].tolist(),
             state.getCurrentWatermarkMs(), state)
    return fn


def stream_edges(df: DataFrame, entity: str = "entity", partition: str = "user_id", ts: str = "ts",
                 order: str = "event_id", window_s: float = 86400, watermark: str = "1 hour") -> DataFrame:
    """SS6: co-occurrence rows from a stream: each event paired with the previous
    event of its partition key (state = that event), as the batch pairing does;
    the rows feed the edge rollup (CG1) in ``foreachBatch`` or a later batch job. Keys are dealt
    into ``PAIR_GROUPS`` groups by a hash, each paired in one call; events without a time pair with none."""
    x = df.withWatermark(ts, watermark).filter(F.col(ts).isNotNull()) \
          .select(F.pmod(F.xxhash64(partition), F.lit(PAIR_GROUPS)).alias("_g"), F.col(partition).cast("string").alias("_p"), F.col(entity).alias("entity"), ts,
                  F.unix_micros(F.col(ts)).alias("_us"), F.col(order).cast("bigint").alias("_o"))
    return x.groupBy("_g").applyInPandasWithState(
        _pair_state(int(window_s * 1_000_000)), "source_entity string, target_entity string, lag_ms double, ts timestamp",
        "keys array<string>, entities array<string>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def merge_edges(state_dir: str):
    """SS6 into CG1: a ``foreachBatch`` function that merges each batch's co-occurrence
    rows into the edge table. The batch is read once, when its rows are written; its summary is
    merged with that of the batches before, and gives every edge whose summary tells all. An
    edge that needs its rows (a first lag below zero, or incidents without a lag) is rolled up again from those of all
    batches if this one touches it, else carried over. Rows, summaries and table are written to
    folders of the batch id, so a retried batch gives the same."""
    key = ["source_entity", "target_entity"]

    def handle(batch: DataFrame, batch_id: int, out: str | None = None) -> None:
        spark = batch.sparkSession

        def at(name: str, k: int = batch_id) -> str:
            return os.path.join(state_dir, name, str(k))

        def rows(first: int) -> DataFrame:
            return spark.read.schema(batch.schema).parquet(*[at("pairs", k) for k in range(first, batch_id + 1)])
        batch.write.mode("overwrite").parquet(at("pairs"))
        new = G.summarize_edges(rows(batch_id))
        if batch_id:
            new = G.merge_summaries(spark.read.parquet(at("summaries", batch_id - 1)), new)
        new.write.mode("overwrite").parquet(at("summaries"))
        summaries = spark.read.parquet(at("summaries"))
        edges = G.edges_of_summaries(summaries)
        rest = summaries.filter(~F.coalesce(G.summary_tells(), F.lit(False))).select(*key)
        if not rest.isEmpty():
            touched = rest.join(rows(batch_id).select(*key).distinct(), key, "left_semi")
            edges = edges.unionByName(G.rollup_edges(rows(0).join(touched, key, "left_semi")))
            if batch_id:
                kept = edge_table(spark, state_dir, batch_id - 1).join(rest, key, "left_semi").join(touched, key, "left_anti")
                edges = edges.unionByName(kept)
        edges.write.mode("overwrite").parquet(at("edges"))
    return handle


def edge_table(spark: SparkSession, state_dir: str, batch_id: int) -> DataFrame:
    """The edge table after a batch of :func:`merge_edges`."""
    return spark.read.parquet(os.path.join(state_dir, "edges", str(batch_id)))


def last_batch(query) -> int:
    """The id of the last micro-batch of a query that has ended."""
    return max(p["batchId"] for p in query.recentProgress)


def late_rows(query) -> int:
    """SS7: rows dropped past the watermark in the last progress of a query."""
    p = query.lastProgress or {}
    return int(sum(s.get("numRowsDroppedByWatermark", 0) for s in p.get("stateOperators", [])))


def stream_dedup_approx(df: DataFrame, keys: list[str], ts: str = "ts", watermark: str = "1 minute") -> DataFrame:
    """SS2 (approximate): Spark's ``dropDuplicatesWithinWatermark`` - rows whose
    key was seen within the watermark delay are dropped (first-seen, not
    last-kept semantics)."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)
