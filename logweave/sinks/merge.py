"""Table maintenance as DataFrame operations: insert-if-absent, counter merge,
coalescing and replacing upserts, cascading deletes, snapshots and NDJSON.

Plain Parquet has no row-level MERGE, so every merge returns the new table
state as a DataFrame; :func:`write_snapshot` writes it to a fresh versioned
directory and never overwrites a path that is being read.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_new(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """SK1: rows of ``batch`` whose key is not in ``target`` (first per key) are appended."""
    new = batch.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new, allowMissingColumns=True)


def merge_counts(target: DataFrame | None, batch: DataFrame, keys: list[str], counter: str = "call_count",
                 order: str | None = None) -> DataFrame:
    """SK2: upsert where a conflict adds to ``counter`` and other fields keep the
    first inserted value (by ``order`` when given)."""
    b = batch if counter in batch.columns else batch.withColumn(counter, F.lit(1).cast("bigint"))
    u = b if target is None else target.unionByName(b, allowMissingColumns=True)
    others = [c for c in u.columns if c not in keys + [counter]]
    if order:
        firsts = [F.min_by(F.col(c), F.col(order)).alias(c) for c in others if c != order] + [F.min(order).alias(order)]
    else:
        firsts = [F.first(c).alias(c) for c in others]
    return u.groupBy(*keys).agg(F.sum(counter).alias(counter), *firsts)


def merge_coalesce(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """SK3: upsert overwriting only the fields the batch supplies (non-null)."""
    cols = [c for c in target.columns if c not in keys]
    t, b = target.alias("t"), batch.alias("b")
    j = t.join(b, keys, "full_outer")
    return j.select(*keys, *[F.coalesce(F.col(f"b.{c}"), F.col(f"t.{c}")).alias(c) if c in batch.columns
                             else F.col(f"t.{c}").alias(c) for c in cols])


def merge_replace(target: DataFrame | None, batch: DataFrame, keys: list[str], cols: list[str] | None = None,
                  order: list[str] | None = None) -> DataFrame:
    """SK4: upsert replacing the named fields (all non-key fields by default);
    several batch rows of a key apply in ``order`` (the last wins)."""
    b = batch
    if order:
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        b = b.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    if target is None:
        return b
    cols = cols or [c for c in b.columns if c not in keys]
    t, bb = target.alias("t"), b.alias("b")
    j = t.join(bb.withColumn("_hit", F.lit(True)), keys, "full_outer")
    out = [F.when(F.col("_hit"), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in cols
           else F.coalesce(F.col(f"t.{c}"), F.col(f"b.{c}") if c in b.columns else F.lit(None)).alias(c)
           for c in target.columns if c not in keys]
    return j.select(*keys, *out)


def cascade_delete(children: DataFrame, ids: DataFrame, key: str = "repo_id", set_null: bool = False) -> DataFrame:
    """SK5: rows of deleted parents removed, or their key set to null."""
    d = ids.select(F.col(key).alias("_d")).distinct().withColumn("_gone", F.lit(True))
    j = children.join(d, children[key] == d["_d"], "left")
    if set_null:
        return j.withColumn(key, F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(key))).drop("_d", "_gone")
    return j.filter(F.col("_gone").isNull()).drop("_d", "_gone")


def write_snapshot(df: DataFrame, base: str, fmt: str = "parquet") -> str:
    """SK6: replace-all: write the new state to a fresh version directory under
    ``base`` and point ``base/_CURRENT`` at it; readers of the old version are
    never disturbed. Returns the version path."""
    version = os.path.join(base, f"v-{uuid.uuid4().hex}")
    df.write.format(fmt).mode("errorifexists").save(version)
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "path string").coalesce(1).write.mode("overwrite").text(
        os.path.join(base, "_CURRENT"))
    return version


def read_snapshot(spark, base: str, fmt: str = "parquet") -> DataFrame:
    cur = spark.read.text(os.path.join(base, "_CURRENT")).first()[0]
    return spark.read.format(fmt).load(cur)


def to_ndjson(df: DataFrame, kind: str) -> DataFrame:
    """SK7: one ``{"type": kind, "data": {...}}`` JSON line per row."""
    return df.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*df.columns).alias("data"))).alias("value"))
