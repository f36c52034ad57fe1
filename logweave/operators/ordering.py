"""Order-dependent columns without one task per key.

A window partitioned by a key alone puts a hot key (say a log file with a
third of all lines) into one task. These helpers compute the same exact values
from windows over (key, chunk), where a chunk is a bounded, order-monotone
slice of the key (a range of line numbers, a minute of time), plus a small
per-chunk table that carries totals (or the last row) from chunk to chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null, so rows with a null key (no time, no
    author) stay; the keys come from ``left``."""
    r = right
    for i, k in enumerate(keys):
        r = r.withColumnRenamed(k, f"_ns{i}")
    cond = left[keys[0]].eqNullSafe(r["_ns0"])
    for i, k in enumerate(keys[1:], 1):
        cond = cond & left[k].eqNullSafe(r[f"_ns{i}"])
    return left.join(r, cond, how).drop(*[f"_ns{i}" for i in range(len(keys))])


def running_sums(df: DataFrame, keys: list[str], order: list, chunk: Column, values: dict[str, Column]) -> DataFrame:
    """Add ``name = sum(value) over (partition by keys order by order rows
    unbounded preceding .. current)`` for every ``name: value``. ``chunk`` must
    not decrease along ``order`` within a key."""
    x = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name, v in values.items():
        x = x.withColumn(f"_rs_{name}", F.sum(v).over(w))
    tot = df.withColumn("_chunk", chunk).groupBy(*keys, "_chunk").agg(
        *[F.sum(v).alias(f"_ct_{name}") for name, v in values.items()])
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    for name in values:
        tot = tot.withColumn(f"_off_{name}", F.coalesce(F.sum(f"_ct_{name}").over(wc), F.lit(0)))
    tot = tot.drop(*[f"_ct_{name}" for name in values])
    x = join_null_safe(x, tot, [*keys, "_chunk"])
    for name in values:
        x = x.withColumn(name, F.col(f"_off_{name}") + F.col(f"_rs_{name}")).drop(f"_off_{name}", f"_rs_{name}")
    return x.drop("_chunk")


def chunked_lag(df: DataFrame, keys: list[str], order: list[str], chunk: Column, cols: list[str],
                prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c> = lag(c) over (partition by keys order by order)`` for each
    column ``c``: inside a chunk by a window, across chunk borders from the last
    row of the previous non-empty chunk (a small per-chunk table)."""
    x = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    okey = F.struct(*[F.col(o) for o in order])
    last = x.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(*[F.col(c) for c in cols]), okey).alias("_last"))
    wc = Window.partitionBy(*keys).orderBy("_chunk")
    last = last.withColumn("_carry", F.lag("_last").over(wc)).drop("_last")
    x = join_null_safe(x, last, [*keys, "_chunk"])
    first_in_chunk = F.row_number().over(w) == 1
    for c in cols:
        x = x.withColumn(prefix + c, F.when(first_in_chunk, F.col("_carry")[c]).otherwise(F.lag(c).over(w)))
    return x.drop("_chunk", "_carry")


def global_rank(df: DataFrame, order: list[Column], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """Dense 1-based position of every row in a total order, without a
    single-partition window: range-partition and sort, number rows inside each
    partition, add the row counts of the partitions before it."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from ..session import ensure_checkpoint_dir
    s = df.repartitionByRange(n, *order).sortWithinPartitions(*order) \
          .withColumn("_pid", F.spark_partition_id()) \
          .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    # partition ids and positions must be read from one evaluation: materialise once
    ensure_checkpoint_dir(df.sparkSession)
    s = s.checkpoint(eager=True)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_p0"))
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return s.join(F.broadcast(counts.drop("_n")), "_pid") \
            .withColumn(out, (F.col("_off") + F.col("_pos") - F.col("_p0") + 1).cast("int")) \
            .drop("_pid", "_pos", "_p0", "_off")


def top_n(df: DataFrame, order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows of a total order with their 1-based rank: every
    partition contributes its own top ``n`` (``orderBy().limit()``), and only
    those ``n`` rows are ranked."""
    lim = df.orderBy(*order).limit(n)
    return lim.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("int"))
