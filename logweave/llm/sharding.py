"""Sharding by sampled splitters.

Records are ordered by a 52-bit key: the upper 36 bits hash the text, the lower 16
the id, so equal texts lie next to each other, and even a group that holds a third
of all rows is divisible. A size-weighted sample of keys gives quantile
boundaries of many small ranges (their number follows the rows); ranges that turn
out overfull are sampled again and subdivided. Exact totals of the ranges then
place every record in the global order, and the record's middle byte decides its
shard, so shards differ by about one record.

Only (id, size, checksum, key) move, never a text. A range is the unit of work of the
final ordering and is bounded by the subdivision. The driver sees the splitters and
one row of totals for each range.

Null texts have no bytes (size 1, checksum 0). Null ids are allowed and come first
within equal keys. Repeated rows each get a slot. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, prepare, scratch

#: Rows a range should hold at most; the number of ranges follows from it.
RANGE_ROWS = 100_000
#: Ranges for each shard at least.
RANGES_A_SHARD = 8
#: Sampled keys for each range.
SAMPLES_A_RANGE = 64
#: A range with more than so many times its share of the bytes or rows is subdivided, into so many parts.
OVERFULL, PARTS = 2.0, 8

KEY_BITS, ID_BITS = 52, 16


def _key(text: Column, row_id: Column) -> Column:
    group = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - (KEY_BITS - ID_BITS))
    own = F.shiftrightunsigned(F.xxhash64(row_id, F.lit("slot")), 64 - ID_BITS)
    return F.shiftleft(group, ID_BITS).bitwiseOR(own)


def _sampled(df: DataFrame, rate: Column) -> DataFrame:
    """Rows drawn with probability ``rate`` (a deterministic draw from the row itself),
    with the weight of a row that stands for more than one draw."""
    draw = F.shiftrightunsigned(F.xxhash64("_id", "_key", F.lit("draw")), 33) / F.lit(float(1 << 31))
    return df.withColumn("_rate", rate).filter(draw < F.col("_rate")) \
             .withColumn("_weight", F.greatest(F.lit(1), F.round("_rate")).cast("long"))


def _quantiles(parts: int) -> str:
    return "percentile(_key, array(" + ",".join(f"{i / parts!r}D" for i in range(1, parts)) + "), _weight)"


def _range_of(splitters: np.ndarray):
    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, key.to_numpy(), side="right").astype(np.int32))
    return range_of


def assign_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, size, text_crc32, shard, slot): shards 0 .. ``shards`` - 1 of near
    equal bytes, slots gapless from 0 in each."""
    spark = prepare(df.sparkSession)
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = scratch(id_text(df, id_col, text_col).select(
        "_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        _key(F.col("_text"), F.col("_id")).alias("_key")), "keys")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(shards * RANGES_A_SHARD, -(-n // RANGE_ROWS))

    first = _sampled(rows, F.lit(float(ranges * SAMPLES_A_RANGE)) * F.col("size") / F.lit(float(max(total, 1)))) \
        .agg(F.expr(_quantiles(ranges)).alias("q")).first()["q"] or []
    splitters = np.unique(np.ceil(np.asarray(first, dtype=np.float64)).astype(np.int64))
    most_bytes, most_rows = OVERFULL * max(total, 1) / ranges, OVERFULL * max(n, 1) / ranges
    while True:
        ranged = rows.withColumn("_range", _range_of(splitters)("_key"))
        seen = ranged.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"),
                                            F.min("_key").alias("low"), F.max("_key").alias("high")).toPandas()
        over = seen[((seen.bytes > most_bytes) | (seen.n > most_rows)) & (seen.low < seen.high)]
        if not len(over):
            break
        # sample the overfull ranges alone, by rows, and cut each at its own quantiles
        rate = float(PARTS * SAMPLES_A_RANGE) / F.element_at(
            F.create_map(*[F.lit(int(x)) for r in zip(over["_range"], over["n"]) for x in r]), F.col("_range"))
        cuts = _sampled(ranged.filter(F.col("_range").isin([int(x) for x in over["_range"]])), rate) \
            .groupBy("_range").agg(F.expr(_quantiles(PARTS)).alias("q")).collect()
        new = [np.ceil(np.asarray(r["q"], dtype=np.float64)).astype(np.int64) for r in cuts]
        more = np.unique(np.concatenate([splitters, *new, over["low"].to_numpy(np.int64) + 1]))
        if len(more) == len(splitters):
            break
        splitters = more

    seen = seen.sort_values("_range")
    seen["_bytes0"] = seen["bytes"].cumsum() - seen["bytes"]
    seen["_rows0"] = seen["n"].cumsum() - seen["n"]
    # one row for each range, whose number is known: safe to send to every executor
    base = spark.createDataFrame(
        [(int(r), int(b), int(k)) for r, b, k in zip(seen["_range"], seen["_bytes0"], seen["_rows0"])],
        "_range int, _bytes0 bigint, _rows0 bigint")
    w = Window.partitionBy("_range").orderBy("_key", "_id", "text_crc32", "size")
    upto = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_upto", upto).withColumn("_pos", F.row_number().over(w)).join(F.broadcast(base), "_range")
    middle = F.col("_bytes0") + F.col("_upto") - F.col("size") / 2
    placed = scratch(placed.select(
        "_id", "size", "text_crc32", (F.col("_rows0") + F.col("_pos")).alias("_pos"),
        F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(total, 1)))).cast("int")).alias("shard")), "placed")
    begin = placed.groupBy("shard").agg(F.min("_pos").alias("_first"))  # a row for each shard
    return placed.join(F.broadcast(begin), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_pos") - F.col("_first")).alias("slot"))


def write_shards(df: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the records below ``path``, a folder for each shard, in slot order."""
    x = df.join(assigned.select(id_col, "shard", "slot"), id_col)
    x.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
