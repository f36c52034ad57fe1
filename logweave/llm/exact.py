"""Exact dedup by progressive refinement.

Texts are compared after each run of white space has become one space. Rows are
grouped by normalised length; rows whose length is shared go on to (length, hash
of the first characters); only rows that still share both have their full
content read again and hashed. Every other row is alone in its group.

Only lengths and 64-bit prefix hashes move in the first two steps; the last step
moves the survivors' ids and reads their texts by a semi join. Hot groups: all
counts are partial aggregates, and the joins back on a group's key are plain joins,
whose large partitions adaptive execution splits.

Null texts count as empty. Of equal texts the row with the smallest id stays (a null
id comes first). Rows that share id and text are one group and stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, id_text, join_on, prepare, scratch

#: Characters of the normalised text whose hash is the second refinement.
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RE, " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: bool = False) -> DataFrame:
    """(``id_col``, keep_id, group_size, kept) for every row; with ``hashes`` also text_sha256, the
    hash of the row's normalised text. It is then taken of every row in the first pass and
    carried along, so that rows with a null or repeated id keep their own."""
    prepare(df.sparkSession)
    src = id_text(df, id_col, text_col)
    text = normalised(F.col("_text"))
    sha = F.sha2(text.cast("binary"), 256).alias("_sha")
    rows = scratch(src.select("_id", F.length(text).alias("_len"),
                              F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("_head"), *([sha] if hashes else [])), "heads")

    shared_len = rows.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_len")
    by_len = join_on(rows, shared_len, ["_len"], "left_semi")
    shared_head = by_len.groupBy("_len", "_head").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_len", "_head")
    left = scratch(join_on(by_len, shared_head, ["_len", "_head"], "left_semi").select("_id").distinct(), "survivors")

    full = join_on(rows if hashes else src, left, ["_id"], "left_semi").select("_id", "_sha" if hashes else sha)
    full = scratch(full, "hashes")
    carried = ["_sha"] if hashes else []
    groups = full.groupBy("_sha").agg(F.min(F.struct(F.col("_id"))).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
    grouped = join_on(full, groups, ["_sha"]).select("_id", F.col("_keep")["_id"].alias("keep_id"), "group_size", *carried)
    single = join_on(rows.select("_id", *carried), left, ["_id"], "left_anti") \
        .select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *carried)
    return grouped.unionByName(single).select(F.col("_id").alias(id_col), "keep_id", "group_size",
                                              F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                                              *[F.col(c).alias("text_sha256") for c in carried])


def with_sha256(df: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verdict with text_sha256, the hash of every row's normalised text, joined by id: an id must
    not stand for different texts. ``exact_dedup(hashes=True)`` has no such condition."""
    sha = df.select(F.col(id_col), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("text_sha256")).distinct()
    return join_on(verdict, sha, [id_col])
