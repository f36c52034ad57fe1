"""Corpus pipeline: quality rules, exact dedup, near dedup, substring dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``docs``. ``run`` writes each stage's result as Parquet in the shared
scratch folder and reads it again for the next.

Every stage judges rows, not ids: a row whose doc_id is null or another row's too goes
through the stages under a number of its own and counts as later than all other rows
(``with_row_key``). Null texts are empty texts; other columns, whatever their names, pass
unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import exact, oddsketch, packing, substring
from logweave.llm import quality as quality_rules
from logweave.llm.common import prepare, scratch, with_row_key


def _only(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows that ``judge``, given the rows and the name of their key, keeps."""
    prepare(docs.sparkSession)
    keyed, key = with_row_key(docs)
    kept = judge(keyed, key).filter("kept").select(key)
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, quality_rules.quality)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, exact.exact_dedup)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; one document of each group stays."""
    return _only(docs, lambda rows, key: oddsketch.near_dedup(rows, words=5, percent=80, bands=30, rows=5, id_col=key))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has are cut out of the texts."""
    prepare(spark)
    keyed, key = with_row_key(docs)
    cut = substring.substring_dedup(keyed, 50, id_col=key).filter(F.col("cut_text").isNotNull()) \
        .select(F.col(key).alias("_cut_key"), F.col("cut_text").alias("_cut"))
    x = keyed.select(F.struct(*docs.columns).alias("_doc"), F.col(key).alias("_of")).join(cut, F.col("_of") == F.col("_cut_key"), "left")
    done = F.col("_cut").isNotNull()
    changed = {"text": F.coalesce("_cut", "_doc.text"),
               "n_chars": F.when(done, F.length("_cut").cast("long")).otherwise(F.col("_doc.n_chars")) if "n_chars" in docs.columns else None}
    return x.select(*[changed[c].alias(c) if c in changed else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of sequences of 4096 tokens."""
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(scratch(cut, "pieces"))


STAGES = [("quality", quality), ("exact", exact_copies), ("near", near_copies), ("substring", repeated_passages), ("pack", pack)]
#: The stages hash, tokenise and search: beyond SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
