"""Registered queries of the corpus operators: thin, over whole tables, with the
production parameters; SQL oracles where SQL can say the same."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import bpe, divergence, exact, langid, oddsketch, packing, quality, rulefit, sharding, substring, tokenfile, urlfilter, variants

#: Rules of the URL query: (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document as digests; null text counts as empty, each row on its own."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip_digests(bpe.encode(_table(spark, sf_dir, "documents"), vocabulary), vocabulary)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in as few sequences as the search finds; null text is its end mark alone."""
    from .common import scratch
    cut = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(scratch(cut, "pieces"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each document once windows of 50 words that a smaller doc_id has are cut; null text has none."""
    return substring.substring_dedup(_table(spark, sf_dir, "documents"), 50).drop("cut_text")


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts: the smallest doc_id; null text counts as empty."""
    return exact.exact_dedup(_table(spark, sf_dir, "documents"), hashes=True)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal size by size-weighted splitters; null text has size 1, rows of one key go by text."""
    x = sharding.assign_shards(_table(spark, sf_dir, "documents"), 16)
    return x.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents of similarity 0.85 on 3-word shingles; documents without words stand alone."""
    return oddsketch.near_dedup(_table(spark, sf_dir, "documents"), words=3, percent=85, bands=25, rows=6)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of each URL, by the longest rule, else the model; a null URL has an empty host and path."""
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each text, learned from documents that are not held out; und without a letter."""
    docs = _table(spark, sf_dir, "documents")
    test = langid.held_out()
    model = langid.train(docs.filter(~test), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.identify(docs, model).withColumn("held_out", test).select("doc_id", "held_out", "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of each document; null text has no words and fails."""
    return quality.quality(_table(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a token folder that is written and read back, in order of doc_id; null text is its end mark alone."""
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/tokens"
    tokenfile.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read_documents(spark, path)


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of each frequent word of the documents; null texts have no words, ties go by code point."""
    return variants.group_variants(variants.word_counts(_table(spark, sf_dir, "documents")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each source from the others of its language and of its terms from the language; nulls count as ''."""
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document, learned from labels that are not held out; empty texts have a score too."""
    return rulefit.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op12_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
             w AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{_UPPER}', '{_LOWER}') AS term FROM d),
             k AS (SELECT lang, term, count(*) AS in_lang FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
             l AS (SELECT lang, count(*) AS v, sum(in_lang) AS total FROM k GROUP BY lang),
             c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
             t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
             g AS (SELECT lang, source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN t USING (lang, source)),
             p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
                          1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (g.total + 2 * v) AS p,
                          1 + (1000000000::HUGEINT * (in_lang + 2)) // (l.total + 2 * v) AS q
                   FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
             s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS f
                   FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
                   FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
                        LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
                   UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM r QUALIFY part = 'pair' OR rank <= 10""",
    "op4_exact": f"""
        WITH t AS (SELECT doc_id, sha256({_NORM}) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
    "op3_substring": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
             s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
             h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM s),
             f AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h),
             r AS (SELECT DISTINCT doc_id, p + unnest(range(50)) AS k FROM h JOIN f USING (h) WHERE doc_id > lo),
             c AS (SELECT doc_id, count(*) AS n_removed, list(k) AS gone FROM r GROUP BY doc_id),
             x AS (SELECT d.doc_id, w, coalesce(n_removed, 0) AS n_removed, gone FROM d LEFT JOIN c USING (doc_id)),
             e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d WHERE doc_id IN (SELECT doc_id FROM c)),
             j AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) AS kept FROM e ANTI JOIN r ON e.doc_id = r.doc_id AND e.k = r.k GROUP BY 1)
        SELECT x.doc_id, CAST(len(w) AS BIGINT) AS n_words, n_removed,
               sha256(CASE WHEN n_removed = 0 THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
        FROM x LEFT JOIN j ON x.doc_id = j.doc_id""",
}

QUERIES = {f.__name__: f for f in (op1_bpe, op2_packing, op3_substring, op4_exact, op5_sharding, op6_near, op7_urls, op8_langid,
                                   op9_quality, op10_tokens, op11_variants, op12_divergence, op13_rules, pipeline)}
