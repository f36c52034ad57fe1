"""Queries over vectors. Items are all ``embeddings`` rows (label < 5: code,
label >= 5: logs, repo = label); query vectors are the normalised per-label
centroids of all items, so the work grows with the table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import concepts as C
from ..operators import vectors as V
from ..sources.tables import table
from .catalog_logs import _CONCEPT_SQL
from .registry import r4, register
from .views import duck_view_sql, view


def centroids(emb):
    """Per-label mean vector (posexplode + partial aggregation; output is bounded
    by labels x dimension)."""
    return V.mean_vectors(emb, "label").withColumnRenamed("label", "query_id")


def _items(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding",
                                                  F.col("label").alias("repo_id"))


def _queries(spark, sf):
    return centroids(table(spark, sf, "embeddings"))


def _code_items(spark, sf):
    ch = view(spark, sf, "v_chunks").drop("repo_id")
    it = _items(spark, sf).filter("repo_id < 5")
    return it.join(ch, it["item_id"] == ch["chunk_id"]).drop("chunk_id")


def _log_items(spark, sf):
    lg = view(spark, sf, "v_logs")
    it = _items(spark, sf).filter("repo_id >= 5")
    return it.join(lg, it["item_id"] == lg["log_id"]).drop("log_id")


# --------------------------------------------------------------------- SQL side

_CENT = """
ex AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
cm AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM ex GROUP BY label, i),
cen AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM cm GROUP BY label),
items AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v, label AS repo_id FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0)"""


def _sim_sql(items: str) -> str:
    return f"""SELECT c.query_id, i.item_id, list_dot_product(i.v, c.q) / (sqrt(list_dot_product(i.v, i.v))
       * sqrt(list_dot_product(c.q, c.q))) AS similarity FROM cen c, {items} i
       WHERE list_dot_product(i.v, i.v) > 0"""


def _knn_sql(items: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank
       FROM ({_sim_sql(items)})) WHERE rank <= {k}"""


_HITS = "SELECT query_id, item_id, round(similarity, 4) AS similarity, rank"


def _out(df):
    return df.select("query_id", "item_id", r4("similarity").alias("similarity"), "rank")


@register("knn_topk", f"WITH {_CENT} {_HITS} FROM ({_knn_sql('items', 5)})")
def knn_topk(spark, sf):
    """VE5: exact top-5 cosine neighbours of every label centroid over all vectors."""
    return _out(V.knn(_queries(spark, sf), _items(spark, sf), 5))


_EVERY_20TH = _CENT[:_CENT.index("ex AS")] + _CENT[_CENT.index("items AS"):] + """,
cen AS (SELECT item_id AS query_id, v AS q FROM items WHERE item_id % 20 = 0)"""


@register("knn_blocked", f"WITH {_EVERY_20TH} {_HITS} FROM ({_knn_sql('items', 5)})")
def knn_blocked(spark, sf):
    """VE5 beyond one block: exact top-5 of every 20th vector among all vectors, joined in
    blocks of 64 queries and 256 items."""
    it = _items(spark, sf)
    q = it.filter("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    return _out(V.knn_blocked(q, it, 5, query_block=64, item_block=256))


@register("knn_threshold", f"WITH {_CENT} {_HITS} FROM ({_knn_sql('items', 20)}) WHERE similarity >= 0.3")
def knn_threshold(spark, sf):
    """VE6: top-20 then similarity >= 0.3 (threshold after top-k)."""
    return _out(V.min_similarity(V.knn(_queries(spark, sf), _items(spark, sf), 20), 0.3))


@register("knn_scoped", f"""WITH {_CENT} {_HITS}
FROM ({_knn_sql('(SELECT * FROM items WHERE repo_id IN (1, 3, 5))', 10)})""")
def knn_scoped(spark, sf):
    """VE7: repository scope pushed below the top-k."""
    return _out(V.knn(_queries(spark, sf), V.scope(_items(spark, sf), [1, 3, 5]), 10))


_LOG_ITEMS = f"""(SELECT i.*, l.service_name, l.ts, l.level, l.message, l.file_reference
   FROM items i JOIN ({duck_view_sql('v_logs')}) l ON i.item_id = l.log_id WHERE i.repo_id >= 5)"""
_CODE_ITEMS = f"""(SELECT i.*, c.file_path, c.chunk_content, c.start_line, c.end_line, c.language
   FROM items i JOIN ({duck_view_sql('v_chunks')}) c ON i.item_id = c.chunk_id WHERE i.repo_id < 5)"""


@register("search_logs", f"""WITH {_CENT}, li AS {_LOG_ITEMS},
h AS ({_knn_sql('li', 10)})
SELECT h.query_id, h.item_id, round(h.similarity, 4) AS similarity, h.rank, li.service_name, li.level, li.message,
       li.file_reference FROM h JOIN li USING (item_id) WHERE h.similarity >= 0.3""")
def search_logs(spark, sf):
    """VE8: log search (scope, top-10, threshold) with log fields attached."""
    li = _log_items(spark, sf)
    h = V.search(_queries(spark, sf), li, 10, 0.3, cols=["service_name", "level", "message", "file_reference"])
    return h.select("query_id", "item_id", r4("similarity").alias("similarity"), "rank", "service_name", "level",
                    "message", "file_reference")


def concept_vectors(spark, sf):
    """Concepts of all logs with a vector: the mean of the vectors of their entries."""
    tc = C.with_templates(view(spark, sf, "v_logs"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("log_id"), "embedding")
    means = V.mean_vectors(e.join(tc.select("log_id", "concept_id"), "log_id"), "concept_id")
    return C.rollup_concepts(tc).join(means, "concept_id")


_CONCEPT_ITEMS = f"""kept AS ({duck_view_sql('v_logs')}){_CONCEPT_SQL},
ce AS (SELECT tc.concept_id, generate_subscripts(e.embedding, 1) AS i, unnest(e.embedding) AS x
       FROM embeddings e JOIN tc ON e.vec_id = tc.log_id),
cv AS (SELECT concept_id, list(x ORDER BY i) AS v FROM (SELECT concept_id, i, avg(CAST(x AS DOUBLE)) AS x FROM ce GROUP BY ALL)
       GROUP BY concept_id),
ci AS (SELECT cv.concept_id AS item_id, cv.v, c.* FROM cv JOIN concepts c USING (concept_id))"""


@register("search_concepts", f"""WITH {_CENT}, {_CONCEPT_ITEMS},
h AS ({_knn_sql('ci', 10)})
SELECT h.query_id, h.item_id, round(h.similarity, 4) AS similarity, h.rank, ci.service_name, ci.template, ci.severity,
       ci.total_occurrences, ci.trend FROM h JOIN ci USING (item_id) WHERE h.similarity >= 0.3""")
def search_concepts(spark, sf):
    """VE9: the 10 nearest log concepts of every label centroid by the concepts' own vectors
    (threshold 0.3), with service, template, severity, occurrences and trend."""
    h = V.search_concepts(_queries(spark, sf), concept_vectors(spark, sf), 10, 0.3)
    return h.select("query_id", "item_id", r4("similarity").alias("similarity"), "rank", *V.CONCEPT_FIELDS)


_RECENT = "(SELECT item_id AS query_id, v AS q FROM items WHERE repo_id >= 5 ORDER BY item_id DESC LIMIT 10)"


@register("nearest_code", f"""WITH {_CENT.replace('cen AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM cm GROUP BY label),', '')},
cen AS {_RECENT},
h AS ({_knn_sql('(SELECT * FROM items WHERE repo_id < 5)', 5)})
{_HITS} FROM (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM h) WHERE best >= 0.25""")
def nearest_code(spark, sf):
    """VE10: for the 10 most recent log vectors, the 5 nearest code vectors; a log
    is kept when its best match reaches 0.25."""
    it = _items(spark, sf)
    recent = it.filter("repo_id >= 5").orderBy(F.col("item_id").desc()).limit(10) \
               .select(F.col("item_id").alias("query_id"), "embedding")
    return _out(V.nearest_code(recent, it.filter("repo_id < 5"), 5, 0.25))


@register("top_k", f"WITH {_CENT} {_HITS} FROM ({_knn_sql('items', 3)})")
def top_k(spark, sf):
    """VE13: rerank disabled -> plain top-k (3 of 20 fetched) by similarity."""
    h = V.knn(_queries(spark, sf), _items(spark, sf), 20)
    return _out(V.top_k(h.drop("rank"), 3))


@register("review_score", f"""WITH {_CENT}, h AS ({_knn_sql('(SELECT * FROM items WHERE repo_id < 5)', 10)}),
s AS (SELECT * FROM h WHERE similarity >= 0.3),
g AS (SELECT c.query_id, count(s.similarity) AS n_sources,
        coalesce(least(100.0, max(s.similarity) * 60 + avg(s.similarity) * 40), 0.0) AS risk_score
      FROM cen c LEFT JOIN s USING (query_id) GROUP BY c.query_id)
SELECT query_id, n_sources, round(risk_score, 4) AS risk_score,
       CASE WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 40 THEN 'mid' ELSE 'low' END AS band FROM g""")
def review_score(spark, sf):
    """VE18 + VE19: change-review score from the sources found for each review query."""
    q = _queries(spark, sf)
    s = V.search(q, _items(spark, sf).filter("repo_id < 5"), 10, 0.3)
    allq = q.select("query_id").join(s, "query_id", "left")
    r = V.review_score(allq)
    return r.select("query_id", "n_sources", r4("risk_score").alias("risk_score"), "band")


@register("retrieval_stats", f"""WITH {_CENT},
hc AS ({_knn_sql('(SELECT * FROM items WHERE repo_id < 5)', 20)}),
hl AS ({_knn_sql('(SELECT * FROM items WHERE repo_id >= 5)', 10)}),
u AS (SELECT query_id, 'code' AS layer FROM hc WHERE similarity >= 0.3
      UNION ALL SELECT query_id, 'log' FROM hl WHERE similarity >= 0.3)
SELECT query_id, count(*) FILTER (WHERE layer = 'code') AS n_code, count(*) FILTER (WHERE layer = 'log') AS n_log,
       count(*) FILTER (WHERE layer = 'concept') AS n_concept, count(*) FILTER (WHERE layer = 'graph') AS n_graph,
       CAST(0.3 AS DOUBLE) AS threshold FROM u GROUP BY query_id""")
def retrieval_stats(spark, sf):
    """VE16: results per layer for every query."""
    q, it = _queries(spark, sf), _items(spark, sf)
    hc = V.search(q, it.filter("repo_id < 5"), 20, 0.3).withColumn("layer", F.lit("code"))
    hl = V.search(q, it.filter("repo_id >= 5"), 10, 0.3).withColumn("layer", F.lit("log"))
    return V.retrieval_stats(hc.unionByName(hl))


@register("check_dimension", """
SELECT len(embedding) AS dim, count(*) AS n, len(embedding) = 64 AS ok FROM embeddings
WHERE embedding IS NOT NULL GROUP BY 1""")
def check_dimension(spark, sf):
    """VE3: vector sizes against the expected dimension (64 in the test data)."""
    e = table(spark, sf, "embeddings").filter(F.col("embedding").isNotNull())
    return e.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")) \
            .withColumn("ok", F.col("dim") == 64)


@register("clip_text", "SELECT doc_id, substr(text, 1, 4000) AS text FROM documents")
def clip_text(spark, sf):
    """VE4: text clipped to the embedding budget (4000 characters)."""
    return table(spark, sf, "documents").select("doc_id", V.clip_text(F.col("text")).alias("text"))


@register("boost_by_logs", f"""WITH {_CENT}, ci AS {_CODE_ITEMS},
li AS (SELECT *, 'p' || CAST(item_id % 300 AS VARCHAR) || '.py' AS ref FROM items WHERE repo_id >= 5),
hc AS ({_knn_sql('ci', 20)}), hc2 AS (SELECT hc.*, ci.file_path FROM hc JOIN ci USING (item_id) WHERE hc.similarity >= 0.3),
hl AS ({_knn_sql('li', 10)}), hl2 AS (SELECT hl.*, li.ref FROM hl JOIN li USING (item_id) WHERE hl.similarity >= 0.3),
b AS (SELECT c.query_id, c.item_id, c.file_path, c.similarity, count(l.ref) AS n FROM hc2 c LEFT JOIN hl2 l
      ON c.query_id = l.query_id AND contains(c.file_path, l.ref) GROUP BY ALL)
SELECT query_id, item_id, file_path, round(least(1.0, similarity + 0.15 * n), 4) AS similarity, n > 0 AS cross_referenced
FROM b""")
def boost_by_logs(spark, sf):
    """VE11: code hits boosted by log hits of the same query whose file reference
    occurs in the chunk path (log reference = p<id % 300>.py)."""
    q = _queries(spark, sf)
    ci = _code_items(spark, sf)
    li = _items(spark, sf).filter("repo_id >= 5").withColumn(
        "file_reference", F.concat(F.lit("p"), (F.col("item_id") % 300).cast("string"), F.lit(".py")))
    hc = V.search(q, ci, 20, 0.3, cols=["file_path"])
    hl = V.search(q, li, 10, 0.3, cols=["file_reference"])
    b = V.boost_by_logs(hc, hl)
    return b.select("query_id", "item_id", "file_path", r4("similarity").alias("similarity"), "cross_referenced")


@register("history_window", """
SELECT conv_id, turn, role, rn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
FROM conversations) WHERE rn <= 10""")
def history_window(spark, sf):
    """VE20: the last 10 turns of every conversation (rn 1 = newest)."""
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return c.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").select("conv_id", "turn", "role", "rn")


@register("sample_chunks", f"""WITH ch AS ({duck_view_sql('v_chunks')}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY start_line, chunk_id) AS r1
      FROM ch) WHERE r1 = 1),
s AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path) AS rank FROM f)
SELECT repo_id, file_path, start_line, substr(chunk_content, 1, 400) AS content, rank FROM s WHERE rank <= 30""")
def sample_chunks(spark, sf):
    """VE21: first chunk of each file, files in path order, 30 per repository, 400 chars."""
    from ..operators.context import sample_chunks as sc
    return sc(view(spark, sf, "v_chunks"), 30, 400)


@register("stitch_summaries", """
WITH v AS (SELECT doc_id // 5 AS repo_set, doc_id, source, text FROM documents WHERE length(text) > 50),
g AS (SELECT repo_set, count(*) AS n,
        string_agg('## Repository: ' || source || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10)
                   ORDER BY doc_id) AS many, any_value(text) AS one FROM v GROUP BY repo_set)
SELECT repo_set, n AS n_summaries, CASE WHEN n = 1 THEN one ELSE many END AS summary FROM g""")
def stitch_summaries(spark, sf):
    """VE22: valid summaries (> 50 chars) of each repository set (5 repositories
    per set) stitched into one context text."""
    from ..operators.context import stitch_summaries as st
    d = table(spark, sf, "documents").select((F.col("doc_id") / 5).cast("bigint").alias("repo_set"), "doc_id",
                                              F.col("source").alias("repo_path"), F.col("text").alias("summary"))
    return st(d, "repo_set", "doc_id")


@register("format_context", f"""WITH {_CENT}, ci AS {_CODE_ITEMS},
h AS ({_knn_sql('ci', 5)}), hh AS (SELECT h.*, ci.file_path, ci.start_line, ci.end_line, ci.language, ci.chunk_content
   FROM h JOIN ci USING (item_id) WHERE h.similarity >= 0.3)
SELECT query_id, count(*) AS n_matches, string_agg('### Match ' || CAST(rank AS VARCHAR) || ' — `' || file_path || '` (lines '
  || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) || ') [similarity: ' || printf('%.2f', similarity * 100)
  || '%]' || chr(10) || '```' || coalesce(language, '') || chr(10) || substr(chunk_content, 1, 800) || chr(10) || '```',
  chr(10) || chr(10) ORDER BY rank) AS context FROM hh GROUP BY query_id""")
def format_context(spark, sf):
    """VE15: numbered match blocks per query (content clipped to 800 characters)."""
    from ..operators.context import format_context as fc
    h = V.search(_queries(spark, sf), _code_items(spark, sf), 5, 0.3,
                 cols=["file_path", "start_line", "end_line", "language", "chunk_content"])
    return fc(h.withColumnRenamed("chunk_content", "content"), "query_id", "rank")


@register("conversation_history", """
SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 10
GROUP BY conv_id""")
def conversation_history(spark, sf):
    """VE20: each conversation's last 10 turns as one ordered history text."""
    from ..operators.context import history_window as hw
    return hw(table(spark, sf, "conversations"), 10)
