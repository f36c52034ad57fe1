"""Queries over error triage, statistics, pull-request files and question planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS_CLASS
from ..operators import questions as Q
from ..operators import stats as S
from ..operators import triage as T
from ..operators.vectors import REVIEW_DIMENSIONS, review_questions
from ..sources.tables import table
from .catalog_deps import _DEP_SQL, _dep_rollup
from .catalog_vectors import _CODE_ITEMS, _items
from .registry import ntz, register
from .views import duck_view_sql, view

_ERR = "('ERROR', 'CRITICAL', 'FATAL', 'WARN')"


@register("recent_errors", f"""
SELECT log_id, service_name, level, recency_rank FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, log_id DESC)
AS recency_rank FROM ({duck_view_sql('v_logs')}) WHERE level IN {_ERR}) WHERE recency_rank <= 10""")
def recent_errors(spark, sf):
    """ET1: the 10 most recent error / warning entries."""
    return T.recent_errors(view(spark, sf, "v_logs")).select("log_id", "service_name", "level", "recency_rank")


@register("recent_errors_per_service", f"""
SELECT log_id, service_name, level, recency_rank FROM (SELECT *, row_number() OVER (PARTITION BY service_name
ORDER BY ts DESC, log_id DESC) AS recency_rank FROM ({duck_view_sql('v_logs')}) WHERE level IN {_ERR})
WHERE recency_rank <= 10""")
def recent_errors_per_service(spark, sf):
    """ET1 (per service): the 10 most recent error / warning entries of every service."""
    return T.recent_errors(view(spark, sf, "v_logs"), per_service=True) \
            .select("log_id", "service_name", "level", "recency_rank")


def _conf_sql(sim: str, n: str, text: str) -> str:
    t = f"coalesce({text}, '')"
    c = (f"least({sim}, 1.0) * 0.5 + least({n} / 5.0, 1.0) * 0.2 + ((CASE WHEN contains({t}, '```') THEN 1.0 ELSE 0.5 END"
         f" + least(length({t}) / 500.0, 1.0)) / 2.0) * 0.3")
    return f"CAST(round_even(CAST(CAST(least({c}, 1.0) AS DOUBLE) AS VARCHAR)::DECIMAL(38, 12), 3) AS DOUBLE)"


@register("confidence_scores", f"""
SELECT doc_id, {_conf_sql('(n_chars % 101) / 100.0', '(doc_id % 7)', 'text')} AS confidence_score,
  CASE WHEN doc_id % 3 = 0 THEN 'high' WHEN doc_id % 3 = 1 THEN 'medium' ELSE 'low' END AS blast_radius_level
FROM documents""")
def confidence_scores(spark, sf):
    """ET2: confidence of a diagnosis text (document) with a derived similarity and match count."""
    d = table(spark, sf, "documents")
    c = T.confidence((F.col("n_chars") % 101) / 100.0, (F.col("doc_id") % 7).cast("double"), F.col("text"))
    lvl = F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("low")
    return d.select("doc_id", c.alias("confidence_score"), lvl.alias("blast_radius_level"))


@register("trust_ladder", f"""WITH c AS (SELECT doc_id, {_conf_sql('(n_chars % 101) / 100.0', '(doc_id % 7)', 'text')} AS conf,
  CASE WHEN doc_id % 3 = 0 THEN 'high' WHEN doc_id % 3 = 1 THEN 'medium' ELSE 'low' END AS lvl FROM documents)
SELECT doc_id, NOT (lvl = 'low' AND conf >= 0.8) AS requires_approval, (lvl = 'low' AND conf >= 0.8) AS auto_apply_eligible
FROM c""")
def trust_ladder(spark, sf):
    """ET3: approval / auto-apply from confidence and blast level."""
    d = table(spark, sf, "documents")
    c = T.confidence((F.col("n_chars") % 101) / 100.0, (F.col("doc_id") % 7).cast("double"), F.col("text"))
    lvl = F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("low")
    t = T.trust_ladder(c, lvl)
    return d.select("doc_id", t["requires_approval"].alias("requires_approval"),
                    t["auto_apply_eligible"].alias("auto_apply_eligible"))


def _diagnoses(logs):
    """Diagnosis text per log, as a text model would return it (derived from the log)."""
    return logs.select("log_id", F.concat(
        F.lit("**Root Cause**: "), F.col("message"), F.lit("\n\n**Suggested Fix**:\n```python\nretry("),
        F.col("log_id").cast("string"), F.lit(")\n```\n\n**Rollback Plan**: revert "),
        F.coalesce(F.col("file_reference"), F.lit("the change")), F.lit("\n\n**Risk**: low")).alias("diagnosis"))


_DIAG_SQL = """'**Root Cause**: ' || message || chr(10) || chr(10) || '**Suggested Fix**:' || chr(10) || '```python' || chr(10)
  || 'retry(' || CAST(log_id AS VARCHAR) || ')' || chr(10) || '```' || chr(10) || chr(10) || '**Rollback Plan**: revert '
  || coalesce(file_reference, 'the change') || chr(10) || chr(10) || '**Risk**: low'"""


def _strip(x):
    return f"regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


_BLOCKS_SQL = _strip("array_to_string(regexp_extract_all({t}, '(?s)```(?:\\w*)\\n(.*?)```', 1), chr(10) || chr(10))")
_SECTION_SQL = _strip("regexp_split_to_array(regexp_extract({t}, '(?is)\\*{{0,2}}Rollback Plan\\*{{0,2}}[:\\s]+(.*)', 1), "
                      "'(?i)\\n\\n\\*{{0,2}}[a-z]')[1]")


@register("code_blocks", f"""WITH l AS ({duck_view_sql('v_logs')}), d AS (SELECT log_id, {_DIAG_SQL} AS diagnosis FROM l)
SELECT log_id, {_BLOCKS_SQL.replace('{t}', 'diagnosis')} AS suggested_code,
       {_SECTION_SQL.replace('{t}', 'diagnosis').replace('{{', '{').replace('}}', '}')} AS rollback_plan FROM d""")
def code_blocks(spark, sf):
    """ET4 + ET5: fenced code and the rollback section of every diagnosis text."""
    d = _diagnoses(view(spark, sf, "v_logs"))
    return d.select("log_id", T.code_blocks(F.col("diagnosis")).alias("suggested_code"),
                    T.section(F.col("diagnosis"), "Rollback Plan").alias("rollback_plan"))


def _triage(spark, sf):
    lg = view(spark, sf, "v_logs")
    it = _items(spark, sf)
    logs = lg.join(it.filter("repo_id >= 5").select(F.col("item_id").alias("log_id"), "embedding"), "log_id")
    ch = view(spark, sf, "v_chunks").drop("repo_id")
    chunks = it.filter("repo_id < 5").join(ch, it["item_id"] == ch["chunk_id"]).drop("chunk_id")
    _, deps = _dep_rollup(spark, sf)
    return T.triage(logs, chunks, deps, _diagnoses(lg))


_TRIAGE_SQL = _DEP_SQL + f""",
items AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v, label AS repo_id FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0),
lg AS ({duck_view_sql('v_logs')}),
logs AS (SELECT lg.*, i.v FROM lg JOIN items i ON i.item_id = lg.log_id AND i.repo_id >= 5),
rec AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, log_id DESC) AS rr FROM logs
        WHERE level IN {_ERR}) WHERE rr <= 10),
ci AS {_CODE_ITEMS},
sims AS (SELECT r.log_id, c.item_id, list_dot_product(c.v, r.v) / (sqrt(list_dot_product(c.v, c.v))
         * sqrt(list_dot_product(r.v, r.v))) AS similarity FROM rec r, ci c WHERE list_dot_product(c.v, c.v) > 0),
top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY similarity DESC, item_id) AS rk
         FROM sims) WHERE rk <= 5),
best AS (SELECT log_id, count(*) AS n_related, arg_min(item_id, rk) AS item_id, max(similarity) AS top_similarity
         FROM top5 GROUP BY 1 HAVING max(similarity) >= 0.25),
bl AS (SELECT target_name, count(*) AS n FROM rr GROUP BY 1),
x AS (SELECT rec.*, best.n_related, best.top_similarity, ci.file_path, ci.start_line, ci.end_line, ci.chunk_content,
             coalesce(bl.n, 0) AS blast_radius, {_DIAG_SQL} AS diagnosis
      FROM rec JOIN best USING (log_id) JOIN ci USING (item_id) LEFT JOIN bl ON bl.target_name = lower(rec.service_name)),
y AS (SELECT *, CASE WHEN blast_radius >= 5 THEN 'high' WHEN blast_radius >= 2 THEN 'medium' ELSE 'low' END AS lvl,
             {_conf_sql('top_similarity', 'n_related', 'diagnosis')} AS conf FROM x)"""


@register("triage", _TRIAGE_SQL + f"""
SELECT log_id AS fix_id, level AS error_level, substr(message, 1, 200) AS error_message, service_name AS error_service,
       file_path AS related_file, CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) AS related_lines,
       CAST(round_even(CAST(CAST(top_similarity AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS similarity_score,
       conf AS confidence_score, blast_radius, lvl AS blast_radius_level,
       NOT (lvl = 'low' AND conf >= 0.8) AS requires_approval, (lvl = 'low' AND conf >= 0.8) AS auto_apply_eligible,
       {_BLOCKS_SQL.replace('{t}', 'diagnosis')} AS suggested_code FROM y""")
def triage(spark, sf):
    """ET6: recent errors -> nearest code -> blast radius -> confidence and trust ladder."""
    t = _triage(spark, sf)
    return t.select("fix_id", "error_level", "error_message", "error_service", "related_file", "related_lines",
                    "similarity_score", "confidence_score", "blast_radius", "blast_radius_level", "requires_approval",
                    "auto_apply_eligible", "suggested_code")


@register("pending_fixes", _TRIAGE_SQL + """
SELECT log_id AS fix_id, ts AS created_at, row_number() OVER (ORDER BY ts DESC, log_id DESC) AS rank FROM y""")
def pending_fixes(spark, sf):
    """ET7: pending fixes newest first."""
    p = T.pending(_triage(spark, sf))
    return p.select("fix_id", ntz("created_at").alias("created_at"), "rank")


# ------------------------------------------------------------------ statistics


@register("log_stats", f"""WITH l AS ({duck_view_sql('v_logs')})
SELECT 'total' AS dimension, '' AS key, count(*) AS n FROM l
UNION ALL SELECT 'level', coalesce(level, 'UNKNOWN'), count(*) FROM l GROUP BY 2
UNION ALL SELECT 'service', service_name, count(*) FROM l GROUP BY 2""")
def log_stats(spark, sf):
    """ST1: totals, per level and per service in one grouping-sets pass."""
    return S.log_stats(view(spark, sf, "v_logs"))


def _pr_files(spark, sf):
    from pyspark.sql import Window
    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("pr"), F.row_number().over(w).alias("file_no"),
        F.concat(F.lit("src/p"), (F.col("l_partkey") % 300).cast("string"), F.lit(".py")).alias("filename"),
        F.when(F.col("l_linenumber") == 1, F.lit("added")).when(F.col("l_linenumber") == 7, F.lit("removed"))
         .otherwise(F.lit("modified")).alias("status"),
        F.when(F.col("l_quantity") % 3 != 0, F.concat(F.lit("@@ +"), F.col("l_quantity").cast("bigint").cast("string"),
                                                      F.lit(" -"), F.col("l_linenumber").cast("string"), F.lit(" @@")))
         .alias("patch"),
        F.col("l_quantity").cast("bigint").alias("additions"), F.col("l_linenumber").cast("bigint").alias("deletions"))


_PR_SQL = """WITH f AS (SELECT l_orderkey AS pr, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
  l_suppkey, l_quantity, l_extendedprice) AS file_no, 'src/p' || CAST(l_partkey % 300 AS VARCHAR) || '.py' AS filename,
  CASE WHEN l_linenumber = 1 THEN 'added' WHEN l_linenumber = 7 THEN 'removed' ELSE 'modified' END AS status,
  CASE WHEN l_quantity % 3 <> 0 THEN '@@ +' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' -' || CAST(l_linenumber AS VARCHAR) || ' @@' END AS patch,
  CAST(l_quantity AS BIGINT) AS additions, CAST(l_linenumber AS BIGINT) AS deletions FROM lineitem)"""


@register("pr_files", _PR_SQL + " SELECT pr, file_no, filename, status, patch, additions, deletions FROM f")
def pr_files(spark, sf):
    """SR6: pull-request file lists as JSON arrays (built per PR) decoded back to rows."""
    f = _pr_files(spark, sf)
    js = f.groupBy("pr").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(
        "file_no", "filename", "status", "patch", "additions", "deletions"))),
        lambda x: x.dropFields("file_no"))).alias("files_json"))
    out = S.read_pr_files(js)
    return out.select("pr", (F.col("file_no") + 1).alias("file_no"), "filename", "status", "patch", "additions", "deletions")


@register("pr_totals", _PR_SQL + " SELECT pr, count(*) AS file_count, sum(additions) AS additions, sum(deletions) AS deletions FROM f GROUP BY 1")
def pr_totals(spark, sf):
    """ST2: file count, additions and deletions per pull request."""
    return S.pr_totals(_pr_files(spark, sf))


@register("unified_diff", _PR_SQL + """
SELECT pr, string_agg(concat_ws(chr(10), CASE WHEN status = 'added' THEN '--- /dev/null' ELSE '--- a/' || filename END,
  CASE WHEN status = 'removed' THEN '+++ /dev/null' ELSE '+++ b/' || filename END, CASE WHEN patch <> '' THEN patch END),
  chr(10) ORDER BY file_no) AS diff FROM f GROUP BY 1""")
def unified_diff(spark, sf):
    """ST3: unified diff text per pull request in file order."""
    return S.unified_diff(_pr_files(spark, sf))


# ------------------------------------------------------------------ questions

def _ascii_words(x: str) -> str:
    """RE2 \\b is ASCII: map non-ASCII letters and digits to an ASCII word char."""
    return f"regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F\\P{{L}}]', '0', 'g'), '[^\\x00-\\x7F\\P{{N}}]', '0', 'g')"


_COUNTS = ", ".join(f"len(regexp_extract_all({_ascii_words('text')}, '(?i){rx}', 1)) AS n_{name}"
                    for name, rx in Q.SIGNALS)
_NAMES = [n for n, _ in Q.SIGNALS]
_BEST = "greatest(" + ", ".join(f"n_{n}" for n in _NAMES) + ")"
_CLASS = ("CASE WHEN " + _BEST + " = 0 THEN 'general' " +
          " ".join(f"WHEN n_{n} = {_BEST} THEN '{n}'" for n in _NAMES) + " END")


@register("classify_questions", f"""
SELECT conv_id, turn, {_CLASS} AS query_type, {', '.join(f'n_{n}' for n in _NAMES)}
FROM (SELECT conv_id, turn, {_COUNTS} FROM conversations)""")
def classify_questions(spark, sf):
    """QP1: signal counts and class of every conversation turn."""
    c = table(spark, sf, "conversations")
    cnt = Q.signal_counts(F.col("text"))
    return c.select("conv_id", "turn", Q.classify(F.col("text")).alias("query_type"),
                    *[F.element_at(cnt, i + 1).alias(f"n_{n}") for i, n in enumerate(_NAMES)])


@register("extract_entities", f"""
SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS entities FROM (
  SELECT doc_id, list_filter(l, lambda x, i: NOT list_contains(l[1:i - 1], x)) AS list_distinct_ordered FROM (
    SELECT doc_id, list_concat(regexp_extract_all(text, '{Q.QUOTED_RE.replace("'", "''")}', 1),
                               regexp_extract_all({_ascii_words('text')}, '{Q.IDENT_RE}', 1)) AS l FROM documents))""")
def extract_entities(spark, sf):
    """QP2: quoted names and CamelCase / kebab-case identifiers of whole documents."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(Q.extract_entities(F.col("text")), "|").alias("entities"))


_RULES_SQL = "(VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool)
                                              else str(v)) for v in r) + ")" for r in Q.PLAN_RULES) + \
    ") AS r(query_type, use_code_retrieval, use_log_retrieval, use_concept_retrieval, use_graph_traversal, graph_depth," \
    " graph_direction, code_fetch_k, log_fetch_k, concept_fetch_k, similarity_threshold_override)"


@register("plan_questions", f"""
WITH c AS (SELECT conv_id, turn, {_CLASS} AS query_type FROM (SELECT conv_id, turn, {_COUNTS} FROM conversations))
SELECT conv_id, turn, c.query_type, use_code_retrieval, use_log_retrieval, use_concept_retrieval, use_graph_traversal,
       CASE WHEN use_graph_traversal THEN graph_depth ELSE 0 END AS graph_depth, graph_direction, code_fetch_k,
       log_fetch_k, concept_fetch_k, CAST(similarity_threshold_override AS DOUBLE) AS similarity_threshold_override
FROM c JOIN {_RULES_SQL} USING (query_type)""")
def plan_questions(spark, sf):
    """QP3 + QP4: retrieval plan of every conversation turn (graph depth 0 when off)."""
    c = table(spark, sf, "conversations").withColumnRenamed("text", "question")
    p = Q.plan_struct(Q.plan_questions(c))
    return p.select("conv_id", "turn", "plan.query_type", "use_code_retrieval", "use_log_retrieval",
                    "use_concept_retrieval", "use_graph_traversal", "plan.graph_depth", "graph_direction",
                    "code_fetch_k", "log_fetch_k", "concept_fetch_k", "similarity_threshold_override")


_DIMS_SQL = " UNION ALL ".join(
    f"SELECT {i} AS dim_no, '{label}' AS dimension, '{prompt}' AS prompt"
    for i, (label, prompt) in enumerate(REVIEW_DIMENSIONS))


@register("pr_review_questions", _PR_SQL + f""",
d AS (SELECT pr, string_agg(concat_ws(chr(10), CASE WHEN status = 'added' THEN '--- /dev/null' ELSE '--- a/' || filename END,
  CASE WHEN status = 'removed' THEN '+++ /dev/null' ELSE '+++ b/' || filename END, CASE WHEN patch <> '' THEN patch END),
  chr(10) ORDER BY file_no) AS diff FROM f GROUP BY 1)
SELECT pr, dim_no, dimension, prompt || chr(10) || chr(10) || substr(diff, 1, 2000) AS question
FROM d, ({_DIMS_SQL}) dims""")
def pr_review_questions(spark, sf):
    """VE18: five review questions (fixed dimension prompts + diff excerpt) per pull request."""
    return review_questions(S.unified_diff(_pr_files(spark, sf)))


@register("pr_review_scores")
def pr_review_scores(spark, sf):
    """VE18 + VE19 end to end: every PR's five questions (hashed embeddings) search
    the embedded code chunks (top 5, threshold 0.3); the review score and band
    come from all sources of the PR."""
    from ..operators import embed as EM
    from ..operators import graph as G
    from ..operators import vectors as V
    q = review_questions(S.unified_diff(_pr_files(spark, sf)))
    q = EM.embed(q.withColumn("query_id", F.col("pr") * 10 + F.col("dim_no")), "question", "code", 64)
    q = G._cut(q.select("query_id", "pr", "embedding"))  # counted, searched and joined: embed once
    ch = EM.embed(view(spark, sf, "v_chunks").select(F.col("chunk_id").alias("item_id"), "chunk_content"),
                  "chunk_content", "code", 64)
    hits = V.search(q.select("query_id", "embedding"), ch, 5, 0.3)
    # up to 25 hits a pull request: they are not to pass through the driver, however small Spark takes them to be
    src = q.select("query_id", "pr").join(hits.hint("merge"), "query_id", "left").select(F.col("pr").alias("query_id"), "similarity")
    return V.review_score(src).withColumnRenamed("query_id", "pr")
