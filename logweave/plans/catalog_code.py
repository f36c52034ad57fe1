"""Queries over code ingestion (``v_files``, ``v_chunks``, ``documents``,
``pages``) and developer profiles (``v_commits`` + ``v_commit_files``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS_CLASS
from ..operators import code as C
from ..operators import profiles as P
from ..sources.tables import table
from .registry import ntz, register
from .views import duck_view_sql, view

# ----------------------------------------------------------------- DuckDB twins

_EXT_SQL = "lower(regexp_extract(regexp_extract({p}, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1))"
_LANG_SQL = "(CASE " + " ".join(f"WHEN {_EXT_SQL} = '{k}' THEN '{v}'" for k, v in C.EXT_LANGUAGE.items()) + " END)"
_SUP_SQL = "(" + _EXT_SQL + " IN (" + ", ".join(f"'{e}'" for e in C.SUPPORTED_EXTENSIONS) + "))"
_RSTRIP = "regexp_replace({t}, '" + WS_CLASS + "+$', '')"
_BLANK = "(regexp_replace({t}, '" + WS_CLASS + "+', '', 'g') = '')"
_NLINES = "len(regexp_extract_all({t}, '" + C.SPLITLINES_RE + "'))"


def _f(tpl: str, t: str) -> str:
    return tpl.replace("{t}", t)


def _slide_sql(lines: str, offset: str, v: str) -> str:
    """Sliding windows over a list of lines (lambda variable name ``v``)."""
    n = f"len({lines})"
    k = f"(CASE WHEN {n} <= 60 THEN 0 ELSE CAST(ceil(({n} - 60) / 50) AS BIGINT) END)"
    starts = f"(CASE WHEN {n} = 0 THEN [] ELSE range(0, {k} * 50 + 1, 50) END)"
    t = f"{_f(_RSTRIP, t=f'array_to_string({lines}[{v} + 1 : least({v} + 60, {n})], chr(0))')}"
    t = t.replace("chr(0)", "''")
    wins = f"list_transform({starts}, lambda {v}: {{'w': {v}, 'e': least({v} + 60, {n}), 't': {t}}})"
    kept = (f"list_filter({wins}, lambda {v}x: NOT {_f(_BLANK, t=f'{v}x.t')} AND {_f(_NLINES, t=f'{v}x.t')} >= 5)")
    return (f"list_transform({kept}, lambda {v}y: {{'content': {v}y.t, 'start_line': CAST({v}y.w + 1 + {offset} AS INTEGER), "
            f"'end_line': CAST({v}y.e + {offset} AS INTEGER)}})")


def _marked_sql(content: str, lang: str) -> str:
    cases = " ".join(f"WHEN {lang} = '{lg}' THEN regexp_replace({content}, '(?m){rx}', chr(1) || '\\0', 'g')"
                     for lg, rx in C.BOUNDARY_PATTERNS.items())
    return f"(CASE {cases} ELSE {content} END)"


_CHUNK_SQL = f"""
x0 AS (SELECT *, {_LANG_SQL.format(p='file_path')} AS language,
              regexp_extract_all(content, '{C.SPLITLINES_RE}') AS lines FROM src),
x1 AS (SELECT *, list_filter(list_transform(string_split({_marked_sql('content', 'language')}, chr(10)),
              lambda s, i: CASE WHEN starts_with(s, chr(1)) THEN i - 1 ELSE -1 END), lambda i: i >= 0) AS b FROM x0),
x2 AS (SELECT *, array_to_string(lines[1 : greatest(b[1], 0)], '') AS pre_t,
              list_transform(b, lambda bb, i: {{'b': bb, 'e': coalesce(b[i + 1], len(lines))}}) AS pieces FROM x1),
x3 AS (SELECT *,
  list_concat(
    CASE WHEN len(b) > 0 AND b[1] > 0 AND NOT {_f(_BLANK, t='pre_t')} AND {_f(_NLINES, t='pre_t')} >= 5
         THEN [{{'content': {_f(_RSTRIP, t='pre_t')}, 'start_line': CAST(1 AS INTEGER), 'end_line': CAST(b[1] AS INTEGER)}}]
         ELSE [] END,
    flatten(list_transform(pieces, lambda p:
      CASE WHEN {_f(_BLANK, t="array_to_string(lines[p.b + 1 : p.e], '')")} THEN []
           WHEN len(lines[p.b + 1 : p.e]) > 60 THEN {_slide_sql('lines[p.b + 1 : p.e]', 'p.b', 'q')}
           ELSE [{{'content': {_f(_RSTRIP, t="array_to_string(lines[p.b + 1 : p.e], '')")},
                  'start_line': CAST(p.b + 1 AS INTEGER), 'end_line': CAST(p.e AS INTEGER)}}] END))) AS bc
  FROM x2),
x4 AS (SELECT *, CASE WHEN language IN ({', '.join(f"'{k}'" for k in C.BOUNDARY_PATTERNS)}) AND len(bc) > 0 THEN bc
                      ELSE {_slide_sql('lines', '0', 'w')} END AS chunks FROM x3),
ch AS (SELECT * EXCLUDE (chunks, lines, b, pre_t, pieces, bc, content), CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS chunk_no,
              unnest(chunks, recursive := true) FROM x4)"""

# ------------------------------------------------------------------ CI queries


@register("detect_language", f"""
SELECT file_path, {_EXT_SQL.format(p='file_path')} AS ext, {_LANG_SQL.format(p='file_path')} AS language,
       {_SUP_SQL.format(p='file_path')} AS supported FROM ({duck_view_sql('v_files')})""")
def detect_language(spark, sf):
    """CI1 + CI2: extension, language and support of every source file."""
    f = view(spark, sf, "v_files")
    p = F.col("file_path")
    return f.select("file_path", C.file_extension(p).alias("ext"), C.detect_language(p).alias("language"),
                    C.file_extension(p).isin(C.SUPPORTED_EXTENSIONS).alias("supported"))


@register("eligible_documents", f"""
SELECT doc_id, octet_length(encode(text)) AS n_bytes FROM documents
WHERE NOT {_f(_BLANK, t='text')} AND octet_length(encode(text)) <= 1000000""")
def eligible_documents(spark, sf):
    """CI3: non-blank texts of at most 1 000 000 UTF-8 bytes."""
    d = table(spark, sf, "documents").withColumnRenamed("text", "content")
    return C.eligible(d).select("doc_id", F.octet_length("content").alias("n_bytes"))


@register("chunk_files", f"""WITH src AS (SELECT * FROM ({duck_view_sql('v_files')}) WHERE {_SUP_SQL.format(p='file_path')}
  AND NOT {_f(_BLANK, t='content')} AND octet_length(encode(content)) <= 1000000),
{_CHUNK_SQL}
SELECT repo, file_path, chunk_no, start_line, end_line, language, content FROM ch""")
def chunk_files(spark, sf):
    """CI2-CI6: supported, eligible files -> boundary chunks (sliding fallback)."""
    f = C.eligible(C.supported(view(spark, sf, "v_files")))
    return C.chunk_files(f).select("repo", "file_path", "chunk_no", "start_line", "end_line", "language", "content")


@register("chunk_documents", f"""WITH src AS (SELECT doc_id, 'doc.txt' AS file_path, text AS content FROM documents
  WHERE NOT {_f(_BLANK, t='text')} AND octet_length(encode(text)) <= 1000000),
{_CHUNK_SQL}
SELECT doc_id, chunk_no, start_line, end_line, content FROM ch""")
def chunk_documents(spark, sf):
    """CI5 (+CI6 fallback): sliding windows of 60 lines (overlap 10) over whole documents."""
    d = table(spark, sf, "documents").select("doc_id", F.lit("doc.txt").alias("file_path"), F.col("text").alias("content"))
    return C.chunk_files(C.eligible(d)).select("doc_id", "chunk_no", "start_line", "end_line", "content")


@register("repo_names", """
SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '\\.git$', '') AS repo_name
FROM pages""")
def repo_names(spark, sf):
    """CI7: repository name from a URL (last segment without .git)."""
    return table(spark, sf, "pages").select("page_id", C.repo_name(F.col("url")).alias("repo_name"))


def _repos(spark, sf):
    c = view(spark, sf, "v_commits")
    return c.groupBy("repo_id").agg(F.min("committed_at").alias("created_at")) \
            .withColumn("commit_count", F.lit(0).cast("bigint")).withColumn("chunk_count", F.lit(0).cast("bigint")) \
            .withColumn("id", F.col("repo_id"))


_REPO_SQL = f"""WITH c AS ({duck_view_sql('v_commits')}), k AS ({duck_view_sql('v_chunks')}),
repos AS (SELECT repo_id, min(committed_at) AS created_at FROM c GROUP BY 1)"""


@register("repo_counters", _REPO_SQL + """
SELECT repo_id, (SELECT count(*) FROM c WHERE c.repo_id = repos.repo_id) AS commit_count,
       (SELECT count(*) FROM k WHERE k.repo_id = repos.repo_id) AS chunk_count FROM repos""")
def repo_counters(spark, sf):
    """CI8: commit and chunk counters added to every repository."""
    r = C.update_repo_counters(_repos(spark, sf), view(spark, sf, "v_commits"), view(spark, sf, "v_chunks"))
    return r.select("repo_id", "commit_count", "chunk_count")


@register("list_repos", _REPO_SQL + """
SELECT repo_id, created_at, row_number() OVER (ORDER BY created_at DESC, repo_id) AS rank FROM repos""")
def list_repos(spark, sf):
    """CI11: repositories newest first."""
    return C.list_repos(_repos(spark, sf)).select("repo_id", ntz("created_at").alias("created_at"), "rank")


def _states(spark, sf):
    """Ingestion states: the latest order per repository decides its state (SK4 replace)."""
    from ..sinks.merge import merge_replace
    o = table(spark, sf, "orders").select(
        F.concat(F.lit("repo"), (F.col("o_orderkey") % 13).cast("string")).alias("repo_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("completed")).when(F.col("o_orderstatus") == "O", F.lit("running"))
         .otherwise(F.lit("failed")).alias("state"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"), (F.col("o_orderkey") % 100).alias("files_processed"),
        F.when(F.col("o_orderstatus") == "P", F.lit("clone failed")).alias("error"), F.col("o_orderkey").alias("_o"))
    return merge_replace(None, o, ["repo_id"], order=["updated_at", "_o"]).drop("_o")


_STATE_SQL = f"""WITH c AS ({duck_view_sql('v_commits')}), k AS ({duck_view_sql('v_chunks')}),
o AS (SELECT 'repo' || CAST(o_orderkey % 13 AS VARCHAR) AS repo_id,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS state,
        o_orderdate AS updated_at, o_orderkey % 100 AS files_processed,
        CASE WHEN o_orderstatus = 'P' THEN 'clone failed' END AS error, o_orderkey FROM orders),
st AS (SELECT repo_id, arg_max(state, (updated_at, o_orderkey)) AS state, max(updated_at) AS updated_at,
         arg_max(files_processed, (updated_at, o_orderkey)) AS files_processed,
         arg_max_null(error, (updated_at, o_orderkey)) AS error FROM o GROUP BY 1)"""


@register("ingest_status", _STATE_SQL + """
SELECT arg_max(state, (updated_at, repo_id)) AS state, arg_max(repo_id, (updated_at, repo_id)) AS repo_id,
       (SELECT count(*) FROM c) AS commits_ingested, (SELECT count(*) FROM k) AS chunks_ingested,
       arg_max(files_processed, (updated_at, repo_id)) AS files_processed FROM st""")
def ingest_status(spark, sf):
    """CI9: totals and the most recently updated ingestion state."""
    return C.ingest_status(view(spark, sf, "v_commits"), view(spark, sf, "v_chunks"), _states(spark, sf))


@register("reset_states", _STATE_SQL + """
SELECT repo_id, CASE WHEN state IN ('failed', 'running') THEN 'completed' ELSE state END AS state,
       CASE WHEN state IN ('failed', 'running') THEN NULL ELSE error END AS error FROM st
WHERE state NOT IN ('failed', 'running') OR repo_id IN (SELECT repo_id FROM k)""")
def reset_states(spark, sf):
    """CI10: stale states completed when the repository has chunks, deleted otherwise."""
    out, _ = C.reset_states(_states(spark, sf), view(spark, sf, "v_chunks"))
    return out.select("repo_id", "state", "error")


def _raw_commits(spark, sf):
    o = table(spark, sf, "orders")
    cf = view(spark, sf, "v_commit_files")
    files = cf.groupBy("sha").agg(F.array_sort(F.collect_set("file_path")).alias("files_changed"))
    raw = o.select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("sha"),
                   F.concat(F.lit("repo"), (F.col("o_orderkey") % 10).cast("string")).alias("repo_id"),
                   F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("\n")).alias("message"),
                   F.when(F.col("o_custkey") % 17 == 0, F.lit("")).otherwise(
                       F.concat(F.lit("dev"), (F.col("o_custkey") % 50).cast("string"))).alias("author_name"),
                   F.when(F.col("o_custkey") % 19 == 0, F.lit(None).cast("string")).otherwise(
                       F.concat(F.lit("dev"), (F.col("o_custkey") % 50).cast("string"), F.lit("@example.org"))).alias("author_email"),
                   F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("committed_date"),
                   F.when(F.col("o_orderstatus") == "O", F.lit("HEAD")).otherwise(F.lit("main")).alias("branch"))
    return raw.join(files, "sha", "left")


@register("read_commits", """
WITH f AS (SELECT 'c' || CAST(l_orderkey AS VARCHAR) AS sha, list_sort(list(DISTINCT 'src/p' || CAST(l_partkey % 300 AS VARCHAR) ||
             CASE l_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.rs' ELSE '.md' END)) AS files
           FROM lineitem GROUP BY 1)
SELECT 'c' || CAST(o_orderkey AS VARCHAR) AS sha, o_orderpriority AS message,
       CASE WHEN o_custkey % 17 = 0 THEN 'Unknown' ELSE 'dev' || CAST(o_custkey % 50 AS VARCHAR) END AS author_name,
       CASE WHEN o_custkey % 19 = 0 THEN '' ELSE 'dev' || CAST(o_custkey % 50 AS VARCHAR) || '@example.org' END AS author_email,
       o_orderdate AS committed_at, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'main' END AS branch,
       array_to_string(coalesce(f.files, []), ',') AS files_changed
FROM orders LEFT JOIN f ON f.sha = 'c' || CAST(o_orderkey AS VARCHAR)""")
def read_commits(spark, sf):
    """SR5: commit export (from orders + lineitem) -> commit rows."""
    c = C.read_commits(_raw_commits(spark, sf))
    return c.select("sha", "message", "author_name", "author_email", ntz("committed_at").alias("committed_at"), "branch",
                    F.array_join("files_changed", ",").alias("files_changed"))


# ------------------------------------------------------------------ DP queries

_DP_SQL = f"""WITH c AS ({duck_view_sql('v_commits')}), cf AS ({duck_view_sql('v_commit_files')}),
k AS ({duck_view_sql('v_chunks')}),
t AS (SELECT DISTINCT author_email, file_path FROM c JOIN cf USING (sha)),
ac AS (SELECT * FROM (SELECT t.author_email, k.*, row_number() OVER (PARTITION BY t.author_email
         ORDER BY k.file_path, k.start_line, k.chunk_id) AS chunk_rank FROM t JOIN k USING (file_path)) WHERE chunk_rank <= 50)"""


def _ac(spark, sf):
    return P.author_chunks(view(spark, sf, "v_commits"), view(spark, sf, "v_commit_files"), view(spark, sf, "v_chunks"))


@register("author_commits", f"""WITH c AS ({duck_view_sql('v_commits')})
SELECT author_name, author_email, count(*) AS commit_count FROM c GROUP BY ALL""")
def author_commits(spark, sf):
    """DP1: commits per author name and email."""
    return P.author_commits(view(spark, sf, "v_commits"))


@register("touched_files", _DP_SQL + " SELECT author_email, file_path FROM t")
def touched_files(spark, sf):
    """DP2: distinct files each author touched."""
    return P.touched_files(view(spark, sf, "v_commits"), view(spark, sf, "v_commit_files"))


@register("author_chunks", _DP_SQL + " SELECT author_email, chunk_id, file_path, start_line, chunk_rank FROM ac")
def author_chunks(spark, sf):
    """DP3: up to 50 chunks of each author's touched files."""
    return _ac(spark, sf).select("author_email", "chunk_id", "file_path", "start_line", "chunk_rank")


def _top_sql(key: str, n: int, out: str) -> str:
    return f"""SELECT author_email, {key}, n, {out} FROM (SELECT *, row_number() OVER (PARTITION BY author_email
    ORDER BY n DESC, f) AS {out} FROM (SELECT author_email, {key}, count(*) AS n, min(chunk_rank) AS f FROM ac
    WHERE {key} IS NOT NULL GROUP BY ALL)) WHERE {out} <= {n}"""


@register("language_counts", _DP_SQL + " " + _top_sql("language", 10, "lang_rank"))
def language_counts(spark, sf):
    """DP4: languages of each author's chunks, top 10."""
    return P.language_counts(_ac(spark, sf)).select("author_email", "language", "n", "lang_rank")


@register("file_counts", _DP_SQL + " " + _top_sql("file_path", 20, "file_rank"))
def file_counts(spark, sf):
    """DP5: files of each author's chunks, top 20."""
    return P.file_counts(_ac(spark, sf)).select("author_email", "file_path", "n", "file_rank")


@register("code_samples", _DP_SQL + """
SELECT author_email, count(*) AS sample_count,
  string_agg(CASE WHEN chunk_rank <= 10 THEN '# ' || file_path || ':' || CAST(start_line AS VARCHAR) || '-' ||
             CAST(end_line AS VARCHAR) || chr(10) || substr(chunk_content, 1, 500) END,
             chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_rank) AS sample_text
FROM ac GROUP BY 1""")
def code_samples(spark, sf):
    """DP6: first 10 code samples per author."""
    return P.code_samples(_ac(spark, sf))


@register("upsert_profiles", f"""WITH c AS ({duck_view_sql('v_commits')}),
a AS (SELECT author_name, author_email, count(*) AS n FROM c GROUP BY ALL)
SELECT author_email, max(author_name) AS author_name, sum(n) AS commit_count FROM a GROUP BY 1""")
def upsert_profiles(spark, sf):
    """DP7: one profile per email (commit counts summed over name spellings)."""
    return P.upsert_profiles(None, P.author_commits(view(spark, sf, "v_commits"))) \
            .select("author_email", "author_name", "commit_count")


@register("list_profiles", _DP_SQL + """,
a AS (SELECT author_email, max(author_name) AS author_name, count(*) AS commit_count FROM c GROUP BY 1),
l AS (""" + _top_sql("language", 10, "lang_rank") + """),
l5 AS (SELECT author_email, string_agg(language || '=' || CAST(n AS VARCHAR), ',' ORDER BY lang_rank) AS languages
       FROM l WHERE lang_rank <= 5 GROUP BY 1)
SELECT author_name, a.author_email, commit_count,
       substr('Profile for ' || author_name || ' (' || CAST(commit_count AS VARCHAR) || ' commits)', 1, 200) AS summary_preview,
       coalesce(languages, '') AS languages,
       row_number() OVER (ORDER BY commit_count DESC, a.author_email) AS rank
FROM a LEFT JOIN l5 USING (author_email)""")
def list_profiles(spark, sf):
    """DP8: profiles by commit count with preview and top-5 languages."""
    prof = P.upsert_profiles(None, P.author_commits(view(spark, sf, "v_commits")))
    prof = prof.withColumn("pattern_summary", P.profile_summary(F.col("author_name"), F.col("commit_count")))
    return P.list_profiles(prof, P.language_counts(_ac(spark, sf)))


@register("profile_language_shares", _DP_SQL + """,
l AS (SELECT author_email, language, count(*) AS n FROM ac WHERE language IS NOT NULL GROUP BY ALL)
SELECT author_email, language, n, CAST(floor(n / sum(n) OVER (PARTITION BY author_email) * 100 + 0.5) AS INTEGER) AS share_pct
FROM l""")
def profile_language_shares(spark, sf):
    """DP9: language share of each author's chunks (percent, half up)."""
    l, _ = P.profile_shares(_ac(spark, sf))
    return l.select("author_email", "language", "n", "share_pct")


@register("profile_file_shares", _DP_SQL + """,
f AS (SELECT author_email, file_path, count(*) AS n, min(chunk_rank) AS f0 FROM ac GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY author_email ORDER BY n DESC, f0) AS file_rank,
             CAST(floor(n / max(n) OVER (PARTITION BY author_email) * 100 + 0.5) AS INTEGER) AS share_of_max_pct FROM f)
SELECT author_email, file_path, n, file_rank, share_of_max_pct,
       array_to_string(string_split(replace(file_path, '\\', '/'), '/')[-3:], '/') AS short_path
FROM r WHERE file_rank <= 15""")
def profile_file_shares(spark, sf):
    """DP9: most touched files (top 15) with share of the maximum and short path."""
    _, f = P.profile_shares(_ac(spark, sf))
    return f.select("author_email", "file_path", "n", "file_rank", "share_of_max_pct", "short_path")
