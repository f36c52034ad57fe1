"""Context assembly: result layouts, formatted context text, samples, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CONTENT_CHARS = 800
SUMMARY_MIN_CHARS = 50


def format_context(hits: DataFrame, group: str = "query_id", order: str = "rank",
                   max_chars: int = MAX_CONTENT_CHARS) -> DataFrame:
    """VE15: per group, ``### Match i — `path` (lines a-b) [score]`` + fenced content,
    joined by blank lines; the score is the rerank score when present, else the
    similarity as a percentage."""
    score = F.format_string("similarity: %.2f%%", F.col("similarity") * 100)
    if "rerank_score" in hits.columns:
        score = F.when(F.col("rerank_score").isNotNull(), F.format_string("rerank: %.3f", F.col("rerank_score"))) \
                 .otherwise(score)
    block = F.concat(F.lit("### Match "), F.col(order).cast("string"), F.lit(" — `"), F.col("file_path"),
                     F.lit("` (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"),
                     F.lit(") ["), score, F.lit("]\n```"), F.coalesce(F.col("language"), F.lit("")), F.lit("\n"),
                     F.substring(F.col("content"), 1, max_chars), F.lit("\n```"))
    g = hits.groupBy(group).agg(F.count(F.lit(1)).alias("n_matches"),
                                F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("_bs"))
    return g.select(group, "n_matches", F.array_join(F.transform("_bs", lambda s: s["b"]), "\n\n").alias("context"))


def combined_context(code: DataFrame | None = None, logs: DataFrame | None = None,
                     concepts: DataFrame | None = None, edges: DataFrame | None = None,
                     group: str = "query_id") -> DataFrame:
    """VE14: code, log, concept and graph rows in one 7-column layout
    (file_path, content, start_line, end_line, language, commit_sha, similarity)."""
    parts = []
    if code is not None:
        parts.append(code.select(group, F.lit("code").alias("layer"), "file_path", F.col("content"),
                                 F.col("start_line").cast("int"), F.col("end_line").cast("int"), "language",
                                 F.coalesce(F.col("commit_sha") if "commit_sha" in code.columns else F.lit(None),
                                            F.lit(None).cast("string")).alias("commit_sha"), "similarity"))
    if logs is not None:
        parts.append(logs.select(
            group, F.lit("log").alias("layer"), F.concat(F.lit("[LOG: "), F.col("service_name"), F.lit("]")).alias("file_path"),
            F.concat(F.lit("["), F.coalesce(F.col("level"), F.lit("LOG")), F.lit("] "),
                     F.coalesce(F.col("ts").cast("string"), F.lit("no-timestamp")), F.lit(": "), F.col("message")).alias("content"),
            F.coalesce(F.col("line_reference").cast("int"), F.lit(0)).alias("start_line"),
            F.coalesce(F.col("line_reference").cast("int"), F.lit(0)).alias("end_line"),
            F.lit("log").alias("language"), F.lit("n/a").alias("commit_sha"), "similarity"))
    if concepts is not None:
        parts.append(concepts.select(
            group, F.lit("concept").alias("layer"),
            F.concat(F.lit("[LOG PATTERN: "), F.col("service_name"), F.lit("]")).alias("file_path"),
            F.concat(F.lit("Pattern: "), F.col("template"), F.lit("\nOccurrences: "), F.col("total_occurrences").cast("string"),
                     F.lit(" | Severity: "), F.coalesce(F.col("severity"), F.lit("None")), F.lit(" | Trend: "),
                     F.col("trend")).alias("content"),
            F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit("log_concept").alias("language"),
            F.lit("n/a").alias("commit_sha"), "similarity"))
    if edges is not None:
        w = Window.partitionBy(group).orderBy("edge_no")
        e = edges.withColumn("_r", F.row_number().over(w)).filter("_r <= 5")
        parts.append(e.select(
            group, F.lit("graph").alias("layer"),
            F.concat(F.lit("[GRAPH EDGE: "), F.col("edge_type"), F.lit("]")).alias("file_path"),
            F.concat(F.col("source_entity"), F.lit(" --["), F.col("edge_type"), F.lit("]--> "), F.col("target_entity"),
                     F.lit(" (confidence="), F.format_string("%.2f", F.col("confidence")), F.lit(", level="),
                     F.coalesce(F.col("promotion_level"), F.lit("unknown")), F.lit(")")).alias("content"),
            F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit("graph").alias("language"),
            F.lit("n/a").alias("commit_sha"), F.coalesce(F.col("confidence"), F.lit(0.5)).alias("similarity")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_chunks(chunks: DataFrame, n_files: int = 30, chars: int = 400, repo: str = "repo_id") -> DataFrame:
    """VE21: first chunk of every file (by start line), files in path order, the
    first ``n_files`` per repository, content clipped."""
    w1 = Window.partitionBy(repo, "file_path").orderBy("start_line", "chunk_id")
    f = chunks.withColumn("_r", F.row_number().over(w1)).filter("_r = 1")
    w2 = Window.partitionBy(repo).orderBy("file_path")
    s = f.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= n_files)
    return s.select(repo, "file_path", "start_line", F.substring("chunk_content", 1, chars).alias("content"), "rank")


def stitch_summaries(summaries: DataFrame, group: str, order: str, summary: str = "summary",
                     path: str = "repo_path") -> DataFrame:
    """VE22: valid summaries (longer than 50 chars) of a repository set: one is
    returned as is, several become headed sections separated by rules."""
    v = summaries.filter(F.length(summary) > SUMMARY_MIN_CHARS)
    sec = F.concat(F.lit("## Repository: "), F.coalesce(F.col(path), F.col(order).cast("string")), F.lit("\n\n"), F.col(summary))
    g = v.groupBy(group).agg(F.count(F.lit(1)).alias("n_summaries"),
                             F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), sec.alias("s"),
                                                                  F.col(summary).alias("t")))).alias("_xs"))
    return g.select(group, "n_summaries", F.when(F.col("n_summaries") == 1, F.col("_xs")[0]["t"]).otherwise(
        F.array_join(F.transform("_xs", lambda x: x["s"]), "\n\n---\n\n")).alias("summary"))


def history_window(turns: DataFrame, n: int = 10, conv: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text") -> DataFrame:
    """VE20: the last ``n`` turns of every conversation, oldest first, as one
    ordered history (a bounded list of ``n`` entries) plus its text form."""
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    last = turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    g = last.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"),
                                                                      F.col(text).alias("content")))).alias("_h"))
    return g.select(conv, F.size("_h").alias("n_turns"),
                    F.array_join(F.transform("_h", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
                    .alias("history"))
