"""Code ingestion: languages, eligibility, chunking, repository bookkeeping.

Chunking builds all chunks of a file inside its row with higher-order
functions (files are capped at 1 MB), then explodes once: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS_CLASS

# Fixed values (must equal the reference).
EXT_LANGUAGE = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript",
                ".tsx": "typescript", ".go": "go", ".java": "java", ".rs": "rust"}
SUPPORTED_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".java", ".rs",
                        ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".swift",
                        ".kt", ".scala", ".sh", ".bash", ".yaml", ".yml", ".json",
                        ".toml", ".cfg", ".ini", ".md", ".rst", ".txt", ".sql",
                        ".html", ".css", ".scss", ".tf", ".hcl"]
BOUNDARY_PATTERNS = {
    "python": r"^(class\s+\w|def\s+\w|async\s+def\s+\w)",
    "javascript": r"^(function\s+\w|class\s+\w|const\s+\w+\s*=\s*(?:async\s+)?\(|export\s+(?:default\s+)?(?:function|class))",
    "typescript": r"^(function\s+\w|class\s+\w|const\s+\w+\s*=\s*(?:async\s+)?\(|export\s+(?:default\s+)?(?:function|class)|interface\s+\w)",
    "go": r"^(func\s+|type\s+\w+\s+struct)",
    "java": r"^(\s*(?:public|private|protected)?\s*(?:static\s+)?(?:class|interface|void|int|String|boolean)\s+\w)",
    "rust": r"^(pub\s+)?(?:fn\s+|struct\s+|impl\s+|trait\s+|enum\s+)",
}
MAX_CHUNK_LINES, MIN_CHUNK_LINES, OVERLAP_LINES = 60, 5, 10
MAX_FILE_BYTES = 1_000_000

# Line breaks of Python's str.splitlines(); a line keeps its terminator.
_BR = r"\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}"
SPLITLINES_RE = rf"[^{_BR}]*(?:\r\n|[{_BR}])|[^{_BR}]+\z"
MARK = "\u0001"  # inserted at boundary matches (only a marker, removed again)


def file_extension(path: Column) -> Column:
    """Lower-cased suffix of the last path component ('' for none / leading dot)."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def detect_language(path: Column) -> Column:
    """CI1: extension -> language, else null."""
    m = F.create_map(*[x for k, v in EXT_LANGUAGE.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, file_extension(path))


def supported(df: DataFrame, path: str = "file_path") -> DataFrame:
    """CI2: files with a supported extension."""
    return df.filter(file_extension(F.col(path)).isin(SUPPORTED_EXTENSIONS))


def rstrip_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS_CLASS}+$", "")


NON_WS_RE = "[^" + WS_CLASS[1:]   # any character that is not whitespace
# zero-width split after each line break (\r\n counts once), keeping the break
SPLIT_AFTER_BREAK = rf"(?<=\r\n|[\n\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]|\r(?!\n))"
_CHUNK_T = "array<struct<content:string,start_line:int,end_line:int>>"


def is_blank(c: Column) -> Column:
    return ~c.rlike(NON_WS_RE)


def eligible(df: DataFrame, content: str = "content") -> DataFrame:
    """CI3: non-blank files of at most 1 000 000 UTF-8 bytes."""
    return df.filter(~is_blank(F.col(content)) & (F.octet_length(content) <= MAX_FILE_BYTES))


def split_lines(content: Column) -> Column:
    """``str.splitlines(keepends=True)``."""
    return F.filter(F.split(content, SPLIT_AFTER_BREAK), lambda x: x != "")


def nonblank_index(lines: Column) -> Column:
    """Per line: its 0-based index when it holds a non-blank character, else -1."""
    return F.transform(lines, lambda l, i: F.when(l.rlike(NON_WS_RE), i).otherwise(F.lit(-1)))


def _chunk(content: Column, start: Column, end: Column) -> Column:
    return F.struct(content.alias("content"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))


def _last_nonblank(nb: Column, a: Column, b: Column) -> Column:
    """Largest non-blank line index in [a, b) (-1 when none)."""
    return F.coalesce(F.array_max(F.slice(nb, a + 1, F.greatest(b - a, F.lit(0)))), F.lit(-1))


def sliding_chunks(lines: Column, nb: Column, base, n, size: int = MAX_CHUNK_LINES, overlap: int = OVERLAP_LINES,
                   min_lines: int = MIN_CHUNK_LINES) -> Column:
    """CI5: windows of ``size`` lines every ``size - overlap`` lines over
    ``lines[base : base + n]``; the last window reaches the end; windows that are
    blank or span fewer than ``min_lines`` lines once trailing whitespace is
    stripped are dropped. ``nb`` is :func:`nonblank_index` of ``lines`` (a
    materialised column), so a window is judged without scanning its text."""
    step = max(1, size - overlap)
    base = F.lit(base) if isinstance(base, int) else base
    k = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step)).cast("int")
    starts = F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), k * step, F.lit(step)))
    wins = F.transform(starts, lambda w: F.struct(
        w.alias("w"), F.least(w + size, n).alias("e"),
        _last_nonblank(nb, base + w, base + F.least(w + size, n)).alias("last")))
    kept = F.filter(wins, lambda x: (x["last"] >= 0) & (x["last"] - (base + x["w"]) + 1 >= min_lines))
    return F.transform(kept, lambda x: _chunk(
        rstrip_ws(F.array_join(F.slice(lines, base + x["w"] + 1, x["e"] - x["w"]), "")),
        base + x["w"] + 1, base + x["e"]))


def _boundaries(content: Column, language: Column) -> Column:
    """0-based line numbers (counting '\\n') where a boundary match starts."""
    marked = None
    for lang, rx in BOUNDARY_PATTERNS.items():
        rep = F.regexp_replace(content, f"(?mdU){rx}", MARK + "$0")
        marked = F.when(language == lang, rep) if marked is None else marked.when(language == lang, rep)
    segs = F.split(marked.otherwise(content), "\n")
    idx = F.transform(segs, lambda s, i: F.when(F.startswith(s, F.lit(MARK)), i).otherwise(F.lit(-1)))
    return F.filter(idx, lambda i: i >= 0)


def boundary_chunks(lines: Column, nb: Column, bounds: Column) -> Column:
    """CI4: preamble (kept when >= 5 lines), then one chunk per boundary piece;
    pieces over 60 lines are cut by the sliding window with their line offset."""
    n = F.size(lines)
    b0 = F.element_at(bounds, 1)
    pre_n = F.least(F.greatest(b0, F.lit(0)), n)
    pre = F.when((F.size(bounds) > 0) & (b0 > 0) & (_last_nonblank(nb, F.lit(0), pre_n) >= 0) & (pre_n >= MIN_CHUNK_LINES),
                 F.array(_chunk(rstrip_ws(F.array_join(F.slice(lines, 1, pre_n), "")), F.lit(1), b0))) \
            .otherwise(F.array().cast(_CHUNK_T))
    pieces = F.transform(bounds, lambda b, i: F.struct(
        b.alias("b"), F.coalesce(F.try_element_at(bounds, i + 2), n).alias("e")))

    def piece_chunks(p):
        m = F.greatest(F.least(p["e"], n) - p["b"], F.lit(0))
        return F.when(_last_nonblank(nb, p["b"], p["b"] + m) < 0, F.array().cast(_CHUNK_T)) \
                .when(m > MAX_CHUNK_LINES, sliding_chunks(lines, nb, p["b"], m)) \
                .otherwise(F.array(_chunk(rstrip_ws(F.array_join(F.slice(lines, p["b"] + 1, m), "")), p["b"] + 1, p["e"])))
    return F.concat(pre, F.flatten(F.transform(pieces, piece_chunks)))


def chunk_files(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """CI6: boundary chunking when the language is known and yields chunks, else
    the sliding window over the whole file. One output row per chunk with
    (…, chunk_no, content, start_line, end_line, language)."""
    x = files.withColumn("language", detect_language(F.col(path))).withColumn("_lines", split_lines(F.col(content)))
    x = x.withColumn("_nb", nonblank_index(F.col("_lines")))
    x = x.withColumn("_b", F.when(F.col("language").isin(list(BOUNDARY_PATTERNS)),
                                  boundary_chunks(F.col("_lines"), F.col("_nb"),
                                                  _boundaries(F.col(content), F.col("language")))))
    chunks = F.when(F.size(F.coalesce(F.col("_b"), F.array())) > 0, F.col("_b")) \
              .otherwise(sliding_chunks(F.col("_lines"), F.col("_nb"), 0, F.size("_lines")))
    keep = [c for c in files.columns if c != content]
    return x.select(*keep, "language", F.posexplode(chunks).alias("chunk_no", "_c")) \
            .select(*keep, "chunk_no", "_c.content", "_c.start_line", "_c.end_line", "language")


def repo_name(url: Column) -> Column:
    """CI7: last path segment of a URL / path without a trailing ``.git``."""
    last = F.regexp_extract(F.regexp_replace(url, "/+$", ""), r"([^/]*)$", 1)
    return F.regexp_replace(last, r"\.git$", "")


def update_repo_counters(repos: DataFrame, commits: DataFrame, chunks: DataFrame, now: Column | None = None) -> DataFrame:
    """CI8: add ingested commits and chunks to each repository's counters."""
    c = commits.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_nc"))
    k = chunks.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_nk"))
    j = repos.join(c, "repo_id", "left").join(k, "repo_id", "left")
    out = j.withColumn("commit_count", F.col("commit_count") + F.coalesce("_nc", F.lit(0))) \
           .withColumn("chunk_count", F.col("chunk_count") + F.coalesce("_nk", F.lit(0)))
    if now is not None:
        out = out.withColumn("last_ingested_at", F.when(F.col("_nc").isNotNull() | F.col("_nk").isNotNull(), now)
                             .otherwise(F.col("last_ingested_at")))
    return out.drop("_nc", "_nk")


def ingest_status(commits: DataFrame, chunks: DataFrame, states: DataFrame) -> DataFrame:
    """CI9: global commit / chunk totals and the most recently updated state, in
    one aggregation over the three inputs."""
    st = F.struct("state", "repo_id", "files_processed")
    u = commits.select(F.lit(1).alias("_c"), F.lit(0).alias("_k"), F.lit(None).alias("_s"), F.lit(None).alias("_t")) \
        .unionByName(chunks.select(F.lit(0).alias("_c"), F.lit(1).alias("_k"), F.lit(None).alias("_s"), F.lit(None).alias("_t"))) \
        .unionByName(states.select(F.lit(0).alias("_c"), F.lit(0).alias("_k"), st.alias("_s"),
                                   F.struct("updated_at", "repo_id").alias("_t")), allowMissingColumns=True)
    g = u.agg(F.sum("_c").cast("bigint").alias("commits_ingested"), F.sum("_k").cast("bigint").alias("chunks_ingested"),
              F.max_by("_s", "_t").alias("_l"))
    return g.select(
        F.coalesce(F.col("_l.state"), F.lit("idle")).alias("state"), F.col("_l.repo_id").alias("repo_id"),
        "commits_ingested", "chunks_ingested", F.coalesce(F.col("_l.files_processed"), F.lit(0)).alias("files_processed"))


def reset_states(states: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CI10: failed / running states become completed when the repository has
    chunks and are deleted otherwise. Returns (states, reset count)."""
    has = chunks.select("repo_id").distinct().withColumn("_has", F.lit(True))
    j = states.join(has, "repo_id", "left")
    stale = F.col("state").isin("failed", "running")
    out = j.filter(~stale | F.col("_has").isNotNull()) \
           .withColumn("error", F.when(stale, F.lit(None).cast("string")).otherwise(F.col("error"))) \
           .withColumn("state", F.when(stale, F.lit("completed")).otherwise(F.col("state"))).drop("_has")
    n = states.agg(F.count_if(F.col("state").isin("failed", "running")).alias("reset"))
    return out, n


def list_repos(repos: DataFrame) -> DataFrame:
    """CI11: repositories newest first (rank column; ties by id)."""
    from .ordering import global_rank
    return global_rank(repos, [F.col("created_at").desc(), F.col("id")])


def read_commits(raw: DataFrame) -> DataFrame:
    """SR5: commit export rows -> commits: message trimmed, author defaults
    ``Unknown`` / empty, time as UTC timestamp, files_changed array."""
    return raw.select(
        "sha", "repo_id",
        F.regexp_replace(F.col("message"), f"^{WS_CLASS}+|{WS_CLASS}+$", "").alias("message"),
        F.coalesce(F.when(F.col("author_name") != "", F.col("author_name")), F.lit("Unknown")).alias("author_name"),
        F.coalesce(F.when(F.col("author_email") != "", F.col("author_email")), F.lit("")).alias("author_email"),
        F.timestamp_seconds(F.col("committed_date")).alias("committed_at"),
        F.when(F.col("branch") != "HEAD", F.col("branch")).alias("branch"),
        F.coalesce(F.col("files_changed"), F.array().cast("array<string>")).alias("files_changed"))
