"""Log sources: raw text files -> ordered lines -> parsed entries.

A document is one uploaded text (a file or a request body). Its lines are
parsed as JSON lines when the first non-blank line starts with ``{``, otherwise
as plain text where a line holding a timestamp or a level starts a new entry
and other lines (stack frames) attach to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.logparse import (has_level, has_ts, parse_error, parse_file_ref, parse_level,
                                  parse_ts, strip_ws)
from ..functions.text import WS_CLASS

# JSON keys consumed by the entry parser (others become metadata).
CONSUMED_KEYS = ["timestamp", "time", "level", "severity", "message", "msg", "error",
                 "exception", "file", "line"]

ENTRY_COLS = ["doc_id", "entry_no", "service_name", "source", "ts", "level", "message",
              "parsed_error", "file_reference", "line_reference", "metadata_json"]


def read_log_text(spark: SparkSession, path: str, service: str | None = None,
                  source: str = "file") -> DataFrame:
    """SR1: text files -> (doc_id, line_no, line, service_name, source).

    Files are read line by line (splittable, a large file spreads over tasks).
    A line's number is the number of lines in the earlier splits of its file
    (a small per-split table) plus its position inside its split, so no task
    numbers a whole file. ``service`` defaults to the file name without extension.
    """
    df = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("doc_id"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_pos"))
    blocks = df.groupBy("doc_id", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_p0"))
    wb = Window.partitionBy("doc_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(wb), F.lit(0))).drop("_n")
    x = df.join(blocks, ["doc_id", "_blk"])
    svc = F.lit(service) if service else F.regexp_extract(F.col("doc_id"), r"([^/]+?)(\.[^./]*)?$", 1)
    return x.select("doc_id", (F.col("_off") + F.col("_pos") - F.col("_p0")).alias("line_no"), "line",
                    svc.alias("service_name"), F.lit(source).alias("source"))


# Line breaks of Python's str.splitlines() (\r\n counts once).
LINE_BREAK_RE = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
LINE_CHUNK = 1 << 16   # order-dependent work is done per 65 536 lines of a document


def split_text(df: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """A text column -> one row per line (the breaks of ``str.splitlines``), numbered."""
    return df.select("*", F.posexplode(F.split(F.col(text), LINE_BREAK_RE)).alias("line_no", "line")).drop(text)


def _framed(lines: DataFrame, doc: str, line_no: str, line: str) -> DataFrame:
    """Apply ``text.strip()`` of the whole document: drop leading / trailing blank
    lines, strip the first line's head and the last line's tail; flag JSON docs.
    Per-document facts come from an aggregation (partial, skew-safe) joined back."""
    nonblank = strip_ws(F.col(line)) != ""
    nb_no = F.when(nonblank, F.col(line_no))
    stats = lines.groupBy(doc).agg(F.min(nb_no).alias("_first"), F.max(nb_no).alias("_last"),
                                   F.min_by(F.col(line), nb_no).alias("_first_line"))
    x = lines.join(stats, doc)
    x = x.filter((F.col(line_no) >= F.col("_first")) & (F.col(line_no) <= F.col("_last")))
    lead = F.regexp_replace(F.col(line), f"^{WS_CLASS}+", "")
    x = x.withColumn(line, F.when(F.col(line_no) == F.col("_first"), lead).otherwise(F.col(line)))
    x = x.withColumn(line, F.when(F.col(line_no) == F.col("_last"),
                                  F.regexp_replace(F.col(line), f"{WS_CLASS}+$", "")).otherwise(F.col(line)))
    is_json = F.startswith(F.regexp_replace(F.col("_first_line"), f"^{WS_CLASS}+", ""), F.lit("{"))
    return x.withColumn("is_json", is_json).drop("_last", "_first_line")


def detect_format(lines: DataFrame, doc: str = "doc_id", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """LP9: (doc, is_json) per document."""
    return _framed(lines, doc, line_no, line).groupBy(doc).agg(F.first("is_json").alias("is_json"))


def assemble_blocks(lines: DataFrame, doc: str = "doc_id", line_no: str = "line_no", line: str = "line",
                    keep: list[str] | None = None) -> DataFrame:
    """LP5: gaps-and-islands; a line with a timestamp or a level opens an entry,
    the first line always does; block text = its lines joined by newlines.
    The block number is a running count of entry starts, computed per chunk of
    lines with chunk offsets (no whole-document window)."""
    from ..operators.ordering import running_sums
    keep = keep or []
    if "_first" not in lines.columns:
        lines = lines.join(lines.groupBy(doc).agg(F.min(line_no).alias("_first")), doc)
    start = has_ts(F.col(line)) | has_level(F.col(line)) | (F.col(line_no) == F.col("_first"))
    x = running_sums(lines, [doc], [line_no], (F.col(line_no) / LINE_CHUNK).cast("bigint"),
                     {"_blk": start.cast("int")})
    g = x.groupBy(doc, "_blk").agg(
        F.min(line_no).alias("entry_no"),
        F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("n"), F.col(line).alias("l")))).alias("_ls"),
        *[F.first(c).alias(c) for c in keep])
    return g.select(doc, "entry_no", F.array_join(F.transform("_ls", lambda s: s["l"]), "\n").alias("text"), *keep)


def parse_plain(df: DataFrame, text: str = "text") -> DataFrame:
    """LP6: an entry's text -> timestamp, level, message, error, file and line."""
    t = F.col(text)
    ref = parse_file_ref(t)
    return df.select("*", parse_ts(t).alias("ts"), parse_level(t).alias("level"), t.alias("message"),
                     parse_error(t).alias("parsed_error"), ref["file"].alias("file_reference"),
                     ref["line"].alias("line_reference"),
                     F.lit(None).cast("map<string,string>").alias("metadata_json")).drop(text)


def _pick(m: Column, first: str, second: str) -> Column:
    """``d.get(first, d.get(second))``: key presence decides, not null-ness."""
    return F.when(F.map_contains_key(m, first), m[first]).otherwise(m[second])


def entry_from_map(m: Column, raw: Column) -> list[Column]:
    """LP7 + LP8: entry fields of a decoded JSON object (as map<string,string>).

    Returns the columns ts, level, message, parsed_error, file_reference,
    line_reference, metadata_json."""
    msg = F.coalesce(_pick(m, "message", "msg"), raw)   # a null message counts as missing
    lvl = F.upper(_pick(m, "level", "severity"))
    lvl = F.when(lvl.isNull() | (lvl == ""), parse_level(msg)).otherwise(lvl)
    f_raw, l_raw = m["file"], m["line"]
    missing = (f_raw.isNull() | (f_raw == "")) & (l_raw.isNull() | (l_raw == ""))
    ref = parse_file_ref(msg)
    err = _pick(m, "error", "exception")
    err = F.when(err.isNull() | (err == ""), parse_error(msg)).otherwise(err)
    meta = F.map_filter(m, lambda k, v: ~k.isin(CONSUMED_KEYS))
    return [parse_ts(_pick(m, "timestamp", "time")).alias("ts"), lvl.alias("level"), msg.alias("message"),
            err.alias("parsed_error"),
            F.when(missing, ref["file"]).otherwise(f_raw).alias("file_reference"),
            F.when(missing, ref["line"]).otherwise(l_raw.try_cast("int")).alias("line_reference"),
            F.when(F.size(meta) > 0, meta).alias("metadata_json")]


def parse_json_entry(df: DataFrame, line: str = "line") -> DataFrame:
    """JSON lines -> entries; a line that is not a JSON object is parsed as plain text."""
    x = df.withColumn("_m", F.from_json(F.col(line), "map<string,string>"))
    js = x.filter(F.col("_m").isNotNull()).select("*", *entry_from_map(F.col("_m"), F.col(line))).drop("_m", line)
    plain = parse_plain(x.filter(F.col("_m").isNull()).drop("_m").withColumnRenamed(line, "_text"), "_text")
    return js.unionByName(plain)


def parse_log_lines(lines: DataFrame, doc: str = "doc_id", line_no: str = "line_no", line: str = "line",
                    service: str = "service_name", source: str = "source") -> DataFrame:
    """SR2 / LP5-LP9: ordered lines of documents -> one row per log entry.

    One path for both formats: in a JSON-lines document every non-blank
    (stripped) line opens an entry, in a plain document a line with a timestamp
    or a level does (the first line always). A running count of entry starts
    numbers the entries, one aggregation gathers their lines, and each entry
    takes its fields from its JSON object when it decodes as one, else from the
    plain-text parser."""
    from ..operators.ordering import running_sums
    keep = [c for c in (service, source) if c in lines.columns]
    fr = _framed(lines, doc, line_no, line)
    js = F.col("is_json")
    x = fr.withColumn(line, F.when(js, strip_ws(F.col(line))).otherwise(F.col(line))) \
          .filter(~js | (F.col(line) != ""))
    start = js | has_ts(F.col(line)) | has_level(F.col(line)) | (F.col(line_no) == F.col("_first"))
    x = running_sums(x, [doc], [line_no], (F.col(line_no) / LINE_CHUNK).cast("bigint"), {"_blk": start.cast("int")})
    g = x.groupBy(doc, "_blk").agg(
        F.min(line_no).alias("entry_no"), F.first("is_json").alias("is_json"),
        F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("n"), F.col(line).alias("l")))).alias("_ls"),
        *[F.first(c).alias(c) for c in keep])
    g = g.select(doc, "entry_no", "is_json", F.array_join(F.transform("_ls", lambda s: s["l"]), "\n").alias("_text"),
                 *keep)
    g = g.withColumn("_m", F.when(F.col("is_json"), F.from_json(F.col("_text"), "map<string,string>")))
    t = F.col("_text")
    ref = parse_file_ref(t)
    plain = [parse_ts(t).alias("ts"), parse_level(t).alias("level"), t.alias("message"),
             parse_error(t).alias("parsed_error"), ref["file"].alias("file_reference"),
             ref["line"].alias("line_reference"), F.lit(None).cast("map<string,string>").alias("metadata_json")]
    structured = entry_from_map(F.col("_m"), t)
    decoded = F.col("_m").isNotNull()
    fields = [F.when(decoded, j).otherwise(pl).alias(n) for j, pl, n in zip(structured, plain, ENTRY_COLS[4:])]
    out = g.select(doc, "entry_no", *keep, *fields)
    for c in (service, source):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(doc, "entry_no", F.col(service).alias("service_name"), F.col(source).alias("source"),
                      *ENTRY_COLS[4:])


def metadata_text(m: Column) -> Column:
    """Canonical ``k=v;k=v`` text of a metadata map (sorted keys), for comparisons."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(m)),
                                    lambda k: F.concat(k, F.lit("="), F.coalesce(m[k], F.lit("null")))), ";")
