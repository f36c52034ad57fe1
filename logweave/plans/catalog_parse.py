"""Queries over log parsing: timestamps, levels, frames, errors, blocks, JSON lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logparse as P
from ..functions.text import WS_CLASS
from ..sources import logs as S
from ..sources.tables import table
from .registry import ntz, register
from .views import duck_view_sql, view

_FILE_SQL, _LINE_SQL = P.parse_file_sql("raw_line")


@register("parse_plain_logs", f"""
SELECT log_id, {P.parse_ts_sql('raw_line')} AS ts, {P.parse_level_sql('raw_line')} AS level,
       {P.parse_error_sql('raw_line')} AS parsed_error, {_FILE_SQL} AS file_reference, {_LINE_SQL} AS line_reference
FROM ({duck_view_sql('v_logs')})""")
def parse_plain_logs(spark, sf):
    """LP1-LP4, LP6 over raw log lines."""
    lg = view(spark, sf, "v_logs").select("log_id", "raw_line")
    p = S.parse_plain(lg, "raw_line")
    return p.select("log_id", ntz("ts").alias("ts"), "level", "parsed_error", "file_reference", "line_reference")


_MF, _ML = P.parse_file_sql("message")


@register("parse_messages", f"""
SELECT log_id, {P.parse_error_sql('message')} AS parsed_error, {P.parse_level_sql('message')} AS level,
       {_MF} AS file_reference, {_ML} AS line_reference
FROM ({duck_view_sql('v_logs')})""")
def parse_messages(spark, sf):
    """LP2-LP4 over log messages (error phrase, level, generic file:line)."""
    lg = view(spark, sf, "v_logs")
    ref = P.parse_file_ref(F.col("message"))
    return lg.select("log_id", P.parse_error(F.col("message")).alias("parsed_error"),
                     P.parse_level(F.col("message")).alias("level"),
                     ref["file"].alias("file_reference"), ref["line"].alias("line_reference"))


_DF, _DL = P.parse_file_sql("text")


@register("parse_documents", f"""
SELECT doc_id, {P.parse_ts_sql('text')} AS ts, {P.parse_level_sql('text')} AS level,
       {_DF} AS file_reference, {_DL} AS line_reference FROM documents""")
def parse_documents(spark, sf):
    """LP1-LP3 over whole documents (prose with occasional numbers and paths)."""
    d = table(spark, sf, "documents")
    t = F.col("text")
    ref = P.parse_file_ref(t)
    return d.select("doc_id", ntz(P.parse_ts(t)).alias("ts"), P.parse_level(t).alias("level"),
                    ref["file"].alias("file_reference"), ref["line"].alias("line_reference"))


def _strip(x: str) -> str:
    return P.strip_ws_sql(x)


_FRAME_SQL = f"""
ll AS ({duck_view_sql('v_log_lines')}),
fr0 AS (SELECT *, min(CASE WHEN {_strip('line')} <> '' THEN line_no END) OVER (PARTITION BY doc_id) AS _first,
                  max(CASE WHEN {_strip('line')} <> '' THEN line_no END) OVER (PARTITION BY doc_id) AS _last FROM ll),
fr1 AS (SELECT doc_id, line_no, _first, _last,
               CASE WHEN line_no = _first THEN regexp_replace(line, '^{WS_CLASS}+', '') ELSE line END AS line0
        FROM fr0 WHERE line_no BETWEEN _first AND _last),
fr2 AS (SELECT doc_id, line_no, _first,
               CASE WHEN line_no = _last THEN regexp_replace(line0, '{WS_CLASS}+$', '') ELSE line0 END AS line FROM fr1),
fr AS (SELECT *, starts_with(max(CASE WHEN line_no = _first THEN line END) OVER (PARTITION BY doc_id), '{{') AS is_json
       FROM fr2)"""


@register("detect_format", f"WITH {_FRAME_SQL} SELECT doc_id, any_value(is_json) AS is_json FROM fr GROUP BY doc_id")
def detect_format(spark, sf):
    """LP9: a document is JSON lines when its first non-blank line starts with '{'."""
    return S.detect_format(view(spark, sf, "v_log_lines"))


_BLOCK_SQL = _FRAME_SQL + f""",
pl AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{P.TS_RE_1}') OR regexp_matches(line, '(?i)\\b{P.LEVEL_WORDS}\\b')
                          OR line_no = _first THEN 1 ELSE 0 END)
                 OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS blk
       FROM fr WHERE NOT is_json),
bl AS (SELECT doc_id, min(line_no) AS entry_no, string_agg(line, chr(10) ORDER BY line_no) AS text
       FROM pl GROUP BY doc_id, blk)"""


@register("assemble_blocks", f"WITH {_BLOCK_SQL} SELECT doc_id, entry_no, text FROM bl")
def assemble_blocks(spark, sf):
    """LP5: multi-line entries of the plain-text documents."""
    fr = S._framed(view(spark, sf, "v_log_lines"), "doc_id", "line_no", "line")
    return S.assemble_blocks(fr.filter(~F.col("is_json")))


def _jget(k: str) -> str:
    return f"json_extract_string(line, '$.\"{k}\"')"


def _jhas(k: str) -> str:
    return f"list_contains(json_keys(line), '{k}')"


def _jpick(a: str, b: str) -> str:
    return f"(CASE WHEN {_jhas(a)} THEN {_jget(a)} ELSE {_jget(b)} END)"


_KEYS = ", ".join(f"'{k}'" for k in S.CONSUMED_KEYS)
_BF, _BL = P.parse_file_sql("text")
_JF, _JL = P.parse_file_sql("msg")

_PARSE_SQL = "WITH " + _BLOCK_SQL + f""",
js0 AS (SELECT doc_id, line_no AS entry_no, {_strip('line')} AS line FROM fr WHERE is_json),
js1 AS (SELECT * FROM js0 WHERE line <> ''),
jo AS (SELECT *, coalesce({_jpick('message', 'msg')}, line) AS msg FROM js1
       WHERE json_valid(line) AND json_type(line) = 'OBJECT'),
jp AS (SELECT doc_id, entry_no, line AS text FROM js1 WHERE NOT (json_valid(line) AND json_type(line) = 'OBJECT')),
jx AS (SELECT doc_id, entry_no,
         {P.parse_ts_sql(_jpick('timestamp', 'time'))} AS ts,
         CASE WHEN coalesce(upper({_jpick('level', 'severity')}), '') = '' THEN {P.parse_level_sql('msg')}
              ELSE upper({_jpick('level', 'severity')}) END AS level,
         msg AS message,
         CASE WHEN coalesce({_jpick('error', 'exception')}, '') = '' THEN {P.parse_error_sql('msg')}
              ELSE {_jpick('error', 'exception')} END AS parsed_error,
         CASE WHEN coalesce({_jget('file')}, '') = '' AND coalesce({_jget('line')}, '') = '' THEN {_JF}
              ELSE {_jget('file')} END AS file_reference,
         CASE WHEN coalesce({_jget('file')}, '') = '' AND coalesce({_jget('line')}, '') = '' THEN {_JL}
              ELSE TRY_CAST({_jget('line')} AS INTEGER) END AS line_reference,
         array_to_string(list_transform(list_sort(list_filter(json_keys(line), lambda k: k NOT IN ({_KEYS}))),
              lambda k: k || '=' || coalesce(json_extract_string(line, '$."' || k || '"'), 'null')), ';') AS meta
       FROM jo),
px AS (SELECT doc_id, entry_no, {P.parse_ts_sql('text')} AS ts, {P.parse_level_sql('text')} AS level, text AS message,
              {P.parse_error_sql('text')} AS parsed_error, {_BF} AS file_reference, {_BL} AS line_reference,
              NULL AS meta FROM (SELECT * FROM bl UNION ALL SELECT * FROM jp))
SELECT doc_id, entry_no, ts, level, message, parsed_error, file_reference, line_reference,
       CASE WHEN meta = '' THEN NULL ELSE meta END AS metadata
FROM (SELECT * FROM jx UNION ALL SELECT * FROM px)"""


@register("parse_log_lines", _PARSE_SQL)
def parse_log_lines(spark, sf):
    """SR2 / LP5-LP9: documents of lines -> log entries (JSON lines or multi-line plain)."""
    e = S.parse_log_lines(view(spark, sf, "v_log_lines"))
    return e.select("doc_id", "entry_no", ntz("ts").alias("ts"), "level", "message", "parsed_error",
                    "file_reference", "line_reference", S.metadata_text(F.col("metadata_json")).alias("metadata"))
