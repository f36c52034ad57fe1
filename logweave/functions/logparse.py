"""Column expressions that parse log text: timestamp, level, file reference, error.

Each Spark expression has a DuckDB twin (``*_sql``) used by the oracles; the
patterns avoid engine-specific classes so Java regex and RE2 agree on ASCII
text, and ``(?U)`` gives the Unicode word classes of the reference where it
matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS

# Fixed values (must equal the reference): timestamp, level, frame and error patterns.
TS_RE_1 = r"([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)"
TS_RE_2 = r"([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})"
LEVEL_WORDS = r"(CRITICAL|FATAL|ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE)"
LEVEL_RE = r"(?i)\b" + LEVEL_WORDS + r"\b"
FILE_REF_RES = [
    r'File "([^"]+)", line ([0-9]+)',            # Python frame
    r"at\s+\S+\((\S+\.java):([0-9]+)\)",          # Java frame
    r"(\S+\.\w{1,4}):([0-9]+)",                   # generic file.ext:line
]
ERROR_RE = r"(?iU)\b(\w*(?:Error|Exception|Fault|Failure|Panic)\b[^\n]*)"

# pieces of a matched timestamp: date, time, fraction, zone
_TS_PARTS = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})([T ])([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]+))?(Z|[+-][0-9]{2}:?[0-9]{2})?$"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def _ts_from_match(m: Column, compat: bool) -> Column:
    date = F.regexp_extract(m, _TS_PARTS, 1)
    sep = F.regexp_extract(m, _TS_PARTS, 2)
    tod = F.regexp_extract(m, _TS_PARTS, 3)
    frac = F.regexp_extract(m, _TS_PARTS, 4)
    zone = F.regexp_extract(m, _TS_PARTS, 5)
    # Formats tried in order by the reference: T-form with fraction + Z / Z /
    # fraction + offset / offset, space form bare, T-form bare. Fractions take at
    # most 6 digits; a T-form fraction needs a zone; the space form takes neither.
    ok_t = (sep == "T") & (F.length(frac) <= 6) & ~((F.length(frac) > 0) & (zone == ""))
    ok_sp = (sep == " ") & (frac == "") & (zone == "")
    base = F.try_to_timestamp(F.concat_ws(" ", date, tod), F.lit("yyyy-MM-dd HH:mm:ss"))
    frac_us = F.when(frac == "", F.lit(0)).otherwise(F.rpad(frac, 6, "0").cast("bigint"))
    us = F.unix_micros(base) + frac_us
    if not compat:
        sign = F.when(F.substring(zone, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
        digits = F.regexp_replace(zone, "[^0-9]", "")
        off_us = sign * (F.substring(digits, 1, 2).cast("bigint") * 3600 + F.substring(digits, 3, 2).cast("bigint") * 60) \
            * F.lit(1_000_000)
        us = us - F.when(zone.isin("", "Z"), F.lit(0)).otherwise(off_us)
    return F.when((m != "") & (ok_t | ok_sp), F.timestamp_micros(us))


def parse_ts(text: Column, compat: bool = True) -> Column:
    """LP1: first pattern that matches and parses wins. ``compat`` keeps the wall
    clock and stamps it UTC (the offset is dropped, as the reference does)."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    first = _ts_from_match(F.regexp_extract(t, TS_RE_1, 1), compat)
    m2 = F.regexp_extract(t, TS_RE_2, 1)
    second = F.when(m2 != "", F.try_to_timestamp(m2, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(first, second)


def has_ts(text: Column) -> Column:
    return F.coalesce(text.rlike(TS_RE_1), F.lit(False))


def parse_level(text: Column) -> Column:
    """LP2: first level word, upper-cased, WARNING -> WARN; none -> null."""
    w = F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), LEVEL_RE, 1))
    return F.when(w == "", F.lit(None).cast("string")).when(w == "WARNING", F.lit("WARN")).otherwise(w)


def has_level(text: Column) -> Column:
    return F.coalesce(text.rlike(LEVEL_RE), F.lit(False))


def parse_file_ref(text: Column) -> Column:
    """LP3: struct(file, line) from a Python frame, else a Java frame, else file.ext:line."""
    t = F.coalesce(text, F.lit(""))
    pats = [f"(?U){p}" for p in FILE_REF_RES]
    file_ = F.coalesce(*[F.when(t.rlike(p), F.regexp_extract(t, p, 1)) for p in pats])
    line = F.coalesce(*[F.when(t.rlike(p), F.regexp_extract(t, p, 2)) for p in pats])
    return F.struct(file_.alias("file"), line.cast("int").alias("line"))


def parse_error(text: Column) -> Column:
    """LP4: from the first word containing Error/Exception/Fault/Failure/Panic to the line end."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(ERROR_RE), strip_ws(F.regexp_extract(t, ERROR_RE, 1)))


# ------------------------------------------------------------------ DuckDB twins


def parse_ts_sql(x: str) -> str:
    m = f"regexp_extract(coalesce(CAST({x} AS VARCHAR), ''), '{TS_RE_1}', 1)"
    p = _TS_PARTS
    date, sep, tod = (f"regexp_extract({m}, '{p}', {i})" for i in (1, 2, 3))
    frac, zone = (f"regexp_extract({m}, '{p}', {i})" for i in (4, 5))
    ok = (f"(({sep} = 'T' AND length({frac}) <= 6 AND NOT (length({frac}) > 0 AND {zone} = '')) OR "
          f"({sep} = ' ' AND {frac} = '' AND {zone} = ''))")
    base = f"try_strptime({date} || ' ' || {tod}, '%Y-%m-%d %H:%M:%S')"
    fr = f"(CASE WHEN {frac} = '' THEN 0 ELSE CAST(rpad({frac}, 6, '0') AS BIGINT) END)"
    first = f"(CASE WHEN {m} <> '' AND {ok} THEN make_timestamp(epoch_us({base}) + {fr}) END)"
    m2 = f"regexp_extract(coalesce(CAST({x} AS VARCHAR), ''), '{TS_RE_2}', 1)"
    second = f"(CASE WHEN {m2} <> '' THEN try_strptime({m2}, '%Y-%m-%d %H:%M:%S') END)"
    return f"coalesce({first}, {second})"


def parse_level_sql(x: str) -> str:
    # RE2 has no case-insensitive \b issues for ASCII input
    w = f"upper(regexp_extract(coalesce({x}, ''), '(?i)\\b{LEVEL_WORDS}\\b', 1))"
    return f"(CASE WHEN {w} = '' THEN NULL WHEN {w} = 'WARNING' THEN 'WARN' ELSE {w} END)"


def parse_file_sql(x: str) -> tuple[str, str]:
    t = f"coalesce({x}, '')"
    files = ", ".join(f"CASE WHEN regexp_matches({t}, '{p}') THEN regexp_extract({t}, '{p}', 1) END" for p in FILE_REF_RES)
    lines = ", ".join(f"CASE WHEN regexp_matches({t}, '{p}') THEN regexp_extract({t}, '{p}', 2) END" for p in FILE_REF_RES)
    return f"coalesce({files})", f"CAST(coalesce({lines}) AS INTEGER)"


def parse_error_sql(x: str) -> str:
    t = f"coalesce({x}, '')"
    pat = ERROR_RE.replace("(?iU)", "(?i)")
    return (f"(CASE WHEN regexp_matches({t}, '{pat}') THEN "
            f"regexp_replace(regexp_extract({t}, '{pat}', 1), '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g') END)")


def strip_ws_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"
