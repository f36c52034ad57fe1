"""Token and template expressions for log messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference).
PLACEHOLDER = "<*>"
ANSI_RE = r"\x1B\[[0-9;]*m"
# Characters Python's str.split() treats as whitespace, as one class that the
# Java and RE2 regex engines read the same way.
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Variable tokens (the whole token must match): UUID, IP[:port], hex >= 32,
# number with an optional unit, URL. \d of the reference is any decimal digit.
VARIABLE_RES = [
    r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})",
    r"\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}(?::\p{Nd}+)?",
    r"(?i:[0-9a-f]{32,})",
    r"\p{Nd}+(?:\.\p{Nd}+)?(?:ms|s|m|h|kb|mb|gb)?",
    r"https?://.+",
]
VARIABLE_RE = "^(?:" + "|".join(VARIABLE_RES) + ")$"
# a placeholder or marked variable followed by marked variables
COLLAPSE_RE = r" (<\*>|\n)(?: \n)+"


def tokenize(text: Column) -> Column:
    """Strip ANSI colour codes and split on whitespace, dropping empty tokens."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), ANSI_RE, ""), WS_CLASS)
    return F.filter(parts, lambda t: t != "")


def is_variable(tok: Column) -> Column:
    return tok.rlike(VARIABLE_RE)


def template(text: Column) -> Column:
    """Variables -> <*>, a variable right after a placeholder is dropped.

    Variables are first marked with a newline, which no token can contain, so a
    run collapses with one linear regex pass over the space-joined tokens."""
    mapped = F.transform(tokenize(text), lambda t: F.when(is_variable(t), F.lit("\n")).otherwise(t))
    joined = F.concat(F.lit(" "), F.array_join(mapped, " "))
    collapsed = F.regexp_replace(joined, COLLAPSE_RE, " $1")
    return F.regexp_replace(F.substring(collapsed, 2, 1 << 30), "\n", PLACEHOLDER)


def concept_id(service: Column, tmpl: Column) -> Column:
    """First 32 hex chars of sha256('service:template')."""
    return F.substring(F.sha2(F.concat_ws(":", F.coalesce(service, F.lit("")), tmpl), 256), 1, 32)


def duck_template_sql(msg: str) -> str:
    """DuckDB expression equal to :func:`template` (used by oracles)."""
    toks = (f"list_filter(string_split_regex(regexp_replace(coalesce({msg}, ''), '{ANSI_RE}', '', 'g'), "
            f"'{WS_CLASS}'), lambda t: t <> '')")
    mapped = f"list_transform({toks}, lambda t: CASE WHEN regexp_matches(t, '{VARIABLE_RE}') THEN chr(10) ELSE t END)"
    joined = f"(' ' || array_to_string({mapped}, ' '))"
    return (f"replace(substr(regexp_replace({joined}, '{COLLAPSE_RE}', ' \\1', 'g'), 2), chr(10), '<*>')")


def duck_concept_id_sql(service: str, tmpl: str) -> str:
    return f"substr(sha256(coalesce({service}, '') || ':' || {tmpl}), 1, 32)"
