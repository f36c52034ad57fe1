"""Source trees -> (repo, file_path, content) rows for chunking and dependency
extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.code import MAX_FILE_BYTES, SUPPORTED_EXTENSIONS, eligible, supported

# The bytes of one character in well-formed UTF-8, written as Latin-1 text.
_UTF8_CHAR = "|".join([
    r"[\x00-\x7F]", r"[\xC2-\xDF][\x80-\xBF]", r"\xE0[\xA0-\xBF][\x80-\xBF]", r"[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}",
    r"\xED[\x80-\x9F][\x80-\xBF]", r"\xF0[\x90-\xBF][\x80-\xBF]{2}", r"[\xF1-\xF3][\x80-\xBF]{3}", r"\xF4[\x80-\x8F][\x80-\xBF]{2}"])


def utf8_text(raw: Column) -> Column:
    """Bytes as text. Bytes that belong to no UTF-8 character are dropped; a replacement
    character that the bytes themselves spell stays."""
    kept = F.regexp_replace(F.decode(raw, "ISO-8859-1"), f"({_UTF8_CHAR})|[\\x80-\\xFF]", "$1")
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.encode(kept, "ISO-8859-1").cast("string"))


def _any_case(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def read_code_files(spark: SparkSession, path: str, repo: str | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """SR4: every supported, non-blank file under ``path`` (recursive), one row a file.

    Extension and length (``max_bytes`` on disk) are tested on the listing, so other files are
    not opened; the length bounds a row. Bytes outside UTF-8 are dropped. Paths are relative to
    ``path``."""
    names = "*{" + ",".join(_any_case(e) for e in sorted(SUPPORTED_EXTENSIONS)) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)
    base = path.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    rel = F.when(F.instr(rel, base) == 1, F.substring(rel, len(base) + 1, 1 << 30)).otherwise(rel)
    x = df.filter(F.col("length") <= max_bytes).select(
        F.lit(repo or path.rstrip("/").split("/")[-1]).alias("repo"), rel.alias("file_path"), utf8_text(F.col("content")).alias("content"))
    return eligible(supported(x))
