"""Helpers shared by the corpus operators: scratch tables in the shared folder,
null-safe joins, and a numpy kernel that finds and hashes the words of a whole
Arrow text column without a Python loop over words.

A *word* is a maximal run of bytes other than space, tab, newline, vertical tab,
form feed and carriage return (``[^\\x20\\x09-\\x0D]+``).
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, ensure_checkpoint_dir

#: Bytes of text that one numpy step handles (one document at least).
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LINE_END = np.zeros(256, dtype=bool)
LINE_END[0x0A] = True
#: Splits text into words on the JVM side.
SPACE_RE = r"[\x20\x09-\x0D]+"


# ---------------------------------------------------------------- Spark side

def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; Arrow batches are kept small
    enough that a batch of long documents fits a Python worker."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def scratch(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: cuts the
    lineage at a place every executor can read. The folder goes when the
    session ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath.getParent())
    return spark.read.schema(df.schema).parquet(path)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where null equals null; the keys come from ``left``."""
    r = right.select(*[F.col(k).alias(f"_jk{i}") if k in keys else F.col(k)
                       for k in right.columns for i in [keys.index(k) if k in keys else 0]])
    cond = None
    for i, k in enumerate(keys):
        c = left[k].eqNullSafe(r[f"_jk{i}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"_jk{i}" for i in range(len(keys))])


def with_row_key(df: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """(``df`` with a further column, its name): an integer of each row alone, ``id_col``
    itself where one row only has that id. Rows without an id, or whose id others have too,
    get numbers above all ids, in the order read; only those rows are written apart.
    The ids that others have are found from a count of ids; no text moves for it."""
    key = "_key"
    while key in df.columns:
        key += "_"
    odd = scratch(df.groupBy(F.col(id_col).alias("_odd")).agg(F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_odd").isNull() | (F.col("_n") > 1)).select("_odd"), "ids")
    top = df.agg(F.max(F.col(id_col).cast("long"))).first()[0]
    repeated = df[id_col].eqNullSafe(odd["_odd"])
    apart = scratch(df.join(odd, repeated, "left_semi")
                    .withColumn(key, F.monotonically_increasing_id() + F.lit(max(-1 if top is None else top, -1) + 1)), "apart")
    return df.join(odd, repeated, "left_anti").withColumn(key, F.col(id_col).cast("long")).unionByName(apart), key


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own (an input may
    carry any other columns)."""
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- Arrow side

def worker_state(name: str) -> dict:
    """A dictionary that this process keeps from task to task. The package is sent to the
    workers by value, so a global of its modules is a new one in every task."""
    held = sys.modules.setdefault("_logweave_worker_state", types.ModuleType("_logweave_worker_state"))
    return held.__dict__.setdefault(name, {})


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    bufs = arr.buffers()
    if len(arr) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(bufs[1], kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def blocks(data: np.ndarray, offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``limit`` bytes: (first, end, bytes, offsets)."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[int, np.ndarray] = {}
BASE_CHAR, BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    p = _POWERS.get(base)
    if p is None or len(p) < n:
        x = np.full(max(n, 1024), base & (2**64 - 1), dtype=np.uint64)
        x[0] = 1
        p = np.multiply.accumulate(x)
        if len(p) <= 1 << 20:
            _POWERS[base] = p
    return p[:n]


class Words:
    """The words of a block of documents: byte ranges ``starts`` / ``ends``, the
    first word of each document in ``first`` (one more entry at the end), and a
    64-bit ``code`` for each word's bytes. ``space``: which bytes part words
    (``LINE_END`` gives the lines that are not empty)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE):
        if lower:
            data = _LOWER[data]
        self.data, self.offs = data, offs
        n = len(data)
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(offs), np.int64)
            return
        inner = ~space[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offs] = True
        before = np.ones(n, dtype=bool)
        before[1:] = ~inner[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = ~inner[1:]
        self.starts = np.flatnonzero(inner & (before | cut[:n]))
        self.ends = np.flatnonzero(inner & (after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offs)
        self._inner = inner

    @property
    def code(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        at = np.cumsum(lens) - lens
        chars = self.data[self._inner]
        pos = np.arange(len(chars)) - np.repeat(at, lens)
        terms = _BYTE_CODE[chars] * powers(BASE_CHAR, int(lens.max()))[pos]
        return mix(np.add.reduceat(terms, at) + lens.astype(np.uint64))

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


class RabinKarp:
    """Rolling polynomial hashes (modulo 2 ** 64) of runs of word codes: one
    prefix sum, then every window of any length in three steps."""

    def __init__(self, code: np.ndarray, base: int):
        p = powers(base, len(code) + 1)
        self.inverse = powers(pow(base, -1, 2**64), len(code) + 1)
        self.prefix = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code * p[:len(code)], out=self.prefix[1:])

    def windows(self, width: int) -> np.ndarray:
        """Hash of the window that starts at each word (those that fit)."""
        n = len(self.prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[width:] - self.prefix[:n]) * self.inverse[:n])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words a .. b - 1 for each pair."""
        return mix((self.prefix[b] - self.prefix[a]) * self.inverse[a] + (b - a).astype(np.uint64))


def starts_of(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end start position, per document, of its windows of ``width`` words."""
    return first[:-1], np.maximum(first[:-1], first[1:] - width + 1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))
