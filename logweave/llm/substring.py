"""Substring dedup: passages of ``width`` words that a document with a smaller id has too.

Rabin-Karp hashes of every window of ``width`` consecutive words are counted in
Spark by the smallest id they start in; a window that an earlier document also has is
repeated, and overlapping repeated windows merge into maximal removal intervals.

Windows that cannot repeat never leave their task. Every window has an *anchor*: the
smallest hash among the runs of ``ANCHOR_WORDS`` words inside it. Equal windows have
equal anchors, so a window whose anchor no other document has is unique. A first
pass over the texts writes each document's distinct anchors (about one for 16 words);
only windows with a shared anchor are hashed in full and moved in the second. Nothing
is lost by this, whatever the data.

Copies: of documents with the same word sequence only the smallest id is searched;
all words of the others lie in its windows (if it has ``width`` words at all).

Hot passages: counts are partial aggregates (one row of a hash for each task), and
joins back on a hash are plain joins, whose large partitions adaptive execution
splits. A window is identified by two independent 64-bit hashes.

Null or empty texts have no words; nothing is removed from them. Rows that share an
id count as one document's parts: they never make each other's words go. A null id
comes before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (BASE_A, BASE_B, RabinKarp, Words, blocks, id_text, join_on, list_array, prepare, scratch, signed,
                     text_buffers)

#: Words in the runs whose smallest hash anchors a window (fewer for narrow windows).
ANCHOR_WORDS = 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` entries."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:]) if len(x) > have else x[:0]
        have *= 2
    rest = width - have
    if rest and len(x):
        x = np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]
    return x


def _windows(w: Words, width: int):
    """(anchor of the window at each word, hash, second hash), and each document's
    first and end window start."""
    code = w.code
    run = min(ANCHOR_WORDS, width)
    one, two = RabinKarp(code, BASE_A), RabinKarp(code, BASE_B)
    anchor = _sliding_min(one.windows(run), width - run + 1)
    last = np.maximum(w.first[:-1], w.first[1:] - width + 1)
    return anchor, one, two, last


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            data, offs = text_buffers(rb.column(1))
            for i, j, d, o in blocks(data, offs):
                w = Words(d, o)
                anchor, one, two, last = _windows(w, width)
                lists = [np.unique(anchor[a:b]) for a, b in zip(w.first[:-1].tolist(), last.tolist())]
                count = np.array([len(x) for x in lists])
                flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(i, j - i), pa.array(w.count.astype(np.int64)),
                     pa.array(signed(one.spans(w.first[:-1], w.first[1:]))), pa.array(signed(two.spans(w.first[:-1], w.first[1:]))),
                     list_array(signed(flat), count, pa.int64())], ["_id", "n_words", "_s1", "_s2", "_anchors"])
    return run


def _candidates(width: int):
    """Windows whose anchor is among the shared ones of their document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            data, offs = text_buffers(rb.column(1))
            shared = rb.column(2)
            at, all_shared = shared.offsets.to_numpy(), shared.values.to_numpy().view(np.uint64)
            for i, j, d, o in blocks(data, offs):
                w = Words(d, o)
                anchor, one, two, last = _windows(w, width)
                h1, h2 = one.windows(width), two.windows(width)
                found = []
                for k, a, b in zip(range(i, j), w.first[:-1].tolist(), last.tolist()):
                    own = np.isin(anchor[a:b], all_shared[at[k]:at[k + 1]])
                    found.append(np.flatnonzero(own) + a)
                count = np.array([len(x) for x in found])
                pos = np.concatenate(found)
                local = pos - np.repeat(w.first[:-1], count)
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(i, j - i), list_array(local.astype(np.int32), count, pa.int32()),
                     list_array(signed(h1[pos]), count, pa.int64()), list_array(signed(h2[pos]), count, pa.int64())],
                    ["_id", "_at", "_h1", "_h2"])
    return run


def covered(n_words: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window that starts at one of ``starts``: the union of
    the windows, as maximal runs."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(width: int):
    """Remove the words; _all: every word goes (a copy)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            data, offs = text_buffers(rb.column(1))
            gone_all = rb.column(2).to_pylist()
            n_words, n_removed, sha, texts = [], [], [], []
            for k in range(rb.num_rows):
                raw = data[offs[k]:offs[k + 1]].tobytes()
                words = raw.split()
                starts = rb.column(3)[k]
                removed, text = 0, None
                if gone_all[k]:
                    removed, kept, text = len(words), b"", b""
                elif starts.is_valid and len(starts.values):
                    gone = covered(len(words), starts.values.to_numpy(zero_copy_only=False).astype(np.int64), width)
                    removed = int(gone.sum())
                    kept = b" ".join([x for x, g in zip(words, gone.tolist()) if not g])
                    text = _spans_left(raw, gone)
                else:
                    kept = b" ".join(words)
                n_words.append(len(words))
                n_removed.append(removed)
                sha.append(hashlib.sha256(kept).hexdigest())
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()),
                 pa.array([t if t is None else t.decode("utf-8", "replace") for t in texts], pa.string())],
                ["_id", "n_words", "n_removed", "kept_sha256", "_cut_text"])
    return run


def _spans_left(raw: bytes, gone: np.ndarray) -> bytes:
    """The text without the removed words; what stood between kept words stays."""
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    out, at = [], 0
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(raw[at:int(w.starts[a])])
        at = int(w.starts[b]) if b < len(gone) else len(raw)
    out.append(raw[at:])
    return b"".join(out)


def repeated_windows(df: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _all, _starts): documents that lose words; ``_all``: every word goes,
    else the starts of their repeated windows."""
    prepare(df.sparkSession)
    src = id_text(df, id_col, text_col)
    kind = src.schema["_id"].dataType.simpleString()
    prof = scratch(src.mapInArrow(_profile(width), f"_id {kind}, n_words bigint, _s1 bigint, _s2 bigint, _anchors array<bigint>")
                   .filter(F.col("n_words") >= width), "profile")
    head = prof.groupBy("_s1", "_s2", "n_words").agg(F.min(F.struct("_id")).alias("_rep"))
    owned = join_on(prof.select("_id", "_s1", "_s2", "n_words"), head, ["_s1", "_s2", "n_words"]) \
        .select("_id", F.col("_rep")["_id"].alias("_rep"))
    copies = owned.filter(~F.col("_id").eqNullSafe(F.col("_rep"))).select("_id").distinct()

    reps = join_on(prof.select("_id", "_anchors"), copies, ["_id"], "left_anti")
    anchors = reps.select("_id", F.explode("_anchors").alias("_anchor"))
    shared = anchors.groupBy("_anchor").agg(F.min(F.struct("_id")).alias("_a"), F.max(F.struct("_id")).alias("_b")) \
                    .filter(~F.col("_a")["_id"].eqNullSafe(F.col("_b")["_id"])).select("_anchor")
    mine = anchors.join(shared, "_anchor", "left_semi").groupBy("_id").agg(F.collect_set("_anchor").alias("_shared"))
    mine = scratch(mine, "shared")
    windows = join_on(src, mine, ["_id"]).select("_id", "_text", "_shared") \
        .mapInArrow(_candidates(width), f"_id {kind}, _at array<int>, _h1 array<bigint>, _h2 array<bigint>") \
        .select("_id", F.explode(F.arrays_zip("_at", "_h1", "_h2")).alias("w")) \
        .select("_id", F.col("w._at").alias("_at"), F.col("w._h1").alias("_h1"), F.col("w._h2").alias("_h2"))
    windows = scratch(windows, "windows")
    first = windows.groupBy("_h1", "_h2").agg(F.min(F.struct("_id")).alias("_lo"), F.max(F.struct("_id")).alias("_hi")) \
                   .filter(~F.col("_lo")["_id"].eqNullSafe(F.col("_hi")["_id"])).select("_h1", "_h2", "_lo")
    repeated = windows.join(first, ["_h1", "_h2"]).filter(~F.col("_id").eqNullSafe(F.col("_lo")["_id"]))
    starts = repeated.groupBy("_id").agg(F.collect_set("_at").alias("_starts"))
    return starts.select("_id", F.lit(False).alias("_all"), "_starts").unionByName(
        copies.select("_id", F.lit(True).alias("_all"), F.lit(None).cast("array<int>").alias("_starts")))


def substring_dedup(df: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_words, n_removed, kept_sha256, cut_text) for every row.
    ``cut_text``: the text without the removed passages, white space elsewhere as it
    was; null where nothing was removed. ``kept_sha256`` is of the kept words joined by
    one space."""
    src = id_text(df, id_col, text_col)
    kind = src.schema["_id"].dataType.simpleString()
    found = repeated_windows(df, width, id_col, text_col)
    x = join_on(src, found, ["_id"], "left").select("_id", "_text", F.coalesce("_all", F.lit(False)).alias("_all"), "_starts")
    return x.mapInArrow(_cut(width), f"_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, _cut_text string") \
            .select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept_sha256", F.col("_cut_text").alias("cut_text"))
