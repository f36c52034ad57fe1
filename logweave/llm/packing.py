"""Best-fit packing of token pieces into sequences of a fixed capacity.

``pieces`` cuts each document's ids into pieces of at most ``capacity`` tokens
(only longer documents are cut). ``pack`` deals the pieces, without their texts,
into blocks of bounded size by a hash, starts each block from best-fit
decreasing and improves it by local search: the emptiest bins give up their
pieces, by a move into a bin with room, or by an exchange of one piece for one or
for two smaller ones of a fuller bin. Every step raises the sum of squared
fills, so the search ends; a bin left without pieces is gone. The search stops at
the lower bound of the number of bins. The bins that stay underfull in their
blocks are dealt out and packed once more together.

The number of blocks follows the number of pieces, and a block is a fixed amount
of work for one task. Ties are broken by (id, piece), so a retried task gives
the same bins.

Rows without a length, or with a length of 0 or less, take no place and are not
returned; pieces longer than the capacity are an error. Repeated rows and null ids are packed
each on their own, and dealt out like any others; ``df`` should be a stored table, since a row's
place in it is part of the deal. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, prepare, scratch, text_buffers
from .library_tokens import loaded, read_vocabulary

#: Pieces that one task packs.
BLOCK_PIECES = 40_000


def pieces(df: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(``id_col``, piece, start, length, ids_crc32) of every document's ids with
    ``end_id`` after them; null texts count as empty. The word vocabulary's own ids."""
    prepare(df.sparkSession)
    spec = read_vocabulary(vocabulary)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(spec, "words")
        for rb in batches:
            data, offs = text_buffers(rb.column(1))
            row, piece, start, length, crc = [], [], [], [], []
            all_ids, at = tok.encode_texts(data, offs)
            for i in range(rb.num_rows):
                ids = all_ids[at[i]:at[i + 1]].tobytes() + end
                for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a:a + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["_id", "piece", "start", "length", "ids_crc32"])

    x = id_text(df, id_col, text_col)
    kind = x.schema["_id"].dataType.simpleString()
    return x.mapInArrow(run, f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint") \
            .withColumnRenamed("_id", id_col)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    mask = 0  # which rooms have a bin
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - n
        if left:
            with_room[left].append(b)
            mask |= 1 << left
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Swap-based local search over the underfull bins; see the module's text."""
    size = np.asarray(lengths, dtype=np.int64)
    least = max(-(-int(size.sum()) // capacity), int((2 * size > capacity).sum()))
    fill = np.array([int(size[b].sum()) for b in bins], dtype=np.int64)
    home = np.empty(len(size), np.int64)
    for k, b in enumerate(bins):
        home[b] = k
    alive = len(bins)
    improved, seen = True, None
    while improved and alive > least:
        improved = False
        under = np.flatnonzero((fill > 0) & (fill < capacity))
        for v in under[np.argsort(fill[under], kind="stable")].tolist():
            if alive <= least:
                break
            if fill[v] == 0 or fill[v] >= capacity:
                continue
            for x in sorted(bins[v], key=lambda i: -lengths[i]):
                if home[x] != v:
                    continue
                seen = seen or _with_room(size, fill, home, capacity)
                if _better_place(x, v, bins, size, fill, home, seen):
                    improved, seen = True, None
            alive -= fill[v] == 0
    return [b for b in bins if b]


def _with_room(size: np.ndarray, fill: np.ndarray, home: np.ndarray, capacity: int) -> tuple:
    """What an exchange can use, as long as no bin changes: the room of each bin, the bin with
    most of it and how much the others have at most; the pieces in bins with room, by size (then
    number), their sizes, and the largest piece that can take their place; the sums of two such
    pieces of one bin, ascending, the largest piece that can take theirs, and their bins."""
    room = np.where(fill > 0, capacity - fill, 0)
    widest = int(np.argmax(room))
    others = int(np.delete(room, widest).max(initial=0))
    items = np.flatnonzero(room[home] > 0)
    items = items[np.argsort(size[items], kind="stable")]
    o = items[np.argsort(home[items], kind="stable")]
    h, sums, at = home[o], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, len(o)):
        i = np.flatnonzero(h[d:] == h[:-d])
        if not len(i):
            break
        sums.append(size[o[i]] + size[o[i + d]])
        at.append(h[i])
    sums, at = np.concatenate(sums), np.concatenate(at)
    order = np.argsort(sums, kind="stable")
    sums, at = sums[order], at[order]
    return room, widest, others, items, size[items], size[items] + room[home[items]], sums, sums + room[at], at


def _better_place(x: int, v: int, bins: list[list[int]], size: np.ndarray, fill: np.ndarray, home: np.ndarray,
                  seen: tuple) -> bool:
    """Move piece ``x`` of bin ``v`` into a fuller bin, or exchange it for one or
    two smaller pieces of one. True if the sum of squared fills has grown. ``seen``: what
    :func:`_with_room` found; only sizes that can make place are read."""
    n = int(size[x])
    room, widest, others, items, sizes, reach, sums, sums_reach, pair_bin = seen
    most = others if widest == v else int(room[widest])

    def exchange(b: int, back: list[int]) -> bool:
        moved = n - int(size[back].sum())
        bins[v].remove(x)
        bins[b].append(x)
        home[x] = b
        for y in back:
            bins[b].remove(y)
            bins[v].append(y)
            home[y] = v
        fill[b] += moved
        fill[v] -= moved
        return True

    if most >= n:
        fits = np.flatnonzero((room >= n) & (fill + n > fill[v]))
        fits = fits[fits != v]
        if len(fits):
            return exchange(int(fits[np.argmin(room[fits])]), [])
    s, e = np.searchsorted(sizes, [n - most, n])
    at = s + np.flatnonzero(reach[s:e] >= n)
    b = home[items[at]]
    at = at[(fill[b] + n > fill[v] + sizes[at]) & (b != v)]
    if len(at):
        y = int(items[at[0]])
        return exchange(int(home[y]), [y])
    # two for one: both from one bin, together smaller than x and with its room as large
    s, e = np.searchsorted(sums, [n - most, n])
    at = s + np.flatnonzero(sums_reach[s:e] >= n)
    b = pair_bin[at]
    b = b[(fill[b] + n > fill[v] + sums[at]) & (b != v)]
    if not len(b):
        return False
    k = int(b.min())
    own = sorted((int(size[i]), i) for i in bins[k] if size[i] < n)
    i, j = 0, len(own) - 1
    while i < j:  # smallest sum that still makes place
        pair = own[i][0] + own[j][0]
        if pair + int(room[k]) < n:
            i += 1
        elif pair >= n or fill[k] + n <= fill[v] + pair:
            j -= 1
        else:
            return exchange(k, [own[i][1], own[j][1]])
    return False


def _pack_block(capacity: int, first_id: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "_piece"], kind="stable", ignore_index=True)
        lengths = pdf["_length"].tolist()
        if lengths and max(lengths) > capacity:
            raise ValueError(f"a piece is longer than the capacity of {capacity}")
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        seq, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for k, b in enumerate(bins):
            at = 0
            for i in sorted(b):
                seq[i], offset[i] = k, at
                at += lengths[i]
            fill[b] = at
        pdf["sequence_id"] = first_id + int(key[0]) * (1 << 24) + seq
        pdf["offset"], pdf["_fill"] = offset, fill
        return pdf
    return run


def pack(df: DataFrame, capacity: int = 4096, id_col: str = "doc_id", piece_col: str = "piece",
         length_col: str = "length") -> DataFrame:
    """The rows of ``df`` with ``sequence_id`` and ``offset`` (gapless from 0 in a sequence)."""
    spark = prepare(df.sparkSession)
    names = df.columns
    x = df.select(F.struct(*names).alias("_row"), F.xxhash64(F.col(id_col), F.col(piece_col), F.col(length_col)).alias("_order"),
                  F.col(piece_col).cast("long").alias("_piece"), F.col(length_col).cast("long").alias("_length")) \
          .filter(F.col("_length") > 0)
    fields = "_row " + x.schema["_row"].dataType.simpleString() + ", _order bigint, _piece bigint, _length bigint"

    def packed(part: DataFrame, n: int, first_id: int) -> DataFrame:
        deal = max(1, -(-n // BLOCK_PIECES))
        # equal rows are dealt out too, however many there are
        salt = F.monotonically_increasing_id()
        return part.withColumn("_block", F.pmod(F.xxhash64("_order", salt, F.lit(first_id)), F.lit(deal))).groupBy("_block") \
                   .applyInPandas(_pack_block(capacity, first_id),
                                  fields + ", _block bigint, sequence_id bigint, offset bigint, _fill bigint")

    n = x.count()
    once = packed(x, n, 0)
    done = ["_row.*", "sequence_id", "offset"]
    if n > BLOCK_PIECES:
        once = scratch(once, "packed")
        under = once.filter(F.col("_fill") < capacity)
        rest = packed(under.select("_row", "_order", "_piece", "_length"), under.count(), 1 << 60)
        return once.filter(F.col("_fill") >= capacity).select(*done).unionByName(rest.select(*done))
    return once.select(*done)
