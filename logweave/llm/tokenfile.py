"""Token ids on disk as directly addressable codes.

A token id is split into chunks of 8 bits. Level 0 holds the lowest chunk of every
token, level 1 the next chunk of those tokens that have one, and so on. Each level's
continuation bitmap says which of its entries go on, and a rank directory (set bits
before every 512th entry) finds their place in the next level. So any token is read with one
step for each of its chunks, without decoding its neighbours.

File format. A token folder is written by Spark's Parquet writer (its commit protocol
covers lost executors, and any store Spark reaches will do): a row for each segment, in
ascending (part, segment): ``part`` int, ``segment`` int, ``doc_ids`` array, ``ends``
array<int> (a document's end in the segment), ``n_tokens`` int, ``before`` bigint (tokens
of its part before the segment), ``codes`` binary.
``codes``, all numbers little-endian unsigned 32-bit: "DAC1", number of levels; then
each level's number of entries; then for each level its chunks (1 byte each), its
bitmap (a bit an entry, lowest first, padded to whole 64 bytes) and its directory.

Documents are range-partitioned by id, so parts ascend; segments are bounded in tokens
(one document at least). A part's start comes from the parts' totals: a row for each
writing task, which is few enough to broadcast, so that codes are read without a shuffle.
Null texts count as empty; a null id comes first; rows of a repeated id stand in the order of their
ids' bytes, so a retried task writes the same.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, prepare, scratch, shuffle_width, text_buffers
from .library_tokens import give_back, loaded, read_vocabulary, unload

#: Tokens of a segment (more only for one longer document).
SEGMENT_TOKENS = 1 << 17
#: Rows of an Arrow batch of texts: small, since workers share an executor with its sort buffers.
BATCH_ROWS = 500
#: Batches after which a worker returns freed memory to the system.
GIVE_BACK = 8
#: Ids and codes are a third smaller on disk with it.
CODEC = "zstd"
STRIDE = 512
MAGIC = b"DAC1"


def encode_codes(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk, rest = (rest & np.uint32(0xFF)).astype(np.uint8), rest >> np.uint32(8)
        goes_on = rest > 0
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (STRIDE // 8), np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, STRIDE // 8)).sum(axis=1, dtype=np.int64)
        levels.append((chunk, bits, (np.cumsum(ones) - ones).astype("<u4")))
        rest = rest[goes_on]
        if not len(rest):
            break
    head = MAGIC + struct.pack(f"<I{len(levels)}I", len(levels), *(len(c) for c, _, _ in levels))
    return head + b"".join(x.tobytes() for level in levels for x in level)


class Codes:
    """Reader of one segment's codes; nothing is decoded before it is asked for."""

    def __init__(self, blob):
        self.blob = memoryview(blob)
        if bytes(self.blob[:4]) != MAGIC:
            raise ValueError("not a token segment")
        n, = struct.unpack_from("<I", self.blob, 4)
        at, self.levels = 8 + 4 * n, []
        for size in struct.unpack_from(f"<{n}I", self.blob, 8):
            strides = -(-size // STRIDE)
            bits = at + size
            ranks = bits + strides * STRIDE // 8
            self.levels.append((size, at, bits, ranks))
            at = ranks + 4 * strides

    def __len__(self) -> int:
        return self.levels[0][0]

    def token(self, i: int) -> int:
        """The id at place ``i``: a chunk, a bit and a rank for each level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for _, chunks, bits, ranks in self.levels:
            value |= self.blob[chunks + i] << shift
            if not self.blob[bits + i // 8] >> (i % 8) & 1:
                break
            first = i - i % STRIDE
            block = int.from_bytes(self.blob[bits + first // 8:bits + first // 8 + STRIDE // 8], "little")
            before, = struct.unpack_from("<I", self.blob, ranks + 4 * (i // STRIDE))
            i = before + (block & ((1 << (i - first)) - 1)).bit_count()
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(len(self), "<u4")
        place = None
        for k, (size, chunks, bits, ranks) in enumerate(self.levels):
            own = np.frombuffer(self.blob, np.uint8, size, chunks).astype("<u4") << np.uint32(8 * k)
            if place is None:
                out |= own
                place = np.arange(size)
            else:
                out[place] |= own
            on = np.unpackbits(np.frombuffer(self.blob, np.uint8, ranks - bits, bits), count=size, bitorder="little")
            place = place[on.view(bool)]
        return out


def _encode(spec: str, kind: str, end: bytes):
    """Rows (id, text) to rows (id, wide, ids): ids of two bytes each where all fit, else of four."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(spec, kind)
        last = np.frombuffer(end, "<u4")
        for k, rb in enumerate(batches):
            data, offs = text_buffers(rb.column(1))
            ids, at = tok.encode_texts(data, offs)
            out, wide = [], []
            for i in range(rb.num_rows):
                own = np.concatenate([ids[at[i]:at[i + 1]], last])
                wide.append(bool(own.max() > 0xFFFF))
                out.append((own if wide[-1] else own.astype("<u2")).tobytes())
            done = pa.RecordBatch.from_arrays([rb.column(0), pa.array(wide), pa.array(out, pa.binary())], ["_id", "_wide", "_ids"])
            del data, ids, out
            if k % GIVE_BACK == 0:
                give_back()
            yield done
    return run


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    unload()  # a worker of the encoding stage may be used again
    give_back()
    part, segment = TaskContext.get().partitionId(), 0
    doc_ids, ends, held, n, before = [], [], [], 0, 0

    def flush() -> pa.RecordBatch:
        codes = encode_codes(np.concatenate(held))
        ids = pa.concat_arrays(doc_ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([segment], pa.int32()),
             pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([ends], pa.list_(pa.int32())),
             pa.array([n], pa.int32()), pa.array([before], pa.int64()), pa.array([codes], pa.binary())],
            ["part", "segment", "doc_ids", "ends", "n_tokens", "before", "codes"])
    for rb in batches:
        for i in range(rb.num_rows):
            ids = np.frombuffer(rb.column(2)[i].as_buffer(), "<u4" if rb.column(1)[i].as_py() else "<u2").astype("<u4")
            if n and n + len(ids) > SEGMENT_TOKENS:
                yield flush()
                segment, before = segment + 1, before + n
                doc_ids, ends, held, n = [], [], [], 0
            n += len(ids)
            doc_ids.append(rb.column(0).slice(i, 1))
            ends.append(n)
            held.append(ids)
    if n:
        yield flush()


def write_tokens(df: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write every document's ids (byte vocabulary, ``end_id`` after each) to the folder ``path``.
    Texts are encoded where they are read; only their ids are sorted and shuffled."""
    spark = prepare(df.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spec = read_vocabulary(vocabulary)
    x = id_text(df, id_col, text_col)
    kind = x.schema["_id"].dataType.simpleString()
    # a table of its own, since the range partitioner reads its input twice
    ids = scratch(x.mapInArrow(_encode(spec, "bytes", int(end_id).to_bytes(4, "little")), f"_id {kind}, _wide boolean, _ids binary"), "ids", CODEC)
    ids.repartitionByRange(max(shuffle_width(spark), 1), "_id").sortWithinPartitions("_id", "_wide", "_ids") \
       .mapInArrow(_write, f"part int, segment int, doc_ids array<{kind}>, ends array<int>, n_tokens int, before bigint, codes binary") \
       .write.option("compression", CODEC).option("parquet.enable.dictionary", "false").parquet(path)


def _with_start(files: DataFrame) -> DataFrame:
    """``files`` with ``_start``, the tokens before each segment. Only the parts' totals
    are summed in one place and broadcast: one row for each writing task."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_part0"))
    return files.join(F.broadcast(parts), F.col("part") == F.col("_part")) \
                .withColumn("_start", F.col("_part0") + F.col("before")).drop("_part", "_part0")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unload()  # a worker of the writing stage may be used again
    give_back()
    for rb in batches:
        for r in range(rb.num_rows):
            ids = Codes(rb.column(3)[r].as_buffer()).all()
            ends = rb.column(2)[r].values.to_numpy().astype(np.int64)
            begin = np.r_[0, ends[:-1]]
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [rb.column(1)[r].values, pa.array(begin + rb.column(0)[r].as_py()), pa.array(ends - begin),
                 pa.array(crc, pa.int64())], ["_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, start, n_tokens, ids_crc32) of every document of a token folder."""
    prepare(spark)
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    x = _with_start(files).select("_start", "doc_ids", "ends", "codes")
    return x.mapInArrow(_read, f"_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("_id", id_col)


def read_tokens(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(place, token): the ids at the global ``place`` numbers; places outside the
    folder are not returned. A place meets only its segment, and only its chunks are read."""
    prepare(spark)
    files = spark.read.parquet(path)
    heads = _with_start(files).select("part", "segment", "n_tokens", "_start")
    # a place's segment: the last one that starts at or before it
    marks = heads.select(F.col("_start").alias("place"), F.lit(0).alias("_kind"), F.struct("part", "segment", "_start", "n_tokens").alias("_seg"))
    asked = places.select(F.col("place").cast("long"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_seg"].dataType).alias("_seg"))
    coarse = F.floor(F.col("place") / F.lit(SEGMENT_TOKENS))  # segments reach over few steps of this grid
    spread = marks.withColumn("_cell", F.explode(F.sequence(coarse, F.floor((F.col("place") + F.col("_seg.n_tokens")) / F.lit(SEGMENT_TOKENS)))))
    hit = asked.select("place", coarse.alias("_cell")).join(spread.select("_cell", "_seg"), "_cell") \
        .filter((F.col("place") >= F.col("_seg._start")) & (F.col("place") < F.col("_seg._start") + F.col("_seg.n_tokens"))) \
        .select("place", F.col("_seg.part").alias("part"), F.col("_seg.segment").alias("segment"), (F.col("place") - F.col("_seg._start")).alias("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = [Codes(b.as_buffer()).token(a) for a, b in zip(rb.column(1).to_pylist(), rb.column(2))]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(out, pa.int64())], ["place", "token"])

    return hit.join(files.select("part", "segment", "codes"), ["part", "segment"]).select("place", "_at", "codes") \
              .mapInArrow(run, "place bigint, token bigint")
