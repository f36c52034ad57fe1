"""Near-dedup with MinHash bands and odd sketches.

Each document is a set of word shingles (A-Z lower-cased; runs of ``words`` words; the
whole sequence where there are fewer). One Arrow pass gives it

* a MinHash of ``bands`` x ``rows`` samples, whose bands are the blocking keys;
* an *odd sketch*: each of its ``SAMPLES`` smallest shingle hashes (bottom-k MinHash
  samples; the whole set of a shorter document) flips one bit of a parity bitmap, so equal
  samples cancel when two bitmaps are XORed, and the population count of the XOR is at
  most the number of samples that differ, and close to it.

1. Documents with equal sets form a class; only its smallest id goes on.
2. In each band bucket every member is paired with the smallest id (a star, not all pairs).
3. Odd sketches drop pairs that differ too much for the similarity. Where both samples are
   whole sets this is a proof, else it allows ``SIGMAS`` standard deviations. The rest are
   confirmed on their full sets.
4. Confirmed links give components. Buckets that still hold several components are
   searched again, *between* components only, by sketch, in blocks of bounded size inside
   a task; only pairs that pass leave it, and are confirmed as before. So no link between two
   members of a bucket is lost, and members of a large group, already joined by their
   stars, are not compared with each other.

A pair at the threshold shares no bucket with probability (1 - t ** rows) ** bands: below
1e-5 for the parameters used. Similarity is confirmed exactly, as ``100 * common >= percent *
union``; shingles are compared by 64-bit hashes.

Hot buckets and hubs: star centres are partial aggregates and plain joins, which
adaptive execution splits. Texts are read twice: once for sketches, once (semi join)
for the sets of documents that have a candidate.

Null, empty and blank texts have empty sets and link with nothing. Documents with
equal non-empty sets are linked. Rows that share an id count as linked. Rows with a
null id are returned alone: component null, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (BASE_A, RabinKarp, Words, blocks, id_text, join_on, list_array, mix, prepare, scratch, signed,
                     text_buffers)
from .components import components

#: Samples of an odd sketch and its bits.
SAMPLES, SKETCH_BITS = 2048, 2048
#: Standard deviations that the estimate of sampled pairs may lie off.
SIGMAS = 6.0
#: Members of one block when a bucket's components are compared.
CELL_ROWS = 2000


class Shingles:
    """Distinct shingle hashes of each document of a block."""

    def __init__(self, d: np.ndarray, o: np.ndarray, words: int):
        w = Words(d, o, lower=True)
        rk = RabinKarp(w.code, BASE_A)
        self.all, self.count, self.first = rk.windows(words), w.count, w.first
        self.whole = rk.spans(w.first[:-1], w.first[1:])
        self.words = words

    def __len__(self) -> int:
        return len(self.count)

    def of(self, k: int) -> np.ndarray:
        n = int(self.count[k])
        if n == 0:
            return self.all[:0]
        if n < self.words:
            return self.whole[k:k + 1]
        a = int(self.first[k])
        x = np.sort(self.all[a:a + n - self.words + 1])
        return x[np.r_[True, x[1:] != x[:-1]]]


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None], \
        (seeds[n:] >> np.uint64(32)).astype(np.uint32)[:, None]


def minhash(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One minimum for each multiplier, over the shingles ``x``."""
    low = (x >> np.uint64(32)).astype(np.uint32)
    best = None
    for i in range(0, len(low), 4096):
        m = (a * low[None, i:i + 4096] + b).min(axis=1)
        best = m if best is None else np.minimum(best, m)
    return best


def odd_sketch(x: np.ndarray) -> np.ndarray:
    """The parity of the smallest hashes that fall on each bit; ``x`` is sorted."""
    bit = (mix(x[:SAMPLES]) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def sampled_bits(percent: int) -> int:
    """Largest XOR population count that a pair of similar sets gives when at
    least one of them has more hashes than samples: at most 2 k (1 - t) of the
    samples differ on average, whatever the sizes."""
    t = percent / 100
    differ = 2 * SAMPLES * (1 - t) + SIGMAS * np.sqrt(2 * SAMPLES * t * (1 - t))
    expected = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differ)
    return int(np.ceil(expected + SIGMAS * np.sqrt(SKETCH_BITS) / 4))


def _sketch(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers(bands * rows)
        salt = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        for rb in batches:
            data, offs = text_buffers(rb.column(1))
            for i, j, d, o in blocks(data, offs):
                s = Shingles(d, o, words)
                n = len(s)
                size, one, two = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                samples = np.zeros((n, bands * rows), np.uint32)
                odd = np.zeros((n, SKETCH_BITS // 64), np.uint64)
                for k in range(n):
                    x = s.of(k)
                    size[k] = len(x)
                    if len(x):
                        one[k], two[k] = x.sum(dtype=np.uint64), mix(x).sum(dtype=np.uint64)
                        samples[k] = minhash(x, a, b)
                        odd[k] = odd_sketch(x)
                terms = mix((samples.astype(np.uint64) + np.uint64(1)) * salt)
                keys = mix(terms.reshape(n, bands, rows).sum(axis=2, dtype=np.uint64)
                           + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                full = np.flatnonzero(size)
                per = np.where(size > 0, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(i, j - i), pa.array(size), pa.array(signed(one)), pa.array(signed(two)),
                     list_array(signed(np.ascontiguousarray(keys[full]).ravel()), per, pa.int64()),
                     list_array(signed(odd.ravel()), np.full(n, odd.shape[1]), pa.int64())],
                    ["_id", "n_shingles", "_s1", "_s2", "_bands", "_odd"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            data, offs = text_buffers(rb.column(1))
            for i, j, d, o in blocks(data, offs):
                s = Shingles(d, o, words)
                sets = [s.of(k) for k in range(len(s))]
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(i, j - i),
                     list_array(signed(np.concatenate(sets)), np.array([len(x) for x in sets]), pa.int64())], ["_id", "_set"])
    return run


def _differing() -> Column:
    """XOR population count of the bitmaps _oa and _ob."""
    out = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        out = out + F.bit_count(F.col("_oa")[i].bitwiseXOR(F.col("_ob")[i]))
    return out


def _bits_allowed(na: Column, nb: Column, percent: int) -> Column:
    exact = F.floor((na + nb) * (100 - percent) / (100 + percent))
    return F.when(F.greatest(na, nb) <= SAMPLES, exact).otherwise(sampled_bits(percent))


def _large_enough(na: Column, nb: Column, percent: int) -> Column:
    """The smaller set is large enough for the similarity at all."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _confirmed(pairs: DataFrame, src: DataFrame, kind: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = scratch(pairs, "pairs")
    need = pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct()
    sets = src.join(need, "_id", "left_semi").mapInArrow(_sets(words), f"_id {kind}, _set array<bigint>") \
              .dropDuplicates(["_id"])
    sets = scratch(sets, "sets")
    x = pairs.join(sets.select(F.col("_id").alias("a"), F.col("_set").alias("_sa")), "a") \
             .join(sets.select(F.col("_id").alias("b"), F.col("_set").alias("_sb")), "b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return x.select("a", "b", common.alias("c"), (F.size("_sa") + F.size("_sb")).alias("n")) \
            .filter(F.col("c") * 100 >= (F.col("n") - F.col("c")) * percent).select("a", "b")


def _between_components(percent: int):
    """Pairs of one cell whose components differ and whose sketches are close."""
    sampled = sampled_bits(percent)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("_id").sort_values(["_comp", "_id"], kind="stable", ignore_index=True)
        odd = np.stack(pdf["_odd"].to_numpy()).view(np.uint64)
        comp, size = pdf["_comp"].to_numpy(), pdf["n_shingles"].to_numpy()
        ids, side = pdf["_id"].to_numpy(), pdf["_side"].to_numpy()
        same_block = pdf["_diagonal"].iloc[0]
        out_a, out_b = [ids[:0]], [ids[:0]]
        ends = np.searchsorted(comp, comp, side="right")
        for i, end in enumerate(ends.tolist()):  # the members of later components
            other = size[end:]
            ok = np.minimum(other, size[i]) * 100 >= np.maximum(other, size[i]) * percent
            if not same_block:
                ok &= side[end:] != side[i]
            j = np.flatnonzero(ok) + end
            if len(j):
                most = np.where(np.maximum(size[j], size[i]) <= SAMPLES,
                                (size[j] + size[i]) * (100 - percent) // (100 + percent), sampled)
                j = j[np.bitwise_count(odd[j] ^ odd[i]).sum(axis=1) <= most]
                out_a.append(np.full(len(j), ids[i]))
                out_b.append(ids[j])
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})
    return run


def near_dedup(df: DataFrame, words: int = 5, percent: int = 80, bands: int = 30, rows: int = 5,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_shingles, component_id, kept) for every row; integer ids."""
    spark = prepare(df.sparkSession)
    src = id_text(df, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    all_docs = scratch(src.mapInArrow(
        _sketch(words, bands, rows), "_id bigint, n_shingles bigint, _s1 bigint, _s2 bigint, "
        "_bands array<bigint>, _odd array<bigint>"), "sketches")
    docs = all_docs.filter(F.col("_id").isNotNull() & (F.col("n_shingles") > 0))
    # classes of equal sets
    head = docs.groupBy("_s1", "_s2", "n_shingles").agg(F.min("_id").alias("_rep"))
    member = docs.select("_id", "_s1", "_s2", "n_shingles").join(head, ["_s1", "_s2", "n_shingles"]).select("_id", "_rep")
    same = member.filter("_id != _rep").select(F.col("_rep").alias("u"), F.col("_id").alias("v"))
    same = scratch(same, "classes")
    reps = docs.join(same.select(F.col("v").alias("_id")).distinct(), "_id", "left_anti").dropDuplicates(["_id"])
    reps = scratch(reps.select("_id", "n_shingles", "_bands", "_odd"), "classes")

    # stars of the band buckets
    keyed = reps.select("_id", F.explode("_bands").alias("_key"))
    centre = keyed.groupBy("_key").agg(F.min("_id").alias("_centre"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    bucketed = scratch(keyed.join(centre, "_key"), "buckets")
    stars = bucketed.filter("_id != _centre").select(F.col("_centre").alias("a"), F.col("_id").alias("b")).distinct()
    light = reps.select("_id", "n_shingles", "_odd")
    screened = stars.join(light.select(F.col("_id").alias("a"), F.col("n_shingles").alias("_na"), F.col("_odd").alias("_oa")), "a") \
                    .join(light.select(F.col("_id").alias("b"), F.col("n_shingles").alias("_nb"), F.col("_odd").alias("_ob")), "b") \
                    .filter(_large_enough(F.col("_na"), F.col("_nb"), percent)) \
                    .filter(_differing() <= _bits_allowed(F.col("_na"), F.col("_nb"), percent)).select("a", "b")
    links = _confirmed(screened, src, "bigint", words, percent).select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = scratch(links, "links")
    comp = scratch(components(links), "components")

    # buckets that still hold several components
    labelled = bucketed.join(comp.select(F.col("id").alias("_id"), "component"), "_id", "left") \
                       .withColumn("_comp", F.coalesce("component", "_id")).drop("component")
    open_keys = labelled.groupBy("_key").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).filter("_lo != _hi").select("_key")
    blocks_of = F.ceil(F.col("_n") / CELL_ROWS).cast("int")
    open_rows = labelled.join(open_keys, "_key", "left_semi") \
        .withColumn("_side", F.pmod(F.xxhash64("_id"), blocks_of).cast("int")) \
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks_of - 1))) \
        .select("_key", "_id", "_comp", "_side", F.least("_side", "_other").alias("_lo"), F.greatest("_side", "_other").alias("_hi")) \
        .join(light, "_id") \
        .select("_key", "_lo", "_hi", "_id", "_comp", "_side", (F.col("_lo") == F.col("_hi")).alias("_diagonal"), "n_shingles", "_odd")
    more = open_rows.groupBy("_key", "_lo", "_hi").applyInPandas(_between_components(percent), "a bigint, b bigint") \
                    .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more_links = _confirmed(more, src, "bigint", words, percent).select(F.col("a").alias("u"), F.col("b").alias("v"))
    hooks = comp.filter("id != component").select(F.col("component").alias("u"), F.col("id").alias("v"))
    final = scratch(components(hooks.unionByName(more_links).unionByName(same)), "components")

    out = all_docs.select("_id", "n_shingles").join(final.select(F.col("id").alias("_id"), "component"), "_id", "left")
    return out.select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("component", "_id").alias("component_id"),
                      (F.coalesce("component", "_id").eqNullSafe(F.col("_id"))).alias("kept"))

