"""Source divergence audit by in-mapper stripes.

Each partition folds whole documents into hash stripes, term -> (documents that hold it,
count in each source), for every language it meets. A partition whose stripes outgrow
``SPILL_CELLS`` spills them; spilled stripes are shuffled by (language, term), sorted
and merged as a stream, so a term that every document holds costs one stripe a spill, and
one merged stripe of memory. Only stripes of terms in at least ``min_docs`` documents of
their language stay.

Shares are exact integers: ``p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))`` with V the kept
terms of the language and N the count of the group (or of the language) over them; a term's
divergence is ``floor((p - q)^2 / (p + q))``.

Part ``term`` compares a (language, source) group with its language, term by term. Part
``pair`` compares two sources of a language over all V kept terms. A stripe holds the
sources that have its term only, so with 0 for a source's share of a term it lacks:

    sum over all terms f(s, t) = sum over terms both have [f(s, t) - f(s, 0) - f(0, t) + f(0, 0)]
                               + sum over terms of s f(s, 0) + sum over terms of t f(0, t)
                               + (V - terms of s - terms of t) * f(0, 0)

The first sum comes from the stripes, folded to one matrix of source pairs a task and
language (spilled when large); the others from a histogram of counts for each source. So no
row is made for a term and a pair of sources.

Null text, language and source count as ''. Every (language, source) that occurs is a
group, with or without terms; without kept terms its pair values are 0. Repeated rows count as
documents of their own. Ties of value go by item, ascending as UTF-8 bytes. An empty
table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, scratch, shuffle_width, text_buffers

SCALE = 1_000_000_000
#: Cells (term, source) a partition holds before it spills its stripes.
SPILL_CELLS = 400_000
#: Cells of the pair matrices a task holds before it spills them.
MATRIX_CELLS = 4_000_000
#: Bytes of a text that are split at a time.
PIECE_BYTES = 1 << 20

#: A-Z lower-cased, a-z and all bytes of non-ASCII characters as they are, the rest blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STRIPE = "lang string, term string, n_docs bigint, sources array<string>, counts array<bigint>"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, at most about ``PIECE_BYTES`` of it at a time."""
    text, a = text.translate(_TERM_BYTES), 0
    while a < len(text):
        b = len(text)
        if b - a > PIECE_BYTES:
            b = text.rfind(b" ", a, a + PIECE_BYTES)
            if b <= a:
                b = text.find(b" ", a + PIECE_BYTES)
                b = len(text) if b < 0 else b
        yield text[a:b].split()
        a = b


class Stripes:
    """Stripes of one partition. A stripe's cells are held by source, so that folding a
    document is two updates of hash tables."""

    def __init__(self):
        self.docs: dict[str, Counter] = defaultdict(Counter)
        self.cells: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

    def fold(self, lang: str, source: str, text: bytes) -> None:
        held: set[bytes] = set()
        for terms in _pieces(text):
            if terms:
                self.cells[lang][source].update(terms)
                held.update(terms)
        if held:
            self.docs[lang].update(held)

    def size(self) -> int:
        return sum(len(c) for by_source in self.cells.values() for c in by_source.values())

    def spill(self) -> Iterator[pa.RecordBatch]:
        for lang, docs in self.docs.items():
            place = {t: i for i, t in enumerate(docs)}
            names = list(self.cells[lang])
            at = [np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in self.cells[lang].values()]
            n = [np.fromiter(c.values(), np.int64, len(c)) for c in self.cells[lang].values()]
            own = np.repeat(np.arange(len(names)), [len(a) for a in at])
            at, n = np.concatenate(at), np.concatenate(n)
            order = np.argsort(at, kind="stable")
            yield _stripe_batch(pa.array([lang] * len(docs)), pa.array(list(docs), pa.binary()).cast(pa.string()),
                                np.fromiter(docs.values(), np.int64, len(docs)), np.bincount(at, minlength=len(docs)),
                                pa.array(names, pa.string()).take(pa.array(own[order])), n[order])
        self.__init__()


def _stripe_batch(lang: pa.Array, term: pa.Array, docs: np.ndarray, sizes: np.ndarray, sources: pa.Array,
                  counts: np.ndarray) -> pa.RecordBatch:
    offs = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [lang, term, pa.array(docs), pa.ListArray.from_arrays(offs, sources), pa.ListArray.from_arrays(offs, pa.array(counts))],
        ["lang", "term", "n_docs", "sources", "counts"])


def _fold_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes, seen = Stripes(), 0
    for rb in batches:
        langs, sources = rb.column(0).to_pylist(), rb.column(1).to_pylist()
        data, offs = text_buffers(rb.column(2))
        for i in range(rb.num_rows):
            stripes.fold(langs[i], sources[i], data[offs[i]:offs[i + 1]].tobytes())
            seen += int(offs[i + 1] - offs[i])
            if seen > PIECE_BYTES:
                seen = 0
                if stripes.size() > SPILL_CELLS:
                    yield from stripes.spill()
    yield from stripes.spill()


def _merged(rb: pa.RecordBatch) -> pa.RecordBatch:
    """Stripes with equal keys, which are neighbours, made one."""
    n = rb.num_rows
    new = np.ones(n, dtype=bool)
    if n > 1:
        same = pc.and_(pc.equal(rb.column(0)[1:], rb.column(0)[:-1]), pc.equal(rb.column(1)[1:], rb.column(1)[:-1]))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
    if new.all():
        return rb
    first = np.flatnonzero(new)
    key = np.repeat(np.cumsum(new) - 1, pc.list_value_length(rb.column(3)).to_numpy())
    sources = rb.column(3).flatten().dictionary_encode()
    code = sources.indices.to_numpy().astype(np.int64)
    cell, inverse = np.unique(key * len(sources.dictionary) + code, return_inverse=True)
    counts = np.zeros(len(cell), np.int64)
    np.add.at(counts, inverse, rb.column(4).flatten().to_numpy())
    owner = cell // len(sources.dictionary)
    at = pa.array(first)
    return _stripe_batch(rb.column(0).take(at), rb.column(1).take(at), np.add.reduceat(rb.column(2).to_numpy(), first),
                         np.bincount(owner, minlength=len(first)),
                         sources.dictionary.take(pa.array(cell % len(sources.dictionary))), counts)


def _merge(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rb in batches:
            if not rb.num_rows:
                continue
            both = _merged(rb if held is None else pa.concat_batches([held, rb.cast(held.schema)]))
            held = both.slice(both.num_rows - 1)
            done = both.slice(0, both.num_rows - 1)
            yield done.filter(pc.greater_equal(done.column(2), min_docs))
        if held is not None and held.column(2)[0].as_py() >= min_docs:
            yield held
    return run


def stripes(df: DataFrame, min_docs: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, term, n_docs, sources, counts): the merged stripe of each kept term."""
    prepare(df.sparkSession)
    x = _read(df, lang_col, source_col).withColumn("_text", F.coalesce(df[text_col].cast("string"), F.lit("")))
    return x.select("lang", "source", "_text").mapInArrow(_fold_documents, _STRIPE) \
            .repartition(max(shuffle_width(df.sparkSession), 1), "lang", "term").sortWithinPartitions("lang", "term") \
            .mapInArrow(_merge(min_docs), _STRIPE)


def _read(df: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    return df.withColumns({"lang": F.coalesce(df[lang_col].cast("string"), F.lit("")),
                           "source": F.coalesce(df[source_col].cast("string"), F.lit(""))})


def _share(count: str, total: str) -> Column:
    """``1 + floor(SCALE * (count + 2) / total)``; null if ``total`` is 0."""
    wide = f"cast({SCALE} as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0))"
    return F.expr(f"case when {total} > 0 then 1 + ({wide}) div cast({total} as decimal(20, 0)) end")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of shares to (lang, source, item, value): the sum over the terms both have."""
    places: dict[str, dict[str, int]] = defaultdict(dict)
    sums: dict[str, np.ndarray] = {}

    def apart(p, q):
        d = p - q
        return d * d // (p + q)

    def spill() -> Iterator[pa.RecordBatch]:
        for lang, m in sums.items():
            names = pa.array(list(places[lang]), pa.string())
            a, b = np.nonzero(m[:len(names), :len(names)])
            a, b = a[a != b], b[a != b]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)),
                                              pa.array(m[a, b])], ["lang", "source", "item", "value"])
        sums.clear()
        places.clear()

    for rb in batches:
        lists = rb.column(1)
        offs = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        names = lists.flatten()
        sources = names.field("source").dictionary_encode()
        share, none = names.field("p").to_numpy(), names.field("zero").to_numpy()
        code, words = sources.indices.to_numpy(), sources.dictionary.to_pylist()
        for lang, a, b in zip(rb.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
            place = places[lang]
            at = np.array([place.setdefault(words[c], len(place)) for c in code[a:b].tolist()])
            m = sums.get(lang)
            if m is None or len(m) < len(place):
                grown = np.zeros((2 * len(place), 2 * len(place)), np.int64)
                if m is not None:
                    grown[:len(m), :len(m)] = m
                m = sums[lang] = grown
            p, z = share[a:b, None], none[a:b, None]
            m[at[:, None], at] += apart(p, p.T) - apart(p, z.T) - apart(z, p.T) + apart(z, z.T)
        if sum(m.size for m in sums.values()) > MATRIX_CELLS:
            yield from spill()
    yield from spill()


def divergence(df: DataFrame, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source",
               text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank); see the module's text."""
    kept = scratch(stripes(df, min_docs, lang_col, source_col, text_col), "stripes")
    cells = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("in_lang"),
                        F.explode(F.arrays_zip("sources", "counts")).alias("_c")) \
                .select("lang", "term", "in_lang", F.col("_c.sources").alias("source"), F.col("_c.counts").alias("n"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("lang_total"))
    nil = {c: 0 for c in ("total", "terms", "v", "lang_total")}
    groups = _read(df, lang_col, source_col).select("lang", "source").distinct() \
        .join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(nil) \
        .withColumn("zero", _share("cast(0 as bigint)", "total + 2 * v"))
    groups = scratch(groups, "groups")
    shared = cells.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total + 2 * v"))

    # terms that a group has more of than its language
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shared.withColumn("q", _share("in_lang", "lang_total + 2 * v")).filter("p > q") \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value")) \
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    # pairs of sources
    both = shared.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("cells")) \
        .filter(F.size("cells") > 1).select("lang", "cells") \
        .mapInArrow(_pair_sums, "lang string, source string, item string, value bigint")
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("terms").alias("other_terms"))
    histogram = shared.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    single = histogram.join(other, "lang").filter(F.col("source") != F.col("item")) \
        .groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _apart("p", "other_zero")).alias("value"))
    rest = groups.join(other, "lang").filter(F.col("source") != F.col("item")) \
        .select("lang", "source", "item", F.coalesce((F.col("v") - F.col("terms") - F.col("other_terms")) * _apart("zero", "other_zero"),
                                                     F.lit(0).cast("long")).alias("value"))
    turned = single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = both.unionByName(single).unionByName(turned).unionByName(rest) \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) \
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)
