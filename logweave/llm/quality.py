"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with
the references of its language by the Jensen-Shannon distance (base 2, 0 .. 1). The
references are sums over all documents of the language that pass the base rules, so they
follow the corpus. Characters have a reference for each language label of the table, words
for those with a list of common words below. A labelled document is judged by the nearest of
its own language's reference and those of the languages with a list, so a wrong label among
these does no harm; a reference of another label, which may stand on a few odd documents, is
used for its own documents only. A null label is judged by the nearest of all references, but
spared if the document has more non-ASCII bytes than ASCII letters and no reference has: its
script is that of a language without a reference. Short documents are spared by minimum
lengths, since their histograms are noise.

Words: a text without a single common word has a distance that depends on the share of
common words in the reference (0.38 for the 0.26 of prose), so the limit is a part of that
distance, looser for shorter texts (``FEW_WORDS``, ``FEW_SHARE``); it holds for texts with
fewer common words than the reference. ``MAX_WORD_DISTANCE`` holds on either side, so for
texts of little else than common words. Only documents labelled with a language
that has a list are judged by words: the lists say nothing about others, and a null label
may stand for any.

One Arrow pass over the texts writes counts of fixed width; the references are one
aggregate of a few rows; a second Arrow pass judges the counts, not the texts.

Base rules: fewer than ``MIN_WORDS`` words, or more than half of the words in repeated
3-word windows, fail. Null and empty texts have no words and fail. Without any reference a
document that passes the base rules is kept. Repeated rows are judged each on their
own; a null language counts for no reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE_A, LINE_END, RabinKarp, Words, blocks, list_array, prepare, scratch, text_buffers

MIN_WORDS = 50
#: Minimum lengths of the two comparisons, and the largest distances that pass.
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.25
MIN_COMMON_WORDS, MAX_WORD_DISTANCE = MIN_WORDS, 0.75
#: Words of a document, and the part of the distance of a text without common words from which
#: it has too few of them; linear between the two lengths, constant outside.
FEW_WORDS, FEW_SHARE = (125, 200), (0.95, 0.70)

#: Common words of the reference languages (fixed values).
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son on aux",
}
WORDS = sorted({w for words in COMMON.values() for w in words.split()})
#: Character classes: lower-case ASCII, upper-case ASCII, other letters (non-ASCII bytes),
#: digits, blanks, line ends, sentence marks, symbols.
CLASSES = 8

_CLASS = np.full(256, 7, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[128:], _CLASS[48:58] = 0, 1, 2, 3
_CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 4, 5
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 6
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_TRIM = np.arange(256, dtype=np.uint8)  # a word without case and sentence marks
_TRIM[65:91] += 32
_TRIM[[ord(c) for c in ".,;:!?'\"()-"]] = 0x20


def _codes(words: list[str]) -> np.ndarray:
    d = [w.encode() for w in words]
    o = np.cumsum([0, *map(len, d)])
    return Words(np.frombuffer(b"".join(d), np.uint8), o).code


def _lines(d: np.ndarray, o: np.ndarray, w: Words) -> np.ndarray:
    """For each document: lines with a word that are equal to an earlier line."""
    n = len(o) - 1
    if not len(d):
        return np.zeros(n, np.int64)
    lines = Words(d, o, space=LINE_END)
    has = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    doc, key = np.repeat(np.arange(n), lines.count)[has], lines.code[has]
    order = np.lexsort((key, doc))
    dup = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][dup], minlength=n)


def _repeats(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document: words in 3-word windows found at least twice in it."""
    n = len(first) - 1
    out = np.zeros(n, np.int64)
    tri = RabinKarp(code, BASE_A).windows(3)
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a < 4:
            continue
        x = tri[a:b - 2]
        y = np.sort(x)
        twice = y[1:][y[1:] == y[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(x, twice))
            hit = np.zeros(b - a, dtype=bool)
            hit[at] = hit[at + 1] = hit[at + 2] = True
            out[k] = hit.sum()
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common = _codes(WORDS)
    rank = np.argsort(common)
    for rb in batches:
        data, offs = text_buffers(rb.column(2))
        for i, j, d, o in blocks(data, offs):
            n = j - i
            w = Words(d, o)
            chars = np.zeros(len(d) + 1, np.int64)
            np.cumsum((d & 0xC0) != 0x80, out=chars[1:])
            in_word = np.zeros(len(w.starts) + 1, np.int64)
            np.cumsum(chars[w.ends] - chars[w.starts], out=in_word[1:])
            symbols = np.zeros(len(d) + 1, np.int64)
            np.cumsum(_SYMBOL[d], out=symbols[1:])
            doc = np.repeat(np.arange(n), np.diff(o))
            classes = np.bincount(doc * CLASSES + _CLASS[d], minlength=n * CLASSES)
            t = Words(_TRIM[d], o)
            code = t.code
            at = np.searchsorted(common[rank], code)
            at[at == len(common)] = 0
            hit = common[rank][at] == code
            t_doc = np.repeat(np.arange(n), t.count)
            words = np.bincount(t_doc * (len(WORDS) + 1) + np.where(hit, rank[at], len(WORDS)),
                                minlength=n * (len(WORDS) + 1))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).slice(i, n), rb.column(1).slice(i, n), pa.array(w.count.astype(np.int64)),
                 pa.array(in_word[w.first[1:]] - in_word[w.first[:-1]]), pa.array(symbols[o[1:]] - symbols[o[:-1]]),
                 pa.array(_lines(d, o, w).astype(np.int64)), pa.array(_repeats(w.code, w.first)),
                 list_array(classes.astype(np.int32), np.full(n, CLASSES), pa.int32()),
                 list_array(words.astype(np.int32), np.full(n, len(WORDS) + 1), pa.int32())],
                ["_id", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_chars", "_words"])


def nearest(counts: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jensen-Shannon distance (root of the divergence, base 2) between each row of
    counts and each row of shares: the smallest for each row of counts, and its row of shares."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    best, at = np.full(len(p), np.inf), np.zeros(len(p), np.int64)
    for k, q in enumerate(shares):
        m = (p + q) / 2
        m[m == 0] = 1
        total = (p * np.log2(np.where(p > 0, p / m, 1)) + q * np.log2(np.where(q > 0, q / m, 1))).sum(axis=1)
        d = np.sqrt(np.maximum(total / 2, 0))
        at[d < best] = k
        best = np.minimum(best, d)
    return best, at


def distance(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The distance of each row of counts to its nearest row of shares."""
    return nearest(counts, shares)[0]


def few_common(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Documents with fewer common words than their nearest reference, as far from it as
    ``FEW_SHARE`` of a text without any."""
    if not len(shares):
        return np.zeros(len(counts), dtype=bool)
    none = np.zeros((1, counts.shape[1]))
    none[0, -1] = 1
    reach = np.array([distance(none, q[None])[0] for q in shares])
    d, at = nearest(counts, shares)
    n = counts.sum(axis=1)
    fewer = counts[:, -1] > shares[at, -1] * n
    return (n >= MIN_COMMON_WORDS) & fewer & (d > np.interp(n, FEW_WORDS, FEW_SHARE) * reach[at])


def _foreign(counts: np.ndarray) -> np.ndarray:
    """Rows of counts of character classes with more non-ASCII bytes than ASCII letters."""
    return counts[:, 2] > counts[:, 0] + counts[:, 1]


def _char_distance(counts: np.ndarray, labels: np.ndarray, langs: list[str], refs: np.ndarray) -> np.ndarray:
    """The distance of each document to the nearest of the references its label allows; infinite
    without any, and for a null label in a script of none of them."""
    shared = np.array([x in COMMON for x in langs], dtype=bool)
    out = np.full(len(counts), np.inf)
    for label in set(labels):
        rows = np.flatnonzero(labels == label) if label is not None else np.flatnonzero([x is None for x in labels])
        use = np.ones(len(langs), dtype=bool) if label is None else shared | np.array([x == label for x in langs], dtype=bool)
        if label is not None and label not in langs:
            continue
        out[rows] = distance(counts[rows], refs[use])
        if label is None and not _foreign(refs).any():
            out[rows[_foreign(counts[rows])]] = np.inf
    return out


def _distances(langs: list[str], chars: np.ndarray, words: np.ndarray):
    """Distances to the nearest references; null for documents that are too short, or without references.
    Words: also null for documents without a label of a language with a list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            labels = np.array(rb.column(rb.schema.get_field_index("_lang")).to_pylist(), dtype=object)
            listed = np.array([x in COMMON for x in labels], dtype=bool)
            for name, refs, least in (("_chars", chars, MIN_CHARS), ("_words", words, MIN_COMMON_WORDS)):
                counts = rb.column(rb.schema.get_field_index(name)).flatten().to_numpy().reshape(rb.num_rows, -1).astype(float)
                d = _char_distance(counts, labels, langs, refs) if name == "_chars" else distance(counts, refs)
                d = np.round(d, 6)
                spared = (counts.sum(axis=1) < least) | ~np.isfinite(d)
                out.append(pa.array(d, mask=spared | ~listed if name == "_words" else spared))
            out.append(pa.array(few_common(counts, refs) & listed))
            keep = [c for c in rb.schema.names if c not in ("_lang", "_chars", "_words")]
            yield pa.RecordBatch.from_arrays([*(rb.column(rb.schema.get_field_index(c)) for c in keep), *out],
                                             [*keep, "char_distance", "word_distance", "_few"])
    return run


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance, kept) for every row."""
    prepare(df.sparkSession)
    x = df.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    kind = x.schema["_id"].dataType.simpleString()
    x = scratch(x.mapInArrow(_features, f"_id {kind}, _lang string, n_words bigint, word_chars bigint, n_symbols bigint, "
                             "n_dup_lines bigint, n_repeat_words bigint, _chars array<int>, _words array<int>"), "features")
    sums = [F.sum(F.col("_chars")[i]).alias(f"c{i}") for i in range(CLASSES)] + \
           [F.sum(F.col("_words")[i]).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    # a row for each language label
    refs = x.filter(F.col("_lang").isNotNull() & ~base_failed()).groupBy("_lang").agg(*sums).collect()
    refs = sorted(refs, key=lambda r: r["_lang"])
    chars = np.array([[r[f"c{i}"] for i in range(CLASSES)] for r in refs], float).reshape(len(refs), CLASSES)
    langs = [r["_lang"] for r in refs]
    words = np.array([[r[f"w{i}"] for i in range(len(WORDS) + 1)] for r in refs if r["_lang"] in COMMON], float).reshape(-1, len(WORDS) + 1)
    chars, words = (x / np.maximum(x.sum(axis=1, keepdims=True), 1) for x in (chars, words))
    x = x.mapInArrow(_distances(langs, chars, words), f"_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, "
                                   "n_dup_lines bigint, n_repeat_words bigint, char_distance double, word_distance double, _few boolean")
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE) | F.col("_few")
    return x.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base_failed().alias("base_failed"), "char_distance", "word_distance", (~base_failed() & ~far).alias("kept"))
