"""Language ID by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, found by a
forward algorithm; a text's is the product over its words. Every byte is a piece of
its own as well, so any text has a segmentation.

Training counts the vocabulary's pieces in a bounded sample of labelled documents of
each language (``TRAIN_DOCS``, drawn by a hash of the id; smaller languages whole),
summed in Spark; the model is languages x pieces numbers. Scoring is one Arrow pass
without a shuffle: the distinct words of a block are looked up in a direct-mapped table
of recent words (fixed size), and new ones run the forward algorithm together, one
numpy step for each pair of positions.

Words are runs of ASCII letters (lower-cased) and non-ASCII characters; words of over
``WORD_BYTES`` bytes are scored in parts. Whole texts are scored.

Null texts and texts without a letter are ``und`` with score 0. Without training
documents every text is ``und``. The score is the posterior probability of the language
given equal priors; ties go to the alphabetically first. Repeated rows are scored each on
their own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE_CHAR, Words, blocks, mix, powers, prepare, text_buffers

#: Training documents of each language, about.
TRAIN_DOCS = 2000
#: Bytes of a word that are segmented together, and of the longest piece used.
WORD_BYTES, PIECE_BYTES = 32, 16
#: Added to every piece's count in every language; a single byte's share of the mass.
SMOOTHING, BYTE_MASS = 0.1, 1e-4
#: Slots of the table of recent words.
TABLE_SLOTS = 1 << 18

_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def vocabulary_pieces(model_path: str) -> list[bytes]:
    """Byte strings of the vocabulary's pieces; a word's start is a space."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out = set()
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            p = sp.id_to_piece(i).replace("▁", " ").encode()
            if len(p) <= PIECE_BYTES:
                out.add(p)
    return sorted(out)


def _hash(matrix: np.ndarray) -> np.ndarray:
    """Prefix sums of polynomial terms along the rows of a byte matrix."""
    terms = (matrix.astype(np.uint64) + np.uint64(1)) * powers(BASE_CHAR, matrix.shape[1])
    out = np.zeros((len(matrix), matrix.shape[1] + 1), np.uint64)
    np.cumsum(terms, axis=1, out=out[:, 1:])
    return out


class PieceModel:
    """Probabilities ``table`` (piece, language); the last row is no piece."""

    def __init__(self, pieces: list[bytes], probabilities: np.ndarray, languages: list[str]):
        self.languages = languages
        k = len(languages)
        every = [*pieces, *(bytes([b]) for b in range(256))]
        code = np.array([self._code(p) for p in every], dtype=np.uint64)
        prob = np.concatenate([probabilities, np.full((256, k), BYTE_MASS / 256)]) if pieces else np.full((256, k), 1 / 256)
        order = np.argsort(code, kind="stable")
        code, prob = code[order], prob[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        self.code, self.table = code[first], np.add.reduceat(prob, first, axis=0)
        self.table = np.concatenate([self.table, np.zeros((1, k))])
        self.lengths = sorted({len(p) for p in every})
        # one slot for each piece in a sparse table of 2 ** 20: most lookups end there
        self.present = np.zeros(1 << 20, dtype=bool)
        self.present[self.code >> np.uint64(44)] = True
        self.inverse = powers(pow(BASE_CHAR, -1, 2**64), WORD_BYTES + 2)
        self.slot_code = np.zeros(TABLE_SLOTS, np.uint64)
        self.slot_score = np.zeros((TABLE_SLOTS, k), np.float32)

    @staticmethod
    def _code(piece: bytes) -> int:
        row = _hash(np.frombuffer(piece, np.uint8)[None, :])
        return int(mix(row[:, -1] + np.uint64(len(piece)))[0])

    def _find(self, code: np.ndarray) -> np.ndarray:
        """Row of ``table`` for each code, the last one for none."""
        out = np.full(len(code), len(self.code), np.int64)
        maybe = np.flatnonzero(self.present[code >> np.uint64(44)])
        at = np.searchsorted(self.code, code[maybe])
        at[at == len(self.code)] = 0
        hit = self.code[at] == code[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def forward(self, matrix: np.ndarray) -> np.ndarray:
        """Log probability of each row (equally long words) in each language, summed
        over all segmentations."""
        n, width = matrix.shape
        prefix = _hash(matrix)
        alpha = np.zeros((width + 1, n, len(self.languages)))
        alpha[0] = 1.0
        for j in range(1, width + 1):
            for size in self.lengths:
                i = j - size
                if i < 0:
                    break
                row = self._find(mix((prefix[:, j] - prefix[:, i]) * self.inverse[i] + np.uint64(size)))
                some = np.flatnonzero(row < len(self.code))
                if len(some):
                    alpha[j, some] += alpha[i, some] * self.table[row[some]]
        return np.log(np.maximum(alpha[width], 1e-300))

    def words(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Scores (word, language), through the table of recent words."""
        slot = (code >> np.uint64(64 - TABLE_SLOTS.bit_length() + 1)).astype(np.int64)
        out = self.slot_score[slot]
        new = np.flatnonzero(self.slot_code[slot] != code)
        if len(new):
            _, first, back = np.unique(code[new], return_index=True, return_inverse=True)
            pick = new[first]
            score = self._fresh(starts[pick], ends[pick], data)
            out[new] = score[back]
            self.slot_code[slot[pick]], self.slot_score[slot[pick]] = code[pick], score
        return out

    def _fresh(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Forward scores of words; longer ones are cut into parts."""
        size = ends - starts
        parts = -(-size // WORD_BYTES)
        owner = np.repeat(np.arange(len(size)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        a = starts[owner] + number * WORD_BYTES
        b = np.minimum(a + WORD_BYTES, ends[owner])
        head = number == 0
        out = np.zeros((len(size), len(self.languages)))
        length = b - a
        for n in np.unique(length).tolist():
            for has_head in (True, False):
                k = np.flatnonzero((length == n) & (head == has_head))
                if len(k):
                    m = data[a[k][:, None] + np.arange(n)]
                    if has_head:
                        m = np.concatenate([np.full((len(k), 1), 0x20, np.uint8), m], axis=1)
                    np.add.at(out, owner[k], self.forward(m))
        return out.astype(np.float32)

    def score(self, d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each document and language, its word count)."""
        w = Words(_LETTERS[d], o)
        count = w.count
        total = np.zeros((len(count), len(self.languages)))
        if len(w.starts):
            s = self.words(w.code, w.starts, w.ends, w.data)
            full = np.flatnonzero(count)
            total[full] = np.add.reduceat(s.astype(np.float64), w.first[:-1][full], axis=0)
        return total, count


def _count_pieces(model_bytes: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        counts: dict[str, Counter] = {}
        for rb in batches:
            data, offs = text_buffers(rb.column(1))
            for i, lang in enumerate(rb.column(0).to_pylist()):
                text = _LETTERS[data[offs[i]:offs[i + 1]]].tobytes().decode("utf-8", "replace")
                counts.setdefault(lang, Counter()).update(sp.encode(text, out_type=str, num_threads=1))
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()),
                                              pa.array(list(c.values()), pa.int64())], ["lang", "piece", "n"])
    return run


def train(labelled: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> PieceModel:
    """Fit piece probabilities on the rows that have a text and a language."""
    with open(model_path, "rb") as f:
        proto = f.read()
    x = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
                .select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"), F.col(id_col).alias("_id"))
    sizes = {r["_lang"]: r["n"] for r in x.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return PieceModel([], np.zeros((0, 0)), [])
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, TRAIN_DOCS / n))]), F.col("_lang"))
    draw = F.shiftrightunsigned(F.xxhash64("_id", F.lit("train")), 33) / F.lit(float(1 << 31))
    counts = x.filter(draw < share).select("_lang", "_text") \
              .mapInArrow(_count_pieces(proto), "lang string, piece string, n bigint") \
              .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # languages x vocabulary at most
    languages = sorted(sizes)
    pieces = vocabulary_pieces(model_path)
    at = {p: i for i, p in enumerate(pieces)}
    table = np.full((len(pieces), len(languages)), SMOOTHING)
    column = {x: i for i, x in enumerate(languages)}
    for lang, piece, n in zip(counts["lang"], counts["piece"], counts["n"]):
        i = at.get(piece.replace("▁", " ").encode())
        if i is not None:
            table[i, column[lang]] += n
    table *= (1 - BYTE_MASS) / table.sum(axis=0)
    return PieceModel(pieces, table, languages)


def _predict(model: PieceModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            data, offs = text_buffers(rb.column(1))
            for i, j, d, o in blocks(data, offs, 4 << 20):
                n = j - i
                lang, score = np.full(n, "und", dtype=object), np.zeros(n)
                if model.languages:
                    total, count = model.score(d, o)
                    best = total.argmax(axis=1)
                    top = 1 / np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
                    ascii_letter = np.zeros(len(d) + 1, np.int64)
                    np.cumsum((d < 128) & (_LETTERS[d] != 0x20), out=ascii_letter[1:])
                    has = ascii_letter[o[1:]] > ascii_letter[o[:-1]]
                    for k in np.flatnonzero(~has & (count > 0)).tolist():
                        has[k] = any(c.isalpha() for c in d[o[k]:o[k + 1]].tobytes().decode("utf-8", "replace"))
                    for k in np.flatnonzero(has).tolist():
                        lang[k], score[k] = model.languages[best[k]], float(top[k])
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(i, n), pa.array(lang.tolist(), pa.string()),
                                                  pa.array(score)], ["_id", "lang_pred", "score"])
    return run


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify(df: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang_pred, score) for every row."""
    prepare(df.sparkSession)
    x = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = x.schema["_id"].dataType.simpleString()
    return x.mapInArrow(_predict(model), f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)
