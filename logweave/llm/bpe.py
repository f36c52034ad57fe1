"""Byte-pair encoding and decoding of whole texts.

A text is cut at special tokens, normalised and split by the vocabulary's rule;
each split is a doubly linked list of symbols. A priority queue holds the merge
rank of every neighbouring pair; the lowest rank merges first (ties: the
leftmost), new neighbours enter the queue, and entries whose symbols have
changed since are skipped when they come up. Decoding concatenates vocabulary
strings.

Rows are independent: one Arrow pass to encode, one to decode, no shuffle. The
vocabulary file (a few MB, a fixed file) is read on the driver and sent with the
tasks. A worker keeps the ids of recent words in a cache of bounded size; numpy cuts plain
texts into units and looks them up (``library_tokens.BlockTexts``), and units that the cache
does not hold are merged as above.

Nulls and empty texts have no ids and decode to an empty text; repeated rows are
encoded each on their own; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, id_text, list_array, prepare, text_buffers, worker_state
from .library_tokens import BLOCK_TEXT, CACHE_MAX_CHARS, BlockTexts, Generations, Units, byte_letters, read_vocabulary

#: Unicode's White_Space characters.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points that count as neither letters nor numbers in the tokenizers library, whose
#: character classes are those of Unicode 16, though a later Unicode version (and so the
#: regex package, depending on its release) has made them so.
LATER_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    r"\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")
LATER_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
#: Capitals that the library lowers and Python's older tables leave: runs (first, last, step, distance).
LATER_CAPITALS = ((0x1C89, 0x1C89, 1, 1), (0xA7CB, 0xA7CB, 1, 0x264 - 0xA7CB), (0xA7CC, 0xA7CE, 2, 1), (0xA7D2, 0xA7D4, 2, 1),
                  (0xA7DA, 0xA7DA, 1, 1), (0xA7DC, 0xA7DC, 1, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 1, 32), (0x16EA0, 0x16EB8, 1, 27))
_LOWER = {c: chr(c + d) for a, b, step, d in LATER_CAPITALS for c in range(a, b + 1, step)}
_L, _N = rf"[\p{{L}}--[{LATER_LETTERS}]]", rf"[\p{{N}}--[{LATER_NUMBERS}]]"
_OTHER = rf"[[^{_WHITE}]--{_L}--{_N}]"
#: Fixed split rules of the two published vocabularies.
WORD_RULE = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{_L}+|{_N}|{_OTHER}+"
BYTE_RULE = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?{_OTHER}+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
#: The word rule for ASCII text, where the classes need no exceptions.
ASCII_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\t-\r A-Za-z0-9]+"


def merge_symbols(symbols: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """Ids of one split after all merges. ``ranks``: pair -> rank; ``merged``: the id a rank merges to.

    A queue entry is ``rank * n + place``, so equal ranks merge from the left; it is stale where the pair
    at its place has another rank by now."""
    n = len(symbols)
    get = ranks.get
    here = list(map(get, zip(symbols, symbols[1:])))
    queue = [r * n + i for i, r in enumerate(here) if r is not None]
    if not queue:
        return symbols
    heapq.heapify(queue)
    pop, push = heapq.heappop, heapq.heappush
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    gone = -1
    while queue:
        rank, i = divmod(pop(queue), n)
        if here[i] != rank:
            continue  # stale: a neighbour has merged since
        j = right[i]
        new = symbols[i] = merged[rank]
        symbols[j] = gone
        k = right[i] = right[j]
        here[i] = None
        if k < n:
            here[j] = None
            left[k] = i
            r = here[i] = get((new, symbols[k]))
            if r is not None:
                push(queue, r * n + i)
        h = left[i]
        if h >= 0:
            r = here[h] = get((symbols[h], new))
            if r is not None:
                push(queue, r * n + h)
    return [s for s in symbols if s != gone]


class Codec(BlockTexts):
    """Encoder and decoder of one vocabulary file (BPE model, byte-level symbols)."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = spec["normalizer"] is not None
        self.rule = regex.compile(WORD_RULE if self.lower else BYTE_RULE)
        self.ascii_rule = regex.compile(ASCII_WORD_RULE) if self.lower else self.rule
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.vocab = vocab
        self.ranks = {}
        self.merged = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
        self.letters = byte_letters()
        by_id = {i: s for s, i in (vocab | self.special).items()}
        self.joined = spec.get("decoder") is None  # strings with a space between, else bytes
        back = {c: b for b, c in self.letters.items()}
        own = set(self.special.values())
        self.strings = [b""] * (max(by_id) + 1)
        for i, s in by_id.items():
            self.strings[i] = s.encode() if self.joined or i in own else bytes(back[c] for c in s)
        self.words, self.runs = Generations(), Generations()
        self.kind, self.units = "words" if self.lower else "bytes", Units()

    def _run(self, run: str) -> bytes:
        """Ids of one split."""
        ids = self.runs.get(run)
        if ids is None:
            ids = self.runs.new[run] = self._merged(run)
        return ids

    def _merged(self, run: str) -> bytes:
        chars = run if self.lower and run.isascii() and run.isprintable() else run.encode().decode("latin-1").translate(self.letters)
        symbols = list(map(self.vocab.get, [*chars[:-1], chars[-1] + self.suffix]))
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        return array("I", merge_symbols(symbols, self.ranks, self.merged)).tobytes()

    def _plain_text(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if text.isascii():
            return b"".join(map(self._run, self.ascii_rule.findall(text.lower() if self.lower else text)))
        if self.lower:
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text).translate(_LOWER))
        return b"".join(map(self._run, self.rule.findall(text)))

    def _segment(self, text: str) -> bytes:
        if self.cut is None or "<" not in text:
            return self._plain_text(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain_text(p)
                        for p in self.cut.split(text) if p)

    def _ask(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of units of plain texts that the cache does not hold; a unit of letters is one split."""
        self.runs.turn()
        out = []
        for u in units:
            if u.isalpha():  # ASCII letters
                text = u.decode()
                out.append(self._merged(text.lower() if self.lower else text))
            elif not self.lower and u[:1] == b" " and u[1:].isalpha():
                out.append(self._merged(u.decode()))
            else:
                out.append(self._plain_text(u.decode()))
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def _odd(self, text: bytes) -> bytes:
        return self.encode(text)

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.lower:
            self.runs.turn()
            return self._segment(text.decode("utf-8", "replace"))
        self.words.turn()  # white space is dropped, so words stand alone
        self.runs.turn()
        young = self.words.new
        split = text.split()
        ids = list(map(young.get, split))
        if None not in ids:
            return b"".join(ids)
        passing = []
        for w in {w for w, v in zip(split, ids) if v is None}:
            v = self.words.old.get(w)
            young[w] = self._segment(w.decode("utf-8", "replace")) if v is None else v
            if len(w) > CACHE_MAX_CHARS:
                passing.append(w)
        out = b"".join(map(young.__getitem__, split))
        for w in passing:
            del young[w]
        return out

    def decode(self, ids: array) -> bytes:
        """UTF-8 text of the ids; bytes that are no UTF-8 become U+FFFD."""
        text = (b" " if self.joined else b"").join(map(self.strings.__getitem__, ids))
        return text if self.joined else text.decode("utf-8", "replace").encode()


def codec(tokenizer_json: str) -> Codec:
    """One codec for each worker process."""
    held, key = worker_state("codec"), hash(tokenizer_json)
    if key not in held:
        held.clear()
        held[key] = Codec(tokenizer_json)
    return held[key]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``ids`` array<int>) for each row."""
    prepare(df.sparkSession)
    spec = read_vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec)
        for rb in batches:
            data, offs = text_buffers(rb.column(1))
            for i, j, d, o in blocks(data, offs, 4 * BLOCK_TEXT):
                ids, at = own.encode_texts(d, o)
                values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(i, j - i), list_array(values, np.diff(at), pa.int32())], ["_id", "ids"])

    x = id_text(df, id_col, text_col)
    kind = x.schema["_id"].dataType.simpleString()
    return x.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def _decoded(encoded: DataFrame, vocabulary: str, id_col: str, ids_col: str, fields: str, row) -> DataFrame:
    prepare(encoded.sparkSession)
    spec = read_vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec)
        for rb in batches:
            out = []
            for v in rb.column(1):
                ids = array("I")
                if v.is_valid and len(v.values):
                    ids.frombytes(v.values.cast(pa.int32()).to_numpy().tobytes())
                out.append(row(ids, own.decode(ids)))
            cols = [pa.array(c) for c in zip(*out)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([rb.column(0), *cols], ["_id", *[f.split()[0] for f in fields.split(", ")]])

    x = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    kind = x.schema["_id"].dataType.simpleString()
    return x.mapInArrow(run, f"_id {kind}, {fields}").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, ``text``) for each row of ids; null ids give an empty text."""
    return _decoded(encoded, vocabulary, id_col, ids_col, "text string", lambda ids, text: (text.decode(),))


def round_trip_digests(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, n_tokens, ids_sha256, decoded_sha256) of encoded rows."""
    return _decoded(encoded, vocabulary, id_col, ids_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                    lambda ids, text: (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                                       hashlib.sha256(text).hexdigest()))
