"""Whole-text token ids from the tokenizers library, block by block.

A text is cut into units where the tokenizer's own split rule always ends a token run, so
the joined ids of the units are those of the whole text; the library is asked once for each
distinct unit a worker's cache does not hold, for units that are runs of letters many in one
call. Two ways lead there:

* *Plain texts* (ASCII and the letters U+00C0 to U+00FF, without an added token's mark) are
  cut by numpy, a block of texts at a time: a run of letters with the marks after it (ASCII
  ones but the apostrophe) makes two units, any other run of visible bytes one. The word vocabulary drops white
  space and case. The byte vocabulary gives the last blank of a run of white space to the unit
  after it; the white space before that is a unit, and so is a last one that is no blank.
  Units are told apart by two 64-bit hashes, looked up in sorted arrays; a hit costs no Python.
* *Other texts* are cut at the added tokens first, then by a pattern: the word vocabulary at
  white space; the byte vocabulary before a space or newline followed by a plain visible
  character, after such a newline, and between a word and the marks that end it.

Both caches are bounded in entries and bytes. The tokenizer file is read on the driver and
sent with the tasks (a vocabulary file has a fixed size of a few MB).
"""

from __future__ import annotations

import os
import re
import string
import sys
from array import array
from itertools import chain, compress
from operator import attrgetter

import numpy as np
import pyarrow as pa

from .common import _BYTE_CODE, _LOWER, _SPACE, blocks, mix, powers, worker_state

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core

from tokenizers import Tokenizer  # noqa: E402
from tokenizers.pre_tokenizers import WhitespaceSplit  # noqa: E402

#: Entries of each generation of the caches of other texts; the older one goes when the younger is full.
CACHE_SEGMENTS = 50_000
#: Longer segments and units are encoded each time they are met (so entries bound the bytes).
CACHE_MAX_CHARS = 48
#: Units that the cache of plain texts holds; over that, those met in more than one block
#: since the last time stay, or those of the last block if these are too many.
CACHE_UNITS = 400_000
#: Units that the library gets in one piece.
ASK_UNITS = 256
#: Bytes of text of a block; longer texts are cut between two words.
BLOCK_TEXT = 1 << 20

#: Plain visible characters: none of them is white space in any rule set.
_VISIBLE = "!-~\u00a1-\u167f\u2c00-\u2fff\u3001-\ud7ff"
#: Letters of European texts: all of them are letters under both split rules.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_CUT = rf"(?=[ \n][{_VISIBLE}]|\Z)"
_SEGMENT = re.compile(rf" ?[{_LETTER}]+(?=[.,;:!?]*{_CUT})|[.,;:!?]+{_CUT}|\n(?=[{_VISIBLE}])|"
                      rf" ?[{_VISIBLE}]+{_CUT}|[\s\S]+?{_CUT}")
#: A word and the marks after it: two token runs under both split rules, and
#: letters that normalisation only lower-cases.
_WORD = re.compile(rf"([{_LETTER}]+)([.,;:!?]*)")
_ID = attrgetter("id")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: visible
    Latin-1 characters stand for themselves, the other bytes take the code
    points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Generations:
    """A bounded cache: a young dictionary, and the one before it."""

    def __init__(self, limit: int = CACHE_SEGMENTS):
        self.limit = limit
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        v = self.new.get(key)
        if v is None:
            v = self.old.get(key)
            if v is not None:
                self.new[key] = v
        return v

    def turn(self) -> None:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}


class BlockTexts:
    """Encoding of many texts a block at a time. A subclass has a ``kind``, its ``units``, ``_odd`` for
    a text that is not plain, and ``_ask`` for the ids of units that the cache does not hold."""

    def _plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block of plain texts."""
        if self.kind == "words":
            data = _LOWER[data]
        starts, ends = cut_units(data, offs, self.kind == "bytes")
        entry, ids, at, size = self.units.find(data, starts, ends, self._ask)
        count = size[entry]
        out = _parts(ids, at[entry], count)
        edge = np.searchsorted(starts, offs)
        return out, np.r_[0, np.cumsum(count)][edge]

    def encode_texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and where each text's begin (one more entry at the end)."""
        parts, sizes = [], np.zeros(len(offs) - 1, np.int64)
        for i, j, d, o in blocks(data, offs, BLOCK_TEXT):
            odd = odd_texts(d, o)
            if j - i == 1 and (odd[0] or len(d) > 2 * BLOCK_TEXT):
                for a, b in ([(0, len(d))] if odd[0] else _slices(d)):
                    ids = np.frombuffer(self._odd(d.tobytes()), "<u4") if odd[0] else self._plain(d[a:b], np.array([0, b - a]))[0]
                    parts.append(ids)
                    sizes[i] += len(ids)
                continue
            # odd texts stand as empty ones in the block, and are put in their places after
            keep = np.repeat(~odd, np.diff(o))
            ids, at = self._plain(d[keep], np.r_[0, np.cumsum(np.where(odd, 0, np.diff(o)))])
            sizes[i:j] = np.diff(at)
            last = 0
            for k in np.flatnonzero(odd).tolist():
                own = np.frombuffer(self._odd(d[o[k]:o[k + 1]].tobytes()), "<u4")
                parts += [ids[last:at[k]], own]
                sizes[i + k], last = len(own), int(at[k])
            parts.append(ids[last:])
        return np.concatenate([np.zeros(0, "<u4"), *parts]), np.r_[0, np.cumsum(sizes)]


class LibraryTokens(BlockTexts):
    """``kind`` is ``words`` (white space dropped, lower case) or ``bytes`` (byte-level, kept)."""

    def __init__(self, tokenizer_json: str, kind: str):
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.kind = kind
        self.stand_in = byte_letters()
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added_re = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        #: the model alone, for runs that are one split each, written in its own symbols
        self.parted = Tokenizer(self.tok.model)
        self.parted.pre_tokenizer = WhitespaceSplit()
        self.code_points = np.array([ord(self.stand_in[b]) for b in range(256)], "<u4")
        self.code_points[10] = 32
        vocab = self.parted.get_vocab()
        suffix = self.tok.model.end_of_word_suffix or ""
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes that an id stands for
        self.width[list(vocab.values())] = [len(s.removesuffix(suffix)) for s in vocab]
        self.units = Units()
        self.seen, self.runs = Generations(), Generations()

    def _whole(self, segments: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(segments, add_special_tokens=False)]

    def _run(self, letters: str) -> bytes:
        """Ids of one letter run, by the library's model (the run is already one split)."""
        v = self.runs.get(letters)
        if v is None:
            v = self.runs.new[letters] = self._split(self._symbols(letters.lower()))
        return v

    def _symbols(self, run: str) -> str:
        return run if run.isascii() else run.encode().decode("latin-1").translate(self.stand_in)

    def _split(self, symbols: str) -> bytes:
        return array("I", list(map(_ID, self.tok.model.tokenize(symbols)))).tobytes()

    def _fill_bytes(self, missing: set) -> list:
        """As ``_fill``, for the byte vocabulary, where a word is a segment and needs no cache of runs."""
        young, old, ask, space = self.seen.new, self.seen.old, [], self.stand_in[32]
        for s in missing:
            v = old.get(s)
            if v is None:
                spaced = s[0] == " "
                word = s[1:] if spaced else s
                if len(s) > CACHE_MAX_CHARS or not _WORD.fullmatch(word) or not word.isalpha():
                    ask.append(s)
                    continue
                symbols = self._symbols(word)
                v = self._split(space + symbols if spaced else symbols)
            young[s] = v
        if ask:
            young.update(zip(ask, self._whole(ask)))
        return [s for s in ask if len(s) > CACHE_MAX_CHARS]

    def _fill(self, missing: set) -> list:
        """Put the ids of missing segments into the young cache; those too long to stay are returned."""
        young, ask, texts = self.seen.new, [], []
        for s in missing:
            v = self.seen.old.get(s)
            if v is None:
                text = s.decode("utf-8", "replace")
                if len(s) <= CACHE_MAX_CHARS and text.isascii() and text.isalpha():
                    young[s] = self._run(text)
                    continue
                m = _WORD.fullmatch(text) if len(s) <= CACHE_MAX_CHARS else None
                if m is None:
                    ask.append(s)
                    texts.append(text)
                    continue
                marks = m[2]
                v = self._run(m[1])
                if marks:
                    tail = self.runs.get(marks)
                    if tail is None:
                        tail = self.runs.new[marks] = self._whole([marks])[0]
                    v += tail
            young[s] = v
        if ask:
            young.update(zip(ask, self._whole(texts)))
        return [s for s in ask if len(s) > CACHE_MAX_CHARS]

    def segments(self, text: bytes) -> list:
        if self.kind == "words":
            return text.split()
        text = text.decode("utf-8", "replace")
        if self.added_re is None or not self.added_re.search(text):
            return _SEGMENT.findall(text)
        # the library takes added tokens out first; what is between them is a text of its own
        return [s for part in self.added_re.split(text) for s in ([part] if part in self.added else _SEGMENT.findall(part))]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        self.seen.turn()
        self.runs.turn()
        out, young = [], self.seen.new
        fill = self._fill if self.kind == "words" else self._fill_bytes
        for t in texts:
            split = self.segments(t)
            ids = list(map(young.get, split))
            if None in ids:
                gaps = [i for i, v in enumerate(ids) if v is None]
                passing = fill({split[i] for i in gaps})
                for i in gaps:
                    ids[i] = young[split[i]]
                for s in passing:
                    del young[s]
            out.append(b"".join(ids))
        return out

    def _odd(self, text: bytes) -> bytes:
        return self.encode([text])[0]

    def _ask(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of units of plain texts that the cache does not hold."""
        lens = np.fromiter(map(len, units), np.int64, len(units))
        data = np.frombuffer(b"".join(units), np.uint8)
        into = np.cumsum(lens) - lens
        letters = np.add.reduceat(_LETTER_BYTE[data], into, dtype=np.int64)
        word = (letters > 0) & (letters + (data[into] == 32) == lens)
        own, sizes = self._letters(list(compress(units, word.tolist())), lens[word])
        rest = np.flatnonzero(~word)
        got = self._whole([units[i].decode() for i in rest.tolist()])
        return _in_order(np.concatenate([np.flatnonzero(word), rest]), np.concatenate([sizes, _sizes(got)]),
                         np.concatenate([own, np.frombuffer(b"".join(got), "<u4")]))

    def _letters(self, units: list[bytes], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_ask``, for runs of letters, with a blank before or without: each is one split, so
        the library's model gets many of them at a time, parted at white space. A unit's ids end
        where the bytes that they stand for do."""
        if not units:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        data = b"\n".join(units)
        if self.kind == "words":
            data = data.decode().lower().encode()
        symbols = self.code_points[np.frombuffer(data, np.uint8)].tobytes().decode("utf-32-le")
        cut = np.r_[0, np.cumsum(lens + 1)][[*range(0, len(units), ASK_UNITS), len(units)]].tolist()
        got = self.parted.encode_batch_fast([symbols[a:b - 1] for a, b in zip(cut, cut[1:])], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in got), "<u4")
        ends, want = np.cumsum(self.width[ids]), np.cumsum(lens)
        last = np.searchsorted(ends, want)
        if not len(ends) or ends[-1] != want[-1] or not np.array_equal(ends[last], want):  # symbols that the vocabulary lacks
            each = [self._split(s) for s in symbols.split(" ")]
            return np.frombuffer(b"".join(each), "<u4"), _sizes(each)
        return ids, np.diff(last, prepend=-1)


#: Bytes that a plain text has: ASCII, and the letters of two bytes that begin with 0xC3.
_LETTER_BYTE = np.zeros(256, dtype=bool)
_LETTER_BYTE[65:91] = _LETTER_BYTE[97:123] = _LETTER_BYTE[128:] = True
#: White space 0, letters 1, marks that no split rule joins to the letters before them (an
#: apostrophe may be) 2, other bytes 3.
_KIND = np.where(_SPACE, 0, np.where(_LETTER_BYTE, 1, 3)).astype(np.uint8)
_KIND[[ord(c) for c in string.punctuation if c != "'"]] = 2


def odd_texts(d: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Which texts of a block are not plain: they have a character over U+00FF or from
    U+0080 to U+00BF, U+00D7, U+00F7, or ``<|``, as added tokens do."""
    bad = (d >= 0xC0) & (d != 0xC3)
    pair = d[:-1] == 0xC3
    bad[:-1] |= pair & ((d[1:] == 0x97) | (d[1:] == 0xB7))
    bad[:-1] |= (d[:-1] == 60) & (d[1:] == 124)
    edge = np.searchsorted(np.flatnonzero(bad), o)
    return edge[1:] > edge[:-1]


def _slices(d: np.ndarray):
    """Parts of a long text, cut before a single blank between two words."""
    a = 0
    while a < len(d):
        b = a + BLOCK_TEXT
        while b < len(d) - 1:
            here = np.flatnonzero((d[b:b + BLOCK_TEXT] == 32) & ~_SPACE[d[b - 1:b - 1 + len(d[b:b + BLOCK_TEXT])]])
            here = here[here + b + 1 < len(d)]
            here = here[~_SPACE[d[here + b + 1]]]
            if len(here):
                b += int(here[0])
                break
            b += BLOCK_TEXT
        if b >= len(d) - 1:
            b = len(d)
        yield a, b
        a = b


def cut_units(d: np.ndarray, o: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the units of a block of plain texts, in order; ``spaces``: white
    space is kept, as the byte vocabulary does."""
    n = len(d)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[d]
    edge = np.zeros(n + 1, dtype=bool)
    edge[o] = True
    turn = edge[:n].copy()
    turn[0] = True
    turn[1:] |= kind[1:] != kind[:-1]
    a = np.flatnonzero(turn)  # runs of bytes of one kind, within a text
    b = np.append(a[1:], n)
    k, first = kind[a], edge[a]
    visible = k > 0
    head, last = visible.copy(), visible.copy()  # the runs that begin and end a run of visible bytes
    head[1:] &= first[1:] | ~visible[:-1]
    last[:-1] &= first[1:] | ~visible[1:]
    two = np.zeros(len(a) + 1, dtype=bool)  # marks that end such a run after its letters
    two[1:-1] = head[:-1] & (k[:-1] == 1) & last[1:] & (k[1:] == 2) & ~head[1:]
    s = head | two[:-1]
    begin, end = [a[s]], [b[last | two[1:]]]
    if spaces:
        i = np.flatnonzero(~visible)
        x, y = a[i], b[i]  # runs of white space
        more = ~edge[y]  # a visible byte of the same text follows
        blank = more & (d[y - 1] == 32)
        led = np.zeros(len(a) + 1, dtype=bool)
        led[i[blank] + 1] = True
        begin[0] = begin[0] - led[:-1][s]
        stop = y - more
        long = stop > x
        own = more & ~blank
        begin += [x[long], y[own] - 1]
        end += [stop[long], y[own]]
    return _marked(begin, n), _marked(end, n)  # units neither overlap nor are empty, so both ascend alike


def _marked(parts: list[np.ndarray], n: int) -> np.ndarray:
    """Distinct places from 0 to ``n`` in ascending order."""
    mark = np.zeros(n + 1, dtype=bool)
    for p in parts:
        mark[p] = True
    return np.flatnonzero(mark)


def _sizes(got: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, got), np.int64, len(got)) // 4


def _in_order(places: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of parts in the order of their ``places``."""
    order = np.argsort(places)
    return _parts(ids, (np.cumsum(size) - size)[order], size[order]), size[order]


def _parts(ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of ``ids`` that begin ``at``, one after the other."""
    into = np.cumsum(size) - size
    return ids[np.repeat(at - into, size) + np.arange(int(size.sum()))]


class Units:
    """Bounded cache of units' ids: two hashes of a unit's bytes to a part of one flat array."""

    def __init__(self):
        self.code, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, dtype=bool)
        self.ids = np.zeros(0, "<u4")

    def find(self, d: np.ndarray, starts: np.ndarray, ends: np.ndarray, ask):
        """(entry of each unit, ids, where an entry's ids begin, how many there are)."""
        if not len(starts):
            return np.zeros(0, np.int64), self.ids, self.at, self.size
        code, check = _hashes(d, starts, ends)
        told = pa.array(code).dictionary_encode()
        code_u = told.dictionary.to_numpy()
        order = np.argsort(code_u)
        rank, one = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        inverse = rank[told.indices.to_numpy()]
        one[inverse] = np.arange(len(code))  # a place where each distinct unit stands
        code_u, check_u = code_u[order], check[one]
        if not np.array_equal(check_u[inverse], check):
            raise RuntimeError("two units of a block share a hash")
        place = np.searchsorted(self.code, code_u)
        held = place < len(self.code)
        held[held] = self.code[place[held]] == code_u[held]
        if not np.array_equal(self.check[place[held]], check_u[held]):
            raise RuntimeError("a unit shares a hash with one of the cache")
        self.again[place[held]] = True
        missing = np.flatnonzero(~held)
        entry = place
        if len(missing):
            raw = d.tobytes()
            flat, size = ask([raw[a:b] for a, b in zip(starts[one[missing]].tolist(), ends[one[missing]].tolist())])
            at = len(self.ids) + np.cumsum(size) - size
            before = place[missing]
            self.code, self.check = np.insert(self.code, before, code_u[missing]), np.insert(self.check, before, check_u[missing])
            self.at, self.size = np.insert(self.at, before, at), np.insert(self.size, before, size)
            self.again = np.insert(self.again, before, False)
            self.ids = np.concatenate([self.ids, flat])
            entry = np.searchsorted(self.code, code_u)
        found = entry[inverse], self.ids, self.at, self.size
        if len(missing) and (len(self.code) > CACHE_UNITS or len(self.ids) > 8 * CACHE_UNITS):
            stay = np.flatnonzero(self.again)
            self._keep(stay if len(stay) <= CACHE_UNITS // 2 else entry[(ends - starts)[one] <= CACHE_MAX_CHARS])
            self.again[:] = False
        elif len(missing) and int((ends - starts)[one[missing]].max()) > CACHE_MAX_CHARS:
            stay = np.ones(len(self.code), dtype=bool)
            stay[entry[(ends - starts)[one] > CACHE_MAX_CHARS]] = False
            self._keep(np.flatnonzero(stay))
        return found

    def _keep(self, entries: np.ndarray) -> None:
        """Only these entries stay."""
        size = self.size[entries]
        self.ids = _parts(self.ids, self.at[entries], size)
        self.code, self.check, self.again = self.code[entries], self.check[entries], self.again[entries]
        self.at, self.size = np.cumsum(size) - size, size


_BASE_CODE, _BASE_CHECK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes of a unit that are hashed eight at a time.
SHORT = 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hashes(d: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each byte range. Eight bytes are mixed in at a time; what is left
    of a range after the first ``SHORT`` bytes goes in as its polynomial hashes."""
    lens = ends - starts
    padded = np.zeros(len(d) + 8, np.uint8)
    padded[:len(d)] = d
    eight = np.ndarray(len(d) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    n = lens.astype(np.uint64)
    code, check = n * np.uint64(_BASE_CODE), n * np.uint64(_BASE_CHECK)
    rows, left, at = None, lens, starts
    for k in range(SHORT // 8):
        if k:
            more = np.flatnonzero(left > 8)
            if not len(more):
                return code, check
            rows = more if rows is None else rows[more]
            left, at = left[more] - 8, at[more] + 8
        word = eight[at] & _MASK[np.minimum(left, 8)]
        for h, base in ((code, _BASE_CODE), (check, _BASE_CHECK)):
            if rows is None:
                h[:] = mix((h ^ word) * np.uint64(base))
            else:
                h[rows] = mix((h[rows] ^ word) * np.uint64(base))
    rest = rows[left > 8]
    if len(rest):
        size = lens[rest] - SHORT
        into = np.cumsum(size) - size
        pos = np.arange(int(size.sum())) - np.repeat(into, size)
        chars = _BYTE_CODE[d[pos + np.repeat(starts[rest] + SHORT, size)]]
        for h, base in ((code, _BASE_CODE), (check, _BASE_CHECK)):
            h[rest] = mix(h[rest] ^ mix(np.add.reduceat(chars * powers(base, int(size.max()))[pos], into)))
    return code, check


def give_back() -> None:
    """Return memory that this worker's libraries hold for later to the system."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def loaded(tokenizer_json: str, kind: str) -> LibraryTokens:
    """One tokenizer and cache for each worker process."""
    held, key = worker_state("tokens"), (hash(tokenizer_json), kind)
    if key not in held:
        held.clear()
        held[key] = LibraryTokens(tokenizer_json, kind)
    return held[key]


assert sys.byteorder == "little" and array("I").itemsize == 4


def unload() -> None:
    """Free this worker's tokenizer and cache (they are built again when asked for)."""
    worker_state("tokens").clear()


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
