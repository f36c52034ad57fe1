"""Ids joined from units and segments against whole-text ids of the library."""

import random
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logweave.llm import library_tokens
from logweave.llm.bpe import Codec
from logweave.llm.library_tokens import LibraryTokens, read_vocabulary

FILES = {"words": "word_bpe_49k.json", "bytes": "byte_bpe_50k.json"}


@pytest.fixture(scope="module", params=sorted(FILES))
def tok(request):
    return LibraryTokens(read_vocabulary(public_tokenizers.path(FILES[request.param])), request.param)


def texts(pieces, n, seed, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def same(tok, some):
    want = [e.ids for e in tok.tok.encode_batch_fast(some, add_special_tokens=False)]
    data = [s.encode() for s in some]
    offs = np.cumsum([0, *map(len, data)])
    ids, at = tok.encode_texts(np.frombuffer(b"".join(data), np.uint8), offs)
    assert len(at) == len(some) + 1 and at[-1] == len(ids)
    for k, (s, w) in enumerate(zip(some, want)):
        assert ids[at[k]:at[k + 1]].tolist() == w, repr(s)
        assert np.frombuffer(tok.encode([s.encode()])[0], "<u4").tolist() == w, repr(s)


PLAIN = ["a", "Word", "the", "été", "ÉTÉ", "ß", "ÿ", "don't", "'s", "'S", "12", "3", ".", ",", "!?", "-", "$", "|", "<", ">", "_", "@", "\x00", "\x1c",
         " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\v", "\f", "x" * 60]
OTHER = ["日本", "İ", "×", "÷", "\xa0", "\x85", " ", "́", "🙂", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "Σας", "ǅ", "½", "​", "　"]


def test_plain_texts(tok):
    same(tok, texts(PLAIN, 3000, 1))


def test_other_texts_among_plain_ones(tok):
    same(tok, texts(PLAIN + OTHER, 4000, 2))


def test_white_space_on_both_sides_of_added_tokens(tok):
    blank = ["", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", " ", "\xa0\n"]
    same(tok, [f"{a}{x}{mark}{y}{b}" for mark in tok.added for x in blank for y in blank for a in ("", "a", "é.") for b in ("", "b", "<|")])


def test_small_blocks_caches_and_cuts_of_long_texts(tok, monkeypatch):
    monkeypatch.setattr(library_tokens, "BLOCK_TEXT", 40)
    monkeypatch.setattr(library_tokens, "CACHE_UNITS", 25)
    monkeypatch.setattr(library_tokens, "CACHE_MAX_CHARS", 5)
    monkeypatch.setattr(tok, "units", library_tokens.Units())
    same(tok, texts(PLAIN + OTHER[:6], 500, 3, 80))
    assert len(tok.units.code) <= 60
    monkeypatch.setattr(library_tokens, "CACHE_UNITS", 100_000)
    long = "".join(chr(97 + i % 26) for i in range(3000))
    same(tok, [long, long + " b  c", "", None or "x", *texts(PLAIN, 200, 4, 60)])
    assert int(tok.units.size.sum()) == len(tok.units.ids) and len(tok.units.ids) < 4000


def test_letters_reach_the_library_many_at_a_time(tok, monkeypatch):
    """Of 30 000 new words, none is asked for alone."""
    words = [f"{'Abé'[i % 3]}{'stuvwxyzöü'[i // 3 % 10]}" + "".join("klmnopqrst"[int(c)] for c in str(i)) for i in range(30_000)]
    calls = []
    monkeypatch.setattr(tok, "units", library_tokens.Units())
    monkeypatch.setattr(tok, "_split", lambda s: calls.append(s))
    data = " ".join(words).encode()
    ids, at = tok.encode_texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert not calls and ids.tolist() == tok.tok.encode(data.decode(), add_special_tokens=False).ids


def test_marks_after_letters_are_units_of_their_own(tok, monkeypatch):
    """So a word is asked for once, whatever marks stand after it."""
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    same(tok, [f"{lead}{word}{m}{n}{tail}" for word in ("ab", "É") for lead in ("", " ", "\n", "(") for m in marks for n in ("", *marks)
               for tail in ("", " c", "s d")])
    monkeypatch.setattr(tok, "units", library_tokens.Units())
    data = " ".join(f"{w}{m}" for w in ("one", "two", "three") for m in marks if m != "'").encode()
    tok.encode_texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(tok.units.code) <= 4 + len(marks)  # the words, "one" without a blank too, and the marks alone


def test_hashes_tell_units_apart_by_content_and_length():
    rng = np.random.default_rng(8)
    lens = [*range(1, 70), 200, 3000]
    parts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in lens] + [b"\0" * n for n in lens]
    for p in [p for p in parts if len(p) in (1, 8, 9, 16, 17, 32, 33, 40, 41, 64, 3000)]:  # one byte differs
        parts += [p[:k] + bytes([p[k] ^ 1]) + p[k + 1:] for k in {0, len(p) // 2, len(p) - 1}]
    parts = sorted(set(parts))
    two = [*parts, *reversed(parts)]
    ends = np.cumsum([len(p) for p in two])
    starts = ends - [len(p) for p in two]
    for h in library_tokens._hashes(np.frombuffer(b"".join(two), np.uint8), starts, ends):
        assert np.array_equal(h[:len(parts)], h[len(parts):][::-1]) and len(np.unique(h)) == len(parts)
    assert len(np.unique(library_tokens._hashes(np.frombuffer(b"abab", np.uint8), np.array([0, 2]), np.array([2, 4]))[0])) == 1


def test_letters_that_a_vocabulary_lacks():
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel
    some = Tokenizer(BPE({"a": 0, "b": 1, "Ġ": 2, "ab": 3, "Ġab": 4}, [("a", "b"), ("Ġ", "ab")]))
    some.pre_tokenizer = ByteLevel(add_prefix_space=False)
    same(LibraryTokens(some.to_str(), "bytes"), ["ab zab abz ba", "z", "", "zz ab", "é ab"])


def test_a_worker_keeps_its_tokenizer_from_task_to_task():
    """Each task unpickles the package's functions anew, with globals of their own."""
    from pyspark import cloudpickle

    from logweave.llm import bpe
    spec = read_vocabulary(public_tokenizers.path(FILES["bytes"]))
    loaded, again, unload = (cloudpickle.loads(cloudpickle.dumps(f)) for f in (library_tokens.loaded, library_tokens.loaded, library_tokens.unload))
    first = loaded(spec, "bytes")
    assert again(spec, "bytes") is first
    unload()
    assert again(spec, "bytes") is not first
    unload()
    codec, again = (cloudpickle.loads(cloudpickle.dumps(bpe.codec)) for _ in range(2))
    assert codec(spec) is again(spec)


def test_no_texts(tok):
    ids, at = tok.encode_texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    assert len(ids) == 0 and at.tolist() == [0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_code_point_between_a_letter_and_a_digit(name):
    """Letters, numbers and capitals of the library's Unicode version, not of Python's."""
    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        own = Codec(f.read())
    library = Tokenizer.from_file(path)
    for low in range(0x80, 0x40000, 1024):
        text = " ".join(f"a{chr(c)}1{chr(c)}b" for c in range(low, low + 1024) if not 0xD800 <= c <= 0xDFFF)
        ids = array("I")
        ids.frombytes(own.encode(text.encode()))
        assert list(ids) == library.encode(text, add_special_tokens=False).ids, hex(low)


def test_own_encoder_merges_a_unit_once_whatever_comes_between(monkeypatch):
    """120 000 other words between two uses of a word; plain and other texts, both vocabularies."""
    from logweave.llm import bpe
    words = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{i:x}".translate(str.maketrans("0123456789", "uvwxyzhgfe")) for i in range(120_000)]
    texts = [t.encode() for t in (" ".join(words[:60_000]), " ".join(words[60_000:]), " ".join(words[:100]), "", " It's\n\t<|endoftext|> Àé x× ?!. 12ab ")]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        calls, real = [], bpe.merge_symbols
        with open(path, encoding="utf-8") as f:
            own = Codec(f.read())
        monkeypatch.setattr(bpe, "merge_symbols", lambda *a: calls.append(1) or real(*a))
        ids, at = own.encode_texts(data, offs)
        monkeypatch.undo()
        assert len(calls) <= len(set(words)) + 40
        library = Tokenizer.from_file(path)
        for i in range(2, len(texts)):
            assert ids[at[i]:at[i + 1]].tolist() == library.encode(texts[i].decode(), add_special_tokens=False).ids


def test_packing_search_reads_only_sizes_that_make_place():
    import time

    from logweave.llm.packing import best_fit, improve
    rng = np.random.default_rng(5)
    for cap, n in ((100, 40), (100, 400), (1000, 900)):   # the search is whole: every piece once, no bin too full
        x = rng.integers(1, cap * 2 // 3, n).tolist()
        bins = improve(best_fit(x, cap), x, cap)
        assert sorted(i for b in bins for i in b) == list(range(n)) and max(sum(x[i] for i in b) for b in bins) <= cap
        assert len(bins) <= len(best_fit(x, cap))
    # three bins for sums that fit two: best fit alone does not find it
    x = [6, 5, 4, 3, 2]
    assert len(best_fit(x, 10)) == 2 and len(improve([[0], [1, 2], [3, 4]], x, 10)) == 2
    # three of these pieces are more than a bin holds, so no bin can be saved: all are tried in vain
    x = np.sort(rng.integers(14, 21, 3000) * 100 + rng.integers(0, 3, 3000)).tolist()
    start = time.process_time()
    bins = improve(best_fit(x, 4096), x, 4096)
    took = time.process_time() - start
    assert sorted(i for b in bins for i in b) == list(range(len(x))) and len(bins) == len(x) // 2
    assert took < 2.5, took   # 0.4 s; 6.0 s where each try read all bins
